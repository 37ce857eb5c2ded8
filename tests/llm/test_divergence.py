import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from attestry.llm import divergence
from attestry.llm.divergence import Divergence, count_terms, radix_order

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def test_radix_order_is_the_stable_order():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 3, 500).astype(np.uint64), rng.integers(0, 1 << 63, 500).astype(np.uint64) >> np.uint64(rng.integers(0, 60))]
    assert radix_order(words).tolist() == np.lexsort((words[1], words[0])).tolist()


def test_counts_of_every_length_bucket():
    rng = random.Random(4)
    terms = ["é" * n for n in range(1, 12)] + ["Ab" * n for n in range(1, 40)] + ["x" * 8, "x" * 9, "x" * 16, "x" * 17, "漢" * 3000, "Ünï"]
    texts = [" ".join(rng.choice(terms) for _ in range(rng.randrange(30))) + rng.choice(["", "1,2;", "\0", "É"]) for _ in range(60)] + ["", "   "]
    groups = sorted(rng.randrange(4) for _ in texts)
    n, docs = Counter(), Counter()
    for g, t in zip(groups, texts, strict=True):
        found = Counter(TERM.findall(t.translate(LOWER)))
        n += Counter({(g, w): c for w, c in found.items()})
        docs += Counter({(g, w): 1 for w in found})
    got_n, got_docs = {}, {}
    for words, group, count, held in count_terms([t.encode() for t in texts], groups):
        for w, g, c, d in zip(words, group.tolist(), count.tolist(), held.tolist(), strict=True):
            assert (g, w.decode()) not in got_n
            got_n[g, w.decode()], got_docs[g, w.decode()] = c, d
    assert got_n == dict(n) and got_docs == dict(docs)


def plain(rows, min_docs=3):
    rows = [tuple(v or "" for v in r) for r in rows]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = Counter(TERM.findall(text.translate(LOWER)))
        counts[lang, source] += found
        docs[lang] += Counter(dict.fromkeys(found, 1))
    out = set()
    for lang in {k[0] for k in counts}:
        kept = [t for t, d in docs[lang].items() if d >= min_docs]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        every = sum(groups.values(), Counter())

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        q_lang, shares = share(every), {s: share(c) for s, c in groups.items()}
        for s, p in shares.items():
            pairs = [(o, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)) for o, q in shares.items() if o != s]
            terms = [(t, (p[t] - q_lang[t]) ** 2 // q_lang[t]) for t in kept if groups[s][t] and p[t] > q_lang[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 200)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:most])}
    return out


def found(df):
    d = Divergence.of(df)
    return {(r["lang"], r["source"], part, r["item"], r["value"], r["rank"]) for part, x in (("pair", d.pairs()), ("term", d.terms())) for r in x.collect()}


@pytest.mark.parametrize("rows,sources", [(1 << 18, 128), (40, 3)])
def test_equals_plain_definition(spark, monkeypatch, rows, sources):
    monkeypatch.setattr(divergence, "BLOCK_ROWS", rows)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", sources)
    rng = random.Random(7)
    words = ["a", "Bb", "ça", "internationalisation", "e" * 40, "the", "Of", "nine9nine", "Zz", "q"]
    docs = [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "", None, "ß", "s4", "s5"]), " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for _ in range(150)]
    docs += [("de", "only", "ein ein ein"), ("de", "other", None), ("es", "alone", "uno"), ("fr", "silent", "12 34"), ("en", "s1", "the " * 300_000)]
    docs += [("en", "s2", "copy of copy")] * 40
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    assert found(df) == plain(docs)
    assert found(df.selectExpr("*", "1 as n", "2 as term", "3 as rank")) == plain(docs)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "lang string, source string, text string")) == set()
