"""Brute force and edge rows for quality rules, language machines, url filters and fixity."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import fixity, langid, quality, urls

SPACE = r"[\x20\x09-\x0D]+"


def slow_quality(rows, min_docs):
    """(kept, lines removed) by row, from the plain definition."""
    norm = lambda line: re.sub("[0-9]+", "0", " ".join(w for w in re.split(SPACE, line) if w).translate({c: c + 32 for c in range(65, 91)}))
    whole, hosts = defaultdict(set), Counter()
    for text, host in rows:
        lines = [norm(x) for x in (text or "").split("\n") if norm(x)]
        hosts[host] += 1
        for line in lines:
            whole[host, line].add("\n".join(lines))
    out = []
    for text, host in rows:
        words = [w for w in re.split(SPACE, text or "") if w]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        many = Counter(grams)
        repeat = len({i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)})
        lines = [x for x in (text or "").split("\n") if norm(x)]
        gone = [len(whole[host, norm(x)]) > max(min_docs, quality.LINE_SHARE * hosts[host]) for x in lines]
        left = sum(len([w for w in re.split(SPACE, x) if w]) for x, g in zip(lines, gone) if not g)
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        depleted = left < len(words) and (left < 20 or 100 * left < 30 * len(words))
        out.append((not failed and not depleted, sum(gone)))
    return out


@pytest.mark.parametrize("broadcast_lines", [1000, 0])
def test_quality_rules_match_the_plain_definition(spark, broadcast_lines):
    rng = random.Random(1)
    line = lambda k: " ".join(f"w{rng.randrange(4000)}" for _ in range(k))
    shared = [line(12) for _ in range(6)]
    texts = ["\n".join([*rng.sample(shared, rng.randrange(5)), *[line(rng.randrange(1, 30)) for _ in range(rng.randrange(5))]]) for _ in range(90)]
    rows = [(t, rng.choice(["a", "b", None])) for t in texts] + [(None, "a"), ("", "a"), ("\n \t\n", None), ("word " * 40_000, "b")] + [(texts[0], "a")] * 9
    df = spark.createDataFrame([(i, t, h, "x", 7) for i, (t, h) in enumerate(rows)], "doc_id long, text string, source string, kept string, lines int")
    got = {r.doc_id: (r.kept, r.n_lines_removed) for r in quality.quality_rules(df, min_docs=5, broadcast_lines=broadcast_lines).collect()}
    assert [got[i] for i in range(len(rows))] == slow_quality(rows, 5)
    assert quality.quality_rules(df.limit(0), broadcast_lines=broadcast_lines).count() == 0


def test_machines_vote_as_one_by_one():
    rng = np.random.default_rng(3)
    names = ["a", "b", "c", "d"]
    pairs = {(x, y): (rng.normal(size=5), float(rng.normal())) for i, x in enumerate(names) for y in names[i + 1 :]}
    x = rng.normal(size=(200, 5))
    best, sure = langid.Machines(names, pairs).predict(x)
    for row, got, confidence in zip(x, best, sure):
        votes, soft = Counter(), {}
        for (a, b), (w, c) in pairs.items():
            m = float(row @ w + c)
            soft[a, b] = 1 / (1 + math.exp(-2 * m))
            votes[b if m > 0 else a] += 1
        top = [n for n in names if votes[n] == max(votes.values())]
        assert names[got] in top
        own = [s if b == names[got] else 1 - s for (a, b), s in soft.items() if names[got] in (a, b)]
        assert confidence == pytest.approx(min(own))


def test_a_text_that_repeats_does_not_push_its_language_out(spark):
    rng = random.Random(4)
    german, french = "der und die das nicht ein haus straße".split(), "le la les des est une maison rue".split()
    text = lambda words: " ".join(rng.choice(words) for _ in range(12))
    rows = [("de", "der hund und die katze")] * 3000 + [("de", text(german)) for _ in range(20)] + [("fr", text(french)) for _ in range(200)]
    df = spark.createDataFrame(rows, "lang string, text string")
    models = langid.train(df, sample=30)
    test = spark.createDataFrame([(i, text(german), "z") for i in range(20)] + [(100 + i, text(french), "z") for i in range(20)], "doc_id long, text string, lang_pred string")
    got = {r.id: r.lang_pred for r in langid.predict_language(test.union(test), models).collect()}
    assert all(v == ("de" if k < 100 else "fr") for k, v in got.items()) and len(got) == 40


def slow_urls(known):
    """Weights of grams by plain counting."""
    counts = defaultdict(lambda: [0, 0])
    for url, accepted in known.items():
        if int(hashlib.md5(url.encode()).hexdigest()[:8], 16) % 5:
            padded = "\x02" * 3 + url
            for i in range(len(url)):
                for k in range(1, 5):
                    counts[padded[i + 4 - k : i + 4]][not accepted] += 1
    counts = {g: c for g, c in counts.items() if sum(c) >= urls.MIN_COUNT}
    totals = defaultdict(lambda: [0, 0])
    for g, c in counts.items():
        totals[len(g), g[:-1]][0] += c[0]
        totals[len(g), g[:-1]][1] += c[1]
    p, weights = {}, {}
    for g in sorted(counts, key=len):
        low = p[g[1:]] if len(g) > 1 else (1 / urls.ALPHABET,) * 2
        t = totals[len(g), g[:-1]]
        p[g] = tuple((counts[g][i] + urls.SMOOTHING * low[i]) / (t[i] + urls.SMOOTHING) for i in (0, 1))
        weights[g] = math.log(p[g][0] / p[g][1]) - math.log(low[0] / low[1])
    return weights


@pytest.mark.parametrize("broadcast_grams", [10_000, 0])
def test_url_scores_match_plain_counting(spark, monkeypatch, broadcast_grams):
    monkeypatch.setattr(urls, "BROADCAST_GRAMS", broadcast_grams)
    rng = random.Random(5)
    made = [f"https://{rng.choice(['a', 'b', 'Shop'])}.{rng.choice(['org', 'com', 'net', 'example.org'])}/{rng.choice(['fr', 'de', 'es', 'en'])}/{rng.randrange(300)}" for _ in range(250)]
    made += [None, "", "no scheme", "x://", "://", "https://ORG", "https://org/?q", "https://b.org#frag/x", "https://é.net/ü", "https://example.org/en/1", made[0], made[0]]
    df = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(made)], "page_id long, url string, verdict string, accepted int")
    rows = {r.page_id: r for r in urls.filter_urls(df).collect()}
    assert len(rows) == len(made)
    known = {made[i]: r.verdict == "allow" for i, r in rows.items() if r.rule}
    weights = slow_urls(known)
    for i, r in rows.items():
        url = made[i] or ""
        if url:
            padded = "\x02" * 3 + url
            score = sum(weights.get(padded[j + 4 - k : j + 4], 0.0) for j in range(len(url)) for k in range(1, 5)) / len(url)
            assert r.score == pytest.approx(score, abs=2e-6)
    by = {made[i]: r for i, r in rows.items()}
    assert (by[None].host, by[None].path, by[None].verdict, by[""].verdict) == ("", "", "block", "block")
    assert by["no scheme"].host == "" and by["https://ORG"].host == "org" and by["https://ORG"].rule is None
    assert by["https://org/?q"].rule == "org/" and by["https://b.org#frag/x"].path == "" and by["https://b.org#frag/x"].rule is None
    assert (by["https://example.org/en/1"].rule, by["https://example.org/en/1"].verdict) == ("example.org/en/1", "block")
    assert urls.filter_urls(df.limit(0)).count() == 0


def slow_tree(leaves, range_bytes, fanout):
    """Hash of each node by level: of the ordered hashes below it."""
    node = defaultdict(list)
    for file, offset, h in leaves:
        node[file, offset // range_bytes].append((offset, h))
    level = {k: hashlib.sha256("".join(h for _, h in sorted(v)).encode()).hexdigest() for k, v in node.items()}
    out = [level]
    while any(n for _, n in level):
        up = defaultdict(list)
        for (file, n), h in level.items():
            up[file, n // fanout].append((n, h))
        level = {k: hashlib.sha256("".join(h for _, h in sorted(v)).encode()).hexdigest() for k, v in up.items()}
        out.append(level)
    return out


def test_trees_and_audit_match_plain_hashing(spark):
    rng = random.Random(6)
    rows = [(f, k * 40 + rng.randrange(20), f"record {f} {k} " + "x" * rng.randrange(50)) for f, n in ((0, 60), (1, 3), (2, 1)) for k in range(n)]
    rows += [(1, 500, "twin a"), (1, 500, "twin b"), (1, 500, "twin b")]
    other = [(f, o, r + "!" if i % 17 == 3 else r) for i, (f, o, r) in enumerate(rows) if i % 23 != 5] + [(2, 9000, "new"), (7, 0, "new file")]
    frame = lambda x: fixity.leaves(spark.createDataFrame([(f, o, len(r), i, r, "z") for i, (f, o, r) in enumerate(x)], "file int, offset long, length long, id long, record string, node string"))
    a, b = frame(rows), frame(other)
    levels = fixity.tree(a, 100, 4)
    want = slow_tree([(r.file, r.offset, r.hash) for r in a.collect()], 100, 4)
    assert [{(r.file, r.node): r.hash for r in level.collect()} for level in levels] == want
    got = Counter((r.file, r.offset, r.status) for r in fixity.audit(a, b, 100, 4).collect())
    has, now = defaultdict(set), defaultdict(set)
    for f, o, r in rows:
        has[f, o].add(r)
    for f, o, r in other:
        now[f, o].add(r)
    slow = Counter()
    for f, o, r in rows:
        if r not in now[f, o]:
            slow[f, o, "changed" if now[f, o] - has[f, o] else "missing"] += 1
    for f, o, r in other:
        if r not in has[f, o] and not has[f, o] - now[f, o]:
            slow[f, o, "extra"] += 1
    assert got == slow and len(got) > 5
    assert fixity.audit(a, a, 100, 4).count() == 0 and fixity.audit(a.limit(0), a.limit(0), 100, 4).count() == 0
    assert {r.status for r in fixity.audit(a.limit(0), b, 100, 4).collect()} == {"extra"}


def test_warc_records_stand_gapless_with_null_and_repeated_rows(spark):
    rows = [(1, "https://a", "body", 1), (1, "https://a", "body", 2), (2, None, None, 3), (None, "https://é", "ü" * 5000, 4), (3, "", "", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, offset int")
    found = sorted((r.file, r.offset, r.length, len(r.record.encode())) for r in fixity.warc_records(df, file_bytes=4000).collect())
    at = defaultdict(int)
    for file, offset, length, size in found:
        assert offset == at[file] and length == size
        at[file] += length
    assert len(found) == 5 and fixity.warc_records(df.limit(0)).count() == 0
    damaged = fixity.damaged_copy(fixity.warc_records(df.withColumn("page_id", F.col("page_id"))))
    assert damaged.count() <= 5
