import math
import random
import tempfile
from collections import Counter

import pytest

from attestry.operators import search
from attestry.operators.search import Postings

DOCS = "doc_id long, text string"


def plain(docs, queries, k, k1=1.2, b=0.75):
    counts = {i: Counter(search.TERM.findall((t or "").lower())) for i, t in docs}
    counts = {i: c for i, c in counts.items() if c}
    df = Counter(t for c in counts.values() for t in c)
    average = sum(c.total() for c in counts.values()) / max(len(counts), 1)
    out = []
    for q, text in queries:
        scores = {}
        for t in set(search.TERM.findall((text or "").lower())):
            idf = math.log(1 + (len(counts) - df[t] + 0.5) / (df[t] + 0.5))
            for i, c in counts.items():
                if c[t]:
                    scores[i] = scores.get(i, 0) + idf * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * c.total() / average))
        ranked = sorted((-round(s, 6), i) for i, s in scores.items())
        out += [(q, i, n + 1, -s) for n, (s, i) in enumerate(ranked[:k])]
    return sorted(out)


@pytest.mark.parametrize("docs_a_range,first", [(256, 4), (7, 1)])
def test_search_equals_plain_scores(spark, monkeypatch, docs_a_range, first):
    monkeypatch.setattr(search, "FIRST", first)
    rng = random.Random(3)
    word = lambda: f"w{int(rng.paretovariate(0.9))}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 40)))) for i in range(300)] + [(400, None), (401, ""), (402, "..."), (403, "Ünï ü_2")]
    docs += [(500 + i, "the same text again") for i in range(60)]
    queries = [(q, " ".join(word() for _ in range(6))) for q in range(8)] + [(20, "again THE"), (21, None), (22, "nowhere"), (23, "ü 2")]
    d, q = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(queries, "item long, text string")
    index = Postings.build(d, "doc_id", "text", docs_a_range)
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    index.write(path)
    for found in (index, Postings.open(spark, path)):
        got = found.search(q, "item", "doc_id", "text", 10).select("item", "doc_id", "rank", "score").collect()
        want = plain(docs, queries, 10)
        assert [tuple(r)[:3] for r in sorted(got)] == [w[:3] for w in want]
        assert all(abs(g["score"] - w[3]) < 2e-6 for g, w in zip(sorted(got), want, strict=True))


def test_ranges_below_the_bound_are_skipped(spark):
    """Documents of another language hold none of a query's terms and their ranges are never read."""
    docs = [(i, f"alpha beta gamma rare{i % 7}" if i < 100 else f"delta epsilon zeta other{i}") for i in range(1000)]
    df = spark.createDataFrame(docs, DOCS).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    index = Postings.build(df, "doc_id", "text", 20)
    assert index.blocks.filter("term = 'alpha'").count() == 5 and index.blocks.select("range").distinct().count() >= 50
    found = index.search(spark.createDataFrame([(1, "rare3 alpha")], "item long, text string"), "item", "doc_id", "text", 5)
    assert [r.doc_id for r in found.orderBy("rank").collect()] == [3, 10, 17, 24, 31]
    empty = Postings.build(spark.createDataFrame([], DOCS), "doc_id", "text")
    assert empty.rows("doc_id").count() == 0
