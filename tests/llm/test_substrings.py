import hashlib
import random
from collections import Counter

from attestry.llm.substrings import LENGTH, doubled_positions, op7_suffix_dedup, remove_repeats


def slow(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        left = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def random_text(rng, n):
    return "".join(rng.choice("abcdé \n") for _ in range(n))


def test_matches_brute_force(spark):
    rng = random.Random(3)
    base = [random_text(rng, rng.randrange(30, 900)) for _ in range(12)]
    passages = [random_text(rng, n) for n in (39, 40, 41, 60, 130)]
    texts = list(base)
    for b in base:
        for _ in range(3):
            t = b
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(t) + 1)
                t = t[:i] + rng.choice(["x", "", "yy"]) + t[i + rng.randrange(2) :]
            i = rng.randrange(len(t) + 1)
            texts.append(t[:i] + rng.choice(passages) + t[i:])
    texts += [None, "", "a" * 39, "b" * 40, "c" * 41, "ab" * 60, passages[4] * 3, passages[1], passages[1][1:] + "z", "short"]
    rows = [(i, t, "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, length=40, split=4).collect()}
    want = slow(texts, 40)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 1000


def test_repeated_rows_and_empty_table(spark):
    text = "abcdefghij" * 5 + "0123456789"
    df = spark.createDataFrame([(1, text), (1, text), (None, "x"), (None, None)], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(df, length=40).collect())
    assert got == [(0, 0, 0), (1, 0, 0), (60, 60, 1), (60, 60, 1)]
    assert remove_repeats(df.limit(0)).count() == 0


def test_prefix_doubling_finds_the_same_strings(spark):
    rng = random.Random(4)
    texts = [random_text(rng, rng.randrange(200)) for _ in range(20)]
    texts += [texts[0], texts[1][:70] + "x" + texts[2], None, "", "ab" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 40] for d in data for i in range(len(d) - 39))
    want = sorted((k, i) for k, d in enumerate(data) for i in range(len(d) - 39) if seen[d[i : i + 40]] > 1)
    assert sorted((r.doc, r.p) for r in doubled_positions(df, 40).collect()) == want


def test_one_string_in_many_documents_is_dealt_to_several_tasks(spark):
    shared = "0123456789abcdef" * 4
    texts = [f"{i}-{shared}-{i}" if i % 2 else f"{i} alone" for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, length=40).collect()}
    assert [got[i] for i in range(3000)] == slow(texts, 40)


def test_planted_passages_go_from_400_bytes_on(spark, tmp_path):
    rng = random.Random(5)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 9))) for _ in range(n))

    passages = [prose(n) for n in (51, 55, 60, 70, 80, 90)]
    long = [len(p.encode()) >= LENGTH for p in passages]
    assert any(long) and not all(long)
    texts = [prose(rng.randrange(20, 200)) for _ in range(40)]
    planted = [k % 6 if k < 24 else None for k in range(40)]
    texts = [t if k is None else f"{t}# {passages[k]} #{prose(20)}" for t, k in zip(texts, planted, strict=True)]
    df = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op7_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(40)] == slow(texts, LENGTH)
    assert [got[i][1] > 0 for i in range(40)] == [k is not None and long[k] for k in planted]
    assert [got[i][0] for i in range(40)] == [len(t.encode()) for t in texts]
