import random

from corpus_pipeline import decontamination_stage, near_duplicate_stage


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_kept(docs):
    """Ids that are the least of their component under similarity 0.8."""
    sets = [shingles(t) for _, t in docs]
    part = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            alike = both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)
            if alike and part[i] != part[j]:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    least = {}
    for (i, _), p in zip(docs, part, strict=True):
        least[p] = min(i, least.get(p, i))
    return sorted(least.values())


def test_near_duplicate_stage_matches_brute_force(spark):
    rng = random.Random(21)
    texts = [[f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 160))] for _ in range(60)]
    passage = [f"p{i}" for i in range(30)]
    for t in texts[:20]:
        t[:0] = passage
    for _ in range(120):  # chains of edits as well
        copy = list(rng.choice(texts))
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        texts.append(copy)
    docs = list(enumerate([" ".join(t) for t in texts] + [None, "", "One  TWO", "one two"]))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_duplicate_stage(spark, df, "").collect()) == slow_kept(docs)


def test_stages_decide_by_row_where_ids_are_null_or_repeat(spark, tmp_path):
    rng = random.Random(22)
    new = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(60))
    item = new()
    a, b, c, d, e = (new() for _ in range(5))
    docs = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, d), (1, e), (3, e), (None, e), (4, None), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in near_duplicate_stage(spark, df, "").collect()), key=str)
    assert got == sorted([(None, a), (None, b), (1, c), (1, d), (1, e), (4, None)], key=str)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = f"{a} {item} {b}"
    docs = [(None, leak), (None, a), (5, leak), (5, b), (6, c), (7, None), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in decontamination_stage(spark, df, str(tmp_path)).collect()), key=str)
    assert got == sorted([x for x in docs if x[1] != leak], key=str)


def test_every_stage_matches_plain_definitions_on_the_documents(spark):
    """Ids that each stage keeps on sf0.001, against brute force over whole texts."""
    import re
    from collections import defaultdict

    from test_edges import slow_quality

    import corpus_pipeline
    from attestry.llm.decontaminate import MATCH, align, needed, words
    from attestry.llm.tokens import WordTokens, tokenizer_path

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "simhash_near_duplicates", "benchmark_decontamination", "personal_data", "best_fit_packing"]

    rows = docs.collect()
    judged = slow_quality([(r.text, r.source) for r in rows], 20)
    kept = corpus_pipeline.saved(stages["quality_rules"](spark, docs, sf))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r, (ok, _) in zip(rows, judged) if ok)

    texts = [(r.doc_id, r.text) for r in kept.collect()]
    unique = corpus_pipeline.saved(stages["simhash_near_duplicates"](spark, kept, sf))
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == slow_kept(texts)

    def leaks_item(text):
        own = words(text)
        return any(w and own and align(w, own)[0] >= needed(len(w), 0.5) for w in items)

    clean = corpus_pipeline.saved(stages["benchmark_decontamination"](spark, unique, sf))
    assert MATCH == 2 and clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in unique.collect() if not leaks_item(r.text))

    masked = corpus_pipeline.saved(stages["personal_data"](spark, clean, sf))
    before = {r.doc_id: r.text for r in clean.collect()}
    after = {r.doc_id: r.text for r in masked.collect()}
    assert masked.columns == docs.columns and set(after) == set(before)
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+|\+1 \(\d{3}\) 555-\d{4}")
    assert not any(plain.search(t) for t in after.values())
    assert all(after[i] == t or re.search(r"\[(EMAIL|IP|CARD|PHONE|SECRET)\]", after[i]) for i, t in before.items())

    own, held = WordTokens.of(tokenizer_path()), defaultdict(list)
    packed = stages["best_fit_packing"](spark, masked, sf).collect()
    for r in packed:
        held[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 2048 and sorted(x)[0][0] == 0 for x in held.values())
    sizes = defaultdict(int)
    for r in packed:
        sizes[r.doc_id] += r.length
    assert dict(sizes) == {i: len(own.encode(t or "")) // 4 + 1 for i, t in after.items()}


def test_stages_on_null_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, key string, cls int"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, None, None, None, None, "k", 1), (1, "", None, None, 0, None, None), (2, long, "en", None, len(long), "k", 2), (2, long, "en", None, len(long), "k", 2)]
    for data, left in ((rows, 1), ([], 0)):
        docs = spark.createDataFrame(data, kind)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.saved(stage(spark, docs, str(tmp_path)))
            assert docs.columns == [x.split()[0] for x in kind.split(", ")], name
        assert docs.count() == left
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert all(r.length == 2048 for r in pieces if r.piece < len(pieces) - 1) and (len(pieces) > 15) == bool(left)


def test_bit_maps_and_range_counts_leave_out_no_pair_at_the_limit():
    import numpy as np

    from attestry.llm.neardup import bit_map, most_shared, possible_pairs, range_counts, similarity

    rng = np.random.default_rng(9)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, rng.choice([0, 1, 3, 30, 60, 250, 600]), dtype=np.uint64)
        for _ in range(3):
            own = base.copy()
            own[rng.random(len(own)) < rng.choice([0, 0.05, 0.1, 0.3])] += np.uint64(1 << 40)
            sets.append(np.unique(own))
    n, maps = np.array([len(x) for x in sets]), [bit_map(x).tobytes() for x in sets]
    found = {tuple(sorted(p)) for i, j in possible_pairs(n, maps, 0.8) for p in zip(i.tolist(), j.tolist())}
    every = [(i, j) for j in range(len(sets)) for i in range(j)]
    near = {(i, j) for i, j in every if similarity(sets[i], sets[j]) >= 0.8}
    assert near <= found and len(found) < 0.2 * len(every)
    for i, j in every:
        both = len(np.intersect1d(sets[i], sets[j]))
        assert most_shared(range_counts(sets[i]), range_counts(sets[j])) >= both


def test_near_copies_send_few_rows_to_python_at_once(spark, monkeypatch):
    from attestry.llm import neardup

    key, used, saved = "spark.sql.execution.arrow.maxRecordsPerBatch", [], neardup.saved
    monkeypatch.setattr(neardup, "saved", lambda df: used.append(spark.conf.get(key)) or saved(df))
    before = spark.conf.get(key)
    df = spark.createDataFrame([(i, f"a b c d e f {i % 3}") for i in range(9)], "key long, text string")
    assert len({r.component for r in neardup.near_copies(df).collect()}) == 3
    assert used and set(used) == {str(neardup.BATCH)} and spark.conf.get(key) == before
