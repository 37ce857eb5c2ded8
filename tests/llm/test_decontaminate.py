import random
import time

import numpy as np

from attestry.llm.decontaminate import GAP, MATCH, MIN_SCORE, MISMATCH, _Items, align, leaks, word_hashes, words


def slow_score(a, b):
    row = [0] * (len(b) + 1)
    best = 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (MATCH if x == y else MISMATCH), row[j + 1] + GAP, new[j] + GAP))
        row = new
        best = max(best, *row)
    return best


def sample(rng, n, vocabulary=400):
    return [f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n)]


def test_alignment_matches_the_recurrence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = sample(rng, rng.randrange(1, 12), 6), sample(rng, rng.randrange(1, 30), 6)
        a, b = ([w.encode() for w in x] for x in (a, b))
        codes = {w: i for i, w in enumerate(dict.fromkeys(a))}
        s, first, end = align(*(np.array([codes.get(w, -1) for w in x]) for x in (a, b)))
        assert s == slow_score(a, b)
        assert not s or slow_score(a, b[first:end]) == s


def test_leaks_match_brute_force_in_one_group_and_in_several(spark):
    rng = random.Random(8)
    items = [(i, " ".join(sample(rng, rng.randrange(20, 40)))) for i in range(12)] + [(50, None), (51, ""), (52, "lone"), (53, "Two words")]
    docs, planted = [], set()
    for i in range(120):
        body = sample(rng, rng.randrange(0, 150), 4000)
        if i % 3 == 0:
            k = rng.randrange(12)
            copy = items[k][1].split()
            planted.add((i, k))
            for _ in range(rng.randrange(3)):  # leaves a run that holds a seed
                copy[rng.randrange(len(copy))] = "edited"
            at = rng.randrange(len(body) + 1)
            body[at:at] = [w.upper() + "," for w in copy]
        docs.append((i, " ".join(body)))
    docs += [(900, None), (901, ""), (902, "a lone word"), (903, "TWO, words."), (903, "TWO, words.")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, text in docs:
        for k, item in items:
            w = words(item)
            if w and slow_score(w, words(text)) >= MIN_SCORE * MATCH * len(w):
                want[i, k] = slow_score(w, words(text)) / (MATCH * len(w))
    for limits in ({}, {"group_words": 100}):
        got = {(r.id, r.item): r.score for r in leaks(d, b, **limits).collect()}
        # Exact scores, and nothing missed that keeps a run of words in one piece.
        assert all(want[k] == s for k, s in got.items()) and planted <= set(got)
    assert leaks(d.limit(0), b).count() == 0 and leaks(d, b.limit(0)).count() == 0


def edited(rng, item, every):
    """The item with a word replaced, dropped or added at every ``every``-th place."""
    out = []
    for i, w in enumerate(item):
        how = rng.randrange(3) if i % every == every - 1 else None
        out += {None: [w], 0: [f"new{rng.randrange(10**6)}"], 1: [], 2: [w, f"new{rng.randrange(10**6)}"]}[how]
    return out


def test_every_pair_at_the_score_is_found_however_edits_lie(spark):
    rng = random.Random(15)
    items = [(i, sample(rng, rng.randrange(1, 50), 900)) for i in range(14)]
    docs = [(0, " ".join(items[0][1]))]
    for i in range(1, 160):
        k, every = rng.randrange(14), rng.choice([1, 2, 3, 4, 5, 6])
        copy = edited(rng, items[k][1], every)
        if i % 5 == 0:  # every fifth word replaced, as in a paraphrase
            copy = [f"new{j}" if j % 5 == 2 else w for j, w in enumerate(items[k][1])]
        if i % 5 == 1:  # a word after every two words leaves no run of three
            copy = [x for j, w in enumerate(items[k][1]) for x in ([w, f"new{j}"] if j % 2 else [w])]
        body = sample(rng, rng.choice([0, 40, 300, 1500]), 4000)
        at = rng.randrange(len(body) + 1)
        docs.append((i, " ".join(body[:at] + copy + body[at:])))
    want = {}
    for i, text in docs:
        for k, item in items:
            w = [x.encode() for x in item]
            s = slow_score(w, words(text))
            if s >= MIN_SCORE * MATCH * len(w):
                want[i, k] = s / (MATCH * len(w))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string")
    for limits in ({}, {"group_words": 100}):
        assert {(r.id, r.item): r.score for r in leaks(d, b, **limits).collect()} == want


def test_search_grows_slowly_with_the_benchmark():
    """Passages meet items through their seeds only: 16 times the items are far from 16 times the work."""
    share = 1 / np.arange(1, 20_001)  # words by rank, as in prose
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{w}" for w in rng.choice(20_000, n, p=share / share.sum()))
    texts, benchmark = [text(1000) for _ in range(60)], [text(40) for _ in range(3200)]

    def seconds(n):
        items = _Items(benchmark[:n], MIN_SCORE)
        codes = [items.known(word_hashes(words(t))) for t in texts]
        df = np.zeros(len(items.vocabulary) + len(items.pairs), np.int64)
        for c in codes:
            df[items.features(c)[0]] += 1
        items.index_seeds(df)
        start = time.process_time()
        for c in codes:
            list(items.candidates(c))
        return time.process_time() - start

    seconds(200)
    few, many = seconds(200), seconds(3200)
    print(few, many)
    assert many < 4 * few


def test_alignment_takes_plain_words_as_well_as_codes():
    import numpy as np

    from attestry.llm.decontaminate import align

    item, passage = b"a b c d".split(), b"x a b d y".split()
    codes = {w: i for i, w in enumerate(dict.fromkeys(item + passage))}
    as_codes = [np.array([codes[w] for w in x]) for x in (item, passage)]
    assert align(item, passage) == align(*as_codes) == (5, 1, 4)
