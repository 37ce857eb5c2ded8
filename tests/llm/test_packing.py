import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from attestry.llm.packing import _best_fit, best_fit_packing, pack_histogram
from attestry.llm.tokens import WordTokens, tokenizer_path


def test_ids_equal_the_tokenizer():
    rng = random.Random(6)
    own, plain = WordTokens(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    bits = ["It's", " we'LL", "ß", "É", "é", "日本", " ", "\n", "\xa0", "\x1c", "12", "½", "_", "--'s", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "Σ", "word", "!?"]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        assert own.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_histogram_is_packed_whole_and_close_to_the_bound():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 101, 3000), np.full(500, 33), np.array([100, 100, 1])):
        counts = np.bincount(lengths, minlength=101)
        seen = np.zeros(101, int)
        groups = pack_histogram(counts, 100)
        for config, n in groups:
            assert sum(config) <= 100
            for k in config:
                seen[k] += n
        assert (seen == counts).all()
        assert sum(n for _, n in groups) <= max(-(-int(lengths.sum()) // 100) * 1.03, len(lengths) / (100 // int(lengths.min())) + 1)


def _least(counts, capacity):
    """No packing needs fewer sequences: long pieces stand alone, what they leave holds no more than it can."""
    k, best = np.arange(capacity + 1), 0
    for a in range(capacity // 2 + 1):
        alone, long = counts[capacity - a + 1 :].sum(), slice(capacity // 2 + 1, capacity - a + 1)
        room = counts[long].sum() * capacity - (counts * k)[long].sum()
        short = (counts * k)[a : capacity // 2 + 1].sum()
        best = max(best, int(alone + counts[long].sum() + max(0, -(-(short - room) // capacity))))
    return best


def test_program_needs_fewer_sequences_than_best_fit_where_that_wastes_room():
    rng = np.random.default_rng(5)
    for lengths, over, share in ((rng.integers(1, 2048, 20000), 4, 1.0), (rng.integers(500, 1100, 20000), 1500, 0.98), (rng.integers(300, 700, 20000), 60, 0.97)):
        counts = np.bincount(lengths, minlength=2049)
        used = sum(n for _, n in pack_histogram(counts))
        assert used <= _least(counts, 2048) + over
        assert used <= share * sum(_best_fit(counts.astype(np.int64), 2048, {}).values())


def test_pieces_fill_their_sequences_without_gaps(spark):
    rng = random.Random(7)
    texts = [" ".join("word" for _ in range(rng.choice([0, 1, 3, 10, 31, 32, 70]))) for _ in range(150)] + [None]
    df = spark.createDataFrame([(i % 140, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = best_fit_packing(df, capacity=32).collect()
    held, own = defaultdict(list), WordTokens.of(tokenizer_path())
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 32
    want = []
    for i, t in enumerate(texts):
        ids = own.encode(t or "") + bytes(4)
        want += [(i % 140, k, at // 4, len(ids[at : at + 128]) // 4, zlib.crc32(ids[at : at + 128])) for k, at in enumerate(range(0, len(ids), 128))]
    assert sorted((r.id, r.piece, r.start, r.length, r.crc) for r in rows) == sorted(want)
    assert best_fit_packing(df.limit(0)).count() == 0


def test_a_task_leaves_no_words_in_its_worker(spark):
    from attestry.llm.packing import pieces

    df = spark.createDataFrame([(i, f"word{i} other{i}") for i in range(64)], "doc_id long, text string")
    assert pieces(df).count() == 64

    def held(batches):
        import pyarrow as pa

        from attestry.llm.tokens import WordTokens

        for batch in batches:
            yield pa.record_batch([pa.array([sum(len(w.young) + len(w.old) for w in WordTokens._made.values())] * len(batch), pa.int64())], names=["n"])

    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {0}
