import random

import pytest

from attestry.llm.edits import EDITS, LEAF, CountTree, PreTokens, count_edited, edit_trees
from attestry.llm.tokens import tokenizer_path

BITS = ["the", " cat", "'", "'ll", "l", "s", "  ", "   ", " ", "\n", "\n\n", "9", "12", "é", "ß", "!", "?!", "日本", " ", "'v", "e", "x" * 30]


@pytest.mark.parametrize("seed", range(6))
def test_edits_equal_a_full_count(seed):
    tokens = PreTokens.of(tokenizer_path("byte_bpe_50k.tiktoken"))
    rng = random.Random(seed)
    for _ in range(60):
        text = "".join(rng.choice(BITS) for _ in range(rng.choice([0, 1, 5, 60, 700])))
        tree = CountTree.build(text, tokens)
        assert tree.text == text
        for _ in range(12):
            a = rng.randrange(len(text) + 2)
            b = a + rng.choice([0, 0, 1, 2, 5, 200])
            new = "".join(rng.choice(BITS) for _ in range(rng.choice([0, 1, 2, 9, 150])))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            want = tokens.pattern.findall(text)
            assert tree.text == text
            assert [s for leaf in tree.leaves for s in leaf[1]] == list(map(len, want))
            assert tree.total == len(tokens.encoding.encode_ordinary(text)) and tree.chars[1] == len(text)


def test_edits_in_one_place_split_leaves():
    tokens = PreTokens.of(tokenizer_path("byte_bpe_50k.tiktoken"))
    tree, text = CountTree.build("start end", tokens), "start end"
    for k in range(40):
        new = f" word{k} and more of it" * 10
        tree.edit(5, 5, new)
        text = text[:5] + new + text[5:]
    assert tree.text == text and tree.total == len(tokens.encoding.encode_ordinary(text))
    assert max(len(leaf[1]) for leaf in tree.leaves) <= 3 * LEAF and len(tree.leaves) > 20


def test_rows_and_stored_trees(spark):
    rows = [(1, "one two three " * 400, [(0, 3, "ONE"), (9, 9, "x")], 1), (2, None, None, 1), (3, "", [(5, 9, "new text")], 1), (4, "a b", [(None, 1, "z"), (0, 99, None)], 1), (1, "again", [], 1)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {EDITS}, tree int")
    got = count_edited(df).collect()
    tokens = PreTokens.of(tokenizer_path("byte_bpe_50k.tiktoken")).encoding.encode_ordinary
    texts = ["ONE two txhree " + "one two three " * 399, "", "new text", "", "again"]
    assert [r.n_tokens for r in got] == [len(tokens(t)) for t in texts] and [r.n_chars for r in got] == list(map(len, texts))
    assert 0 < got[0].n_chars_encoded < 200
    trees = count_edited(df.filter("doc_id = 3"))
    more = spark.createDataFrame([(3, 2, 0, 0, "B"), (3, 1, 0, 0, "A ")], "id long, seq int, start long, end long, replacement string")
    assert [r.n_tokens for r in edit_trees(trees, more).collect()] == [len(tokens("BA new text"))]
    assert count_edited(df.limit(0)).count() == 0


def test_very_long_text(spark):
    text = "one two three, four! " * 60_000
    df = spark.createDataFrame([(1, text, [(600_000, 600_003, "edited here"), (10**9, 10**9, " end")])], f"doc_id long, text string, edits {EDITS}")
    row = count_edited(df, keep_tree=False).first()
    whole = text[:600_000] + "edited here" + text[600_003:] + " end"
    assert row.n_tokens == len(PreTokens.of(tokenizer_path("byte_bpe_50k.tiktoken")).encoding.encode_ordinary(whole)) and row.n_chars_encoded < len(text) * 1.1
