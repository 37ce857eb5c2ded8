"""Token counts that follow edits.

A document is cut into pre-tokens, whose token counts do not depend on their
neighbours. The pre-tokens stand in chunks, the leaves of a segment tree that
sums characters and tokens. An edit finds its chunks through the tree, cuts
only the touched text again, with the pre-tokens before it whose cut may have
looked ahead, until the new cuts meet the old ones, and updates the sums above
the touched leaves. Trees are stored as rows, so later edits start from them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.text import slices
from attestry.llm.tokens import tokenizer_path
from attestry.sources.tables import read_table

#: Pre-tokens in a leaf when a tree is built, and pre-tokens before an edit that are cut again.
LEAF, CONTEXT = 64, 3
CACHED_COUNTS = 120_000

TREE = "array<struct<text:string,sizes:array<int>,counts:array<int>>>"
EDITS = "array<struct<start:long,end:long,replacement:string>>"


class PreTokens:
    """Cuts texts into pre-tokens and counts the tokens of each, with a bounded cache."""

    _made: dict[str, PreTokens] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> PreTokens:
        """One for each worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def counts(self, pieces: list[str]) -> list[int]:
        if len(self.cache) > CACHED_COUNTS:
            self.cache.clear()
        try:
            return list(map(self.cache.__getitem__, pieces))
        except KeyError:
            for w in set(pieces):
                if w not in self.cache:
                    self.cache[w] = len(self.encoding.encode_ordinary(w))
            return list(map(self.cache.__getitem__, pieces))


class CountTree:
    """Segment tree of a document: leaves hold (text, sizes, counts) of consecutive pre-tokens."""

    def __init__(self, leaves: list[list], tokens: PreTokens):
        self.tokens = tokens
        self.encoded = 0  # characters cut and counted since the tree was made
        self._index(leaves or [["", [], []]])

    def _index(self, leaves: list[list]) -> None:
        self.leaves, self.width = leaves, 1
        while self.width < len(leaves):
            self.width *= 2
        self.chars, self.sums = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (text, _, counts) in enumerate(self.leaves):
            self.chars[self.width + i], self.sums[self.width + i] = len(text), sum(counts)
        for i in range(self.width - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @classmethod
    def build(cls, text: str, tokens: PreTokens) -> CountTree:
        pieces = tokens.pattern.findall(text)
        counts, sizes, leaves, at = tokens.counts(pieces), list(map(len, pieces)), [], 0
        for i in range(0, len(pieces), LEAF):
            n = sum(sizes[i : i + LEAF])
            leaves.append([text[at : at + n], sizes[i : i + LEAF], counts[i : i + LEAF]])
            at += n
        return cls(leaves, tokens)

    @property
    def total(self) -> int:
        return self.sums[1]

    def find(self, place: int) -> tuple[int, int]:
        """Leaf that holds the character at ``place``, and where the leaf begins."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if place >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.width, before

    def _put(self, at: int, leaf: list) -> None:
        self.leaves[at] = leaf
        i = self.width + at
        self.chars[i], self.sums[i] = len(leaf[0]), sum(leaf[2])
        while i > 1:
            i //= 2
            self._add(i)

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replaces characters ``start`` to ``end`` (both cut to the text)."""
        n = self.chars[1]
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        first, before = self.find(start)
        # Enough pre-tokens before the edit that no earlier cut saw its text.
        while first and (before + sum(self.leaves[first][1][:CONTEXT]) > start - 3 or len(self.leaves[first][1]) <= CONTEXT):
            first -= 1
            before -= len(self.leaves[first][0])
        last, after = self.find(end)
        after += len(self.leaves[last][0])
        sizes, counts = [], []
        for leaf in self.leaves[first : last + 1]:
            sizes += leaf[1]
            counts += leaf[2]
        text = "".join(leaf[0] for leaf in self.leaves[first : last + 1])
        # Kept pre-tokens on the left: all but the CONTEXT last ones that end before the edit.
        keep, at, ends = 0, before, []
        for s in sizes:
            if at + s > start - 3:
                break
            at += s
            ends.append(at)
        keep = max(0, len(ends) - CONTEXT)
        left = ends[keep - 1] if keep else before
        old_ends, at = {}, before
        for i, s in enumerate(sizes):
            at += s
            old_ends[at] = i + 1
        shift = len(replacement) - (end - start)
        ahead = "".join(leaf[0] for leaf in self.leaves[last + 1 : last + 2])
        while True:
            fresh = text[left - before : start - before] + replacement + text[end - before :] + ahead
            pieces, place, meet = [], left, None
            more = last + 2 < len(self.leaves) or bool(ahead)
            for m in self.tokens.pattern.finditer(fresh):
                place = left + m.end()
                pieces.append(m.group())
                if place >= start + len(replacement) and place - shift >= end and old_ends.get(place - shift, 0):
                    meet = old_ends[place - shift]
                    break
            # The last cuts of a region that ends inside the text may be wrong.
            if meet is not None and (place < left + len(fresh) - 3 or not more):
                break
            if last + 1 >= len(self.leaves):
                meet = len(sizes)
                break
            last += 1
            text += self.leaves[last][0]
            sizes += self.leaves[last][1]
            counts += self.leaves[last][2]
            at = after
            for i, s in enumerate(self.leaves[last][1]):
                at += s
                old_ends[at] = len(sizes) - len(self.leaves[last][1]) + i + 1
            after = at
            ahead = "".join(leaf[0] for leaf in self.leaves[last + 1 : last + 2])
        self.encoded += sum(map(len, pieces))
        new = [*counts[:keep], *self.tokens.counts(pieces), *counts[meet:]]
        new_sizes = [*sizes[:keep], *map(len, pieces), *sizes[meet:]]
        whole = text[: start - before] + replacement + text[end - before :]
        # The same leaves share the new pre-tokens, so the tree keeps its shape
        # until they outgrow twice their size: then they are split.
        leaves, at, parts = last + 1 - first, 0, []
        split = len(new) > 2 * LEAF * leaves
        each = LEAF if split else -(-len(new) // leaves)
        for k in range(-(-len(new) // LEAF) if split else leaves):
            part = new_sizes[k * each : (k + 1) * each]
            n = sum(part)
            parts.append([whole[at : at + n], part, new[k * each : (k + 1) * each]])
            at += n
        if split:
            self._index(self.leaves[:first] + parts + self.leaves[last + 1 :])
        else:
            for k, part in enumerate(parts):
                self._put(first + k, part)

    def rows(self) -> list[dict]:
        return [{"text": t, "sizes": s, "counts": c} for t, s, c in self.leaves]

    @property
    def text(self) -> str:
        return "".join(leaf[0] for leaf in self.leaves)


def _run(path: str, stored: bool, keep_tree: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = PreTokens.of(path)
        for batch in slices(batches):
            before, after, cut, size, trees = [], [], [], [], []
            for source, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if stored:
                    tree = CountTree([[x["text"], x["sizes"], x["counts"]] for x in source or ()], tokens)
                else:
                    tree = CountTree.build(source or "", tokens)
                before.append(tree.total)
                for e in edits or ():
                    if e and e["start"] is not None and e["end"] is not None:
                        tree.edit(e["start"], e["end"], e["replacement"] or "")
                after.append(tree.total)
                cut.append(tree.encoded)
                size.append(tree.chars[1])
                trees.append(tree.rows() if keep_tree else None)
            leaf = pa.list_(pa.struct([("text", pa.string()), ("sizes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]))
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (before, after, cut, size)), pa.array(trees, leaf)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens_before", "n_tokens", "n_chars_encoded", "n_chars", "tree"])

    return run


def _schema(df: DataFrame) -> str:
    return f"id {df.schema['id'].dataType.simpleString()}, n_tokens_before long, n_tokens long, n_chars_encoded long, n_chars long, tree {TREE}"


def count_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", path: str | None = None, keep_tree: bool = True) -> DataFrame:
    """(id, n_tokens_before, n_tokens, n_chars_encoded, n_chars, tree) of every row after its edits.

    The edits (EDITS) apply in order, each to the text that the one before
    left; places beyond the text are cut to it and edits without places are
    ignored. A null text counts as empty, null edits as none. Repeated rows
    repeat; texts are cut whole, however long; edits at one place apply in
    their order; columns other than the three named are not read. An empty
    table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(edits_col).cast(EDITS).alias("edits"))
    return rows.mapInArrow(_run(path or tokenizer_path("byte_bpe_50k.tiktoken"), False, keep_tree), _schema(rows))


def edit_trees(trees: DataFrame, edits: DataFrame, id_col: str = "id", path: str | None = None) -> DataFrame:
    """Trees of :func:`count_edited` after further rows (id, seq, start, end, replacement) of edits."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "replacement"))), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement")))
    grouped = edits.groupBy(F.col(id_col).alias("i")).agg(ordered.cast(EDITS).alias("edits"))
    rows = trees.join(grouped, F.col("id") == F.col("i"), "left").select("id", "tree", "edits")
    return rows.mapInArrow(_run(path or tokenizer_path("byte_bpe_50k.tiktoken"), True, True), _schema(rows))


def cleaning_edits(text, source):
    """Edits that a cleaning pass makes: a source line in front, the first e-mail address masked, the middle line break joined, a closing line."""
    n = F.length(text)
    address = F.regexp_extract(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", 0)
    head = F.concat(F.lit("source: "), F.coalesce(source, F.lit("unknown")), F.lit("\n"))
    at = F.when(address != "", F.instr(text, address) - 1 + F.length(head))
    half = F.floor(n / 2) + F.length(head)
    one = lambda a, b, what: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), what.alias("replacement"))
    zero = F.lit(0)
    return F.array(one(zero, zero, head), one(at, at + F.length(address), F.lit("<email>")), one(half, half + 7, F.lit(" - ")), one(n * 2 + 99, n * 2 + 99, F.lit("\nEnd of document.")))


def op1_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document of the table before and after a cleaning pass."""
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    edited = docs.select("doc_id", "text", cleaning_edits(text, F.col("source")).alias("edits"))
    found = count_edited(edited, keep_tree=False)
    return found.select(F.col("id").alias("doc_id"), "n_tokens_before", "n_tokens", "n_chars_encoded", "n_chars")


QUERIES = {"op1_edited_token_counts": op1_edited_token_counts}
ORACLE_SQL: dict[str, str] = {}
