"""Repair of the turns of conversations by weighted CYK interval parsing.

The repair grammar accepts the role initials ``(s?(ua)+)?``. Its nonterminals
are pairs [p, q] of places in that pattern, and all its rules are in Chomsky
normal form: [p, q] -> [p, r] [r, q] over two adjoining spans, and [p, q] ->
one turn that is kept, given another role or deleted. The cell of a span holds
for each pair the least (cost, audit) of edits that lead from p to q over the
span's turns; insertions are closed over in every cell, before and after.

A cell of a span may be made from any one cut of it, since the rule for r
stands for every way through the cut: so spans are combined bottom-up by
length, neighbours with neighbours, and each length needs only the lengths
below it. Tasks parse blocks of up to ``BLOCK`` turns, and the cells of a long
conversation's blocks meet in further rounds of ``FAN_IN``, so no conversation
has to fit in a task.

The least cell by (cost, audit) is exact: of two audits of equal cost over the
same turns none is a proper prefix of the other (it would lack insertions,
which cost), so the order of two audits stays whatever is put before or after.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attestry.llm.text import SPACES
from attestry.runtime import saved
from attestry.sources.tables import read_table

#: Turns of a block, and cells that meet in one group of a round.
BLOCK, FAN_IN = 512, 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Places in the pattern: before all, after s, after u, after a.
START, S, U, A = range(4)
STEPS = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
ENDS = (START, A)
LEGAL_PAIRS = ("su", "ua", "au")
ROLE = {"u": "user", "a": "assistant"}

#: (cost, audit) for each pair of places that the span can lead between.
Cell = dict[tuple[int, int], tuple[int, str]]


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two adjoining spans: the least of [p, r] [r, q] over r."""
    found: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            other = right.get((r, q))
            if other is not None:
                both = (cost + other[0], audit + other[1])
                if (p, q) not in found or both < found[p, q]:
                    found[p, q] = both
    return found


def _closure() -> Cell:
    """The cell of no turns: the least insertions between every two places; a third would come back to a place."""
    one: Cell = {(p, q): (INSERT, "I") for (p, c), q in STEPS.items() if c in ROLE}
    found: Cell = {(p, p): (0, "") for p in range(4)} | one
    for pair, least in combine(one, one).items():
        found[pair] = min(least, found.get(pair, least))
    return found


EMPTY = _closure()


@lru_cache(4096)
def leaf(initial: str, fault: str) -> Cell:
    """The cell of one turn by its role's initial and its fault ('', blank, duplicate or truncated)."""
    turn: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if fault in ("", "truncated"):
        more = TRUNCATED if fault else 0
        for (p, c), q in STEPS.items():
            ways = ([(KEEP + more, "K")] if c == initial else []) + ([(REROLE + more, "R")] if c in ROLE else [])
            if ways:
                turn[p, q] = min(ways)
    return combine(combine(EMPTY, turn), EMPTY)


@lru_cache(8192)
def _short(spans: tuple[tuple[str, str], ...]) -> Cell:
    """The cell of up to 8 turns; conversations repeat these."""
    if len(spans) == 1:
        return leaf(*spans[0])
    half = 1 << (len(spans) - 1).bit_length() - 1
    return combine(_short(spans[:half]), _short(spans[half:]))


def bottom_up(cells: list[Cell]) -> Cell:
    """The cell of adjoining spans, combined by length: pairs, then pairs of those."""
    while len(cells) > 1:
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else EMPTY


def parse(turns: list[tuple[str, str]]) -> Cell:
    """The cell of the (initial, fault) of adjoining turns."""
    return bottom_up([_short(tuple(turns[i : i + 8])) for i in range(0, len(turns), 8)])


def repeated(turn: tuple[str, str], times: int) -> Cell:
    """The cell of one turn that repeats, by doubling its length."""
    power, found = leaf(*turn), None
    while times:
        if times & 1:
            found = power if found is None else combine(found, power)
        times >>= 1
        power = combine(power, power) if times else power
    return found if found is not None else EMPTY


class Span(NamedTuple):
    """What is known of adjoining turns of one conversation."""

    blank: int
    duplicate: int
    truncated: int
    illegal: int
    turns: int
    first_turn: int | None
    last_turn: int | None
    first: str
    last: str
    cell: Cell


def join_spans(a: Span, b: Span) -> Span:
    """Two adjoining spans as one. Turns are ordered, those without a number first."""
    same = a.last_turn is not None and a.last_turn == b.first_turn
    first = a.first_turn if a.first_turn is not None else b.first_turn
    last = b.last_turn if b.last_turn is not None else a.last_turn
    illegal = a.illegal + b.illegal + (a.last + b.first not in LEGAL_PAIRS)
    return Span(a.blank + b.blank, a.duplicate + b.duplicate, a.truncated + b.truncated, illegal, a.turns + b.turns - same, first, last, a.first, b.last, combine(a.cell, b.cell))


def _balanced(spans: list[Span]) -> Span:
    while len(spans) > 1:
        spans = [join_spans(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn")
_CELL = "costs array<long>, audits array<string>"


def _packed(span: Span) -> list:
    """A span as plain values; pairs that the cell lacks are null."""
    cells = [span.cell.get((p, q), (None, None)) for p in range(4) for q in range(4)]
    return [*span[:9], [c for c, _ in cells], [a for _, a in cells]]


def _unpacked(values: list) -> Span:
    *known, costs, audits = values
    return Span(*known, {(i // 4, i % 4): (int(c), a) for i, (c, a) in enumerate(zip(costs, audits, strict=True)) if c is not None})


def _row_span(turn, initial: str, fault: str, again: str, copies: int) -> Span:
    """A turn and its copies; the first has ``fault``, the others ``again``."""
    cell = leaf(initial, fault)
    if copies > 1:
        cell = combine(cell, repeated((initial, again), copies - 1))
    count = lambda kind: (fault == kind) + (copies - 1) * (again == kind)
    inside = (copies - 1) * (initial + initial not in LEGAL_PAIRS)
    return Span(count("blank"), count("duplicate"), count("truncated"), inside, int(turn is not None), turn, turn, initial, initial, cell)


def _block_span(rows: list[tuple]) -> Span:
    """Many turns of one conversation; plain ones are parsed by their (initial, fault)."""
    if any(r[4] > 1 for r in rows):
        return _balanced([_row_span(*r) for r in rows])
    counts = [sum(r[2] == kind for r in rows) for kind in ("blank", "duplicate", "truncated")]
    numbers = [r[0] for r in rows if r[0] is not None]
    illegal = sum(a[1] + b[1] not in LEGAL_PAIRS for a, b in zip(rows, rows[1:], strict=False))
    return Span(*counts, illegal, len(set(numbers)), numbers[0] if numbers else None, numbers[-1] if numbers else None, rows[0][1], rows[-1][1], parse([(r[1], r[2]) for r in rows]))


def _blocks(schema: pa.Schema, size: int):
    """Rows come in the order of conversations and turns; a block is one span with the order of its first turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        begin = None

        def span() -> list:
            return [*begin, *_packed(_block_span(held))]

        for batch in batches:
            out = []
            for conv, turn, role, h, fault, again, copies in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if begin is None or len(held) >= size or begin[0] != conv:
                    if held:
                        out.append(span())
                    held, begin = [], (conv, turn, role, h)
                held.append((turn, role[:1], fault, again, copies))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        if held:
            yield pa.record_batch([pa.array([v], t) for v, t in zip(span(), schema.types, strict=True)], schema=schema)

    return run


def _joined(group: pa.Table) -> pa.Table:
    """The spans of one group of a round, in their order, as one."""
    group = group.sort_by("place").drop_columns(["place", "part"])
    rows = list(zip(*(c.to_pylist() for c in group.columns), strict=True))
    values = [*rows[0][:4], *_packed(_balanced([_unpacked(list(r[4:])) for r in rows]))]
    return pa.table([pa.array([v], t) for v, t in zip(values, group.schema.types, strict=True)], schema=group.schema)


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, h, fault, again, copies) of each distinct row (conv, turn, role, text).

    ``fault`` is the first fault of a row: blank, duplicate (its role and text
    stand earlier in the conversation), truncated or ''; ``again`` is that of
    its equals at the same turn. Rows are pre-aggregated by a hash of the text,
    so repeated rows are counted and no text is shuffled.
    """
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    narrow = rows.select("conv", "turn", "role", F.md5("text").alias("h"), last.alias("last_char"))
    fixed = F.when(F.col("last_char") == "", "blank").when(~F.col("last_char").isin(".", "!", "?"), "truncated").otherwise("")
    distinct = saved(narrow.groupBy("conv", "turn", "role", "h").agg(F.count(F.lit(1)).alias("copies"), F.first(fixed).alias("own")))
    order = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = distinct.groupBy("conv", "role", "h").agg(F.min(order).alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = firsts.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("h").alias("g"), "at")
    found = distinct.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g")), "left")
    later = F.when(F.col("own") == "blank", "blank").otherwise("duplicate")
    fault = F.when(F.col("at").isNotNull() & (F.col("at") != order), later).otherwise(F.col("own"))
    return found.select("conv", "turn", "role", "h", fault.alias("fault"), later.alias("again"), "copies")


def repair_plans(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation.

    ``rows`` has conv, turn (integers), role and text without nulls in the last
    two. The order of a conversation is by turn (nulls first), then by role and
    by the hash of the text; rows that repeat stand side by side. A very long
    conversation is parsed in blocks by several tasks. A null conversation is
    one of its own. Without rows there is no plan.
    """
    whole = saved(rows.select("conv", "turn", "role", "text"))
    flagged = faults(whole)
    kinds = f"conv {whole.schema['conv'].dataType.simpleString()}, turn {whole.schema['turn'].dataType.simpleString()}, role string, h string"
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    schema = f"{kinds}, {counts}, first string, last string, {_CELL}"
    keys = ["conv", "turn", "role", "h"]
    dealt = flagged.repartitionByRange(*keys).sortWithinPartitions(*keys)
    spans = saved(dealt.mapInArrow(_blocks(to_arrow_schema(StructType.fromDDL(schema)), BLOCK), schema))
    while True:
        long = spans.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv").alias("c"))
        if long.isEmpty():
            break
        several = spans.join(long, F.col("conv").eqNullSafe(F.col("c")), "left_semi")
        single = spans.join(long, F.col("conv").eqNullSafe(F.col("c")), "left_anti")
        placed = several.withColumn("place", F.expr("row_number() over (partition by conv order by turn, role, h) - 1"))
        merged = placed.withColumn("part", F.expr(f"place div {FAN_IN}")).groupBy("conv", "part").applyInArrow(_joined, schema)
        spans = saved(single.unionByName(merged))
    from_start = F.array(*[F.when(F.get("costs", F.lit(q)).isNotNull(), F.struct(F.get("costs", F.lit(q)).alias("cost"), F.get("audits", F.lit(q)).alias("audit"))) for q in ENDS])
    best = F.array_min(F.filter(from_start, lambda x: x.isNotNull()))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    return spans.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", best.alias("best")).select("*", "best.*").drop("best")


class _Writer:
    """Follows an audit over the turns of one conversation."""

    def __init__(self, conv, audit: str):
        self.conv, self.audit, self.at, self.place, self.state = conv, audit, 0, 0, START

    def _out(self, edit: str, turn, role: str, text: str) -> tuple:
        self.state = STEPS[self.state, role[:1]]
        self.place += 1
        return self.conv, self.place, edit, turn, role, text

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._out("I", None, ROLE["a" if self.state == U else "u"], "")

    def turn(self, turn, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._out(edit, turn, role if edit == "K" else ROLE["a" if self.state == U else "u"], text)


def _rewrite(schema: pa.Schema):
    """A conversation comes as the row of its plan and then its turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            out: list[tuple] = []
            for conv, plan, turn, role, text, audit in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if plan == 0:
                    if writer:
                        out += writer.inserted()
                    writer = _Writer(conv, audit)
                else:
                    out += writer.turn(turn, role, text)
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        if writer and (out := list(writer.inserted())):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv, place, edit, turn, role, text): the conversations as ``plans`` repair them.

    Places count from 1; inserted turns have no number and an empty text. The
    turns of a conversation pass through one task in order, one at a time, and
    leave it so: its rows lie together in one partition.
    """
    turns = rows.select("conv", F.lit(1).alias("plan"), "turn", "role", "text", F.lit(None).cast("string").alias("audit"), F.md5("text").alias("h"))
    none = lambda c: F.lit(None).cast(turns.schema[c].dataType).alias(c)
    heads = plans.select("conv", F.lit(0).alias("plan"), none("turn"), none("role"), none("text"), "audit", none("h"))
    both = turns.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "plan", "turn", "role", "h").drop("h")
    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = f"conv {kind('conv')}, place long, edit string, turn {kind('turn')}, role string, text string"
    return both.mapInArrow(_rewrite(to_arrow_schema(StructType.fromDDL(schema))), schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs over the rows of each conversation as they come."""
    import hashlib

    last, digest = None, None
    for batch in batches:
        done = []
        for conv, place, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if place == 1:
                if digest:
                    done.append((last, digest.hexdigest()))
                last, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if done:
            yield pa.record_batch([pa.array([d[0] for d in done], batch.schema.types[0]), pa.array([d[1] for d in done])], names=["conv", "sha256"])
    if digest:
        yield pa.record_batch([pa.array([last], batch.schema.types[0]), pa.array([digest.hexdigest()])], names=["conv", "sha256"])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text) after the faults that the audit plants by the check sum of ``conv_id:turn``; nulls read as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    changed: Column = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv", "turn", role.alias("role"), changed.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def audit_conversations(conversations: DataFrame) -> DataFrame:
    """One row for each conversation with its faults, the plan of its repair and the digest of what is repaired.

    Further columns are ignored. Roles are judged by their first letter; an
    empty role has none and cannot be kept. Null roles and texts are one space
    (so blank), a null conversation is one of its own. Very long texts are
    hashed, and pass through tasks one at a time. An empty table gives no rows.
    """
    rows = saved(damaged(conversations))
    plans = saved(repair_plans(rows))
    fixed = repaired_turns(rows, plans).select("conv", "place", "role", "text")
    digests = saved(fixed.mapInArrow(_digests, f"conv {rows.schema['conv'].dataType.simpleString()}, sha256 string"))
    every = conversations.select(F.col("conv_id").alias("conv")).distinct()
    renamed = lambda df, c: df.withColumnRenamed("conv", c)
    found = every.join(renamed(plans, "p"), F.col("conv").eqNullSafe(F.col("p")), "left").join(renamed(digests, "d"), F.col("conv").eqNullSafe(F.col("d")), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("conv").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table after the planted damage, with its repair."""
    return audit_conversations(read_table(spark, sf_dir, "conversations"))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}


def _add(state: str, cost: str, edit: str) -> str:
    """SQL: a way, its cost in twelve digits and then its audit, with one more edit; least() of ways is the least by (cost, audit)."""
    return f"(lpad(CAST(CAST({state}[1:12] AS BIGINT) + {cost} AS VARCHAR), 12, '0') || {state}[13:] || '{edit}')"


def _sql() -> str:
    """The contract turn by turn: the least way to each place of the pattern, then the way back over its audit."""
    kept = "fault IN ('', 'truncated')"
    take = lambda state, letter: f"CASE WHEN {kept} THEN CASE WHEN c = '{letter}' THEN {_add(state, 't', 'K')} ELSE {_add(state, '2 + t', 'R')} END END"
    gone = lambda state: _add(state, "3", "D")
    return f"""WITH RECURSIVE bits AS (SELECT i, i AS v, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
coded AS (SELECT src.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda k: CAST(unicode(s[k]) AS BIGINT))), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) % 20 AS kind FROM src, crc),
rows_ AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded WHERE kind <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS e FROM rows_),
turns AS (SELECT *, left(role, 1) AS c, CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN e NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM num),
step AS (SELECT *, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t FROM turns),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM turns GROUP BY 1),
way AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000000' AS w0, CAST(NULL AS VARCHAR) AS ws, '000000000002I' AS wu, '000000000004II' AS wa FROM facts
UNION ALL SELECT conv_id, i, r0, rs, least(least(ru, {_add('least(r0, rs, ra)', '2', 'I')}), {_add(f"least(ra, {_add(f'least(ru, ' + _add('least(r0, rs, ra)', '2', 'I') + ')', '2', 'I')})", '2', 'I')}), least(ra, {_add("least(ru, " + _add('least(r0, rs, ra)', '2', 'I') + ")", '2', 'I')})
FROM (SELECT s.conv_id, s.i, {gone('w0')} AS r0, least({gone('ws')}, CASE WHEN {kept} AND c = 's' THEN {_add('w0', 't', 'K')} END) AS rs, least({gone('wu')}, {take('least(w0, ws, wa)', 'u')}) AS ru, least({gone('wa')}, {take('wu', 'a')}) AS ra FROM way JOIN step s ON s.conv_id IS NOT DISTINCT FROM way.conv_id AND s.i = way.i + 1)),
plan AS (SELECT f.*, CAST(least(w0, wa)[1:12] AS BIGINT) AS cost, least(w0, wa)[13:] AS audit FROM facts f JOIN way ON way.conv_id IS NOT DISTINCT FROM f.conv_id AND way.i = f.n),
told AS (SELECT conv_id, audit, 0 AS k, CAST(0 AS BIGINT) AS i, '0' AS last, [] :: VARCHAR[] AS said FROM plan
UNION ALL SELECT told.conv_id, audit, k + 1, CASE WHEN edit = 'I' THEN told.i ELSE told.i + 1 END, CASE WHEN edit = 'D' THEN last ELSE left(who, 1) END, CASE WHEN edit = 'D' THEN said ELSE list_append(said, who || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END) END
FROM (SELECT told.*, audit[k + 1] AS edit, s.text, CASE WHEN audit[k + 1] = 'K' THEN s.role WHEN last = 'u' THEN 'assistant' ELSE 'user' END AS who FROM told LEFT JOIN turns s ON s.conv_id IS NOT DISTINCT FROM told.conv_id AND s.i = told.i + 1 WHERE k < length(audit)) told),
ends AS (SELECT conv_id, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256 FROM told WHERE k = length(audit))
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) every LEFT JOIN plan p ON p.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM every.conv_id"""


ORACLE_SQL = {"op11_conversation_repair": _sql()}
