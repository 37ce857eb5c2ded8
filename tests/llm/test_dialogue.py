import hashlib
import random
import zlib
from itertools import product

import pytest

from attestry.llm import dialogue
from attestry.llm.dialogue import audit_conversations, bottom_up, combine, leaf, parse, repeated

SPACES = " \t\n\x0b\x0c\r"
FORMS = "conv_id long, turn long, role string, text string"


def search(turns):
    """Least (cost, audit) by trying every edit at every turn, turn after turn, without spans."""
    goes = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def insertions(ways):
        for _ in range(2):
            for state, (cost, audit) in list(ways.items()):
                for c in "ua":
                    to, new = goes.get((state, c)), (cost + 2, audit + "I")
                    if to and new < ways.get(to, (10**9, "")):
                        ways[to] = new
        return ways

    ways = insertions({"0": (0, "")})
    for initial, fault in turns:
        after = {}
        for state, (cost, audit) in ways.items():
            options = [(state, cost + 3, audit + "D")]
            if fault in ("", "truncated"):
                extra = int(fault == "truncated")
                options += [(goes[state, c], cost + extra + (0 if edit == "K" else 2), audit + edit) for c, edit in [(initial, "K"), ("u", "R"), ("a", "R")] if (state, c) in goes]
            for to, *new in options:
                if tuple(new) < after.get(to, (10**9, "")):
                    after[to] = tuple(new)
        ways = insertions(after)
    return min(w for s, w in ways.items() if s in "0a")


def best(cell):
    return min(cell[0, q] for q in (0, 3) if (0, q) in cell)


def enumerated(turns, inserts=2):
    """Least (cost, audit) over all edit scripts with up to ``inserts`` insertions in each place."""
    import re

    found = []
    gaps = [[("I", c) for c in s] for n in range(inserts + 1) for s in product("ua", repeat=n)]

    def options(initial, fault):
        yield [("D", "")], 3
        if fault in ("", "truncated"):
            extra = int(fault == "truncated")
            yield [("K", initial)], extra
            for c in "ua":
                yield [("R", c)], 2 + extra

    for edits in product(*[list(options(*t)) for t in turns]):
        for placed in product(gaps, repeat=len(turns) + 1):
            script, cost = list(placed[0]), 0
            for (e, c), gap in zip(edits, placed[1:], strict=True):
                script, cost = script + e + gap, cost + c
            if re.fullmatch("(s?(ua)+)?", "".join(c for _, c in script)):
                found.append((cost + 2 * sum(len(g) for g in placed), "".join(e for e, _ in script)))
    return min(found)


TURNS = [(c, f) for c in "suat" for f in ("", "truncated", "duplicate", "blank")]


def test_cell_equals_all_scripts():
    rng = random.Random(5)
    for _ in range(40):
        turns = [rng.choice(TURNS[:14]) for _ in range(rng.randrange(0, 3))]
        assert best(parse(turns)) == enumerated(turns), turns


def test_cell_equals_search_and_any_cut_gives_the_same():
    rng = random.Random(3)
    for _ in range(300):
        turns = [rng.choice(TURNS) for _ in range(rng.randrange(0, 60))]
        cell = parse(turns)
        assert best(cell) == search(turns)
        cut = rng.randrange(len(turns) + 1)
        assert combine(parse(turns[:cut]), parse(turns[cut:])) == cell
    assert repeated(("u", "truncated"), 37) == bottom_up([leaf("u", "truncated")] * 37)


def plain_audit(rows):
    """{conv_id: row} from the contract, in plain Python."""
    word = lambda v: " " if v is None else str(v)
    found = {}
    for conv, turn, role, text in rows:
        kept = found.setdefault(conv, [])
        role, text = word(role), word(text)
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in found.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, turns = set(), []
        for _, role, text in kept:
            end = text.rstrip(SPACES)[-1:]
            turns.append((role[:1], "blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated"))
            seen.add((role, text))
        cost, audit = search(turns)
        repaired, state, at = [], "0", iter(kept)
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(at)
            if edit != "D":
                role = role if edit == "K" else "assistant" if state == "u" else "user"
                repaired.append(f"{role}:{text}")
                state = role[:1]
        numbers = [t for t, _, _ in kept if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        out[conv] = (gaps, *(sum(f == k for _, f in turns) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def equal(spark, rows, df=None):
    got = audit_conversations(df or spark.createDataFrame(rows, FORMS)).collect()
    want = plain_audit(rows)
    assert len(got) == len(want) and {r["conv_id"]: tuple(r)[1:] for r in got} == want


def test_table_equals_plain_definition(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    equal(spark, [tuple(r) for r in df.collect()], df)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (7, None, "assistant", None), (7, None, "assistant", "x"), (8, 2, "", "No role."), (8, 3, "usher", "é?\n"), (9, 1, "system", "S."), (9, -5, "user", " \t")]
    rows += [(10, 4, "user", "Same."), (10, 4, "user", "Same."), (10, 4, "user", "Same."), (10, 9, "user", "Same."), (11, 1, "user", "word " * 200_000 + "end.")]
    rows += [(c, 0, "user", "Dropped.") for c in range(100, 140)]  # some lose their only row
    equal(spark, rows)
    assert any(not v[6] and not v[5] for c, v in plain_audit(rows).items() if c and c >= 100)
    assert audit_conversations(spark.createDataFrame([], FORMS)).count() == 0
    wide = spark.createDataFrame(rows, FORMS).selectExpr("*", "1 as conv", "'x' as audit", "2 as h")
    equal(spark, rows, wide)


@pytest.mark.parametrize("block,fan_in", [(512, 64), (16, 3)])
def test_long_conversation_is_parsed_in_blocks(spark, monkeypatch, block, fan_in):
    monkeypatch.setattr(dialogue, "BLOCK", block)
    monkeypatch.setattr(dialogue, "FAN_IN", fan_in)
    rng = random.Random(1)
    rows = [(1, t if t % 50 else None, rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", f"Turn {t}.", f"Turn {t}", ""])) for t in range(3000)]
    rows += [(2, 5, "user", "Again and again.")] * 2000 + [(3, 1, "user", "Hi."), (3, 2, "assistant", "Hi.")]
    equal(spark, rows)
