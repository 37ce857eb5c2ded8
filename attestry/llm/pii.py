"""Personal data by weak supervision, in DataFrame expressions only.

Exact patterns give the base spans. Further candidates come from wider patterns:
near misses of the base patterns (digit runs that fail the card's check sum or
its length, calls with too few digits, addresses with parts above 255) and other
spellings (disguised e-mail addresses, national phone numbers, cards with other
separators, IPv6). Regex, gazetteer and context labelers vote on every
candidate or abstain. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is for each kind, and its posteriors are the
soft labels of the final span classifier (naive Bayes over the shape and the
surroundings of a span), which decides on the further candidates. Base spans
always stay. Secrets (keys and tokens after their name) are counted apart.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.runtime import saved
from attestry.sources.tables import read_table

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "[A-Za-z0-9._%+-]"
_NOT_AFTER_LOCAL = rf"(?:(?<!{_LOCAL})|\G)"
#: The base patterns. Possessive and anchored to the start of a run, they match
#: what the plain ones match, in linear time.
BASE = {
    "email": rf"{_NOT_AFTER_LOCAL}{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates for the classifier; a later kind gives way to an earlier one.
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:\[at\]|\(at\)|\{{at\}}) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.]))",
    "phone": r"(?<![0-9+)])(?<![0-9+)][\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\x20.-]?[0-9])|\+[0-9](?:[\x20().-]{0,3}[0-9]){6,8}(?![0-9])",
    "card": r"(?<![0-9./])[0-9]{4}(?:([./_])[0-9]{4}\1[0-9]{4}\1)[0-9]{2,7}(?![0-9./])|(?<![0-9])[0-9](?:[\x20-]?[0-9]){8,18}+(?![0-9])",
}
#: A literal that a text with a match holds; texts without it are not searched.
NEEDS = {"email": "@", "phone": "+"}
WIDE_NEEDS = {"email": "at"}
SECRET = r"(?i)\b((?:[a-z]+[_-])?(?:token|secret|password|passwd|api[_-]?key)\s{0,3}[=:]\s{0,3}\"?)[A-Za-z0-9+/_-]{16,}"
#: Code points within which another base span speaks for a candidate.
BESIDE = 160

# Gazetteers.
DOMAINS = "com org net edu gov mil int info biz io dev app eu de fr es it uk us ca at ch be nl pt br mx ar co"
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
ISSUERS = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|[68])|6(?:011|5|4[4-9])|35)"
# Words near a span that speak for its kind, and words that speak against any.
CUES = {
    "email": "mail|correo|courriel|contact|kontakt|contacto|write|schreib",
    "ip": r"\bip\b|server|host|address|adresse|login|client",
    "card": "card|karte|carte|tarjeta|visa|master|credit|pay|zahl",
    "phone": r"phone|\btel|call|fax|mobile|handy|anruf|appel|llam|whatsapp",
}
AGAINST = r"version|isbn|issn|doi|order no|invoice|serial|build|release|section|\bref\b"

LABELERS = ("shape", "length", "gazetteer", "near", "against", "beside", "edges")
ROUNDS = 12


def _ip_parts_fit(value: Column) -> Column:
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    at = F.sequence(F.lit(1), F.length(digits))

    def worth(i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(at, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """What a base match must pass."""
    if kind == "ip":
        return _ip_parts_fit(value)
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _placed(text: Column, values: Column, pattern: str, kind: str, base: bool) -> Column:
    """Array of candidate structs: the text between the matches gives their places in code points."""
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        a = acc["pos"] + F.length(x["gap"])
        b = a + F.length(x["value"])
        return F.struct(b.alias("pos"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), x["value"].alias("value")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    found = F.aggregate(pairs, start, add)["out"]
    if base:
        found = F.filter(found, lambda s: _holds(kind, s["value"]))

    def full(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("no"),
            s["end"].alias("end"),
            F.lit(base).alias("base"),
            s["value"].alias("value"),
            text.substr(F.greatest(s["start"] - 31, F.lit(1)), F.least(s["start"], F.lit(32))).alias("before"),
            text.substr(s["end"] + 1, F.lit(1)).alias("after"),
            F.lit(False).alias("beside"),
        )

    return F.transform(found, full)


def _clear_of(wide: Column, taken: Column) -> Column:
    """Candidates that overlap no span taken before."""
    meets = lambda w: F.exists(taken, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    return F.filter(wide, lambda w: ~meets(w))


_CANDIDATE = "array<struct<start:int,no:int,end:int,base:boolean,value:string,before:string,after:string,beside:boolean>>"


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__cands``: base spans and further candidates that overlap no base span."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    sets = [("b", BASE, NEEDS), ("w", WIDE, WIDE_NEEDS)]
    values = {}
    for tag, patterns, needs in sets:
        for kind, pattern in patterns.items():
            got = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
            values[f"__{tag}_{kind}"] = F.when(text.contains(needs[kind]), got).otherwise(none) if kind in needs else got
    docs = docs.withColumns(values)
    arrays = {}
    empty = F.array().cast(_CANDIDATE)
    for tag, patterns, _ in sets:
        for kind, pattern in patterns.items():
            v = F.col(f"__{tag}_{kind}")
            arrays[f"__{tag}_{kind}"] = F.when(F.size(v) > 0, _placed(text, v, pattern, kind, tag == "b")).otherwise(empty)
    docs = docs.withColumns(arrays).withColumn("__base", F.concat(*[F.col(f"__b_{kind}") for kind in KINDS])).withColumn("__cands", F.col("__base"))
    for kind in WIDE:
        wide = F.col(f"__w_{kind}")
        docs = docs.withColumn("__cands", F.when(F.size(wide) > 0, F.concat("__cands", _clear_of(wide, F.col("__cands")))).otherwise(F.col("__cands")))
    beside = lambda c: F.exists("__base", lambda b: (b["start"] != c["start"]) & (F.abs(b["start"] - c["start"]) <= BESIDE))
    marked = F.transform(F.array_sort("__cands"), lambda c: c.withField("beside", beside(c)))
    return docs.withColumn("__cands", F.when(F.size("__cands") > 1, marked).otherwise(F.col("__cands"))).drop("__base", *values)


def votes(c: Column) -> dict[str, Column]:
    """The labelers' votes on a candidate struct: 1, 0 or null to abstain."""
    value, before, digits = c["value"], F.lower(c["before"]), _digits(c["value"])
    by_kind = lambda *cases: F.when(c["no"] == 0, cases[0]).when(c["no"] == 1, cases[1]).when(c["no"] == 2, cases[2]).otherwise(cases[3])
    domain = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
    yes = lambda x: F.when(x, 1).otherwise(0)
    only = lambda x: F.when(x, 1)
    shape = by_kind(
        yes(domain.rlike("^[a-z]{2,10}$") & ~value.contains("..")),
        yes(value.contains(":") | value.rlike(r"^(?!0)(?:[1-9]?[0-9]?[0-9]\.?){4}$")),
        yes(_luhn(value) & F.length(digits).between(13, 19)),
        yes(F.length(digits).between(10, 13)),
    )
    length = F.when(c["no"] == 2, yes(F.length(digits).isin(15, 16))).when(c["no"] == 3, yes(F.length(digits).between(10, 12)))
    gazetteer = by_kind(
        only(domain.isin(*DOMAINS.split())),
        F.when(value.rlike(r"^(?:0|10|127|192\.168|169\.254|2(?:2[4-9]|[345][0-9]))\."), 0).otherwise(F.lit(1)),
        yes(digits.rlike(ISSUERS)),
        only(digits.rlike(f"^(?:{'|'.join(CALLING_CODES.split())})")),
    )
    near = only(by_kind(*(before.rlike(CUES[k]) for k in KINDS)))
    against = F.when(before.rlike(AGAINST), 0)
    edges = yes(before.rlike(r"(?:^|[\s(\[<\"':,;|])$") & c["after"].rlike(r"^(?:$|[\s)\]>\"':,;.!?|])"))
    return dict(zip(LABELERS, (shape, length, gazetteer, near, against, only(c["beside"]), edges), strict=True))


def features(c: Column) -> list[Column]:
    """Names of the discrete features that the classifier sees: shape and surroundings, not votes."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), c["no"] + 1)
    n, d = F.length(c["value"]), F.length(_digits(c["value"]))
    name = lambda what, x: F.concat(kind, F.lit(f"/{what}="), x.cast("string"))
    class_of = lambda x: F.when(x.rlike("^[A-Za-z]"), "letter").when(x.rlike("^[0-9]"), "digit").when(x.rlike(r"^\s"), "space").when(x == "", "none").otherwise("sign")
    return [
        name("length", F.least(F.floor(n / 4), F.lit(12))),
        name("digits", F.least(F.floor(d / 2), F.lit(10))),
        name("separator", F.regexp_extract(c["value"], r"([^A-Za-z0-9])", 1)),
        name("left", class_of(F.right(c["before"], F.lit(1)))),
        name("right", class_of(c["after"])),
        name("beside", c["beside"]),
    ]


@dataclass
class Model:
    """Reliabilities (yes if true, yes if false) by kind and labeler, priors by kind, log odds by feature."""

    reliability: dict[tuple[int, str], tuple[float, float]]
    prior: dict[int, float]
    log_odds: dict[str, float] = field(default_factory=dict)

    def posterior(self) -> Column:
        """Probability that a row with kind number ``no`` and vote columns is personal data."""
        score = F.lit(0.0)
        for no, p in self.prior.items():
            own = F.lit(math.log(p / (1 - p)))
            for name in LABELERS:
                t, f = self.reliability[no, name]
                own = own + F.when(F.col(name) == 1, math.log(t / f)).when(F.col(name) == 0, math.log((1 - t) / (1 - f))).otherwise(0.0)
            score = F.when(F.col("no") == no, own).otherwise(score)
        return 1 / (1 + F.exp(-score))

    def accepts(self, c: Column) -> Column:
        """The classifier's decision on a candidate struct."""
        start = F.lit(0.0)
        for no, p in self.prior.items():
            start = F.when(c["no"] == no, math.log(p / (1 - p))).otherwise(start)
        if not self.log_odds:
            return start > 0
        table = F.create_map(*[F.lit(x) for pair in sorted(self.log_odds.items()) for x in pair])
        return sum((F.coalesce(F.element_at(table, f), F.lit(0.0)) for f in features(c)), start) > 0


def _bounded(x: float) -> float:
    return min(max(x, 0.02), 0.98)


def train(cands: DataFrame) -> Model:
    """Reliabilities and classifier from saved rows with ``__cands``.

    The table of vote patterns has at most 3 rows to the power of the number
    of labelers for each kind; each round of expectation-maximisation is an
    aggregation of it. Without candidates the starting values stay.
    """
    rows = cands.select(F.explode("__cands").alias("c"))
    table = saved(rows.select(F.col("c.no").alias("no"), *[v.alias(k) for k, v in votes(F.col("c")).items()], F.array(*features(F.col("c"))).alias("features")).groupBy("no", *LABELERS, "features").agg(F.count(F.lit(1)).alias("n")))
    patterns = saved(table.groupBy("no", *LABELERS).agg(F.sum("n").alias("n")))
    model = Model({(no, name): (0.8, 0.3) for no in range(len(KINDS)) for name in LABELERS}, dict.fromkeys(range(len(KINDS)), 0.7))
    for _ in range(ROUNDS):
        weighed = patterns.withColumn("q", model.posterior())
        sums = []
        for name in LABELERS:
            voted, yes = F.col(name).isNotNull(), F.col(name) == 1
            for tag, when, share in (("ty", yes, F.col("q")), ("t", voted, F.col("q")), ("fy", yes, 1 - F.col("q")), ("f", voted, 1 - F.col("q"))):
                sums.append(F.sum(F.when(when, F.col("n") * share).otherwise(0.0)).alias(f"{name}_{tag}"))
        found = weighed.groupBy("no").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("q")).alias("q"), *sums).collect()
        if not found:
            return model
        rate = lambda a, b, was: _bounded((a + 8 * was) / (b + 8))  # noqa: E731  eight votes of prior belief
        for r in found:
            model.reliability |= {(r.no, k): (rate(r[f"{k}_ty"], r[f"{k}_t"], 0.8), rate(r[f"{k}_fy"], r[f"{k}_f"], 0.3)) for k in LABELERS}
        model.prior |= {r.no: _bounded((r.q + 5.6) / (r.n + 8)) for r in found}
    weighed = table.withColumn("q", model.posterior())
    by_feature = weighed.select("n", "q", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum(F.col("n") * F.col("q")).alias("t"), F.sum(F.col("n") * (1 - F.col("q"))).alias("f"))
    totals = {r.no: (r.t, r.f) for r in weighed.groupBy("no").agg(F.sum(F.col("n") * F.col("q")).alias("t"), F.sum(F.col("n") * (1 - F.col("q"))).alias("f")).collect()}
    for r in by_feature.collect():  # a few dozen shapes for each kind
        t, f = totals[KINDS.index(r.feature.partition("/")[0])]
        model.log_odds[r.feature] = math.log((r.t + 1) / (t + 8)) - math.log((r.f + 1) / (f + 8))
    return model


def with_spans(cands: DataFrame, model: Model) -> DataFrame:
    """Rows with ``__cands`` narrowed to the base spans and the accepted candidates."""
    return cands.withColumn("__cands", F.filter("__cands", lambda c: c["base"] | model.accepts(c)))


def _listed(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["no"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans, n_added, n_secret) of every row.

    ``base`` and ``spans`` list kind:start:end (code points, end exclusive) by
    start and kind; the first counts are of base spans, ``n_added`` of what the
    classifier adds. A null text counts as empty; repeated rows repeat; texts
    are searched whole, however long; of candidates at one place the earlier
    kind stays; columns of ``docs`` other than the two named are not read. An
    empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    narrow = saved(with_candidates(docs).select("id", "__cands", F.coalesce(F.regexp_count("text", F.lit(SECRET)), F.lit(0)).cast("long").alias("n_secret")))
    found = with_spans(narrow, train(narrow))
    base = F.filter("__cands", lambda c: c["base"])
    of_kind = lambda no: F.filter(base, lambda c: c["no"] == no)
    counts = [F.size(of_kind(no)).cast("long").alias(f"n_{kind}") for no, kind in enumerate(KINDS)]
    added = (F.size("__cands") - F.size(base)).cast("long").alias("n_added")
    return found.select("id", *counts, _listed(base).alias("base"), _listed(F.col("__cands")).alias("spans"), added, "n_secret")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and secrets by [SECRET].

    A null text stays null; other columns stay as they are.
    """
    columns = docs.columns
    # Written once with the texts: every pattern is searched once.
    held = saved(with_candidates(docs, text_col))
    found = with_spans(held, train(held))
    text = F.col(text_col)
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def add(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["out"], text.substr(acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0))), F.element_at(tags, s["no"] + 1))
        return F.when(s["start"] >= acc["pos"], F.struct(s["end"].alias("pos"), gap.alias("out"))).otherwise(F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out")))

    done = F.aggregate("__cands", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), add, lambda a: F.concat(a["out"], text.substr(a["pos"] + 1, F.length(text))))
    return found.withColumn(text_col, F.regexp_replace(F.when(F.size("__cands") > 0, done).otherwise(text), SECRET, "$1[SECRET]")).select(*columns)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document of the table."""
    found = personal_data(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "n_added", "n_secret")


QUERIES = {"op3_personal_data": op3_personal_data}
ORACLE_SQL: dict[str, str] = {}
