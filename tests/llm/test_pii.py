import hashlib
import random
import re

from pyspark.sql import functions as F

from attestry.llm.pii import personal_data, redact, train, with_candidates

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    s = 0
    for i, d in enumerate(map(int, reversed(digits))):
        s += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return s % 10 == 0


def slow_base(text):
    found = []
    for no, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), no, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def card(rng, n, sep):
    digits = [rng.randrange(10) for _ in range(n - 1)]
    digits += [next(d for d in range(10) if luhn([*digits, d]))]
    return "".join(str(d) + (sep if i % 4 == 3 and i < n - 1 else "") for i, d in enumerate(digits))


def test_base_spans_match_the_plain_patterns(spark):
    rng = random.Random(5)
    bits = ["a@b.co", "a@b.co%d@e.fr", ".x@y-z.a.b", "@", "a@b", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.4", "0000.0.0.0", "1.2.3", "+1 (555) 555-0101", "+12", "+1((((((", "+49.30.1234567-8", "ü", "é", "😀", " ", "\n", "-", "12 - 34", "word", "1 2 3"]
    texts = ["".join(rng.choice([*bits, card(rng, rng.randrange(12, 22), rng.choice(["", " ", "-"]))]) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    texts += [None, "", "x" * 50_000, "1" * 20_000, "a@" + "b." * 5000 + "c", "+1" * 3000, "(" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r for r in personal_data(df).collect()}
    for i, text in enumerate(texts):
        want = slow_base(text)
        assert got[i].base == want, (text, got[i].base, want)
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
        assert got[i].n_email + got[i].n_ip + got[i].n_card + got[i].n_phone == len(list(filter(None, want.split(","))))
    assert hashlib.sha256(b"").hexdigest()


def test_method_adds_disguised_spans_and_redacts(spark):
    rows = [(i, f"Write to me at mail user{i}@example.com or call +1 555 555 01{i:02d} now") for i in range(40)]
    rows += [(100, "My mail: jane.doe [at] example [dot] com, thanks"), (101, "phone (555) 123-4567."), (102, None), (103, "é +1 (555) 555-0101 a@b.co ü")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.spans for r in personal_data(df).collect()}
    assert got[100] == "email:9:40" and got[101].startswith("phone:6:") and got[102] == ""
    clean = {r.doc_id: r.text for r in redact(df).collect()}
    assert clean[103] == "é [PHONE] [EMAIL] ü" and clean[102] is None and clean[100] == "My mail: [EMAIL], thanks"
    assert personal_data(df.limit(0)).count() == 0


def test_classifier_decides_on_near_misses_of_the_documents(spark, tmp_path):
    """Numbers of card length without the check sum are added, digit runs inside keys are not."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = with_candidates(docs).select("__cands")
    held.write.mode("overwrite").parquet(path := f"{tmp_path}/c")
    held = spark.read.parquet(path)
    model = train(held)
    rows = held.select(F.explode("__cands").alias("c")).filter("NOT c.base").select("c.*", model.accepts(F.col("c")).alias("yes")).collect()
    cards = [r for r in rows if r.no == 2 and len(r.value) == 16 and not (r.before[-1:].isalnum() or r.after.isalnum())]
    inside = [r for r in rows if r.no == 2 and (r.before[-1:].isalpha() or r.after.isalpha())]
    assert len(cards) > 5 and sum(r.yes for r in cards) >= 0.9 * len(cards)
    assert len(inside) > 5 and sum(r.yes for r in inside) <= 0.1 * len(inside)


def test_withheld_base_spans_are_found_again(spark, tmp_path):
    """Half of the base spans stand as further candidates; the classifier accepts nine of ten of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = with_candidates(docs).select(F.transform("__cands", lambda c: c.withField("base", c["base"] & (c["start"] % 2 == 0))).alias("__cands"), F.col("__cands").alias("was"))
    held.write.mode("overwrite").parquet(path := f"{tmp_path}/w")
    held = spark.read.parquet(path)
    model = train(held.select("__cands"))
    rows = held.select(F.explode(F.arrays_zip("__cands", "was")).alias("z")).filter("z.was.base AND NOT z.__cands.base").select(model.accepts(F.col("z.__cands")).alias("yes")).collect()
    assert len(rows) > 20 and sum(r.yes for r in rows) >= 0.9 * len(rows)


def test_secrets_are_counted_and_redacted(spark):
    df = spark.createDataFrame([(1, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y'), (2, None), (3, "api_key: abc")], "doc_id long, text string")
    assert {r.id: r.n_secret for r in personal_data(df).collect()} == {1: 1, 2: 0, 3: 0}
    assert {r.doc_id: r.text for r in redact(df).collect()} == {1: 'x token = "[SECRET]" y', 2: None, 3: "api_key: abc"}
