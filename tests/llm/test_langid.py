from pyspark.sql import functions as F

from attestry.llm.langid import op6_language_id, predict_language, train


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    found = op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out AND lang_pred <> 'und'")
    right, n = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count(F.lit(1))).first()
    assert n > 20 and right > 0.95


def test_edge_rows(spark):
    rows = [(1, "the cat and the dog", "en", 1), (2, None, "en", 1), (3, "12 !?", "fr", 1), (4, "", None, 1), (None, "le chat et le chien", "fr", 1), (5, "the hat", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.id: (r.lang_pred, r.score) for r in predict_language(df, train(df.select("lang", "text"))).collect()}
    assert got[2] == got[3] == got[4] == ("und", 0.0) and got[1][0] == "en" and got[None][0] == "fr" and 0 <= got[5][1] <= 1
    empty = df.limit(0)
    assert predict_language(empty, train(empty.select("lang", "text"))).count() == 0
    assert {r.lang_pred for r in predict_language(df, train(empty.select("lang", "text"))).collect()} == {"und"}


def test_very_long_and_repeated_rows(spark):
    known = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog that sat", "en"), ("le chat et le chien qui dort", "fr"), ("der hund und die katze", "de"), ("el perro y el gato", "es")] * 5)]
    models = train(spark.createDataFrame(known, "doc_id long, text string, lang string").select("lang", "text"))
    rows = [(1, "the cat and the dog that sat " * 50_000), (2, "le chat et le chien"), (2, "le chat et le chien"), (3, "x" * 1_000_000)]
    got = predict_language(spark.createDataFrame(rows, "doc_id long, text string"), models).collect()
    assert len(got) == 4 and [r.lang_pred for r in got if r.id == 1] == ["en"]
    assert len({tuple(r) for r in got if r.id == 2}) == 1 and [r.lang_pred for r in got if r.id == 2] == ["fr", "fr"]
