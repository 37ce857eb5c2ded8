from attestry.llm.quality import frequent_lines, quality_rules


def test_template_lines_count_every_distinct_document(spark):
    shared = [f"Navigation entry {chr(97 + i)} of the site" for i in range(10)]
    docs = [(i, "\n".join([*shared, "own " + "".join(chr(97 + int(c)) for c in str(i))]), "host") for i in range(150)]
    docs += [(1000 + i, "\n".join([*shared, "own a"]), "host") for i in range(40)]  # copies of document 0
    docs += [(2000 + i, "one line\nand another", "copied") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert sorted(r.n_docs for r in frequent_lines(df).collect()) == [150] * 10
    removed = {r.doc_id: r.n_lines_removed for r in quality_rules(df).collect()}
    assert all(n == (0 if i >= 2000 else 10) for i, n in removed.items())
