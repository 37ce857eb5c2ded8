from pyspark.sql import functions as F

from attestry.llm.urls import longest_rule


def test_of_equal_rules_the_first_wins(spark):
    df = spark.createDataFrame([("a.com", "/x")], "host string, path string")
    for rules in ((("allow", "com/"), ("block", "com/")), (("block", "com/"), ("allow", "com/"), ("block", "com/y"))):
        rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
        assert tuple(df.select(rule, verdict).first()) == ("com/", rules[0][0])
