"""URL filters by the ratio of two character language models.

The urls that the rules allow train one model, those that they block another.
Both are variable-order Markov models: a character is predicted from the
longest context of up to ORDER - 1 characters that was seen often enough, and
each order is smoothed by the next lower one. The weight of a gram is what its
order adds to the log-likelihood difference of the next lower order, so the
sum of the weights of all grams of a url is its difference, which is divided by
its length. The threshold is calibrated on a fifth of the ruled urls that took
no part in the training. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.runtime import saved
from attestry.sources.tables import read_table

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
ORDER, MIN_COUNT, SMOOTHING, ALPHABET = 4, 3, 4.0, 128
#: The model is broadcast up to this many grams (about 40 bytes each), joined by shuffle beyond.
BROADCAST_GRAMS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; of equals the first."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def grams(url: Column) -> Column:
    """All grams of 1 to ORDER characters that end at a character of the url."""
    pad = "\x02" * (ORDER - 1)
    padded = F.concat(F.lit(pad), url)
    each = lambda k: F.transform(F.sequence(F.lit(1), F.length(url)), lambda i: padded.substr(i + (ORDER - k), F.lit(k)))
    return F.when(F.length(url) > 0, F.flatten(F.array(*[each(k) for k in range(1, ORDER + 1)]))).otherwise(F.array().cast("array<string>"))


def _fold(url: Column) -> Column:
    return F.conv(F.substring(F.md5(url), 1, 8), 16, 10).cast("long") % 5


def _spread(urls: DataFrame) -> DataFrame:
    """Urls are short and give hundreds of grams each: they are dealt to all tasks before."""
    return urls.repartition(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def gram_weights(urls: DataFrame) -> DataFrame:
    """(gram, weight) learnt from (url, accepted)."""
    rows = _spread(urls).select(F.col("accepted"), F.explode(grams(F.col("url"))).alias("gram"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    counts = saved(rows.groupBy("gram").agg(one(F.col("accepted"))("a"), one(~F.col("accepted"))("r")).filter(F.col("a") + F.col("r") >= MIN_COUNT))
    below, weights = None, None
    for k in range(1, ORDER + 1):
        level = counts.filter(F.length("gram") == k).withColumn("context", F.substring("gram", 1, k - 1)).withColumn("shorter", F.substring("gram", 2, k))
        totals = level.groupBy("context").agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
        level = level.join(totals, "context")
        if below is None:
            level = level.withColumn("la", F.lit(1.0 / ALPHABET)).withColumn("lr", F.lit(1.0 / ALPHABET))
        else:
            level = level.join(below.select(F.col("gram").alias("shorter"), F.col("pa").alias("la"), F.col("pr").alias("lr")), "shorter")
        smooth = lambda n, t, low: (F.col(n) + SMOOTHING * F.col(low)) / (F.col(t) + SMOOTHING)
        below = level.select("gram", smooth("a", "ta", "la").alias("pa"), smooth("r", "tr", "lr").alias("pr"), "la", "lr")
        own = below.select("gram", (F.log("pa") - F.log("pr") - F.log("la") + F.log("lr")).alias("weight"))
        weights = own if weights is None else weights.unionByName(own)
    return saved(weights)


def scores(urls: DataFrame, weights: DataFrame) -> DataFrame:
    """(url, score) of distinct urls: mean weight by character; 0 without a known gram."""
    distinct = urls.select("url").filter(F.length("url") > 0).distinct()
    table = F.broadcast(weights) if weights.count() <= BROADCAST_GRAMS else weights
    found = _spread(distinct).select("url", F.explode(grams(F.col("url"))).alias("gram")).join(table, "gram", "left")
    return found.groupBy("url").agg(F.round(F.coalesce(F.sum("weight"), F.lit(0.0)) / F.length("url"), 6).alias("score"))


def threshold(ruled: DataFrame, scored: DataFrame) -> float:
    """The cut, in hundredths, of least balanced error over (url, accepted); 0 if a class is absent."""
    # Scores lie in a few hundreds of hundredths, whatever the input.
    bins = ruled.join(scored, "url").groupBy(F.floor(F.col("score") * 100).alias("cut")).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    order = Window.orderBy("cut")
    lost = F.sum("a").over(order.rowsBetween(Window.unboundedPreceding, -1))
    passed = F.sum("r").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    errors = bins.select("cut", F.coalesce(lost, F.lit(0)).alias("lost"), passed.alias("passed"), F.sum("a").over(every).alias("ta"), F.sum("r").over(every).alias("tr")).filter("ta > 0 AND tr > 0")
    best = errors.select("cut", F.round(F.col("lost") / F.col("ta") + F.col("passed") / F.col("tr"), 9).alias("error")).orderBy("error", F.abs("cut"), "cut").first()
    return best.cut / 100 if best else 0.0


def filter_urls(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (columns of these names are replaced).

    A rule decides where one fits. Else the score decides: allow from the
    threshold on. A null or empty url is blocked. Repeated rows get equal
    verdicts, an empty table gives an empty result; without ruled urls of both
    kinds every score is compared with 0. Urls are scored whole, however long.
    """
    host, path = host_and_path(F.col(url_col))
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    pages = pages.drop(*[c for c in ("host", "path", "rule", "verdict", "score", "__url") if c in pages.columns and c != url_col])
    pages = pages.withColumn("__url", F.coalesce(F.col(url_col), F.lit(""))).withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("verdict", ruled)
    known = saved(pages.filter(F.col("verdict").isNotNull()).select(F.col("__url").alias("url"), (F.col("verdict") == "allow").alias("accepted")).distinct())
    weights = gram_weights(known.filter(_fold(F.col("url")) != 0))
    found = saved(scores(pages.select(F.col("__url").alias("url")), weights))
    cut = threshold(known.filter(_fold(F.col("url")) == 0), found)
    judged = pages.join(found.withColumnRenamed("url", "__url"), "__url", "left").drop("__url")
    own = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return judged.withColumn("verdict", F.coalesce("verdict", own))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page of the table."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    case = lambda part: "CASE " + " ".join(f"WHEN (host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN '{t if part else v}'" for v, t in sorted(RULES, key=lambda r: -len(r[1]))) + " END"
    pad = f"repeat(chr(2), {ORDER - 1})"
    levels, weights = [], []
    for k in range(1, ORDER + 1):
        low = f"{1.0 / ALPHABET}" if k == 1 else None
        levels.append(f"""p{k} AS (
  SELECT c.gram, (c.a + {SMOOTHING} * {low or 's.pa'}) / (t.ta + {SMOOTHING}) AS pa, (c.r + {SMOOTHING} * {low or 's.pr'}) / (t.tr + {SMOOTHING}) AS pr, {low or 's.pa'} AS la, {low or 's.pr'} AS lr
  FROM counts c JOIN (SELECT gram[:{k - 1}] AS context, sum(a) AS ta, sum(r) AS tr FROM counts WHERE length(gram) = {k} GROUP BY 1) t ON c.gram[:{k - 1}] = t.context
  {'' if k == 1 else f'JOIN p{k - 1} s ON s.gram = c.gram[2:]'} WHERE length(c.gram) = {k}
)""")
        weights.append(f"SELECT gram, ln(pa) - ln(pr) - ln(la) + ln(lr) AS weight FROM p{k}")
    return f"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), ruled AS (
  SELECT *, {case(True)} AS rule, {case(False)} AS v FROM h
), known AS (
  SELECT DISTINCT url, v = 'allow' AS accepted, ('0x' || md5(url)[1:8])::BIGINT % 5 AS fold FROM ruled WHERE v IS NOT NULL
), ends AS (
  SELECT url, {pad} || url AS padded, unnest(range(1, length(url) + 1)) AS i FROM (SELECT DISTINCT url FROM ruled)
), g AS (
  SELECT url, unnest([{', '.join(f'substring(padded, i + {ORDER - k}, {k})' for k in range(1, ORDER + 1))}]) AS gram FROM ends
), counts AS (
  SELECT gram, count(*) FILTER (WHERE accepted) AS a, count(*) FILTER (WHERE NOT accepted) AS r FROM g JOIN known USING (url) WHERE fold <> 0
  GROUP BY gram HAVING count(*) >= {MIN_COUNT}
), {', '.join(levels)}, weights AS (
  {' UNION ALL '.join(weights)}
), scored AS (
  SELECT url, round(coalesce(sum(weight), 0) / length(url), 6) AS score FROM g LEFT JOIN weights USING (gram) GROUP BY url
), bins AS (
  SELECT floor(score * 100) AS cut, count(*) FILTER (WHERE accepted) AS a, count(*) FILTER (WHERE NOT accepted) AS r FROM known JOIN scored USING (url) WHERE fold = 0 GROUP BY 1
), errors AS (
  SELECT cut, coalesce(sum(a) OVER (ORDER BY cut ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(a) OVER () + sum(r) OVER (ORDER BY cut ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / sum(r) OVER () AS error FROM bins
), best AS (
  SELECT coalesce((SELECT cut / 100 FROM errors WHERE error IS NOT NULL ORDER BY round(error, 9), abs(cut), cut LIMIT 1), 0) AS cut
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled LEFT JOIN scored USING (url) CROSS JOIN best
"""


ORACLE_SQL = {"op9_url_filters": _oracle()}
QUERIES = {"op9_url_filters": op9_url_filters}
