"""URL filters: allow and block rules, and a character language-model ratio for the rest.

DataFrame and SQL operations only. URLs that a rule fits are the training set:
allowed ones for the first model, blocked ones for the second. Each model is a
variable-order Markov chain over a folded alphabet of at most 64 symbols: the
chance of a symbol after two symbols is smoothed by the chance after one, that
by the plain chance, and that by a uniform one, with weights that grow with
how often the context was seen. The difference of the two log-likelihoods,
divided by the number of symbols, is held against a threshold calibrated on
the training URLs.

The model has at most 64**3 rows, whatever the input, and so can be broadcast;
training counts are pre-aggregated by trigram before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, staged

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Symbols kept as they are; digits fold to 0 and all others to *.
KEPT = "a-z0./:?=&#%_+~-"
#: Pseudo-count of the shorter context, and the size of the alphabet with the start and end marks.
BACKOFF, SYMBOLS = 2.0, 44


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def trigrams(url: Column) -> Column:
    """Array of the folded url's trigrams, with two start marks and an end mark; empty for null and empty urls."""
    folded = F.regexp_replace(F.translate(url, UPPER + "123456789", UPPER.lower() + "0" * 9), f"[^{KEPT}]", "*")
    marked = F.split(F.concat(F.lit("^^"), folded, F.lit("$")), "")
    n = F.greatest(F.lit(0), F.size(marked) - 2)
    first, second, third = (F.slice(marked, k, n) for k in (1, 2, 3))  # each evaluates the split once, not once for each symbol
    grams = F.zip_with(F.zip_with(first, second, lambda a, b: F.concat(a, b)), third, lambda a, b: F.concat(a, b))
    return F.when(F.length(url) > 0, grams).otherwise(F.array().cast("array<string>"))


LEVELS = """
  SELECT g.gram, {sides} FROM (SELECT DISTINCT gram FROM {{counts}}) g
  LEFT JOIN (SELECT gram, {n} FROM {{counts}} GROUP BY gram) t ON t.gram = g.gram
  LEFT JOIN (SELECT left(gram, 2) AS k, {n} FROM {{counts}} GROUP BY 1) t_ctx ON t_ctx.k = left(g.gram, 2)
  LEFT JOIN (SELECT right(gram, 2) AS k, {n} FROM {{counts}} GROUP BY 1) b ON b.k = right(g.gram, 2)
  LEFT JOIN (SELECT substr(gram, 2, 1) AS k, {n} FROM {{counts}} GROUP BY 1) b_ctx ON b_ctx.k = substr(g.gram, 2, 1)
  LEFT JOIN (SELECT right(gram, 1) AS k, {n} FROM {{counts}} GROUP BY 1) u ON u.k = right(g.gram, 1)
  CROSS JOIN (SELECT {n} FROM {{counts}}) u_ctx
"""


def ratio_sql() -> str:
    """SQL over {counts} (gram, allowed, blocked): gram and the log ratio of its chances in both models."""

    def log_chance(side: str) -> str:
        chance = f"(1D / {SYMBOLS})"
        for level in ("u", "b", "t"):
            chance = f"((coalesce({level}.{side}, 0) + {BACKOFF}D * {chance}) / (coalesce({level}_ctx.{side}, 0) + {BACKOFF}D))"
        return f"ln({chance})"

    return LEVELS.format(sides=f"{log_chance('allowed')} - {log_chance('blocked')} AS ratio", n="sum(allowed) AS allowed, sum(blocked) AS blocked")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict, score and threshold for every row of pages (page_id, url).

    score is the length-normalised log-likelihood difference, null for null and
    empty urls; without a rule those are blocked, as nothing speaks for them.
    Others are allowed when the score reaches the threshold, which lies
    between the mean scores of the allowed and the blocked training URLs, nearer to
    the class that varies less. If the rules allow or block no URL at all,
    there is no ratio to judge by, and URLs without a rule are allowed. Rows with equal page_id or
    url are judged one by one, null ids too; an empty table gives an empty
    result. Other columns of pages are ignored."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    labelled = ruled.where("by_rule IS NOT NULL").select("by_rule", F.explode(trigrams(F.col("url"))).alias("gram"))
    of = lambda what: F.count(F.when(F.col("by_rule") == what, 1))
    seen = labelled.groupBy("gram").agg(of("allow").alias("allowed"), of("block").alias("blocked"))
    every = ruled.where("by_rule IS NULL").select(F.explode(trigrams(F.col("url"))).alias("gram")).distinct()
    counts = staged(
        seen.unionByName(every.select("gram", F.lit(0).cast("long").alias("allowed"), F.lit(0).cast("long").alias("blocked")))
        .groupBy("gram")
        .agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    )
    model = spark.sql(ratio_sql(), counts=counts)
    numbered = ruled.withColumn("row", F.monotonically_increasing_id())
    grams = numbered.select("*", F.explode_outer(trigrams(F.col("url"))).alias("gram"))
    scored = staged(
        grams.join(F.broadcast(model), "gram", "left")  # at most SYMBOLS ** 3 rows
        .groupBy("row", "page_id", "url", "host", "path", "rule", "by_rule")
        .agg(F.avg("ratio").alias("score"))
        .drop("row")
    )
    mean, spread = (lambda w: F.avg(F.when(F.col("by_rule") == w, F.col("score")))), (lambda w: F.stddev_pop(F.when(F.col("by_rule") == w, F.col("score"))))
    classes = scored.agg(mean("allow").alias("a"), spread("allow").alias("sa"), mean("block").alias("b"), spread("block").alias("sb"))
    between = F.coalesce(F.try_divide(F.col("a") * F.col("sb") + F.col("b") * F.col("sa"), F.col("sa") + F.col("sb")), (F.col("a") + F.col("b")) / 2)
    threshold = classes.select(between.alias("threshold"))
    by_method = (
        F.when(F.col("score").isNull(), "block")
        .when(F.col("threshold").isNull() | (F.round("score", 9) >= F.round("threshold", 9)), "allow")
        .otherwise("block")
    )
    return scored.crossJoin(F.broadcast(threshold)).select("page_id", "url", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), F.round("score", 6).alias("score"))


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


def _duckdb() -> str:
    lower, cases_rule, cases_verdict = UPPER.lower(), "", ""
    for what, text in sorted(RULES, key=lambda r: -len(r[1])):
        name, slash, start = text.partition("/")
        fits = f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{start}') THEN "
        cases_rule, cases_verdict = cases_rule + fits + f"'{text}' ", cases_verdict + fits + f"'{what}' "
    return f"""
WITH rest AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT row_number() OVER () AS row, *, CASE {cases_rule} END AS rule, CASE {cases_verdict} END AS by_rule FROM parsed),
marked AS (SELECT *, '^^' || regexp_replace(translate(url, '{UPPER}123456789', '{lower}000000000'), '[^{KEPT}]', '*', 'g') || '$' AS m FROM ruled),
grams AS (SELECT row, by_rule, unnest(list_transform(range(1, length(m) - 1), lambda i: substr(m, i, 3))) AS gram FROM marked WHERE length(url) > 0),
counts AS (SELECT gram, CAST(count(*) FILTER (by_rule = 'allow') AS BIGINT) AS allowed, CAST(count(*) FILTER (by_rule = 'block') AS BIGINT) AS blocked FROM grams GROUP BY gram),
total AS (SELECT sum(allowed) AS a, sum(blocked) AS b FROM counts),
last AS (SELECT right(gram, 1) AS c, sum(allowed) AS a, sum(blocked) AS b FROM counts GROUP BY 1),
middle AS (SELECT substr(gram, 2, 1) AS c, sum(allowed) AS a, sum(blocked) AS b FROM counts GROUP BY 1),
ends AS (SELECT right(gram, 2) AS g, sum(allowed) AS a, sum(blocked) AS b FROM counts GROUP BY 1),
starts AS (SELECT left(gram, 2) AS g, sum(allowed) AS a, sum(blocked) AS b FROM counts GROUP BY 1),
plain AS (SELECT c, (last.a + 2 / 44.0::DOUBLE) / (total.a + 2) AS a, (last.b + 2 / 44.0::DOUBLE) / (total.b + 2) AS b FROM last, total),
pair AS (SELECT g, (ends.a + 2 * plain.a) / (middle.a + 2) AS a, (ends.b + 2 * plain.b) / (middle.b + 2) AS b FROM ends JOIN plain ON plain.c = right(g, 1) JOIN middle ON middle.c = left(g, 1)),
model AS (SELECT gram, ln((allowed + 2 * pair.a) / (starts.a + 2)) - ln((blocked + 2 * pair.b) / (starts.b + 2)) AS ratio FROM counts JOIN pair ON pair.g = right(gram, 2) JOIN starts ON starts.g = left(gram, 2)),
scored AS (SELECT r.page_id, r.host, r.path, r.rule, r.by_rule, s.score FROM ruled r LEFT JOIN (SELECT row, avg(ratio) AS score FROM grams JOIN model USING (gram) GROUP BY row) s ON s.row = r.row),
classes AS (SELECT avg(score) FILTER (by_rule = 'allow') AS a, stddev_pop(score) FILTER (by_rule = 'allow') AS sa, avg(score) FILTER (by_rule = 'block') AS b, stddev_pop(score) FILTER (by_rule = 'block') AS sb FROM scored),
cut AS (SELECT CASE WHEN sa + sb > 0 THEN (a * sb + b * sa) / (sa + sb) ELSE (a + b) / 2 END AS threshold FROM classes)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN score IS NULL THEN 'block' WHEN threshold IS NULL OR round(score, 9) >= round(threshold, 9) THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score
FROM scored, cut
"""


OP10_SQL = _duckdb()
