"""URL filters: rules on hosts and paths, and gradient-boosted trees on lexical features for what no rule judges.

A rule is (verdict, host and path); it fits its host and all subdomains if the path starts as the rule's;
the longest wins (then the least, in ASCII). URLs that a rule judges are the labelled ones. Trees are fitted
on a bounded, repeatable sample of distinct labelled URLs (`sample`, those of least hash) and applied to all rows
by column expressions and the model's own transformation: no Python, no Arrow, and only URLs are read.

Features: lengths of URL, host and path; depth; labels of the host; ratio of digits, in all and in the path; entropy
of characters; counts of parameters, hyphens and escapes; a fragment; and of the suffix (last label of the host) the
smoothed share of blocked URLs and the number of URLs in the sample. The table of suffixes is part of the model and
has at most `sample` rows, so it is broadcast.

Defined results: a null URL, or one without "://", has an empty host and path and is judged by the trees on
what characters it has; where labelled URLs of one kind are missing there are no trees and the verdict is that
of the kind there is (allow, if there is none); repeated rows and null ids each keep a row; other columns are
carried in `row`, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import load

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEXICAL = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "path_digit_ratio", "entropy", "parameters", "hyphens", "escapes", "fragment"]
#: Weight of the overall share of blocked URLs in a suffix's own.
PRIOR = 10


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, UPPER.lower()), F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the rule that fits and wins, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):  # the last one asked wins
        own_host, slash, own_path = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def _entropy(text: Column) -> Column:
    """Bits a character; characters outside ASCII count as one."""
    plain = F.regexp_replace(text, "[^\\x00-\\x7F]", "ÿ")
    n = F.length(plain).cast("double")
    share = F.transform(F.array_distinct(F.split(plain, "")), lambda c: F.when(c != "", (n - F.length(F.replace(plain, c, F.lit("")))) / n))
    return F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def lexical(rows: DataFrame) -> DataFrame:
    """rows (url, host, path and others) with the features that one URL gives, and its suffix."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, "(?s)^[^?#]*\\?([^#]*)", 1)
    ratio = lambda text: F.when(F.length(text) > 0, _count(text, "[0-9]") / F.length(text)).otherwise(0.0)
    made = {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "depth": _count(path, "[^/]") * -1 + F.length(path), "labels": F.when(host != "", 1 + _count(host, "[.]")).otherwise(0.0),
        "digit_ratio": ratio(url), "path_digit_ratio": ratio(path), "entropy": _entropy(url),
        "parameters": F.when(query != "", 1 + _count(query, "[&;]")).otherwise(0.0), "hyphens": _count(url, "[-]"), "escapes": _count(url, "%"),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
    }
    return rows.select("*", *(made[c].cast("double").alias(c) for c in LEXICAL), F.substring_index("host", ".", -1).alias("suffix"))


class UrlModel:
    """Boosted trees and the suffixes that they know; trees is None where labels of one kind are missing."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: DataFrame | None, share: float):
        self.trees, self.suffixes, self.share = trees, suffixes, share

    def features(self, rows: DataFrame) -> DataFrame:
        known = rows.join(F.broadcast(self.suffixes), "suffix", "left")
        known = known.withColumn("suffix_share", F.coalesce("suffix_share", F.lit(self.share))).withColumn("suffix_n", F.coalesce("suffix_n", F.lit(0.0)))
        return VectorAssembler(inputCols=[*LEXICAL, "suffix_share", "suffix_n"], outputCol="features").transform(known)

    def blocked(self, rows: DataFrame) -> DataFrame:
        """rows (of `lexical`) with `blocked`, whether the URL is more likely blocked than not."""
        if self.trees is None:
            return rows.withColumn("blocked", F.lit(self.share > 0.5))
        return self.trees.transform(self.features(rows)).withColumn("blocked", F.col("prediction") > 0.5)


def fit(labelled: DataFrame, sample: int = 20_000, trees: int = 20, depth: int = 4, seed: int = 2024) -> UrlModel:
    """Fit on labelled URLs (url, blocked): on `sample` distinct ones at most, those of least hash."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("url IS NOT NULL").groupBy("url").agg(F.max("blocked").alias("blocked"))
    rows = rows.orderBy(F.xxhash64(F.lit(seed), "url"), "url").limit(sample)  # one bounded partition, in one order
    rows = lexical(rows.select("url", F.col("blocked").cast("double").alias("label"), host.alias("host"), path.alias("path"))).persist()
    try:
        kinds = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
        share = kinds.get(1.0, 0) / max(1, sum(kinds.values()))
        if len(kinds) < 2:
            return UrlModel(None, None, share)
        stats = rows.groupBy("suffix").agg(F.sum("label").alias("bad"), F.count("*").cast("double").alias("suffix_n"))
        stats = stats.select("suffix", ((F.col("bad") + PRIOR * share) / (F.col("suffix_n") + PRIOR)).alias("suffix_share"), "suffix_n")
        table = rows.sparkSession.createDataFrame(stats.collect(), stats.schema)  # `sample` rows at most
        model = UrlModel(None, table, share)
        model.trees = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label").fit(model.features(rows))
        return model
    finally:
        rows.unpersist()


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", carry: list[str] | None = None, **fitting) -> DataFrame:
    """row (a struct of the columns in carry, all by default), host, path, rule, verdict and by_rule."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.struct(*[pages[c] for c in carry or pages.columns]).alias("row"), pages[url_col].cast("string").alias("url"))
    rows = rows.select("row", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("won", rule_of(F.col("host"), F.col("path"), rules))
    model = fit(rows.where("won IS NOT NULL").select("url", (F.col("won.verdict") == "block").cast("int").alias("blocked")), **fitting)
    judged = model.blocked(lexical(rows))
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    return judged.select("row", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", own).alias("verdict"), F.col("won").isNotNull().alias("by_rule"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages"), RULES, carry=["page_id"]).select("row.page_id", "host", "path", "rule", "verdict")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12 without the trees' verdicts, which SQL lacks."""
    out = judge_urls(load(spark, sf_dir, "pages"), RULES, carry=["page_id"])
    return out.select("row.page_id", "host", "path", "rule", F.when(F.col("by_rule"), F.col("verdict")).alias("verdict"))


_AFTER = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END"
_VALUES = ", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for v, r in RULES)
ORACLE_RULES = f"""
WITH u AS (SELECT page_id, row_number() OVER () AS r, translate(regexp_extract(a, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, {_AFTER} AS a FROM pages)),
rules(verdict, h, p, rule) AS (VALUES {_VALUES}),
f AS (SELECT u.r, rules.rule, rules.verdict, row_number() OVER (PARTITION BY u.r ORDER BY length(rules.rule) DESC, rules.rule) AS k FROM u JOIN rules ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p))
SELECT page_id, host, path, rule, verdict FROM u LEFT JOIN f ON u.r = f.r AND f.k = 1
"""
