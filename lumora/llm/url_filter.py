"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes.

A rule is ``host + path`` (``net/``, ``example.net/en/``). It fits a URL when the URL's host is the rule's host or one of
its subdomains and the URL's path starts with the rule's path. Of several fitting rules the longest wins; of two equally
long ones (the same string with both verdicts) ``block`` wins.

Every URL is expanded into the expressions that a rule could equal: each suffix of the host at label borders, with each
prefix of the path whose length some rule has. Expressions meet the rules in an equi-join on the first bytes of their
SHA-256; the full digest then confirms the hit. The best hit is folded per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Hex digits of the digest that make the join key.
PREFIX_HEX = 8
#: Up to so many rules (about 150 bytes each, so 15 MB) the rule side is broadcast; beyond, the join is shuffled.
BROADCAST_RULES = 100_000
#: In the shuffled join, hot expressions are spread over so many copies of the rules.
SALTS = 32


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Judge every row of ``pages(page_id, url)`` by ``rules(rule, verdict)``.

    Returns page_id, host, path, rule, verdict, n_hits (rules that fit). Null or malformed URLs have an empty host and path
    and get ``default``; so does a URL that no rule fits. A rule with an empty host never fits (no expression is empty).
    """
    # the rule set is the small side by nature; its distinct path lengths and numbers of host labels bound the expansion
    slash = F.instr("rule", "/")
    rules = rules.where(F.col("rule").isNotNull()).select(
        "rule", F.coalesce("verdict", F.lit("block")).alias("rule_verdict"),
        F.when(slash > 0, F.length("rule") - slash + 1).otherwise(0).alias("path_len"),
        F.size(F.split(F.substring_index("rule", "/", 1), r"\.", -1)).alias("labels"), F.sha2("rule", 256).alias("digest"))
    stats = rules.agg(F.count("*").alias("n"), F.collect_set("path_len").alias("lengths"), F.collect_set("labels").alias("labels")).first()
    small, lengths, counts = stats.n <= broadcast_rules, sorted(stats.lengths), sorted(stats.labels)
    rules = rules.select("digest", "rule_verdict", F.substring("digest", 1, PREFIX_HEX).alias("prefix"))

    n_labels = F.length("host") - F.length(F.translate("host", ".", "")) + 1
    fitting = F.filter(F.lit(counts).cast("array<int>") if counts else F.array().cast("array<int>"), lambda k: k <= n_labels)
    suffixes = F.transform(fitting, lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    wanted = F.filter(F.lit(lengths).cast("array<int>") if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(wanted, lambda n: F.substring(F.col("path"), F.lit(1), n))
    rows = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("row", F.monotonically_increasing_id())
    exprs = rows.withColumn("suffix", F.explode_outer(suffixes)).withColumn("expr", F.explode_outer(F.transform(prefixes, lambda p: F.concat("suffix", p))))
    exprs = exprs.withColumn("sha", F.sha2("expr", 256)).withColumn("prefix", F.substring("sha", 1, PREFIX_HEX))
    if small:
        hits = exprs.join(F.broadcast(rules), "prefix", "left")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = exprs.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).join(salted, ["prefix", "salt"], "left")
    # rows of one URL are neighbours, so the partial aggregation folds them before the shuffle
    hit = F.when((F.col("digest") == F.col("sha")) & (F.col("suffix") != ""), F.struct(F.length("expr").alias("n"), F.col("rule_verdict"), F.col("expr")))
    best = hits.groupBy("row", "page_id", "host", "path").agg(F.max(hit).alias("best"), F.count(hit).alias("n_hits"))
    return best.select("page_id", "host", "path", F.col("best.expr").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"), "n_hits")
