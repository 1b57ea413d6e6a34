"""URL filtering: given rules first, else association rules that Spark's FP-growth mines from labels. No Python in tasks.

Tokens of a URL are its host's labels and registrable suffixes, its path's segments and its query's keys; a number counts
as one token whatever it is. Labelled URLs and a class item are the transactions. Rules come from the frequent itemsets that
hold the class item, divided by the frequency of the same set without it; they stay if they reach ``support`` and
``confidence``. A rule goes if a part of its tokens has a rule of the same verdict that is as confident: where it fits, the
other one fits too and wins or ties, so no verdict changes. Each rule left is filed in an inverted index under its token that
fewest labelled URLs have. A distinct URL meets only the rules filed under one of its tokens, and those whose other tokens it
also has fit. Of fitting rules the most confident one decides (then support, then block before allow); without any, the
verdict is allow. Rules are ranked once, so that the decision is the greatest rank, a number.

The number of rules is bounded by the relative support, not by the pages: it is checked, and only up to
``BROADCAST_RULES`` rules of ``BROADCAST_TOKENS`` tokens in all the index is broadcast; beyond that both sides shuffle by
token. A URL that many pages share is decided once; pages then meet the decided URLs in a join that can be split.

Defined cases: null URLs and those without :// have an empty host and path and no tokens; repeated rows each give a row;
without labelled pages there are no mined rules; a URL of any length is one row; other columns are never read; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD, GOOD = "class:block", "class:allow"
BROADCAST_RULES, BROADCAST_TOKENS = 20_000, 200_000
SUPPORT = 0.005
CONFIDENCE = 0.6
#: (verdict, host and path)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict), null if none fits; the longest rule wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens; each names the part it comes from."""
    def named(part: str, pieces: Column) -> Column:
        short = F.transform(F.filter(pieces, lambda x: x != ""), lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x))
        return F.transform(short, lambda x: F.concat(F.lit(part), x))

    labels = F.split(host, r"\.")
    suffix = F.substring_index(host, ".", -2)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    words = F.split(F.lower(path), r"[/._\-]+")
    return F.array_distinct(F.concat(named("host:", labels), F.when(suffix != "", F.array(F.concat(F.lit("suffix:"), suffix))).otherwise(F.array().cast("array<string>")), named("path:", words), named("query:", keys)))


RULE = "antecedent array<string>, verdict string, confidence double, support double"


def frequent(labelled: DataFrame, support: float) -> tuple[DataFrame, int]:
    """(written table of frequent itemsets: items (sorted), freq; number of transactions), from rows of (items, bad)."""
    rows = labelled.select(F.concat("items", F.array(F.when(F.col("bad"), F.lit(BAD)).otherwise(F.lit(GOOD)))).alias("items"))
    n = rows.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], "items array<string>, freq long"), 0
    sets = FPGrowth(itemsCol="items", minSupport=support).fit(rows).freqItemsets
    return written(sets.select(F.array_sort("items").alias("items"), "freq"), "op2"), n


def rules_of(sets: DataFrame, n: int, support: float, confidence: float) -> DataFrame:
    """antecedent, verdict, confidence, support of all rules with the class as consequent."""
    classes = F.array(F.lit(BAD), F.lit(GOOD))
    own = sets.filter(F.arrays_overlap("items", classes) & (F.size("items") > 1))
    whole = own.select(F.array_except("items", classes).alias("antecedent"), F.when(F.array_contains("items", BAD), "block").otherwise("allow").alias("verdict"), F.col("freq").alias("both"))
    rules = whole.join(sets.select(F.col("items").alias("antecedent"), "freq"), "antecedent")
    found = rules.select("antecedent", "verdict", (F.col("both") / F.col("freq")).alias("confidence"), (F.col("both") / F.lit(max(n, 1))).alias("support"))
    return found.filter((F.col("support") >= support) & (F.col("confidence") >= confidence))


def filed(rules: DataFrame, sets: DataFrame) -> DataFrame:
    """The rules, each with the token under which it is filed: the one that fewest transactions have."""
    often = sets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    each = rules.select("*", F.explode("antecedent").alias("token")).join(often, "token")
    return each.groupBy(*rules.columns).agg(F.min(F.struct("freq", "token")).alias("rarest")).select(*rules.columns, F.col("rarest.token").alias("token"))


def pruned(rules: DataFrame, sets: DataFrame) -> DataFrame:
    """Without the rules of which a proper part has a rule of the same verdict and at least the confidence."""
    few = filed(rules.withColumnsRenamed({"antecedent": "part", "confidence": "sure"}).drop("support").withColumnRenamed("part", "antecedent"), sets).withColumnsRenamed({"antecedent": "part", "verdict": "say"})
    asks = rules.select("*", F.explode("antecedent").alias("token"))
    less = (F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0) & (F.col("say") == F.col("verdict")) & (F.col("sure") >= F.col("confidence"))
    beaten = asks.join(few, "token").filter(less).select("antecedent", "verdict").distinct()
    return rules.join(beaten, ["antecedent", "verdict"], "left_anti")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """A written index of the rules that decide, from rows of (items array<string>, bad boolean): antecedent, verdict,
    confidence, support, token (under which it is filed) and rank (ascending by confidence, support, block before allow)."""
    sets, n = frequent(labelled, support)
    rules = written(pruned(rules_of(sets, n, support, confidence), sets), "op2")
    order = Window.orderBy("confidence", "support", F.col("verdict") == "block", F.desc("antecedent"))  # of the few rules that are left
    return written(filed(rules, sets).withColumn("rank", F.row_number().over(order)), "op2")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, page_id: str = "page_id", url: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and mined: the confidence of the mined rule that fits best (null: none).
    ``labels``: doc_id (of a page), quality, toxic; a page counts as bad if its quality is 0 or it is toxic."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    known = labels.groupBy("doc_id").agg(F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    index = mine(rows.join(known, rows.page_id == known.doc_id).select(tokens(F.col("url"), host, path).alias("items"), (F.col("bad") == 1).alias("bad")), support, confidence)
    size = index.agg(F.count("*").alias("rules"), F.coalesce(F.sum(F.size("antecedent")), F.lit(0)).alias("tokens")).first()
    small = size["rules"] <= broadcast_rules and size["tokens"] <= BROADCAST_TOKENS
    side = index.select("token", "antecedent", "rank")
    asked = rows.select("url").filter("url is not null").distinct().withColumn("items", tokens(F.col("url"), host, path))
    met = asked.select("url", "items", F.explode("items").alias("token")).join(F.broadcast(side) if small else side.hint("merge"), "token")
    best = met.filter(F.size(F.array_except("antecedent", "items")) == 0).groupBy("url").agg(F.max("rank").alias("rank"))
    says = index.select("rank", F.col("verdict").alias("say"), F.col("confidence").alias("mined"))
    # written, so that the join deals both sides anew and can split a URL that many pages share
    decided = written(best.join(F.broadcast(says) if small else says.hint("merge"), "rank").select("url", "say", "mined"), "op2")
    rule, listed_say = listed(F.col("host"), F.col("path"), rules)
    split = rows.join(decided, "url", "left").select("page_id", host.alias("host"), path.alias("path"), "say", "mined")
    return split.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(listed_say, "say", F.lit("allow")).alias("verdict"), "mined")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
