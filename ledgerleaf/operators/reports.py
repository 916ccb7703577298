"""Procurement reports over order lines: grouped counts in one pass, nested rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import bridges as B
from ..plans.catalog import query


def labelled(spark, sf_dir: str) -> DataFrame:
    p = B.purchases(spark, sf_dir)
    return p.select("line", "gate", *[T.bucket_label(F.col(c)).alias(c) for c in ("buyer", "seller", "category")])


LABEL = "CASE WHEN {0} IS NULL THEN '(null)' WHEN trim({0}) = '' THEN '(blank)' ELSE trim({0}) END AS {0}"
LABELLED = {"labelled": "SELECT line, gate, " + ", ".join(LABEL.format(c) for c in ("buyer", "seller", "category")) + " FROM purchases"}


@query("AGG-19", B.with_views("purchases", "SELECT grouping_id(buyer, seller, category, gate) AS level, buyer, seller, category, gate, count(*) AS n FROM labelled GROUP BY GROUPING SETS ((buyer), (seller), (category), (buyer, seller), (gate))", **LABELLED))
def agg19(spark, sf_dir):
    """Raw keys are counted first, in two sets; labels and the five levels are made from these counts."""
    cols = ("buyer", "seller", "category", "gate")
    raw = B.purchases(spark, sf_dir).select(*cols).groupingSets([["buyer", "seller"], ["category", "gate"]], *cols).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    shown = [T.bucket_label(F.col(c)).alias(c) for c in cols[:3]]
    pairs = raw.where("g = 3").select(*shown[:2], "n").groupingSets([["buyer"], ["seller"], ["buyer", "seller"]], "buyer", "seller").agg((F.grouping_id() * 4 + 3).alias("level"), F.sum("n").alias("n"))
    kinds = raw.where("g = 12").select(shown[2], "gate", "n").groupingSets([["category"], ["gate"]], "category", "gate").agg((F.grouping_id() + 12).alias("level"), F.sum("n").alias("n"))
    return pairs.unionByName(kinds, allowMissingColumns=True).select("level", *cols, "n")


@query("AGG-19-missing", B.with_views("purchases", "SELECT CAST(count_if(buyer IS NULL) AS BIGINT) AS buyer, CAST(count_if(seller IS NULL) AS BIGINT) AS seller, CAST(count_if(category IS NULL) AS BIGINT) AS category FROM purchases"))
def missing(spark, sf_dir):
    return B.purchases(spark, sf_dir).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("buyer", "seller", "category")])


def counted(spark, sf_dir: str, *keys: str) -> DataFrame:
    """How many purchases each labelled key has: raw keys are counted before they are labelled."""
    raw = B.purchases(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("n"))
    return raw.select(*[T.bucket_label(F.col(k)).alias(k) for k in keys], "n").groupBy(*keys).agg(F.sum("n").alias("n"))


def top(counts: DataFrame, n: int, *keys: str, within: tuple[str, ...] = ()) -> DataFrame:
    """WIN-04: of counted keys the most frequent, ties by name; within groups if given."""
    by: list[Column] = [F.desc("n"), *map(F.col, keys)]
    if not within:
        return counts.orderBy(*by).limit(n)
    return counts.withColumn("r", F.row_number().over(Window.partitionBy(*within).orderBy(*by))).where(F.col("r") <= n).drop("r")


@query("WIN-04", B.with_views("purchases", "SELECT buyer, count(*) AS n FROM labelled GROUP BY buyer ORDER BY n DESC, buyer LIMIT 20", **LABELLED))
def win04(spark, sf_dir):
    return top(counted(spark, sf_dir, "buyer"), 20, "buyer")


@query("WIN-04-pairs", B.with_views("purchases", "SELECT buyer || ' -> ' || seller AS pair, n FROM (SELECT buyer, seller, count(*) AS n FROM labelled GROUP BY ALL ORDER BY n DESC, buyer, seller LIMIT 25)", **LABELLED))
def win04_pairs(spark, sf_dir):
    return top(counted(spark, sf_dir, "buyer", "seller"), 25, "buyer", "seller").select(F.concat("buyer", F.lit(" -> "), "seller").alias("pair"), "n")


@query("WIN-04-nested", B.with_views("purchases", "SELECT category, seller, n FROM (SELECT category, seller, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, seller) AS r FROM labelled GROUP BY category, seller) WHERE r <= 10", **LABELLED))
def win04_nested(spark, sf_dir):
    return top(counted(spark, sf_dir, "category", "seller"), 10, "seller", within=("category",))


@query("WIN-05", B.with_views("purchases", "SELECT category, string_agg(line, ',' ORDER BY line) AS examples FROM (SELECT category, line, row_number() OVER (PARTITION BY category ORDER BY line) AS r FROM labelled) WHERE r <= 5 GROUP BY category", **LABELLED))
def win05(spark, sf_dir):
    w = Window.partitionBy("category").orderBy("line")
    first = labelled(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 5")
    return first.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x.cast("string")), ",").alias("examples"))


@query("AGG-20", "SELECT user_id, CAST(sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS BIGINT) AS used, bool_or(event_type = 'error') AS exhausted FROM events GROUP BY user_id")
def agg20(spark, sf_dir):
    e = B.read(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("user_id").agg(F.sum("k").alias("used"), F.bool_or(F.col("event_type") == "error").alias("exhausted"))


@query("WIN-16", "SELECT event_id, user_id, CAST(sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM events")
def win16(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return B.read(spark, sf_dir, "events").select("event_id", "user_id", F.sum(F.get_json_object("props", "$.k").cast("long")).over(w).alias("running"))


@query("JSN-01", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.none') IS NULL AS absent FROM events")
def jsn01(spark, sf_dir):
    v = F.try_parse_json("props")
    return B.read(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), F.try_variant_get(v, "$.none", "string").isNull().alias("absent"))


@query("MTH-10", B.with_views("purchases", """SELECT line, round_even(least(0.95, CASE WHEN gate = 'unclear' THEN 0.75 ELSE 1 END, CASE WHEN gate = 'yes' AND buyer IS NULL THEN 0.86 ELSE 1 END, CASE WHEN gate = 'yes' AND seller = ' ' THEN 0.88 ELSE 1 END), 4) AS confidence FROM purchases"""))
def mth10(spark, sf_dir):
    cap = lambda cond, at: F.when(cond, F.lit(at)).otherwise(F.lit(1.0))
    yes = F.col("gate") == "yes"
    return B.purchases(spark, sf_dir).select("line", F.bround(F.least(F.lit(0.95), cap(F.col("gate") == "unclear", 0.75), cap(yes & F.col("buyer").isNull(), 0.86), cap(yes & (F.col("seller") == " "), 0.88)), 4).alias("confidence"))
