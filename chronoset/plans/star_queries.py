"""The statement shapes of the relational side, over the star schema: lookups, left joins, firsts, spans, rollups and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import joins, sets
from ..sources.project import table
from .registry import query

_TIES = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
_TIES_SQL = ", ".join(_TIES)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_suppkey = 7 ORDER BY l_orderkey, l_linenumber, l_partkey")
def point_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered projection of one key's rows; the filter reaches the scan."""
    return table(spark, sf_dir, "lineitem").where("l_suppkey = 7").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").orderBy("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20")
def lookup_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where("n_nationkey < 20").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@query("""SELECT o_orderkey, c_custkey, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def three_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    c = t("customer").where("c_acctbal > 0")
    out = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("o_orderkey", "c_custkey", "n_name", "r_name")


@query("SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey")
def count_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderstatus = 'F'")
def join_with_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT min(epoch_us(l_shipdate)) AS first, max(epoch_us(l_shipdate) + l_quantity::BIGINT) AS last FROM lineitem")
def span_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(l_shipdate as timestamp_ntz))")
    return table(spark, sf_dir, "lineitem").agg(F.min(us).alias("first"), F.max(us + F.col("l_quantity").cast("long")).alias("last"))


@query(f"SELECT l_suppkey, l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_TIES_SQL}) AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 10) WHERE k = 1")
def first_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 10")
    return li.groupBy("l_suppkey").agg(F.min(F.struct(*_TIES)).alias("x")).select("l_suppkey", "x.l_orderkey", "x.l_partkey")


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: len(w) > 2 AND w NOT IN ('the', 'and', 'for', 'with')))), ' ') AS tokens, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS title FROM part")
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(S.title_tokens(F.col("p_name")), " ").alias("tokens"), S.normal_title(F.col("p_name")).alias("title"))


@query("SELECT o_custkey AS c, ('0x' || substr(sha256('spring' || chr(0) || o_custkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.2 AS is_test, count(*) AS n FROM orders GROUP BY o_custkey")
def salted_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count("*").alias("n"))
    return sets.salted_split(o, "c", "spring", 0.2)


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.top_k(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value")), "value", 3)


@query("SELECT o_orderkey FROM orders ORDER BY sha256('s1' || o_orderkey::VARCHAR), o_orderkey LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "s1", 50)


@query("SELECT o_custkey, epoch_us(max(o_orderdate)) AS latest FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def recent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))")
    return sets.recent(table(spark, sf_dir, "orders").select("o_custkey", us.alias("latest")), "o_custkey", "latest", 20)


@query("SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS band, o_orderstatus AS cls, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderstatus))")
def class_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    g = o.groupingSets([["o_orderpriority", "o_orderstatus"], ["o_orderstatus"]], "o_orderpriority", "o_orderstatus").agg(F.grouping("o_orderpriority").alias("g"), F.count("*").alias("n"))
    return g.select(F.when(F.col("g") == 1, "all").otherwise(F.col("o_orderpriority")).alias("band"), F.col("o_orderstatus").alias("cls"), "n")


@query("SELECT s_suppkey AS key, name, value FROM (SELECT s_suppkey, s_acctbal, s_nationkey::DOUBLE AS s_nation FROM supplier) UNPIVOT (value FOR name IN (s_acctbal, s_nation))".replace("s_suppkey AS key", "s_suppkey"))
def flatten_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nation"))
    return sets.unpivot(s, ["s_suppkey"], ["s_acctbal", "s_nation"])


@query("""WITH a AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT k, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NULL THEN 'right' WHEN b.v IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b USING (k)""")
def merge_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return sets.merge_outer(side("F"), side("O"), ["k"], "v")


@query("SELECT c_mktsegment AS band, round(avg(c_acctbal), 6) AS mean, count(c_acctbal) AS n, round(stddev_pop(c_acctbal), 6) AS sd, round(quantile_cont(c_acctbal, 0.95), 6) AS p95 FROM customer GROUP BY 1")
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("band")).agg(F.round(F.avg("c_acctbal"), 6).alias("mean"), F.count("c_acctbal").alias("n"), F.round(F.stddev_pop("c_acctbal"), 6).alias("sd"), F.round(F.percentile("c_acctbal", 0.95), 6).alias("p95"))


@query("""WITH m AS (SELECT o_orderpriority AS p, o_orderstatus = 'F' AS hit, o_totalprice > 150000 AS said FROM orders), c AS (SELECT p, count_if(hit AND said)::BIGINT AS tp, count_if(said)::BIGINT AS s, count_if(hit)::BIGINT AS h FROM m GROUP BY p)
SELECT p, tp, round(tp / s, 9) AS precision, round(tp / h, 9) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / s) * (tp / h) / (tp / s + tp / h) ELSE 0.0 END, 9) AS f1 FROM c""".replace("AS precision", 'AS "precision"'))
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), (F.col("o_orderstatus") == "F").alias("hit"), (F.col("o_totalprice") > 150000).alias("said"))
    c = m.groupBy("p").agg(F.count_if(F.col("hit") & F.col("said")).alias("tp"), F.count_if("said").alias("s"), F.count_if("hit").alias("h"))
    precision, recall = F.col("tp") / F.col("s"), F.col("tp") / F.col("h")
    return c.select("p", "tp", F.round(precision, 9).alias("precision"), F.round(recall, 9).alias("recall"), F.round(S.f1(precision, recall), 9).alias("f1"))


@query("""WITH r AS (SELECT o_custkey AS c, o_totalprice AS v, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS next, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS k, o_orderkey FROM orders)
SELECT c, o_orderkey AS best, CASE WHEN v >= 300000 THEN 'sure' WHEN v >= 1.2 * coalesce(next, 0) THEN 'clear' ELSE 'close' END AS verdict FROM r WHERE k = 1""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each key, taken if sure or clear of the runner-up."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), F.desc("o_orderkey"))
    r = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.lead("o_totalprice").over(w).alias("next"), F.row_number().over(w).alias("k")).where("k = 1")
    verdict = F.when(F.col("o_totalprice") >= 300000, "sure").when(F.col("o_totalprice") >= 1.2 * F.coalesce("next", F.lit(0.0)), "clear").otherwise("close")
    return r.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("best"), verdict.alias("verdict"))


@query("""WITH s AS (SELECT l_suppkey AS k, l_returnflag AS t, l_linestatus AS o FROM lineitem) SELECT t, o, count(*) AS n, count(DISTINCT k) AS keys FROM s GROUP BY t, o""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("t"), F.col("l_linestatus").alias("o")).agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("keys"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) / 8.64e10 AS d FROM orders), b AS (SELECT a.o_custkey, a.o_orderkey AS x, b.o_orderkey AS y FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(a.d - b.d) <= 10)
SELECT x, y FROM b""")
def band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))") / F.lit(8.64e10)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", day.alias("d"))
    a, b = o.select(F.col("o_orderkey").alias("x"), F.col("o_custkey").alias("ka"), F.col("d").alias("da")), o.select(F.col("o_orderkey").alias("y"), F.col("o_custkey").alias("kb"), F.col("d").alias("db"))
    return joins.band_join(a, b, [("ka", "kb")], "da", "db", 10.0, extra=F.col("x") < F.col("y")).select("x", "y")


@query("""WITH s AS (SELECT l_suppkey AS k, l_quantity AS x, l_extendedprice AS y FROM lineitem) SELECT k, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 3) AS intercept, round(corr(y, x), 6) AS r FROM s GROUP BY k""")
def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return s.groupBy("k").agg(F.round(F.regr_slope("y", "x"), 4).alias("slope"), F.round(F.regr_intercept("y", "x"), 3).alias("intercept"), F.round(F.corr("y", "x"), 6).alias("r"))


@query("""WITH h AS (SELECT o_orderstatus AS g, floor(o_totalprice / 10000)::INT AS b, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT (unnest(range(9)) - 4)::INT AS s)
SELECT s, sum(least(a.n, b.n))::BIGINT AS shared FROM s JOIN h a ON a.g = 'F' JOIN h b ON b.g = 'O' AND b.b + s = a.b GROUP BY s""")
def histogram_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of two histograms overlaps at each shift."""
    h = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("g"), F.floor(F.col("o_totalprice") / 10000).cast("int").alias("b")).agg(F.count("*").alias("n"))
    a, b = h.where("g = 'F'").select("b", F.col("n").alias("na")), h.where("g = 'O'").select(F.col("b").alias("from"), F.col("n").alias("nb"))
    moved = b.select(F.explode(F.array(*[F.lit(i) for i in range(-4, 5)])).alias("s"), "from", "nb").withColumn("b", F.col("from") + F.col("s"))
    return moved.join(a, "b").groupBy("s").agg(F.sum(F.least("na", "nb")).alias("shared"))


@query("""WITH r AS (SELECT c_nationkey AS k, c_acctbal AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS i FROM customer) SELECT n_nationkey, round(coalesce(median(v), 0.28), 6) AS speed FROM nation LEFT JOIN r ON k = n_nationkey AND i <= 12 GROUP BY n_nationkey""")
def recent_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of a key's last twelve rows, or a seed."""
    r = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_acctbal", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_custkey"))).alias("i")).where("i <= 12")
    m = r.groupBy("k").agg(F.percentile("c_acctbal", 0.5).alias("m"))
    n = table(spark, sf_dir, "nation")
    return n.join(m, n["n_nationkey"] == m["k"], "left").select("n_nationkey", F.round(F.coalesce("m", F.lit(0.28)), 6).alias("speed"))


@query("""WITH c AS (SELECT l_shipmode_ AS s, count(*) AS n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY 1) SELECT k, round(-ln(coalesce(n, 0.5) / sum_n), 9) AS surprisal FROM (SELECT unnest(['AF', 'NO', 'NF', 'RF', 'XX']) AS k), (SELECT sum(n) AS sum_n FROM c) LEFT JOIN c ON s = k""")
def figure_surprisal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("k")).agg(F.count("*").alias("n"))
    keys = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("AF", "NO", "NF", "RF", "XX")])).alias("k"))
    total = c.agg(F.lit(1).alias("one"), F.sum("n").alias("total"))  # one row
    return keys.join(c, "k", "left").withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("k", F.round(-F.log(F.coalesce("n", F.lit(0.5)) / F.col("total")), 9).alias("surprisal"))


@query("""WITH t AS (SELECT l_returnflag AS f, l_suppkey % 2 AS fold, l_linenumber AS v FROM lineitem), c AS (SELECT f, fold, v, count(*) AS n FROM t GROUP BY ALL), a AS (SELECT count(DISTINCT v) AS a FROM t),
s AS (SELECT f, fold, sum(n) AS n FROM c GROUP BY ALL) SELECT x.f, round(sum(x.n * -log2((coalesce(y.n, 0) + 0.5) / (s.n + 0.5 * a))) / sum(x.n), 9) AS bits FROM c x LEFT JOIN c y ON y.f = x.f AND y.v = x.v AND y.fold = 1 - x.fold JOIN s ON s.f = x.f AND s.fold = 1 - x.fold, a GROUP BY x.f""")
def held_out_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy of each fold under the other fold's counts, smoothed over the whole alphabet."""
    li = table(spark, sf_dir, "lineitem")
    c = li.withColumn("fold", F.pmod("l_suppkey", F.lit(2))).groupBy(F.col("l_returnflag").alias("f"), "fold", F.col("l_linenumber").alias("v")).agg(F.count("*").alias("n"))
    other = c.select("f", (1 - F.col("fold")).alias("fold"), "v", F.col("n").alias("m"))
    size = other.groupBy("f", "fold").agg(F.sum("m").alias("total"))
    letters = c.agg(F.lit(1).alias("one"), F.countDistinct("v").alias("a"))  # one row
    bits = -F.log2((F.coalesce("m", F.lit(0)) + 0.5) / (F.col("total") + 0.5 * F.col("a")))
    out = c.join(other, ["f", "fold", "v"], "left").join(size, ["f", "fold"]).withColumn("one", F.lit(1)).join(F.broadcast(letters), "one")
    return out.groupBy("f").agg(F.round(F.sum(F.col("n") * bits) / F.sum("n"), 9).alias("bits"))


@query("SELECT o_orderpriority AS p, round(sum(o_totalprice * o_custkey) / sum(o_custkey), 4) AS weighted, round(avg(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 4) AS trusted FROM orders GROUP BY 1")
def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.round(F.sum(F.col("o_totalprice") * F.col("o_custkey")) / F.sum("o_custkey"), 4).alias("weighted"), F.round(F.avg(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))), 4).alias("trusted"))


@query("SELECT s_nationkey AS n, arg_max(s_suppkey, (s_acctbal, -s_suppkey)) AS lead, CASE WHEN max(s_acctbal) < 5000 THEN 'rhythm' ELSE 'lead' END AS role FROM supplier GROUP BY 1")
def lead_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.max_by("s_suppkey", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("lead"), F.when(F.max("s_acctbal") < 5000, "rhythm").otherwise("lead").alias("role"))

