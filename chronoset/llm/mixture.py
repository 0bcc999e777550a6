"""Mixing sources to target weights by weighted fair queueing.

Each source is shuffled by a hash; a document's virtual finish time is its source's words up to and with it, divided by the
source's target. All sources are then sorted by that time. A source's own time is over at 1: the document at which it passes 1 is
taken in part, those after it aren't, so each source gives its target to a word, however few documents it has. The sorted mix is cut
where what is taken reaches the total budget. A source whose target is beyond its size is gone through again, up to `passes` times.

Running sums never need a source in one task: words are summed by source and hash range first, then within such a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Documents of a source in one hash range, about.
RANGE_ROWS = 1000


def word_count(text) -> F.Column:  # noqa: ANN001
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2) -> DataFrame:
    """(source, source_size, place, target, quota, budget) from (source, source_size): weights repeat over the sources by code point,
    null last; budget is the whole words in all targets, and quota a target in whole words: rounded down, and up for those with the
    largest rests (of equal ones the first) until the quotas sum to the budget.

    Targets are weight * level, no more than passes * source_size, with the level at which all of them sum to share * all sizes:
    what sharing the excess again and again comes to. There is one row a source, so these windows hold one row a source.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    out = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    out = out.withColumn("weight", F.element_at(w, F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1)).withColumn("most", F.lit(float(passes)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "place")
    out = out.withColumn("before", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("behind", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    out = out.withColumn("level", (F.lit(share) * F.col("all") - F.col("before")) / F.col("behind"))
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))
    out = out.withColumn("level", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = out.select("source", "source_size", "place", F.least("most", F.col("weight") * F.col("level")).alias("target"))
    out = out.withColumn("budget", F.floor(F.round(F.sum("target").over(Window.partitionBy()), 3))).withColumn("whole", F.floor(F.col("target") + 1e-6))
    out = out.withColumn("rest", F.round(F.col("target") - F.col("whole"), 6))
    over = F.col("budget") - F.sum("whole").over(Window.partitionBy())
    up = F.row_number().over(Window.orderBy(F.desc("rest"), "place")) <= over
    return out.select("source", "source_size", "place", "target", (F.col("whole") + up.cast("int")).alias("quota"), "budget")


def schedule(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2, salt: str = "mix", range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mix in its order, cut at the budget: a row for each document and pass, with `offset`, the words before it in the mix.

    (doc_id, source, size, source_size, target, pass, finish, taken, offset); rows that the mix doesn't reach have taken 0 and no
    offset. docs: doc_id, text, source; other columns don't matter. A null text has size 0; null is a source, the last one. A null
    doc_id is a key like any other. Repeated rows are documents of their own (which of several equal rows comes first changes
    nothing). An empty table gives no rows. Documents are ordered by md5 of the salt and doc_id, so reruns agree.
    """
    key = F.md5(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), key.alias("key")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    aim = cut(targets(sizes.select("source", "source_size"), weights, share, passes))
    most = sizes.agg(F.max("rows")).first()[0] or 0
    digits = 1
    while 16**digits * range_rows < most:
        digits += 1
    sized = sized.withColumn("range", F.substring("key", 1, digits))
    sums = sized.groupBy("source", "range").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("first", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    firsts = sums.join(aim, sums["source"].eqNullSafe(aim["source"])).select(sums["source"].alias("s"), F.col("range").alias("r"), "first", "source_size", "place", "target", "quota", "budget")
    queue = sized.join(firsts, sized["source"].eqNullSafe(firsts["s"]) & (sized["range"] == firsts["r"]))
    own = Window.partitionBy("place", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    queue = queue.withColumn("first", F.col("first") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    queue = queue.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("first", F.col("first") + F.col("pass") * F.col("source_size"))
    queue = queue.withColumn("finish", F.when(F.col("target") > 0, (F.col("first") + F.col("size")) / F.col("target")).otherwise(F.lit(0.0)))
    queue = queue.withColumn("due", F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("first"))))  # before the source's time 1
    order = ["finish", "place", "pass", "key", "doc_id", "size"]
    queue = cut(queue.select("doc_id", "source", "source_size", "target", "budget", "due", *order).orderBy(*order))
    queue = queue.withColumn("part", F.spark_partition_id())
    parts = queue.groupBy("part").agg(F.sum("due").alias("words"))
    parts = parts.withColumn("base", F.coalesce(F.sum("words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    queue = queue.join(F.broadcast(parts), "part").withColumn("offset", F.col("base") + F.coalesce(F.sum("due").over(own), F.lit(0)))  # one row a partition
    taken = F.greatest(F.lit(0), F.least("due", F.col("budget") - F.col("offset"))).cast("long")
    queue = queue.withColumn("taken", taken).withColumn("offset", F.when(F.col("taken") > 0, F.col("offset")))
    return queue.select("doc_id", "source", "size", "source_size", "target", "place", "key", "pass", "finish", "taken", "offset")


def mix(docs: DataFrame, **how: object) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, offset) of each document: schedule() summed over its passes.

    Equal rows of one doc_id come out as rows of their own, with what they take together dealt evenly, the rest to the first.
    """
    rows = schedule(docs, **how)
    each = rows.groupBy("doc_id", "source", "size", "source_size", "target").agg(F.sum("taken").alias("all"), F.count_if(F.col("pass") == 0).alias("n"), F.min("offset").alias("offset"))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    taken = F.floor(F.col("all") / F.col("n")) + F.when(F.col("copy") <= F.pmod("all", "n"), 1).otherwise(0)
    return each.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "offset")


#: DuckDB: the rows of mix() without source, with its default parameters.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix' || COALESCE(doc_id::VARCHAR, '')) AS key FROM documents
), sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sizes
), weighed AS (
  SELECT *, ([3.0, 1.0, 2.0])[((place - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM placed
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
         - COALESCE(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own
  FROM weighed
), level AS (SELECT arg_min(own, (most / weight, place)) AS level FROM levels WHERE own <= most / weight
), aim AS (SELECT source, source_size, place, least(most, weight * level) AS target FROM weighed, level
), budget AS (SELECT floor(round(sum(target), 3))::BIGINT AS budget FROM aim
), wholes AS (SELECT *, floor(target + 1e-6)::BIGINT AS whole, round(target - floor(target + 1e-6), 6) AS rest FROM aim, budget
), quotas AS (
  SELECT source, source_size, place, target, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, place) <= budget - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM wholes
), queue AS (
  SELECT s.doc_id, s.size, s.key, a.source_size, a.place, a.target, a.quota, p.pass,
         COALESCE(sum(s.size) OVER (PARTITION BY a.place, p.pass ORDER BY s.key, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + p.pass * a.source_size AS first
  FROM sized s JOIN quotas a ON s.source IS NOT DISTINCT FROM a.source, (VALUES (0), (1)) p(pass)
), timed AS (
  SELECT *, CASE WHEN target > 0 THEN (first + size) / target ELSE 0.0 END AS finish, greatest(0, least(size, quota - first)) AS due FROM queue
), sorted AS (
  SELECT *, COALESCE(sum(due) OVER (ORDER BY finish, place, pass, key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM timed
), took AS (SELECT *, greatest(0, least(due, budget - ahead))::BIGINT AS taken FROM sorted, budget
)
SELECT doc_id, size, source_size, target, sum(taken)::BIGINT AS taken, min(CASE WHEN taken > 0 THEN ahead END) AS "offset"
FROM took GROUP BY doc_id, size, source_size, target
"""
