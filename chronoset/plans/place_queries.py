"""Queries that place, compare and edit: classes of placement, metronomes, anchors, runs around a peak, edits applied, tool output read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins, places, stats
from ..sources.project import frames, notes, table
from .registry import query
from .grid_queries import RAGGED, ragged
from .kernel_queries import _GREEDY, _pairs
from .note_queries import _LINES, BEATS, FRAMES, NOTES, PHASED, line_and_oracle, phased

_TWO = PHASED + """, tw AS (SELECT track, note_id, beat_idx, beat_idx * 24 + round_even(phase * 12, 0)::BIGINT * 2 AS h, beat_idx * 24 + CASE WHEN note_id % 3 = 0 THEN round_even((phase + confidence / 8) * 3, 0)::BIGINT * 8 ELSE round_even((phase + confidence / 8) * 4, 0)::BIGINT * 6 END AS o, 2 + note_id % 5 AS division, count(*) OVER (PARTITION BY track, beat_idx) AS n FROM phased WHERE phase IS NOT NULL),
tx AS (SELECT *, o - h AS d, h % 24 AS hf, o % 24 AS of_, h // 24 = o // 24 AS same FROM tw),
cl AS (SELECT track, note_id, CASE WHEN same AND n <= 2 AND hf IN (12, 16, 18) AND of_ = 18 THEN 'late offbeat as dotted' WHEN d = 0 THEN 'hit' WHEN same AND n <= 2 AND hf IN (12, 16, 18) AND of_ = 12 THEN 'swing convention' WHEN of_ = 0 AND abs(d) <= 6 THEN 'annotation literal'
  WHEN division >= 5 OR hf NOT IN (0, 6, 12, 18, 8, 16, 3, 9, 15, 21, 4, 20) THEN 'below the grid' WHEN hf IN (8, 16) AND of_ IN (0, 6, 12, 18) AND n >= 3 THEN 'triplet as binary' WHEN hf IN (0, 6, 12, 18) AND of_ IN (8, 16) THEN 'binary as triplet'
  WHEN hf IN (12, 16) AND same AND of_ < hf THEN 'early offbeat as 16th' WHEN hf IN (12, 16) AND same AND of_ > hf AND of_ NOT IN (8, 16) THEN 'late offbeat as dotted' WHEN hf = 0 AND d > 0 AND d <= 6 THEN 'laid-back beat after it' WHEN hf = 0 AND d < 0 AND -d <= 6 THEN 'pushed beat before it' ELSE 'other' END AS class FROM tx)"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, note_id, class): how our place of each note differs from the annotated one, both on a grid of 24 a beat."""
    p = phased(spark, sf_dir).where("phase is not null")
    moved = F.col("phase") + F.col("confidence") / 8
    o = F.when(F.col("note_id") % 3 == 0, F.bround(moved * 3).cast("long") * 8).otherwise(F.bround(moved * 4).cast("long") * 6)
    n = F.count("*").over(Window.partitionBy("track", "beat_idx"))
    t = p.withColumn("n", n).withColumn("h", F.col("beat_idx") * 24 + F.bround(F.col("phase") * 12).cast("long") * 2).withColumn("o", F.col("beat_idx") * 24 + o)
    return t.select("track", "note_id", places.placement_class(F.col("h"), F.col("o"), 2 + F.col("note_id") % 5, F.col("n")).alias("class"))


@query(_TWO + "SELECT note_id, class FROM cl")
def placement_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("note_id", "class")


@query(_TWO + "SELECT track, class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY track), 6) AS share FROM cl GROUP BY track, class")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track's differences by kind."""
    c = placed(spark, sf_dir).groupBy("track", "class").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("track")), 6))


@query("""WITH s AS (SELECT o_orderkey, (['4/4', '12/8', '6/8', '7/8', '3/4', '9/8'])[o_orderkey % 6 + 1] AS name, CASE WHEN o_orderkey % 11 = 0 THEN 2 END AS forced FROM orders), t(name, a, b, p) AS (VALUES ('3/8', 3, 8, 1), ('6/8', 6, 8, 2), ('9/8', 9, 8, 3), ('12/8', 12, 8, 4))
SELECT o_orderkey, coalesce(a, split_part(s.name, '/', 1)::INT) AS numerator, coalesce(b, split_part(s.name, '/', 2)::INT) AS denominator, greatest(1, coalesce(forced, p, split_part(s.name, '/', 1)::INT)) AS pulses FROM s LEFT JOIN t USING (name)""")
def meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of metres as signature and pulses: known ones looked up, others read, pulses that are given first."""
    names = ("4/4", "12/8", "6/8", "7/8", "3/4", "9/8")
    s = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("name"), F.when(F.col("o_orderkey") % 11 == 0, 2).alias("forced"))
    return s.select("o_orderkey", *places.meter(F.col("name"), F.col("forced")))


@query(RAGGED + """, sd AS (SELECT track, i, t, list(t) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS l, list(t) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS r FROM ni),
pu AS (SELECT *, (l[9] - l[1]) / 8 AS pl, (r[9] - r[1]) / 8 AS pr FROM sd WHERE len(l) = 9 AND len(r) = 9),
cl AS (SELECT *, (pl + pr) / 2 AS p FROM pu WHERE len(list_filter(range(1, 9), lambda k: abs(l[k + 1] - l[k] - pl) > 0.35 * pl)) = 0 AND len(list_filter(range(1, 9), lambda k: abs(r[k + 1] - r[k] - pr) > 0.35 * pr)) = 0 AND abs(pl - pr) <= 0.15 * (pl + pr) / 2)
SELECT track, i, round((list_median(list_transform(range(1, 10), lambda k: l[k] - p * (k - 9))) - list_median(list_transform(range(1, 10), lambda k: r[k] - p * k))) / p, 6) AS jump FROM cl""".replace("list_median(", "list_aggregate(").replace("l[k] - p * (k - 9)))", "l[k] - p * (k - 9)), 'median')").replace("r[k] - p * k)))", "r[k] - p * k), 'median'))"))
def metronome_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many beats the count runs ahead after each beat, by one metronome laid across eight intervals either side."""
    return places.metronome_jumps(ragged(spark, sf_dir), 8, 0.35, 0.15).withColumn("jump", F.round("jump", 6))


@query(_LINES + """, k AS (SELECT p.track, x, y FROM p JOIN line USING (track) WHERE round(abs(y - (slope * x + intercept)), 9) <= 0.02) SELECT track, count(*) AS anchors, round(min(x), 5) AS first, round(max(x), 5) AS last FROM k GROUP BY track""")
def clock_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that a track's line passes near."""
    n = notes(spark, sf_dir)
    kept = n.join(stats.theil_sen(n, ["track"], "onset", "confidence"), "track").where(F.round(F.abs(F.col("confidence") - (F.col("slope") * F.col("onset") + F.col("intercept"))), 9) <= 0.02)
    return kept.groupBy("track").agg(F.count("*").alias("anchors"), F.round(F.min("onset"), 5).alias("first"), F.round(F.max("onset"), 5).alias("last"))


@query(FRAMES + """, pk AS (SELECT track, arg_max(frame, (level, -frame)) AS peak FROM frames GROUP BY track), ab AS (SELECT track, frame, frame - lag(frame) OVER (PARTITION BY track ORDER BY frame) > 3 AS apart FROM frames WHERE level >= 40000),
ru AS (SELECT track, frame, sum(CASE WHEN coalesce(apart, true) THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM ab), at_ AS (SELECT r.track, run FROM ru r JOIN pk ON pk.track = r.track AND pk.peak = r.frame)
SELECT r.track, min(frame) AS first, max(frame) + 1 AS after FROM ru r JOIN at_ USING (track, run) GROUP BY r.track""")
def run_around_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of loud frames around each track's loudest, over gaps of two."""
    f = frames(spark, sf_dir)
    peak = f.groupBy("track").agg(F.max_by("frame", F.struct("level", -F.col("frame"))).alias("peak"))
    return places.run_around(f.where("level >= 40000"), peak, 2)


@query(PHASED + """, bar AS (SELECT track, floor(beat_idx / 4)::BIGINT AS bar, round((beat_idx % 4) + phase, 6) AS pos, pitch = 48 AS rest FROM phased WHERE phase IS NOT NULL), pt AS (SELECT DISTINCT track, bar, pos, rest FROM bar), cut AS (SELECT DISTINCT track, bar, pos FROM pt UNION SELECT DISTINCT track, bar, 4.0 FROM pt),
nx AS (SELECT track, bar, pos, lead(pos) OVER (PARTITION BY track, bar ORDER BY pos) AS after FROM cut), fs AS (SELECT track, bar, min(pos) AS first FROM cut GROUP BY track, bar)
SELECT track, bar, pos AS start, after FROM nx JOIN pt USING (track, bar, pos) WHERE NOT rest UNION ALL SELECT track, bar, -1.0, first FROM fs WHERE first > 0.02""")
def bar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of bars that are filled by notes and rests; what sounds before the first of them was tied in."""
    p = phased(spark, sf_dir).where("phase is not null")
    points = p.select("track", F.floor(F.col("beat_idx") / 4).alias("bar"), F.round((F.col("beat_idx") % 4) + F.col("phase"), 6).alias("pos"), (F.col("pitch") == 48).alias("rest")).distinct()
    return places.bar_events(points, 4.0, 0.02)


_PLACED = PHASED + """, an0 AS (SELECT track, note_id, onset, beat_idx + phase + confidence / 5 AS pos FROM phased WHERE phase IS NOT NULL AND source = 'click'), an1 AS (SELECT *, max(pos) OVER (PARTITION BY track ORDER BY onset, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM an0),
an AS (SELECT track, pos, onset, row_number() OVER (PARTITION BY track ORDER BY pos) AS k, count(*) OVER (PARTITION BY track) AS n FROM an1 WHERE upto IS NULL OR pos > upto),
ms AS (SELECT track, note_id, beat_idx + phase AS pos FROM phased WHERE phase IS NOT NULL AND source = 'view'), pv AS (SELECT m.track, m.note_id, m.pos, count(a.k) AS below FROM ms m LEFT JOIN an a ON a.track = m.track AND a.pos < m.pos GROUP BY ALL)"""


@query(_PLACED + """SELECT v.note_id, round(lo.onset + (v.pos - lo.pos) * (hi.onset - lo.onset) / (hi.pos - lo.pos), 5) AS seconds FROM pv v JOIN (SELECT DISTINCT track, n FROM an WHERE n >= 2) c ON c.track = v.track JOIN an lo ON lo.track = v.track AND lo.k = greatest(1, least(v.below, c.n - 1)) JOIN an hi ON hi.track = v.track AND hi.k = lo.k + 1""")
def place_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missed notes in seconds: between the anchors around their position, or on the line of the outermost two."""
    p = phased(spark, sf_dir).where("phase is not null").withColumn("pos", F.col("beat_idx") + F.col("phase"))
    anchors = p.where("source = 'click'").select("track", "note_id", "onset", (F.col("pos") + F.col("confidence") / 5).alias("pos"))
    out = places.interpolate(p.where("source = 'view'").select("track", "note_id", "pos"), anchors)
    return out.select("note_id", F.round("seconds", 5).alias("seconds"))


@query(_GREEDY.rsplit("SELECT note_id, o_id", 1)[0].rstrip() + """, gone AS (SELECT note_id FROM rounds WHERE taken) SELECT note_id AS id, pitch, 'line' AS origin FROM line WHERE note_id NOT IN (SELECT note_id FROM gone)
UNION ALL SELECT o_id, o_pitch, 'added' FROM oracle WHERE o_conf >= 0.98 AND NOT EXISTS (SELECT 1 FROM line WHERE rec = o_rec AND pitch = o_pitch AND abs(onset - o_onset) <= 0.1)""")
def edited_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line without erased notes and with those switched on from the other detector's pool."""
    a, b = line_and_oracle(spark, sf_dir)
    gone = _pairs(spark, sf_dir, "greedy", 1.0, ["rec", "pitch"]).select("note_id")
    pool = joins.band_join(b.where("o_conf >= 0.98"), a.select("rec", "pitch", "onset"), [("o_rec", "rec"), ("o_pitch", "pitch")], "o_onset", "onset", 0.1, "left_anti")
    kept = a.join(gone, "note_id", "left_anti").select(F.col("note_id").alias("id"), "pitch", F.lit("line").alias("origin"))
    return kept.union(pool.select("o_id", "o_pitch", F.lit("added")))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 OR s_acctbal < 0 THEN 'bronze' WHEN (s_suppkey % 7) / (s_nationkey % 5 * 20.0) <= 0.05 AND (s_suppkey % 4) / (s_nationkey % 5 * 20.0) <= 0.02 AND s_acctbal / 10000 >= 0.3 THEN 'silver' ELSE 'bronze' END AS tier FROM supplier""")
def page_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read pages that hold what is printed, and bars that fill their metre, are silver; all others, and those of which nothing is known, bronze."""
    printed = F.when(F.col("s_nationkey") % 5 != 0, F.col("s_nationkey") % 5 * 20.0)
    filled = F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal") / 10000)
    return table(spark, sf_dir, "supplier").select("s_suppkey", places.page_tier(printed, F.col("s_suppkey") % 7, F.col("s_suppkey") % 4, filled, 0.05, 0.02, 0.3).alias("tier"))


@query("""WITH t AS (SELECT o_orderkey, 'Pitch: 0.' || o_orderkey % 97 || chr(13) || 'Voice: 0.5' || chr(10) || 'Pitch: 0.' || o_orderkey % 89 || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN 'how: all' || chr(10) ELSE '' END || 'alignments: ' || o_orderkey % 7 AS text FROM orders)
SELECT o_orderkey, regexp_extract_all(text, 'Pitch: ([0-9.]+)', 1)[-1]::DOUBLE AS pitch, regexp_extract_all(text, 'Voice: ([0-9.]+)', 1)[-1]::DOUBLE AS voice, regexp_extract_all(text, 'how: ([a-z]+)', 1)[-1] AS how, regexp_extract_all(text, 'alignments: ([0-9]+)', 1)[-1]::INT AS alignments FROM t""")
def tool_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scoring tool's printed lines as fields, the last value of each."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Pitch: 0."), (k % 97).cast("string"), F.lit("\rVoice: 0.5\nPitch: 0."), (k % 89).cast("string"), F.lit("\n"), F.when(k % 3 == 0, "how: all\n").otherwise(""), F.lit("alignments: "), (k % 7).cast("string"))
    t = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    last = lambda name, form: places.last_field("text", name, form)
    return t.select("o_orderkey", last("Pitch", "[0-9.]+").cast("double").alias("pitch"), last("Voice", "[0-9.]+").cast("double").alias("voice"), last("how", "[a-z]+").alias("how"), last("alignments", "[0-9]+").cast("int").alias("alignments"))


@query(BEATS + "SELECT track, beat_idx, round(t, 6) AS t FROM beats WHERE t >= 100.0 - 24.0 AND t <= coalesce(CASE WHEN track % 2 = 0 THEN 400.0 END, 1e12) + 24.0")
def span_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of a region and a margin either side; a region without an end goes on."""
    from ..sources.project import beats

    end = F.coalesce(F.when(F.col("track") % 2 == 0, 400.0), F.lit(1e12))
    return beats(spark, sf_dir).where((F.col("t") >= 100.0 - 24.0) & (F.col("t") <= end + 24.0)).select("track", "beat_idx", F.round("t", 6).alias("t"))


@query("""WITH base AS (SELECT c_custkey AS k, c_acctbal AS v, 0 AS w FROM customer), up AS (SELECT o_custkey AS k, o_totalprice AS v, o_orderkey AS w FROM orders WHERE o_orderstatus = 'F'), u AS (SELECT * FROM base UNION ALL SELECT * FROM up)
SELECT k, round(arg_max(v, (w, v)), 4) AS v, max(w) > 0 AS updated FROM u GROUP BY k""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by key, the last write of each."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(0).cast("long").alias("at"))
    up = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("at"))
    return places.upsert(base, up, ["k"], "at").select("k", F.round("v", 4).alias("v"), (F.col("at") > 0).alias("updated"))


@query(FRAMES + """, c AS (SELECT track, frame // 16 AS bar, pitch::BIGINT % 12 AS i, count(*) AS n FROM frames WHERE pitch IS NOT NULL GROUP BY ALL), f AS (SELECT track, bar, i, n / sqrt(sum(n * n) OVER (PARTITION BY track, bar)) AS v FROM c), nb AS (SELECT track, max(bar) + 1 AS bars FROM f GROUP BY track),
lk AS (SELECT a.track, bars, b.bar - a.bar AS lag_, a.bar, sum(a.v * b.v) AS raw FROM f a JOIN nb USING (track) JOIN f b ON b.track = a.track AND b.i = a.i AND b.bar >= a.bar + greatest(8, bars // 3) GROUP BY a.track, bars, b.bar - a.bar, a.bar),
sm AS (SELECT *, round(sum(raw) OVER (PARTITION BY track, lag_ ORDER BY bar RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4, 9) AS s FROM lk), pk AS (SELECT *, max(s) OVER (PARTITION BY track, lag_) AS peak FROM sm), pa AS (SELECT *, min(CASE WHEN s = peak THEN bar END) OVER (PARTITION BY track, lag_) AS top FROM pk),
ab AS (SELECT *, bar - lag(bar) OVER (PARTITION BY track, lag_ ORDER BY bar) > 5 AS apart FROM pa WHERE s >= greatest(0.55, peak - 0.3)), rn AS (SELECT *, sum(CASE WHEN coalesce(apart, true) THEN 1 ELSE 0 END) OVER (PARTITION BY track, lag_ ORDER BY bar ROWS UNBOUNDED PRECEDING) AS run FROM ab),
rs AS (SELECT track, lag_, bars, peak, top, min(bar) AS first, max(bar) + 1 AS after FROM rn GROUP BY track, lag_, run, bars, peak, top), ok AS (SELECT * FROM rs WHERE top BETWEEN first AND after - 1 AND first <= 0.3 * bars AND after + lag_ >= 0.7 * bars AND peak >= 0.6)
SELECT track, arg_max(first, (peak, -lag_)) AS first, arg_max(after, (peak, -lag_)) AS after, arg_max(lag_, (peak, -lag_)) AS "lag", round(max(peak), 6) AS similarity FROM ok GROUP BY track""")
def find_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars that open a track and come again at its end, by chroma."""
    c = frames(spark, sf_dir).where("pitch is not null").groupBy("track", F.floor(F.col("frame") / 16).alias("bar"), (F.col("pitch").cast("long") % 12).alias("i")).agg(F.count("*").alias("n"))
    f = c.withColumn("v", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("track", "bar")))).drop("n")
    return places.repeated_section(f, 8, 4, 0.55, 0.3, 4, 0.3, 0.6).withColumn("similarity", F.round("similarity", 6))
