"""More queries of lines, pages and frames: crops, replays, residuals, splices, rasters and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import islands, joins
from ..sources.project import frames, notes, table
from .registry import query
from .note_queries import BEATS, FRAMES, LINE, NOTES, OWN, PHASED, SAME_REC, line_and_oracle, own_beats, phased


@query(NOTES + """SELECT note_id, round(onset + 10.0, 5) AS onset FROM notes WHERE onset >= 100.0 AND onset < coalesce(CASE WHEN track % 2 = 0 THEN 400.0 END, 720.0)""")
def crop_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of each track, shifted; an end that is null is the track's end."""
    n = notes(spark, sf_dir).withColumn("end", F.when(F.col("track") % 2 == 0, F.lit(400.0)))
    return n.where((F.col("onset") >= 100.0) & (F.col("onset") < F.coalesce("end", F.lit(720.0)))).select("note_id", F.round(F.col("onset") + 10.0, 5).alias("onset"))


@query(NOTES + """SELECT note_id FROM notes n WHERE NOT EXISTS (SELECT 1 FROM notes s WHERE s.source = 'error' AND s.note_id + 1 = n.note_id) AND onset BETWEEN 48.0 - 0.05 AND 480.0 + 0.05""")
def audible_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes within a span, its edges with a tolerance, without those silenced."""
    n = notes(spark, sf_dir)
    silenced = n.where("source = 'error'").select((F.col("note_id") + 1).alias("note_id"))
    return n.where(F.col("onset").between(48.0 - 0.05, 480.0 + 0.05)).join(silenced, "note_id", "left_anti").select("note_id")


@query(BEATS + """, p AS (SELECT note_id, track, 2 + confidence * 50 AS pos FROM notes), b AS (SELECT track, beat_idx, t, lead(t) OVER (PARTITION BY track ORDER BY beat_idx) AS nxt FROM beats)
SELECT note_id, round(t + (nxt - t) * (pos - floor(pos)), 5) AS at_time FROM p JOIN b ON p.track = b.track AND b.beat_idx = floor(pos)::INT""")
def time_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of a position in beats, between its beat and the next."""
    from ..sources.project import beats

    p = notes(spark, sf_dir).select("note_id", "track", (2 + F.col("confidence") * 50).alias("pos")).withColumn("beat_idx", F.floor("pos").cast("int"))
    b = beats(spark, sf_dir).withColumn("nxt", F.lead("t").over(islands.by("track", "beat_idx")))
    return p.join(b, ["track", "beat_idx"]).select("note_id", F.round(F.col("t") + (F.col("nxt") - F.col("t")) * (F.col("pos") - F.floor("pos")), 5).alias("at_time"))


@query(NOTES + OWN + """, s AS (SELECT track, t, lead(t) OVER (PARTITION BY track ORDER BY t) - t AS gap FROM own), m AS (SELECT track, median(gap) AS mid, count(gap) AS n FROM s GROUP BY track),
o AS (SELECT track, mid, n, sum(CASE WHEN abs(log2(gap / mid)) >= 1.0 THEN 1 ELSE 0 END) / n AS out FROM s JOIN m USING (track) WHERE gap > 0 GROUP BY track, mid, n) SELECT track, 720.0 / mid / n <= 2.0 AS plausible, round(out, 9) AS outliers, (720.0 / mid / n > 2.0 OR out > 0.5) AS suspect FROM o""")
def grid_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.stats import intervals

    s = intervals(own_beats(spark, sf_dir))
    m = s.groupBy("track").agg(F.percentile("gap", 0.5).alias("mid"), F.count("gap").alias("n"))
    o = s.where("gap > 0").join(m, "track").groupBy("track", "mid", "n").agg((F.count_if(F.abs(F.log2(F.col("gap") / F.col("mid"))) >= 1.0) / F.col("n")).alias("out"))
    beyond = 720.0 / F.col("mid") / F.col("n")
    return o.select("track", (beyond <= 2.0).alias("plausible"), F.round("out", 9).alias("outliers"), ((beyond > 2.0) | (F.col("out") > 0.5)).alias("suspect"))


@query(NOTES + LINE + """SELECT round(0.001 * k, 3) AS shift, count(*) AS hits FROM (SELECT unnest(range(-2, 3)) * 50 AS k), line WHERE EXISTS (SELECT 1 FROM oracle WHERE o_rec = rec AND o_pitch = pitch AND abs(onset * 1.0 + 0.001 * k - o_onset) <= 0.2) GROUP BY k""")
def affine_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many notes of a line meet the other one after each shift."""
    a, b = line_and_oracle(spark, sf_dir)
    moved = a.select("rec", "note_id", "pitch", "onset", F.explode(F.array(*[F.lit(50 * k) for k in range(-2, 3)])).alias("k")).withColumn("moved", F.col("onset") + 0.001 * F.col("k"))
    hit = joins.band_join(moved, b, [SAME_REC, ("pitch", "o_pitch")], "moved", "o_onset", 0.2, "left_semi")
    return hit.groupBy("k").agg(F.count("*").alias("hits")).select(F.round(0.001 * F.col("k"), 3).alias("shift"), "hits")


@query(NOTES + LINE + """, p AS (SELECT rec, note_id, onset, pitch - o_pitch AS step, onset - o_onset AS d, row_number() OVER (PARTITION BY note_id ORDER BY abs(onset - o_onset), o_id) AS k FROM line JOIN oracle ON rec = o_rec AND abs(onset - o_onset) <= 0.5),
m AS (SELECT rec, note_id, onset, d, step FROM p WHERE k = 1), g AS (SELECT rec, median(d) AS g, median(step) AS gs FROM m GROUP BY rec), l AS (SELECT a.rec, a.note_id, median(b.d) AS local, median(b.step) AS local_step, count(*) AS n FROM m a JOIN m b ON a.rec = b.rec AND abs(a.onset - b.onset) <= 2.0 GROUP BY a.rec, a.note_id)
SELECT note_id, round(CASE WHEN n < 5 THEN g ELSE local END, 6) AS residual, round(CASE WHEN n < 5 THEN gs ELSE local_step END, 6) AS step, n FROM l JOIN g USING (rec)""")
def alignment_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median offset in time and pitch of matched pairs near each, or of all of the recording with fewer than five near."""
    a, b = line_and_oracle(spark, sf_dir)
    near = joins.band_join(a.select("rec", "note_id", "onset", "pitch"), b, [SAME_REC], "onset", "o_onset", 0.5)
    d = F.col("onset") - F.col("o_onset")
    best = F.struct(F.abs(d), "o_id")
    m = near.groupBy("rec", "note_id", "onset").agg(F.min_by(d, best).alias("d"), F.min_by(F.col("pitch") - F.col("o_pitch"), best).alias("step"))
    g = m.groupBy("rec").agg(F.percentile("d", 0.5).alias("g"), F.percentile("step", 0.5).alias("gs"))
    both = joins.band_join(m.select("rec", "note_id", "onset"), m.select(F.col("rec").alias("o_rec"), F.col("onset").alias("there"), "d", "step"), [SAME_REC], "onset", "there", 2.0)
    local = both.groupBy("rec", "note_id").agg(F.percentile("d", 0.5).alias("local"), F.percentile("step", 0.5).alias("local_step"), F.count("*").alias("n"))
    pick = lambda one, all_: F.round(F.when(F.col("n") < 5, F.col(all_)).otherwise(F.col(one)), 6)
    return local.join(g, "rec").select("note_id", pick("local", "g").alias("residual"), pick("local_step", "gs").alias("step"), "n")


@query(NOTES + """, e AS (SELECT track, duration, lead(onset) OVER (PARTITION BY track ORDER BY onset, note_id) - onset - duration AS rest FROM notes)
SELECT track, round(100.0 * count(*) FILTER (WHERE duration < 0.25) / count(*), 6) AS short_values, round(100.0 * count(*) FILTER (WHERE rest > 0 AND rest < 1.0) / count(*), 6) AS short_rests FROM e GROUP BY track""")
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short values and short rests in a hundred events."""
    rest = F.lead("onset").over(islands.by("track", "onset", "note_id")) - F.col("onset") - F.col("duration")
    e = notes(spark, sf_dir).withColumn("rest", rest)
    rate = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 6)
    return e.groupBy("track").agg(rate(F.col("duration") < 0.25).alias("short_values"), rate((F.col("rest") > 0) & (F.col("rest") < 1.0)).alias("short_rests"))


@query(PHASED + """, s AS (SELECT track, onset, note_id, round_even((beat_idx + phase) * 4, 0) AS ours, round_even((beat_idx + phase + confidence / 40) * 4, 0) AS theirs FROM phased WHERE phase IS NOT NULL),
g AS (SELECT track, ours - lag(ours) OVER w AS a, theirs - lag(theirs) OVER w AS b FROM s WINDOW w AS (PARTITION BY track ORDER BY onset, note_id)) SELECT track, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 9) AS rhythm, count(a) AS n FROM g WHERE a IS NOT NULL GROUP BY track""")
def score_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of consecutive gaps that two writings of one line have in common."""
    w = islands.by("track", "onset", "note_id")
    p = phased(spark, sf_dir).where("phase is not null").withColumn("at", F.col("beat_idx") + F.col("phase"))
    p = p.withColumn("ours", F.bround(F.col("at") * 4)).withColumn("theirs", F.bround((F.col("at") + F.col("confidence") / 40) * 4))
    g = p.select("track", (F.col("ours") - F.lag("ours").over(w)).alias("a"), (F.col("theirs") - F.lag("theirs").over(w)).alias("b")).where("a is not null")
    return g.groupBy("track").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 9).alias("rhythm"), F.count("a").alias("n"))


@query(FRAMES + """, w AS (SELECT track, frame, periodicity, median(level) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS before, max(level) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS after,
  min(level) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS dip FROM frames) SELECT track, frame FROM w WHERE periodicity >= 0.05 AND before > 0 AND 20 * log10(after / before) >= 6.0 AND 20 * log10(before / dip) >= 3.0""")
def corroborate_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames before which the level rises, with a dip between."""
    w = islands.by("track", "frame")
    f = frames(spark, sf_dir).withColumn("before", F.percentile("level", 0.5).over(w.rowsBetween(-4, -1))).withColumn("after", F.max("level").over(w.rowsBetween(0, 3))).withColumn("dip", F.min("level").over(w.rowsBetween(-2, 2)))
    rise, fall = 20 * F.log10(F.col("after") / F.col("before")), 20 * F.log10(F.col("before") / F.col("dip"))
    return f.where((F.col("periodicity") >= 0.05) & (F.col("before") > 0) & (rise >= 6.0) & (fall >= 3.0)).select("track", "frame")


@query(BEATS + OWN + """, s AS (SELECT track, t, lead(t) OVER (PARTITION BY track ORDER BY t) AS nxt FROM own), m AS (SELECT track, median(nxt - t) AS mid FROM s GROUP BY track), g AS (SELECT track, t AS lo, nxt AS hi, mid FROM s JOIN m USING (track) WHERE nxt - t > 3.0 * mid)
SELECT b.track, b.t FROM beats b JOIN g ON b.track = g.track AND b.t >= lo AND b.t < hi WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.track = b.track AND abs(o.t - b.t) <= 1.0)""")
def splice_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of a filler grid within the gaps of another, not near one that is there."""
    from ..sources.project import beats

    base = own_beats(spark, sf_dir)
    s = base.select("track", F.col("t").alias("lo"), F.lead("t").over(islands.by("track", "t")).alias("hi"))
    m = s.groupBy("track").agg(F.percentile(F.col("hi") - F.col("lo"), 0.5).alias("mid"))
    g = s.join(m, "track").where((F.col("hi") - F.col("lo")) > 3.0 * F.col("mid")).select(F.col("track").alias("gt"), "lo", "hi")
    inside = joins.stabbing_join(beats(spark, sf_dir), g, [("track", "gt")], "t", ("lo", "hi"), 24.0).select("track", "t")
    return joins.band_join(inside, base.select(F.col("track").alias("bt"), F.col("t").alias("there")), [("track", "bt")], "t", "there", 1.0, "left_anti")


@query(NOTES + """, h AS (SELECT track, note_id, onset, onset + 4.0 * confidence + 1.0 AS off, pitch FROM notes), f AS (SELECT track, note_id, onset, pitch, unnest(range(ceil(onset / 2)::BIGINT, ceil(off / 2)::BIGINT)) AS frame FROM h)
SELECT track, frame, arg_max(pitch, (onset, note_id)) AS pitch FROM f GROUP BY track, frame""")
def notes_to_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on a frame clock; of several that sound, the later onset wins."""
    off = F.col("onset") + 4.0 * F.col("confidence") + 1.0
    lo, hi = F.ceil(F.col("onset") / 2), F.ceil(off / 2) - 1
    f = notes(spark, sf_dir).withColumn("lo", lo).withColumn("hi", hi).where("hi >= lo").select("track", "note_id", "onset", "pitch", F.explode(F.sequence("lo", "hi")).alias("frame"))
    return f.groupBy("track", "frame").agg(F.max_by("pitch", F.struct("onset", "note_id")).alias("pitch"))


@query("""SELECT b.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: greatest(b.embedding[i]::DOUBLE - a.embedding[i]::DOUBLE, 0.0))), 5) AS flux FROM embeddings b JOIN embeddings a ON a.vec_id = b.vec_id - 1""")
def spectral_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summed rises of each row's bins over those of the row before."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("b"))
    before = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("b").alias("a"))
    rise = F.aggregate(F.zip_with("b", "a", lambda x, y: F.greatest(x - y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return e.join(before, "vec_id").select("vec_id", F.round(rise, 5).alias("flux"))


@query(NOTES + """, w(f, v) AS (VALUES ('click', 0.5), ('view', -0.25), ('purchase', 1.0), ('p0', 0.1), ('p1', 0.2), ('p2', -0.3)), x AS (SELECT track, note_id, source AS f FROM notes UNION ALL SELECT track, note_id, 'p' || (pitch % 4)::VARCHAR FROM notes),
s AS (SELECT track, note_id, round(sum(coalesce(v, 0)), 9) AS score FROM x LEFT JOIN w USING (f) GROUP BY ALL) SELECT track, arg_max(note_id, (score, -note_id)) AS best, round(max(score), 6)::DOUBLE AS score FROM s GROUP BY track""")
def sparse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates' sparse features times weights; the best of each track, ties to the smaller id."""
    n = notes(spark, sf_dir)
    x = n.select("track", "note_id", F.explode(F.array("source", F.concat(F.lit("p"), (F.col("pitch") % 4).cast("string")))).alias("f"))
    w = spark.range(1).select(F.explode(F.create_map(*[F.lit(v) for p in (("click", 0.5), ("view", -0.25), ("purchase", 1.0), ("p0", 0.1), ("p1", 0.2), ("p2", -0.3)) for v in p])).alias("f", "v"))
    s = x.join(F.broadcast(w), "f", "left").groupBy("track", "note_id").agg(F.round(F.sum(F.coalesce("v", F.lit(0.0))), 9).alias("score"))
    return s.groupBy("track").agg(F.max_by("note_id", F.struct("score", -F.col("note_id"))).alias("best"), F.round(F.max("score"), 6).alias("score"))


@query(NOTES + OWN + """, s AS (SELECT track, t, lead(t) OVER (PARTITION BY track ORDER BY t) - t AS gap FROM own), m AS (SELECT track, median(gap) AS mid FROM s GROUP BY track)
SELECT track, round(60.0 / mid, 6) AS bpm, CASE WHEN 600.0 / mid < 100 THEN 'SLOW' WHEN 600.0 / mid < 140 THEN 'MEDIUM' WHEN 600.0 / mid < 200 THEN 'MEDIUM UP' ELSE 'UP' END AS band FROM m""")
def tempo_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.stats import median_interval

    m = median_interval(own_beats(spark, sf_dir))
    return m.select("track", F.round(60.0 / F.col("median"), 6).alias("bpm"), S.tempo_class(600.0 / F.col("median")).alias("band"))


@query(PHASED + """, b AS (SELECT note_id, floor(beat_idx / 4)::BIGINT AS bar FROM phased WHERE beat_idx IS NOT NULL), c AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_name AS chord FROM nation WHERE n_nationkey < 8)
SELECT note_id, bar, chord FROM b JOIN c ON ((bar - 3) % 8 + 8) % 8 = i""")
def place_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart of eight bars gone through again and again from a form bar on."""
    b = phased(spark, sf_dir).where("beat_idx is not null").select("note_id", F.floor(F.col("beat_idx") / 4).cast("long").alias("bar"))
    c = table(spark, sf_dir, "nation").where("n_nationkey < 8").select((F.row_number().over(Window.orderBy("n_nationkey")) - 1).alias("i"), F.col("n_name").alias("chord"))  # eight rows
    return b.join(F.broadcast(c), F.pmod(F.col("bar") - 3, F.lit(8)) == F.col("i")).select("note_id", "bar", "chord")


@query(FRAMES + """, m AS (SELECT track, frame, 1.0 + periodicity AS len FROM frames), p AS (SELECT *, sum(len) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) - len AS start, median(len) OVER (PARTITION BY track) AS mid FROM m)
SELECT track, frame, round(start, 5) AS start, round(start - frame * mid, 5) AS overrun FROM p""")
def page_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars placed one after another, and how far they run over an even grid."""
    w = islands.by("track", "frame")
    m = frames(spark, sf_dir).select("track", "frame", (1.0 + F.col("periodicity")).alias("len"))
    start = F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len")
    p = m.withColumn("start", start).withColumn("mid", F.percentile("len", 0.5).over(Window.partitionBy("track")))
    return p.select("track", "frame", F.round("start", 5).alias("start"), F.round(F.col("start") - F.col("frame") * F.col("mid"), 5).alias("overrun"))


@query(PHASED + """SELECT note_id, round(CASE WHEN phase - 0.05 < 0 THEN 0.0 ELSE phase - 0.05 END, 6) AS unlagged, round(CASE WHEN phase <= 0 OR phase >= 1 THEN phase WHEN phase <= 0.5 THEN phase / 0.5 * 0.62 ELSE 0.62 + (phase - 0.5) / 0.5 * (1 - 0.62) END, 6) AS unwarped,
round(0.62 / (1 - 0.62) / (1 + 0.62 / (1 - 0.62)), 6) AS star FROM phased WHERE phase IS NOT NULL""")
def unwarp_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = phased(spark, sf_dir).where("phase is not null")
    star = S.phase_from_bur(S.bur_from_phase(F.lit(0.62)))
    return p.select("note_id", F.round(F.greatest(F.lit(0.0), F.col("phase") - 0.05), 6).alias("unlagged"), F.round(S.unwarp_phase(F.col("phase"), F.lit(0.62)), 6).alias("unwarped"), F.round(star, 6).alias("star"))
