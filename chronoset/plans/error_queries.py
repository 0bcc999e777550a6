"""Queries of the error ladders: reference notes are views, ours clicks, another detector's purchases; frames are dealt to recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import errors, joins, stats
from ..operators.lineage import settled
from ..sources.project import SQL, frames, notes
from .kernel_queries import matched
from .registry import query

#: Frames of twelve tracks, one after another, are those of a recording; a frame is a tenth of a unit long.
HOP = 0.1
EVIDENCE = "WITH " + SQL["notes"] + ", " + SQL["frames"] + """,
n AS (SELECT track // 50 AS rec, note_id AS id, onset, duration, pitch, confidence, source FROM notes),
ref AS (SELECT * FROM n WHERE source = 'view'), est AS (SELECT * FROM n WHERE source = 'click'), other AS (SELECT * FROM n WHERE source = 'purchase'),
ev AS (SELECT track // 12 AS rec, (track % 12) * 60.0::DOUBLE + frame * 0.1::DOUBLE AS t, 47.0::DOUBLE + pitch / 4 AS f0, periodicity, level FROM frames),
w AS (SELECT id, pitch, t, f0, periodicity, level >= 30000 AS loud, level, coalesce(abs(f0 - pitch) <= 0.5, false) AS same FROM ref JOIN ev ON ref.rec = ev.rec AND t >= onset - 0.03 AND t < onset + greatest(duration, 0.05)),
sp AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY t ROWS UNBOUNDED PRECEDING) AS spell FROM w),
runs AS (SELECT id, max(c) AS run FROM (SELECT id, spell, count(*) AS c FROM sp WHERE same GROUP BY id, spell) GROUP BY id),
facts AS (SELECT w.id, count(*) AS frames, max(periodicity) AS most, avg(CASE WHEN loud THEN 1.0 ELSE 0.0 END) AS energetic, avg(CASE WHEN loud AND periodicity >= 0.05 THEN 1.0 ELSE 0.0 END) AS live, avg(CASE WHEN same THEN 1.0 ELSE 0.0 END) AS at_ref,
  median(CASE WHEN loud AND periodicity >= 0.05 THEN f0 END) AS live_f0, avg(level) AS level, coalesce(max(run), 0) AS run FROM w LEFT JOIN runs ON runs.id = w.id GROUP BY w.id)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = notes(spark, sf_dir).select(F.floor(F.col("track") / 50).alias("rec"), F.col("note_id").alias("id"), "onset", "duration", "pitch", "confidence", "source")
    return tuple(n.where(F.col("source") == s).drop("source") for s in ("view", "click", "purchase"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return f.select(F.floor(F.col("track") / 12).alias("rec"), (F.pmod("track", F.lit(12)) * 60.0 + F.col("frame") * 0.1).alias("t"), (47.0 + F.col("pitch") / 4).alias("f0"), "periodicity", "level")


def _facts(ref: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.frame_facts(ref, _evidence(spark, sf_dir), 0.03, 0.05, 0.05, 30000.0, 0.5)


@query(EVIDENCE + "SELECT id, frames, most, round(energetic, 6) AS energetic, round(live, 6) AS live, round(at_ref, 6) AS at_ref, live_f0, run FROM facts")
def frame_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the frames say about each reference note."""
    f = _facts(_sides(spark, sf_dir)[0], spark, sf_dir)
    return f.select("id", "frames", "most", *[F.round(c, 6).alias(c) for c in ("energetic", "live", "at_ref")], "live_f0", "run")


_MISSED = EVIDENCE + """, missed AS (SELECT * FROM ref r WHERE NOT EXISTS (SELECT 1 FROM est e WHERE e.rec = r.rec AND e.pitch = r.pitch AND abs(e.onset - r.onset) <= 0.05)),
cov AS (SELECT m.id, arg_min(e.pitch = m.pitch, (e.pitch <> m.pitch, e.onset, e.id)) AS same, arg_min(e.onset + e.duration, (e.pitch <> m.pitch, e.onset, e.id)) AS cover_end FROM missed m JOIN est e ON e.rec = m.rec AND m.onset > e.onset + 0.05 AND m.onset <= e.onset + e.duration GROUP BY m.id),
lm AS (SELECT m.id, CASE WHEN count(*) >= 3 THEN median(e.pitch) END AS line FROM missed m JOIN est e ON e.rec = m.rec AND abs(e.onset - m.onset) <= 2.0 GROUP BY m.id),
ladder AS (SELECT m.id, CASE WHEN c.same THEN 'merged' WHEN c.id IS NOT NULL AND cover_end - m.onset >= 0.2 THEN 'absorbed' WHEN c.id IS NOT NULL THEN 'squeezed'
  WHEN EXISTS (SELECT 1 FROM other o WHERE o.rec = m.rec AND o.pitch = m.pitch AND abs(o.onset - m.onset) <= 0.1) THEN 'not_picked' WHEN f.level < 25000 THEN 'left_stem' WHEN f.id IS NULL THEN 'unclassified'
  WHEN energetic = 0 THEN 'gated' WHEN most < 0.05 THEN 'unvoiced' WHEN live = 0 THEN 'gated' WHEN run BETWEEN 1 AND 1 THEN 'too_short' WHEN run >= 2 AND m.pitch < line - 4 THEN 'dropped_register' WHEN run >= 2 THEN 'dropped'
  WHEN abs(abs(live_f0 - m.pitch) - 12) <= 0.5 OR abs(abs(live_f0 - m.pitch) - 24) <= 0.5 THEN 'tracked_octave' WHEN live_f0 IS NOT NULL THEN 'tracked_other' ELSE 'unclassified' END AS class
  FROM missed m LEFT JOIN cov c ON c.id = m.id LEFT JOIN facts f ON f.id = m.id LEFT JOIN lm ON lm.id = m.id)"""


def _unmatched(a: DataFrame, b: DataFrame) -> DataFrame:
    """Notes of a without one of b of their pitch within 0.05."""
    return joins.band_join(a, b.select(F.col("rec").alias("m_rec"), F.col("pitch").alias("m_pitch"), F.col("onset").alias("m_on")), [("rec", "m_rec"), ("pitch", "m_pitch")], "onset", "m_on", 0.05, "left_anti")


def missed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, est, other = _sides(spark, sf_dir)
    missed = _unmatched(ref, est)
    heard = joins.band_join(missed.select("rec", "id", "pitch", "onset"), other.select(F.col("rec").alias("h_rec"), F.col("pitch").alias("h_pitch"), F.col("onset").alias("h_on")), [("rec", "h_rec"), ("pitch", "h_pitch")], "onset", "h_on", 0.1, "left_semi")
    return errors.classify_miss(missed, est, _facts(missed, spark, sf_dir), heard, 25000.0, 0.05, 0.2, HOP, 4.0, 2.0, 0.5)


@query(_MISSED + "SELECT id, class FROM ladder")
def classify_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missed_classes(spark, sf_dir)


_EXTRA = EVIDENCE + """, extra AS (SELECT * FROM est e WHERE NOT EXISTS (SELECT 1 FROM ref r WHERE e.rec = r.rec AND e.pitch = r.pitch AND abs(e.onset - r.onset) <= 0.05)),
xc AS (SELECT e.id, arg_min(r.pitch, (r.pitch <> e.pitch, r.onset, r.id)) AS cover_pitch FROM extra e JOIN ref r ON e.rec = r.rec AND e.onset > r.onset + 0.05 AND e.onset <= r.onset + r.duration + 0.05 GROUP BY e.id),
xl AS (SELECT e.id, CASE WHEN count(*) >= 3 THEN median(r.pitch) END AS line FROM extra e JOIN ref r ON e.rec = r.rec AND abs(e.onset - r.onset) <= 2.0 GROUP BY e.id),
xs AS (SELECT e.id, max(o.confidence) / any_value(e.confidence) AS ratio FROM extra e JOIN other o ON e.rec = o.rec AND e.pitch = o.pitch AND abs(e.onset - o.onset) <= 0.3 GROUP BY e.id),
xg AS (SELECT e.id, max(r.onset) FILTER (WHERE r.onset <= e.onset) AS before, min(r.onset) FILTER (WHERE r.onset > e.onset) AS after FROM extra e LEFT JOIN ref r ON e.rec = r.rec GROUP BY e.id),
xladder AS (SELECT e.id, CASE WHEN cover_pitch = e.pitch THEN 'split_sustain' WHEN e.pitch < line - 4 THEN 'bleed_register' WHEN ratio >= 1.0 THEN 'bleed_cross_stem' WHEN abs(e.pitch - cover_pitch) IN (12, 24) THEN 'fragment_octave'
  WHEN abs(e.pitch - cover_pitch) IN (1, 2) THEN 'fragment_neighbour' WHEN cover_pitch IS NOT NULL THEN 'fragment_other' WHEN after - before >= 1.0 THEN 'between_phrases' WHEN before IS NOT NULL AND after IS NOT NULL THEN 'between_notes'
  WHEN before IS NOT NULL OR after IS NOT NULL THEN 'between_phrases' ELSE 'unclassified' END AS class FROM extra e LEFT JOIN xc ON xc.id = e.id LEFT JOIN xl ON xl.id = e.id LEFT JOIN xs ON xs.id = e.id LEFT JOIN xg ON xg.id = e.id)"""


def extra_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, est, other = _sides(spark, sf_dir)
    return errors.classify_extra(_unmatched(est, ref), ref, other, 0.05, 4.0, 2.0, 0.3, 1.0, 1.0)


@query(_EXTRA + "SELECT id, class FROM xladder")
def classify_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extra_classes(spark, sf_dir)


@query(_EXTRA + _MISSED.removeprefix(EVIDENCE) + """, every AS (SELECT rec, 'miss' AS kind, class FROM missed JOIN ladder USING (id) UNION ALL SELECT rec, 'extra', class FROM extra JOIN xladder USING (id))
SELECT rec, kind, class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY rec, kind), 6) AS share FROM every GROUP BY rec, kind, class""")
def error_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recording's errors by class, with their share of its misses or extras."""
    from pyspark.sql import Window

    ref, est, _ = _sides(spark, sf_dir)
    one = missed_classes(spark, sf_dir).join(ref.select("rec", "id"), "id").select("rec", F.lit("miss").alias("kind"), "class")
    two = extra_classes(spark, sf_dir).join(est.select("rec", "id"), "id").select("rec", F.lit("extra").alias("kind"), "class")
    n = one.union(two).groupBy("rec", "kind", "class").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("rec", "kind")), 6))


@query(EVIDENCE + """, p AS (SELECT r.rec, r.id AS ref_id, e.id AS est_id, r.onset AS ro, r.onset + r.duration + 0.05 AS rend, r.pitch AS rp, e.onset AS eo, e.pitch AS ep, row_number() OVER (PARTITION BY r.id ORDER BY abs(e.onset - r.onset), e.id) AS k FROM ref r JOIN est e ON e.rec = r.rec AND abs(e.onset - r.onset) <= 0.15)
SELECT ref_id, est_id, CASE WHEN ep = rp AND abs(eo - ro) <= 0.05 THEN 'unaligned' WHEN ep = rp AND eo > ro THEN 'timing_late' WHEN ep = rp THEN 'timing_early' WHEN EXISTS (SELECT 1 FROM est b WHERE b.rec = p.rec AND b.pitch = rp AND b.onset > eo AND b.onset <= rend) THEN 'attack_transient'
WHEN abs(eo - ro) > 0.05 THEN 'loose' WHEN abs(ep - rp) IN (12, 24) THEN 'octave' WHEN abs(ep - rp) IN (1, 2) THEN 'neighbour' ELSE 'other_pitch' END AS class FROM p WHERE k = 1""")
def classify_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest note of ours to each reference note, and how the two differ."""
    ref, est, _ = _sides(spark, sf_dir)
    e = est.select(F.col("rec").alias("e_rec"), F.col("id").alias("est_id"), F.col("onset").alias("est_onset"), F.col("pitch").alias("est_pitch"))
    near = joins.band_join(ref.select("rec", F.col("id").alias("ref_id"), F.col("onset").alias("ref_onset"), F.col("duration").alias("ref_duration"), F.col("pitch").alias("ref_pitch")), e, [("rec", "e_rec")], "ref_onset", "est_onset", 0.15)
    best = near.groupBy("ref_id").agg(F.min_by(F.struct("rec", "ref_onset", "ref_duration", "ref_pitch", "est_id", "est_onset", "est_pitch"), F.struct(F.abs(F.col("est_onset") - F.col("ref_onset")), "est_id")).alias("x"))
    return errors.classify_pairs(best.select("ref_id", "x.*"), est, 0.05, 0.05).drop("body_id")


#: How far apart a pair may be, and how far a hit.
PAIR, HIT = 0.15, 0.05


def solo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits are a maximum matching within a pitch; pairs one of least distance among the notes that no hit has."""
    n = settled(notes(spark, sf_dir).select(F.floor(F.col("track") / 50).alias("rec"), F.col("note_id").alias("id"), "onset", "duration", "pitch", "confidence", "source").where(F.col("source").isin("view", "click", "purchase")))
    ref, est, other = (n.where(F.col("source") == s).drop("source") for s in ("view", "click", "purchase"))
    hits = settled(matched(ref, est, "most", HIT, ["rec", "pitch"]).toDF("ref_id", "est_id"))
    free = lambda notes, side: notes.join(hits.select(F.col(side).alias("id")), "id", "left_anti")
    pairs = settled(matched(free(ref, "ref_id"), free(est, "est_id"), "cost", PAIR, ["rec"]).toDF("ref_id", "est_id"))

    def misses(missed: DataFrame) -> DataFrame:
        missed = settled(missed)
        heard = joins.band_join(missed.select("rec", "id", "pitch", "onset"), other.select(F.col("rec").alias("h_rec"), F.col("pitch").alias("h_pitch"), F.col("onset").alias("h_on")), [("rec", "h_rec"), ("pitch", "h_pitch")], "onset", "h_on", 0.1, "left_semi")
        return errors.classify_miss(missed, est, _facts(missed, spark, sf_dir), heard, 25000.0, 0.05, 0.2, HOP, 4.0, 2.0, 0.5)

    extras = lambda extra: errors.classify_extra(settled(extra), ref, other, 0.05, 4.0, 2.0, 0.3, 1.0, 1.0)
    return errors.classify_all(ref, est, hits, pairs, misses, extras, HIT, 0.05)


@query()
def solo_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every note of the reference and of ours: a hit, one of a pair, missed or made up, each with its one class."""
    return solo_rows(spark, sf_dir)


@query()
def f1_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each class of error takes of a recording's 1 - F1; they sum to it."""
    return errors.deficit(solo_rows(spark, sf_dir)).withColumn("part", F.round("part", 6))


@query(EVIDENCE + """, f AS (SELECT rec, t, sqrt(level) AS rms FROM ev), o AS (SELECT rec, list_sort(list(rms)) AS v FROM f GROUP BY rec), g AS (SELECT rec, v[least(len(v) - 1, floor(len(v) * 0.95))::INT + 1] AS loud FROM o)
SELECT e.id, round(20 * log10(avg(rms) / any_value(loud)), 6) AS db, round(avg(CASE WHEN rms >= 0.6 * loud THEN 1.0 ELSE 0.0 END), 6) AS open FROM est e JOIN f ON e.rec = f.rec AND t >= onset AND t < onset + duration JOIN g ON g.rec = e.rec GROUP BY e.id""")
def note_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level under each note against the recording's loud reference (the value at 95 in a hundred), and how many frames pass a gate."""
    f = _evidence(spark, sf_dir).select("rec", "t", F.sqrt("level").alias("rms"))
    loud = stats.order_statistic(f, ["rec"], "rms", 0.95).select(F.col("rec").alias("g_rec"), F.col("value").alias("loud"))
    e = _sides(spark, sf_dir)[1].select(F.col("rec").alias("e_rec"), "id", "onset", (F.col("onset") + F.col("duration")).alias("end"))
    at = joins.stabbing_join(f, e, [("rec", "e_rec")], "t", ("onset", "end"), 1.0).join(loud, F.col("rec") == F.col("g_rec"))
    return at.groupBy("id").agg(F.round(20 * F.log10(F.avg("rms") / F.first("loud")), 6).alias("db"), F.round(F.avg((F.col("rms") >= 0.6 * F.col("loud")).cast("double")), 6).alias("open"))
