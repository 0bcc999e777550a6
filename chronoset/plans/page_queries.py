"""Queries of written pages: scalar lookups, notated positions and lengths, scraps and bends, page scores and edits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import islands, kernels, pages
from ..sources.project import notes, table
from .registry import query
from .kernel_queries import _lists
from .note_queries import NOTES, PHASED, phased

#: Written lengths in quarters, with their names and dots.
LENGTHS = ((4.0, "whole", 0), (3.0, "half", 1), (2.0, "half", 0), (1.5, "quarter", 1), (1.0, "quarter", 0), (0.75, "eighth", 1), (0.5, "eighth", 0), (0.375, "16th", 1), (0.25, "16th", 0), (0.125, "32nd", 0))


@query(NOTES + """, v(len, name, dots) AS (VALUES (4.0, 'whole', 0), (3.0, 'half', 1), (2.0, 'half', 0), (1.5, 'quarter', 1), (1.0, 'quarter', 0), (0.75, 'eighth', 1), (0.5, 'eighth', 0), (0.375, '16th', 1), (0.25, '16th', 0), (0.125, '32nd', 0)),
c AS (SELECT note_id, arg_min(name, (round(abs(len::DOUBLE - confidence * 4), 9), len)) AS type, arg_min(dots, (round(abs(len::DOUBLE - confidence * 4), 9), len)) AS dots, round_even(any_value(confidence) * 4 * 24, 0)::BIGINT AS ticks FROM notes, v GROUP BY note_id) SELECT * FROM c""")
def note_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest written length of each note, its dots, and its ticks."""
    near = lambda x: F.array_min(F.array(*[F.struct(F.round(F.abs(F.lit(v) - x), 9).alias("d"), F.lit(v).alias("v"), F.lit(n).alias("type"), F.lit(k).alias("dots")) for v, n, k in LENGTHS]))
    x = F.col("confidence") * 4
    return notes(spark, sf_dir).withColumn("b", near(x)).select("note_id", F.col("b.type").alias("type"), F.col("b.dots").alias("dots"), F.bround(x * 24).cast("long").alias("ticks"))


@query(PHASED + """, p AS (SELECT note_id, beat_idx + phase AS x, pitch, confidence, duration, source FROM phased WHERE phase IS NOT NULL)
SELECT note_id, round(floor(x) + CASE WHEN x - floor(x) <= 0.5 THEN (x - floor(x)) * (0.5 + 0.12) / 0.5 ELSE 0.5 + 0.12 + (x - floor(x) - 0.5) * (0.5 - 0.12) / 0.5 END, 6) AS swung,
CASE WHEN pitch >= 54 THEN 'right' ELSE 'left' END AS hand, duration < 0.45 AND confidence < 0.5 AS faint, CASE WHEN source = 'view' THEN 'line' WHEN pitch % 2 = 0 THEN 'all' ELSE 'line' END AS view,
round(2.5 + 1.25 * x, 6) AS mapped, round(3.0 + x * 60.0 / 132.0, 6) AS seconds, ([0, 1, 2, 3, 4, 5, 6, -5, -4, -3, -2, -1])[(7 * (pitch % 12)) % 12 + 1] AS fifths FROM p""")
def written_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swing put back, hands, faintness, views, maps of time and keys, a note at a time."""
    p = phased(spark, sf_dir).where("phase is not null").withColumn("x", F.col("beat_idx") + F.col("phase"))
    named = F.when(F.col("source") == "view", "line")
    return p.select(
        "note_id", F.round(S.swing_position(F.col("x"), 0.12), 6).alias("swung"), F.when(F.col("pitch") >= 54, "right").otherwise("left").alias("hand"), S.is_faint(F.col("duration"), F.col("confidence"), 0.45, 0.5).alias("faint"),
        F.coalesce(named, F.when(F.col("pitch") % 2 == 0, "all"), F.lit("line")).alias("view"), F.round(2.5 + 1.25 * F.col("x"), 6).alias("mapped"), F.round(3.0 + F.col("x") * 60.0 / 132.0, 6).alias("seconds"), S.fifths(F.col("pitch")).alias("fifths"),
    )


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_extendedprice, l_quantity::INT // 8 AS bar, l_quantity::INT % 4 + 1 AS beat, l_linenumber % 3 + 1 AS tatum, l_partkey::INT % 4 AS division, CASE WHEN l_suppkey % 20 = 0 THEN NULL WHEN l_suppkey % 2 = 0 THEN 3 ELSE 4 END AS period, l_suppkey FROM lineitem),
p AS (SELECT *, row_number() OVER w AS n, bar * period + (beat - 1) + (least(tatum, greatest(division, 1)) - 1) / greatest(1, division)::DOUBLE AS pos FROM m WHERE period IS NOT NULL WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice))
SELECT l_suppkey AS melid, n, round(pos - first_value(pos) OVER (PARTITION BY l_suppkey ORDER BY n), 6) AS pos FROM p""")
def notated_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in beats from bar, beat, tatum and division, from each melody's first note; rows without a metre are left out."""
    q = F.col("l_quantity").cast("int")
    division = F.greatest(F.lit(1), F.col("l_partkey").cast("int") % 4)
    period = F.when(F.col("l_suppkey") % 20 == 0, None).when(F.col("l_suppkey") % 2 == 0, 3).otherwise(4)
    pos = pages.position(F.floor(q / 8), q % 4 + 1, F.least(F.col("l_linenumber") % 3 + 1, division), division, F.col("period"))
    m = table(spark, sf_dir, "lineitem").withColumn("period", period).where("period is not null").withColumn("pos", pos)
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    first = F.first("pos").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return m.select(F.col("l_suppkey").alias("melid"), F.row_number().over(w).alias("n"), F.round(F.col("pos") - first, 6).alias("pos"))


@query("""WITH m AS (SELECT l_suppkey AS melid, CASE WHEN l_suppkey % 5 = 0 AND l_linenumber = 1 THEN 3 ELSE 4 END AS period, CASE WHEN l_suppkey % 7 = 0 THEN 8 ELSE 4 END AS denom, l_quantity::INT // 8 AS bar, l_quantity::INT % 4 AS beat FROM lineitem),
g AS (SELECT melid FROM m GROUP BY melid HAVING count(DISTINCT (period, denom)) = 1 AND min(denom) = 4) SELECT melid, min(period)::INT AS bar_length, count(*) AS n, round(min((bar - 1) * period + beat), 6)::DOUBLE AS first, round(max((bar - 1) * period + beat), 6)::DOUBLE AS last FROM m JOIN g USING (melid) GROUP BY melid""")
def notated_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute positions of melodies of one metre in quarters; others are refused whole."""
    q = F.col("l_quantity").cast("int")
    m = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("melid"), F.when((F.col("l_suppkey") % 5 == 0) & (F.col("l_linenumber") == 1), 3).otherwise(4).alias("period"), F.when(F.col("l_suppkey") % 7 == 0, 8).otherwise(4).alias("denom"), F.floor(q / 8).alias("bar"), (q % 4).alias("beat"))
    return pages.one_metre(m).withColumn("first", F.col("first").cast("double")).withColumn("last", F.col("last").cast("double"))


_WRITTEN = PHASED + """, ev AS (SELECT track, note_id, floor((beat_idx + round_even(phase * 4, 0) / 4) / 4)::BIGINT AS bar, (beat_idx + round_even(phase * 4, 0) / 4) - floor((beat_idx + round_even(phase * 4, 0) / 4) / 4) * 4 AS beat, round_even(confidence * 8, 0) / 4 AS len, pitch FROM phased WHERE phase IS NOT NULL),
gp AS (SELECT *, lead(bar * 4 + beat) OVER (PARTITION BY track ORDER BY bar, beat, note_id) - (bar * 4 + beat) AS gap FROM ev)"""


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, note_id, bar, beat, len, pitch, gap): notes on a grid of four a beat, with the beats to the next."""
    at = F.col("beat_idx") + F.bround(F.col("phase") * 4) / 4
    e = phased(spark, sf_dir).where("phase is not null").withColumn("bar", F.floor(at / 4)).withColumn("beat", at - F.floor(at / 4) * 4).withColumn("len", F.bround(F.col("confidence") * 8) / 4)
    pos = F.col("bar") * 4 + F.col("beat")
    return e.select("track", "note_id", "bar", "beat", "len", "pitch", (F.lead(pos).over(islands.by("track", "bar", "beat", "note_id")) - pos).alias("gap"))


@query(_WRITTEN + """SELECT note_id, round(CASE WHEN gap > 1e-6 AND (gap <= 0.5 + 1e-6 OR len >= 0.75 * gap OR (abs(beat - round_even(beat, 0)) <= 1e-6 AND abs(gap - round_even(gap, 0)) <= 1e-6 AND round_even(gap, 0) BETWEEN 1 AND 2) OR (gap - len > 1e-6 AND gap - len <= 1.0 + 1e-6 AND len >= 1.5 - 1e-6)) THEN gap ELSE len END, 6) AS written,
len <= 0.5 + 1e-6 AND coalesce(gap, 1e9) >= 1.0 - 1e-6 AND abs(beat * 2 - round_even(beat * 2, 0)) <= 1e-6 AND beat + 1.0 <= 4.0 + 1e-6 AS staccato FROM gp""")
def notated_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Played lengths as written ones: short gaps, held notes, notes held to a beat and short rests are closed; short notes before a rest are staccato quarters."""
    w = written(spark, sf_dir)
    return w.select("note_id", F.round(pages.written_length(F.col("beat"), F.col("len"), F.col("gap"), fill=0.75, cap=0.5, hold=2, close=1.0), 6).alias("written"), pages.staccato(F.col("beat"), F.col("len"), F.col("gap")).alias("staccato"))


_BEATS = PHASED + """, bt AS (SELECT track, beat_idx, count(*) AS n, min(phase) AS first, max(phase) AS last FROM phased WHERE phase IS NOT NULL GROUP BY track, beat_idx)"""


@query(_BEATS + """SELECT a.track, a.beat_idx, round(least(0.2, a.first), 6) AS lag FROM bt a LEFT JOIN bt b ON b.track = a.track AND b.beat_idx = a.beat_idx - 1 WHERE a.n <= 2 AND a.first BETWEEN 0.15 AND 0.35 AND a.last < 0.88 AND coalesce(b.last, 0.0) < 0.8""")
def isolated_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag of sparse beats whose first note is late, if nothing before them may be written on their line."""
    b = phased(spark, sf_dir).where("phase is not null").groupBy("track", "beat_idx").agg(F.count("*").alias("n"), F.min("phase").alias("first"), F.max("phase").alias("last"))
    return pages.isolated_lags(b, 2, 0.15, 0.35, 0.88, 0.8, 0.2).withColumn("lag", F.round("lag", 6))


@query(PHASED + """, pr AS (SELECT track, beat_idx AS unit, phase AS x FROM phased WHERE phase IS NOT NULL UNION ALL SELECT track, beat_idx - 1, 1.0 + phase FROM phased WHERE phase IS NOT NULL),
f AS (SELECT track, unit, list_sort(list(x)) AS v FROM pr WHERE x < 1.9 GROUP BY track, unit HAVING count(*) = 3), g AS (SELECT *, v[2] - v[1] AS a, v[3] - v[2] AS b FROM f WHERE unit >= 0 AND unit % 2 = 0 AND v[1] <= 0.3)
SELECT track, unit, round(a, 6) AS a, round(b, 6) AS b, greatest(a, b) / least(a, b) <= 1.6 AND a BETWEEN 0.4 AND 0.9 AND b BETWEEN 0.4 AND 0.9 AS triplet FROM g""")
def quarter_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of beats that hold three onsets, and whether they are evenly apart."""
    p = phased(spark, sf_dir).where("phase is not null").select("track", "beat_idx", "phase")
    return pages.quarter_triplets(p, 1.9, 0.3, (0.4, 0.9), 1.6).withColumn("a", F.round("a", 6)).withColumn("b", F.round("b", 6))


_FAINT = NOTES + ", fn AS (SELECT *, duration < 0.45 AND confidence < 0.9 AS faint, pitch % 2 + 1 AS voice FROM notes)"


@query(_FAINT + """SELECT note_id FROM fn a WHERE faint AND NOT EXISTS (SELECT 1 FROM fn b WHERE b.track = a.track AND b.faint AND b.note_id <> a.note_id AND abs(b.onset - a.onset) <= 4.0)""")
def faint_scraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faint notes with no other faint one near."""
    n = notes(spark, sf_dir).where(S.is_faint(F.col("duration"), F.col("confidence"), 0.45, 0.9))
    w = islands.by("track", "onset", "note_id")
    alone = lambda t: F.coalesce(F.abs(t.over(w) - F.col("onset")) > 4.0, F.lit(True))
    return n.where("onset is not null").withColumn("alone", alone(F.lag("onset")) & alone(F.lead("onset"))).where("alone").select("note_id")


_NEIGHBOURS = NOTES + """, nb AS (SELECT note_id, track, onset, pitch, duration, confidence, lag(pitch) OVER w AS bp, lag(onset + duration) OVER w AS be, lead(pitch) OVER w AS ap, lead(onset) OVER w AS ao, lead(onset + duration) OVER w AS ae, lag(onset) OVER w AS bo FROM notes WINDOW w AS (PARTITION BY track ORDER BY onset, note_id))"""


@query(_NEIGHBOURS + "SELECT note_id FROM nb WHERE duration < 0.6 AND confidence < 0.95 AND ((abs(ap - pitch) = 1 AND abs(ao - onset - duration) <= 2.0) OR (abs(bp - pitch) = 1 AND abs(onset - be) <= 2.0))")
def slide_scraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faint notes a semitone from a neighbour that they touch."""
    b = pages.neighbours(notes(spark, sf_dir))
    touch = lambda p, d: (F.abs(F.col(p) - F.col("pitch")) == 1) & (F.abs(d) <= 2.0)
    end = F.col("onset") + F.col("duration")
    near = F.coalesce(touch("after_pitch", F.col("after_onset") - end), F.lit(False)) | F.coalesce(touch("before_pitch", F.col("onset") - F.col("before_end")), F.lit(False))
    return b.where(S.is_faint(F.col("duration"), F.col("confidence"), 0.6, 0.95) & near).select("note_id")


@query(_NEIGHBOURS + """, bn AS (SELECT *, coalesce(bp = ap AND abs(pitch - bp) BETWEEN 1 AND 3 AND abs(onset - be) <= 6.0 AND abs(ao - onset - duration) <= 6.0, false) AS bend FROM nb),
tied AS (SELECT *, coalesce(lag(bend) OVER w, false) AS after_bend FROM bn WINDOW w AS (PARTITION BY track ORDER BY onset, note_id)),
ids AS (SELECT *, sum(CASE WHEN bend OR after_bend THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY onset, note_id ROWS UNBOUNDED PRECEDING) AS held FROM tied)
SELECT track, round(min(onset), 6) AS onset, round(max(CASE WHEN bend THEN onset ELSE onset + duration END) - min(onset), 6) AS duration, arg_min(pitch, (onset, note_id)) AS pitch, count(*) FILTER (WHERE bend) AS bends FROM ids GROUP BY track, held""")
def join_bends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held notes with the bends between them and the notes held again written as one."""
    out = pages.join_bends(notes(spark, sf_dir), 3, 6.0)
    return out.select("track", F.round("onset", 6).alias("onset"), F.round("duration", 6).alias("duration"), "pitch", "bends")


_DELTAS = PHASED + """, dl AS (SELECT track, note_id, onset, beat_idx + phase AS ours, beat_idx + phase + round_even(confidence * 3, 0) / 2 + CASE WHEN onset > 400 THEN 1.0 ELSE 0.0 END AS theirs FROM phased WHERE phase IS NOT NULL)"""


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = phased(spark, sf_dir).where("phase is not null").withColumn("ours", F.col("beat_idx") + F.col("phase"))
    return p.select("track", "note_id", "onset", "ours", (F.col("ours") + F.bround(F.col("confidence") * 3) / 2 + F.when(F.col("onset") > 400, 1.0).otherwise(0.0)).alias("theirs"))


@query(_DELTAS + """, w AS (SELECT track, floor(onset / 48)::BIGINT AS w, median(ours - theirs) AS local, count(*) AS n FROM dl GROUP BY ALL), g AS (SELECT track, median(ours - theirs) AS whole FROM dl GROUP BY track)
SELECT track, w, round(CASE WHEN n < 4 THEN whole ELSE local END, 6) AS shift, n FROM w JOIN g USING (track)""")
def window_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each window sits against the reference: its median difference, or the track's with fewer than four anchors."""
    d = _deltas(spark, sf_dir).withColumn("d", F.col("ours") - F.col("theirs"))
    g = d.groupBy("track").agg(F.percentile("d", 0.5).alias("whole"))
    w = d.groupBy("track", F.floor(F.col("onset") / 48).alias("w")).agg(F.percentile("d", 0.5).alias("local"), F.count("*").alias("n"))
    return w.join(g, "track").select("track", "w", F.round(F.when(F.col("n") < 4, F.col("whole")).otherwise(F.col("local")), 6).alias("shift"), "n")


@query(_DELTAS + """, b AS (SELECT track, onset, note_id, CASE WHEN x >= 4.0 THEN 0.0 ELSE x END AS d FROM (SELECT *, round_even((((ours - theirs)::DOUBLE % 4.0 + 4.0) % 4.0) * 2, 0) / 2 AS x FROM dl)), c AS (SELECT track, d, count(*) AS n, min((onset, note_id)) AS seen FROM b GROUP BY track, d)
SELECT track, arg_max(d, (n, -seen[1])) AS beat_offset, round(max(n) / sum(n), 6) AS beat_share, round(coalesce(sum(n) FILTER (WHERE d = 0.0), 0) / sum(n), 6) AS on_the_bar, sum(n)::BIGINT AS beat_n FROM c GROUP BY track""".replace("min((onset, note_id)) AS seen", "min(onset) AS seen").replace("-seen[1]", "-seen"))
def beat_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest difference of two writings modulo the bar, its share, and how many notes sit on the same beat."""
    return pages.beat_agreement(_deltas(spark, sf_dir), 4.0)


@query(_DELTAS + """, v AS (SELECT track, note_id, onset, ours, round_even((ours - theirs) * 2, 0) / 2 AS x, row_number() OVER (PARTITION BY track ORDER BY onset, note_id) AS i FROM dl),
near AS (SELECT a.track, a.i, b.x, count(*) AS n FROM v a JOIN v b ON a.track = b.track AND b.i BETWEEN a.i - 3 AND a.i + 3 GROUP BY ALL), lab AS (SELECT track, i, arg_max(x, (n, -x)) AS label FROM near GROUP BY track, i),
r0 AS (SELECT track, i, label, sum(CASE WHEN label IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(label) OVER (PARTITION BY track ORDER BY i) AS was FROM lab)),
r1 AS (SELECT track, run, any_value(label) AS label, min(i) AS first, count(*) AS n FROM r0 GROUP BY track, run), r2 AS (SELECT *, lag(label) OVER (PARTITION BY track ORDER BY run) AS was FROM r1 WHERE n >= 4)
SELECT r2.track, round(v.ours, 5) AS ours, was AS before, label AS after FROM r2 JOIN v ON v.track = r2.track AND v.i = r2.first WHERE was IS NOT NULL AND label <> was""")
def difference_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the difference of two writings steps: changes of its rolling mode that last four notes or more."""
    out = pages.difference_trace(_deltas(spark, sf_dir), 3, 4)
    return out.select("track", F.round("ours", 5).alias("ours"), "before", "after")


_ORIGINS = PHASED + """, orig AS (SELECT track, note_id, onset, round_even(beat_idx + phase - (round_even(confidence * 20, 0) / 2 + track % 3), 0)::BIGINT AS origin, row_number() OVER (PARTITION BY track ORDER BY onset, note_id) AS i FROM phased WHERE phase IS NOT NULL)"""


@query(_ORIGINS + """, ph AS (SELECT track, ((origin % 4) + 4) % 4 AS phase, count(*) AS n, min(i) AS seen FROM orig GROUP BY ALL), b AS (SELECT track, arg_max(phase, (n, -seen)) AS phase, max(n) AS top, sum(n)::BIGINT AS votes FROM ph GROUP BY track),
o AS (SELECT o.track, origin, i, votes FROM orig o JOIN b ON b.track = o.track AND ((origin % 4) + 4) % 4 = phase), f AS (SELECT track, origin, count(*) AS n, min(i) AS seen FROM o WHERE i <= greatest(1, round_even(votes * 0.2, 0)) GROUP BY ALL),
l AS (SELECT track, origin, count(*) AS n, min(i) AS seen FROM o WHERE i > votes - greatest(1, round_even(votes * 0.2, 0)) GROUP BY ALL), a AS (SELECT track, origin, count(*) AS n, min(i) AS seen FROM o GROUP BY ALL),
m AS (SELECT track, arg_max(origin, (n, -seen)) AS x FROM a GROUP BY track), mf AS (SELECT track, arg_max(origin, (n, -seen)) AS x FROM f GROUP BY track), ml AS (SELECT track, arg_max(origin, (n, -seen)) AS x FROM l GROUP BY track)
SELECT b.track, votes, phase, round(top / votes, 6) AS share, coalesce(mf.x, m.x) AS first, coalesce(ml.x, m.x) AS last, votes >= 8 AND top / votes >= 0.3 AS trusted FROM b JOIN m ON m.track = b.track LEFT JOIN mf ON mf.track = b.track LEFT JOIN ml ON ml.track = b.track""")
def bars_on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's bar lines on a grid by votes: the phase, and the origins that the page's two ends vote for."""
    p = phased(spark, sf_dir).where("phase is not null")
    origin = F.bround(F.col("beat_idx") + F.col("phase") - (F.bround(F.col("confidence") * 20) / 2 + F.col("track") % 3)).cast("long")
    o = p.select("track", origin.alias("origin"), F.row_number().over(islands.by("track", "onset", "note_id")).alias("i"))
    return pages.bars_on_grid(o, 4, 0.2, 8, 0.3).withColumn("share", F.round("share", 6))


@query()
def edit_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest edits that turn one order's line into the next one's: notes inserted, left out or of another pitch, moved places and changed values."""

    def run(batches):  # noqa: ANN001, ANN202
        line = lambda v, k: (np.arange(v.shape[1]) * 0.5 + v % k * 0.25, (v % (k + 1) + 1) / 4, v % 12)
        for b in batches:
            found = np.zeros((len(b), 5), dtype=np.int64)
            for at, x, y in kernels.by_shape(b["seq"].to_list(), b["other"].to_list()):
                found[at] = kernels.edits_many(line(x, 3), line(y, 2))
            yield pd.DataFrame(found, columns=["insertions", "deletions", "pitch", "position", "value"]).assign(o_orderkey=b["o_orderkey"].to_numpy())

    return _lists(spark, sf_dir).mapInPandas(run, "o_orderkey long, insertions long, deletions long, pitch long, position long, value long")


@query()
def score_against_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the next order's line one order's covers, and how far rhythm and values agree."""

    def run(batches):  # noqa: ANN001, ANN202
        line = lambda v, k: [(i * 0.5 + x % k * 0.25, (x % (k + 1) + 1) / 4, x % 12) for i, x in enumerate(v)]
        for b in batches:
            shift, _ = kernels.best_shifts([[v % 12 for v in y] for y in b["other"]], [[v % 12 for v in x] for x in b["seq"]], range(-6, 7))
            rows = [(key, *kernels.page_score(line(x, 3), line(y, 2), shift=int(s))) for key, x, y, s in zip(b["o_orderkey"], b["seq"], b["other"], shift, strict=True)]
            yield pd.DataFrame(rows, columns=["o_orderkey", "coverage", "rhythm", "value", "shift"])

    return _lists(spark, sf_dir).mapInPandas(run, "o_orderkey long, coverage double, rhythm double, value double, shift long")


@query(_WRITTEN + """SELECT track, string_agg('Note ' || pitch || ' ' || round_even((bar * 4 + beat) * 500, 0)::BIGINT || ' ' || round_even(len * 500, 0)::BIGINT, chr(10) ORDER BY bar, beat, note_id) AS lines FROM ev WHERE len > 0 GROUP BY track""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page as lines of text for a scoring tool, 500 ms a quarter."""
    ms = lambda x: F.bround(x * 500).cast("long").cast("string")
    text = F.concat_ws(" ", F.lit("Note"), F.col("pitch").cast("string"), ms(F.col("bar") * 4 + F.col("beat")), ms(F.col("len")))
    rows = F.array_sort(F.collect_list(F.struct("bar", "beat", "note_id", text.alias("line"))))
    return written(spark, sf_dir).where("len > 0").groupBy("track").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("lines"))


@query(_WRITTEN + """, c AS (SELECT track, pitch, sum(len) AS w FROM ev WHERE len > 0 GROUP BY ALL),
q AS (SELECT track, pitch, sum(w) OVER (PARTITION BY track ORDER BY pitch) AS upto, sum(w) OVER (PARTITION BY track) AS total FROM c), m AS (SELECT track, min(pitch) AS mid FROM q WHERE upto >= total / 2 GROUP BY track)
SELECT track, mid, CASE WHEN mid < 54 THEN 'bass' ELSE 'treble' END AS clef FROM m""")
def clefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clef of each track, by the median pitch weighed by length."""
    m = pages.weighted_median(written(spark, sf_dir).where("len > 0"), ["track"], "pitch", "len").withColumnRenamed("median", "mid")
    return m.select("track", "mid", F.when(F.col("mid") < 54, "bass").otherwise("treble").alias("clef"))


@query(_WRITTEN + "SELECT track, round(avg(CASE WHEN len <= 0.25 THEN 1.0 ELSE 0.0 END), 6) AS short FROM ev GROUP BY track")
def short_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir).groupBy("track").agg(F.round(F.avg((F.col("len") <= 0.25).cast("double")), 6).alias("short"))


@query(_WRITTEN + """, bm AS (SELECT *, len <= 0.5 AND len > 0 AS flagged, floor(beat)::BIGINT AS slot FROM ev), nw AS (SELECT *, coalesce(flagged AND lag(flagged) OVER w AND lag(bar) OVER w = bar AND lag(slot) OVER w = slot, false) AS goes_on FROM bm WINDOW w AS (PARTITION BY track ORDER BY bar, beat, note_id)),
id AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY bar, beat, note_id ROWS UNBOUNDED PRECEDING) AS g FROM nw), sz AS (SELECT *, count(*) OVER (PARTITION BY track, g) AS n, row_number() OVER (PARTITION BY track, g ORDER BY beat, note_id) AS k FROM id)
SELECT note_id, CASE WHEN k = 1 THEN 'begin' WHEN k = n THEN 'end' ELSE 'continue' END AS mark FROM sz WHERE n > 1""")
def beam_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beams over flagged notes of one beat: where each begins, goes on and ends."""
    return pages.beam_marks(written(spark, sf_dir))


@query(PHASED + """, hv AS (SELECT track, pitch % 2 + 1 AS voice, beat_idx + phase AS pos, (floor((beat_idx + phase + 0.15) / 2) * 2)::INT AS unit FROM phased WHERE phase IS NOT NULL),
hg AS (SELECT track, unit, voice, list_sort(list(round(pos - unit, 9))) AS o, count(*) AS n FROM hv GROUP BY track, unit, voice),
hf AS (SELECT *, CASE WHEN n = 3 THEN round(list_min(list_transform(range(31), lambda k: (abs(o[1] - k * 0.005::DOUBLE) + abs(o[2] - k * 0.005::DOUBLE - 2 / 3.0::DOUBLE) + abs(o[3] - k * 0.005::DOUBLE - 4 / 3.0::DOUBLE)) / 3)), 9) END AS thirds,
  CASE WHEN n = 3 THEN round(list_min(list_transform(range(31), lambda k: list_sum(list_transform(o, lambda x: abs(x - k * 0.005::DOUBLE - 0.5::DOUBLE * round_even((x - k * 0.005::DOUBLE) / 0.5::DOUBLE, 0)))) / 3)), 9) END AS eighths FROM hg),
hh AS (SELECT track, unit, coalesce(max(n) FILTER (WHERE voice = 1), 0) AS upper_, coalesce(max(n) FILTER (WHERE voice = 2), 0) AS lower_, bool_and(coalesce(thirds <= 0.2 AND eighths >= 1.1 * thirds, false)) AS two, bool_or(coalesce(thirds <= 0.15 AND eighths >= 1.2 * thirds, false)) AS one FROM hf GROUP BY track, unit)
SELECT track, unit, upper_ AS upper, lower_ AS lower FROM hh WHERE (upper_ = 3 AND lower_ = 3 AND two) OR (upper_ + lower_ = 3 AND (upper_ = 0 OR lower_ = 0) AND one)""")
def head_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half bars that read as quarter-note triplets over both voices."""
    p = phased(spark, sf_dir).where("phase is not null").select("track", (F.col("pitch") % 2 + 1).alias("voice"), (F.col("beat_idx") + F.col("phase")).alias("pos"))
    return pages.head_triplets(p, 0.15, 0.2, 1.1, 0.15, 1.2)
