"""Queries whose step is inherently sequential: grouped kernels on one track's rows.

None has an oracle in SQL; tests hold the kernels against brute force and the queries against the kernels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import islands, kernels, windows
from ..operators.lineage import settled
from ..sources.project import frames, notes, table
from .registry import query
from .note_queries import FRAMES, LINE, NOTES, line_and_oracle, voices


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sequences: an order's quantities and those of the next order of the customer."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), lambda x: x["l_quantity"].cast("int")).alias("seq"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    both = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("o_orderkey", "seq", F.lead("seq").over(w).alias("other"))
    return both.where("other is not null")


@query()
def align_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global alignment of each pair: equal pairs, substitutions, insertions and deletions."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            x, y = b["seq"].to_list(), b["other"].to_list()
            same, subs = kernels.alignments(x, y, 12)
            yield pd.DataFrame({"o_orderkey": b["o_orderkey"], "matches": same, "subs": subs, "inserted": [len(v) for v in y] - same - subs, "deleted": [len(v) for v in x] - same - subs})

    return _lists(spark, sf_dir).mapInPandas(run, "o_orderkey long, matches long, subs long, inserted long, deleted long")


@query()
def best_transposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shift of the second sequence, of two octaves either way, that aligns best."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            shift, most = kernels.best_shifts(b["seq"].to_list(), b["other"].to_list())
            yield pd.DataFrame({"o_orderkey": b["o_orderkey"], "shift": shift, "matches": most})

    return _lists(spark, sf_dir).mapInPandas(run, "o_orderkey long, shift long, matches long")


def _candidates(a: DataFrame, b: DataFrame, band: float, keys: list[str]) -> DataFrame:
    """Neighbourhoods of notes (rec, id, onset, pitch) of both sides, cut where nothing of equal keys is within the band, so each is a
    small group."""
    columns = ["rec", "id", "onset", "pitch"]
    rows = a.select(F.lit(0).alias("side"), *columns).union(b.select(F.lit(1), *columns))
    w = islands.by(keys, "onset", "side", "id")
    new = F.coalesce(F.col("onset") - F.lag("onset").over(w) > band, F.lit(True))
    own = Window.partitionBy(*keys, "part")
    rows = rows.withColumn("part", islands.island_id(new, w)).withColumn("sides", F.min("side").over(own) != F.max("side").over(own))
    return rows.where("sides").drop("sides")


#: Seconds that an unequal pitch counts as in a pairing.
PENALTY = 0.05


def _matched(method: str, band: float):  # noqa: ANN202
    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["side"] == 0].reset_index(drop=True), g[g["side"] == 1].reset_index(drop=True)
        left, right = list(zip(a["onset"], a["pitch"], strict=True)), list(zip(b["onset"], b["pitch"], strict=True))
        if method == "greedy":
            pairs = kernels.greedy_match(left, right, band)
        elif method == "most":
            edges = [[j for j, y in enumerate(right) if abs(x[0] - y[0]) <= band] for x in left]
            pairs = [(i, j) for i, j in enumerate(kernels.maximum_matching(edges, len(right))) if j >= 0]
        elif not left or not right:
            pairs = []
        else:
            cost = np.array([[abs(x[0] - y[0]) + PENALTY * (x[1] != y[1]) if abs(x[0] - y[0]) <= band else 1e3 for y in right] + [1e3] * len(left) for x in left]).reshape(len(left), -1)
            pairs = [(i, j) for i, j in enumerate(kernels.assignment(cost)) if j < len(right) and cost[i, j] < 1e3]
        return pd.DataFrame({"note_id": [int(a["id"][i]) for i, _ in pairs], "o_id": [int(b["id"][j]) for _, j in pairs]}, columns=["note_id", "o_id"])

    return run


def matched(a: DataFrame, b: DataFrame, method: str, band: float, keys: list[str]) -> DataFrame:
    """(note_id, o_id) of notes (rec, id, onset, pitch) of two sides, by one of the matchings."""
    return kernels.per_group(_candidates(a, b, band, keys), [*keys, "part"], ["onset", "side", "id"], _matched(method, band), "note_id long, o_id long")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a, b = line_and_oracle(spark, sf_dir)
    return a.select("rec", F.col("note_id").alias("id"), "onset", "pitch"), b.select(F.col("o_rec").alias("rec"), F.col("o_id").alias("id"), F.col("o_onset").alias("onset"), F.col("o_pitch").alias("pitch"))


def _pairs(spark: SparkSession, sf_dir: str, method: str, band: float, keys: list[str]) -> DataFrame:
    return matched(*_sides(spark, sf_dir), method, band, keys)


@query()
def note_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A maximum matching of both detectors' notes of one recording and pitch."""
    return _pairs(spark, sf_dir, "most", 1.0, ["rec", "pitch"])


_GREEDY = NOTES.replace("WITH ", "WITH RECURSIVE ", 1) + LINE + """, cand AS (SELECT note_id, o_id, row_number() OVER (ORDER BY abs(onset - o_onset), onset, note_id, o_onset, o_id) AS r FROM line JOIN oracle ON rec = o_rec AND pitch = o_pitch AND abs(onset - o_onset) <= 1.0),
rounds(note_id, o_id, r, taken, k) AS (SELECT note_id, o_id, r, false, 0 FROM cand
  UNION ALL SELECT * FROM (WITH live AS (SELECT * FROM rounds WHERE NOT taken), best AS (SELECT *, r = min(r) OVER (PARTITION BY note_id) AND r = min(r) OVER (PARTITION BY o_id) AS wins FROM live),
    won AS (SELECT note_id, o_id FROM best WHERE wins) SELECT note_id, o_id, r, wins, k + 1 FROM best b WHERE wins OR NOT EXISTS (SELECT 1 FROM won w WHERE w.note_id = b.note_id OR w.o_id = b.o_id)))
SELECT note_id, o_id FROM rounds WHERE taken"""


@query(_GREEDY)
def greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one recording and pitch, nearest first, each note once."""
    return _pairs(spark, sf_dir, "greedy", 1.0, ["rec", "pitch"])


@query()
def pair_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the notes that note_hits leaves, the pairs of least total distance, of any pitch; an unequal one has a penalty."""
    a, b = _sides(spark, sf_dir)
    a, b = settled(a), settled(b)
    hits = settled(matched(a, b, "most", 1.0, ["rec", "pitch"]))
    a, b = a.join(hits.select(F.col("note_id").alias("id")), "id", "left_anti"), b.join(hits.select(F.col("o_id").alias("id")), "id", "left_anti")
    return matched(a, b, "cost", 0.5, ["rec"])


@query()
def viterbi_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothest likely path through 50 pitch bins of each track's frames."""

    def likely(p: np.ndarray) -> np.ndarray:
        far = np.abs(np.arange(1, 51)[None, :] - np.nan_to_num(p, nan=25.0)[:, None])
        return np.where(np.isnan(p)[:, None], 0.0, -0.05 * far)

    def run(groups: list[pd.DataFrame]) -> pd.DataFrame:
        paths = kernels.viterbi_many([likely(g["pitch"].to_numpy(dtype=float)) for g in groups], 0.02)
        return pd.concat(groups)[["track", "frame"]].assign(bin=np.concatenate(paths))

    return kernels.per_groups(frames(spark, sf_dir), ["track"], ["frame"], run, "track long, frame long, bin long")


@query()
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each track's means of 16 frames."""
    bars = frames(spark, sf_dir).groupBy("track", F.floor(F.col("frame") / 16).alias("bar")).agg(F.avg("level").alias("level"), F.avg("periodicity").alias("p"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = g[["level", "p"]].to_numpy(dtype=float)
        x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
        at = kernels.change_points(x, 4.0, 4)
        return pd.DataFrame({"track": [g["track"].iloc[0]] * len(at), "bar": g["bar"].to_numpy()[at]})

    return kernels.per_group(bars, ["track"], ["bar"], run, "track long, bar long")


@query()
def beam_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line through each track's clusters."""
    from ..operators.windows import velocities

    c = velocities(islands.anchored_clusters(notes(spark, sf_dir), 5.0))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        groups = [x for _, x in g.groupby("cluster", sort=True)]
        line = kernels.pick_line([list(zip(x["rank"], x["pitch"], strict=True)) for x in groups])
        return pd.DataFrame({"note_id": [int(groups[a]["note_id"].iloc[i]) for a, i in line]}, columns=["note_id"])

    return kernels.per_group(c.select("track", "cluster", "onset", "note_id", "rank", "pitch"), ["track"], ["cluster", "onset", "note_id"], run, "note_id long")


_PEAKS = FRAMES.replace("WITH ", "WITH RECURSIVE ", 1) + """, p AS (SELECT track, frame, level, lag(level) OVER w AS b, lead(level) OVER w AS a, avg(level) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m FROM frames WINDOW w AS (PARTITION BY track ORDER BY frame)),
top AS (SELECT track, frame FROM p WHERE level >= b AND level > a AND level >= m + 10000.0),
taken AS (SELECT track, min(frame) AS frame FROM top GROUP BY track UNION ALL SELECT track, frame FROM (SELECT t.track, t.frame, row_number() OVER (PARTITION BY t.track ORDER BY t.frame) AS k FROM taken x JOIN top t ON t.track = x.track AND t.frame >= x.frame + 4) WHERE k = 1)
SELECT track, frame FROM taken"""


@query(_PEAKS)
def separated_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks over the mean around them, each four frames or more after the last one taken: the first of each anchored cluster."""
    top = windows.peaks(frames(spark, sf_dir), "level", 5, 10000.0, edges=False).select("track", F.col("frame").alias("note_id"), F.col("frame").cast("double").alias("onset"))
    c = islands.anchored_clusters(top, 3.5)
    return c.select("track", F.col("cluster").cast("long").alias("frame")).distinct()


@query()
def two_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices of the notes that sound together, whole connected stretches of ten tracks of a source, up to 64 a group."""
    n = voices(notes(spark, sf_dir)).withColumnRenamed("part", "tracks").withColumn("duration", F.lit(0.4) + F.col("confidence"))
    w = islands.by(["source", "tracks"], "onset", "note_id")
    ended = F.max(F.col("onset") + F.col("duration")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    n = n.withColumn("part", F.floor(islands.island_id(F.coalesce(F.col("onset") >= ended, F.lit(True)), w) / 64))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        voice = kernels.two_voices(list(zip(g["onset"], g["onset"] + g["duration"], g["pitch"], strict=True)))
        return pd.DataFrame({"note_id": g["note_id"], "voice": voice})

    return kernels.per_group(n.select("source", "tracks", "part", "onset", "duration", "note_id", "pitch"), ["source", "tracks", "part"], ["onset", "note_id"], run, "note_id long, voice long")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, track, change): the mean confidence of a track's second half less that of its first."""
    mean = lambda c: F.avg(F.when(c, F.col("confidence")))
    per = notes(spark, sf_dir).groupBy("track").agg((mean(F.col("onset") >= 360) - mean(F.col("onset") < 360)).alias("change")).where("change is not null")
    return per.select(F.floor(F.col("track") / 10).alias("rec"), "track", F.round("change", 9).alias("change"))


@query(NOTES + """, c AS (SELECT track // 10 AS rec, round(avg(confidence) FILTER (WHERE onset >= 360) - avg(confidence) FILTER (WHERE onset < 360), 9) AS change FROM notes GROUP BY track), r AS (SELECT rec, count(change) AS n, sum(change) AS s FROM c WHERE change IS NOT NULL GROUP BY rec)
SELECT sum(n)::BIGINT AS n, round(sum(s) / sum(n), 6) AS mean, count(*) FILTER (WHERE s > 0) AS up, count(*) FILTER (WHERE s < 0) AS down FROM r""")
def mean_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean change of the tracks, and how many recordings rise and fall."""
    r = changes(spark, sf_dir).groupBy("rec").agg(F.count("*").alias("n"), F.sum("change").alias("s"))
    return r.agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean"), F.count_if(F.col("s") > 0).alias("up"), F.count_if(F.col("s") < 0).alias("down"))


DRAWS = 10_000


@query()
def paired_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean change with a bootstrap interval over recordings (with all their tracks) and a sign test over them.

    Each recording has a Poisson weight in each of 10,000 draws, seeded by its number, which is resampling with replacement in the
    limit; a task sums its recordings' weights to two numbers a draw, so nothing but these vectors meets in one place.
    """
    r = changes(spark, sf_dir).groupBy("rec").agg(F.count("*").alias("n"), F.sum("change").alias("s"))

    def draw(batches):  # noqa: ANN001, ANN202
        total = np.zeros((2, DRAWS))
        for b in batches:
            for rec, n, s in zip(b["rec"], b["n"], b["s"], strict=True):
                total += np.random.default_rng([0, int(rec)]).poisson(1.0, DRAWS) * np.array([[n], [s]])
        yield pd.DataFrame({"draw": np.arange(DRAWS), "n": total[0], "s": total[1]})

    means = r.mapInPandas(draw, "draw int, n double, s double").groupBy("draw").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))  # null where a draw is of nothing
    edge = lambda q: F.round(F.percentile("mean", q), 6)
    spread = means.agg(F.lit(1).alias("one"), edge(0.025).alias("low"), edge(0.975).alias("high"))  # one row
    n = F.col("up") + F.col("down")
    p = F.when(n > 0, F.least(F.lit(1.0), 2 * scalar.binomial_tail(n, n - F.least("up", "down"), F.lit(0.5)))).otherwise(F.lit(1.0))
    return mean_change(spark, sf_dir).withColumn("p", p).withColumn("one", F.lit(1)).join(F.broadcast(spread), "one").drop("one")
