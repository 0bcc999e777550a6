"""Queries that write tracks in a file format and read them again; signal kernels; the stage cache."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import kernels, signal
from ..sources import adapters
from ..sources.project import frames, notes, table
from . import stages
from .registry import query
from .grid_queries import ragged
from .note_queries import FRAMES, NOTES

#: A file holds 240 units of a track, so its size is bounded however long a track is.
PART = 240.0


def _files(rows: DataFrame, keys: list[str], write, parse, schema: str) -> DataFrame:  # noqa: ANN001
    """Rows of `schema` that `parse` makes of the file that `write` makes of each group."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(groups: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.DataFrame([{**r, **{k: g[k].iloc[0] for k in keys}} for g in groups for r in parse(write(g))], columns=names)

    return kernels.per_groups(rows, keys, [], run, schema)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir).withColumn("part", F.floor(F.col("onset") / PART))
    return n.withColumn("start", F.col("onset") - F.col("part") * PART)


@query(NOTES + """, parts AS (
  SELECT track, pitch, duration, floor(onset / 240)::BIGINT AS part, onset - floor(onset / 240) * 240 AS start FROM notes
), ticks AS (SELECT track, part, pitch, round_even(start * 960, 0) AS a, round_even((start + duration) * 960, 0) AS z FROM parts)
SELECT track, part, pitch, round(a / 960, 6) AS onset, round(greatest(a + 1, z) / 960 - a / 960, 6) AS duration FROM ticks""")
def midi_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notes through a MIDI file: times to a tick, no note shorter than one."""

    def write(g: pd.DataFrame) -> bytes:
        return adapters.write_midi(list(zip(g["start"], g["duration"], g["pitch"], [90] * len(g), strict=True)))

    parse = lambda content: [{k: r[k] for k in ("pitch", "onset", "duration")} for r in adapters.parse_midi(content)]
    out = _files(_parts(spark, sf_dir), ["track", "part"], write, parse, "track long, part long, pitch int, onset double, duration double")
    return out.withColumn("onset", F.round("onset", 6)).withColumn("duration", F.round("duration", 6))


@query(NOTES + """, p AS (SELECT track, floor(onset / 240)::BIGINT AS part, pitch, round_even((onset - floor(onset / 240) * 240) * 480, 0) AS a, round_even((onset - floor(onset / 240) * 240 + duration) * 480, 0) AS z FROM notes)
SELECT track, part, pitch, round(a / 480, 6) AS position, round((greatest(a + 1, z) - a) / 480, 6) AS duration FROM p""")
def score_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes through a score file, cut at its bar lines and tied together again."""

    def write(g: pd.DataFrame) -> bytes:
        return adapters.write_musicxml(list(zip(g["start"], g["duration"], g["pitch"], strict=True))).encode()

    out = _files(_parts(spark, sf_dir), ["track", "part"], write, adapters.parse_musicxml, "track long, part long, voice string, position double, duration double, pitch int, tie_stop boolean, grace boolean")
    path = F.concat_ws("/", "track", "part")
    line = adapters.tied(out.withColumn("path", path).withColumn("part", F.lit("P1")))
    key = F.split("path", "/")
    return line.select(key[0].cast("long").alias("track"), key[1].cast("long").alias("part"), "pitch", F.round("position", 6).alias("position"), F.round("duration", 6).alias("duration"))


@query(FRAMES + """, s AS (SELECT track, frame // 512 AS part, frame % 512 AS i, floor(level / 4) / 32768.0 AS x FROM frames), d AS (SELECT track, part, i // 2 AS j, avg(x) AS x, count(*) AS n FROM s GROUP BY ALL), w AS (SELECT track, part, j // 16 AS window_, x FROM d WHERE n = 2)
SELECT track, part::BIGINT AS part, window_::BIGINT AS window_, round(sqrt(avg(x * x)), 6) AS rms, round(max(abs(x)), 6) AS peak FROM w GROUP BY track, part, window_ HAVING count(*) = 16""")
def pcm_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as 16-bit samples through a PCM file, read at half its rate, in windows of sixteen."""
    f = frames(spark, sf_dir).withColumn("part", F.floor(F.col("frame") / 512))

    def write(g: pd.DataFrame) -> bytes:
        return adapters.write_pcm(np.floor(g.sort_values("frame")["level"].to_numpy() / 4), 8000)

    parse = lambda content: [{"window_": r["window"], "rms": r["rms"], "peak": r["peak"]} for r in adapters.parse_wav(content, 16, 4000)]
    out = _files(f, ["track", "part"], write, parse, "track long, part long, window_ long, rms double, peak double")
    return out.withColumn("rms", F.round("rms", 6)).withColumn("peak", F.round("peak", 6))


@query(NOTES + "SELECT source, count(*) AS n, round(avg(confidence * 2 + 1), 6) AS mean FROM notes WHERE confidence >= 0.25 GROUP BY source")
def cached_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stages over notes, each found again by what it was made from."""
    todo = [
        ("filter", lambda df, least: df.where(F.col("confidence") >= least), {"least": 0.25}),
        ("scale", lambda df, by, plus: df.withColumn("confidence", F.col("confidence") * by + plus), {"by": 2, "plus": 1}),
        ("count", lambda df: df.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean")), {}),
    ]
    return stages.run(spark, notes(spark, sf_dir).select("note_id", "source", "confidence"), todo, f"{stages.shared_folder(spark)}/stages")[0]


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, 9), lambda i: pow(embedding[i]::DOUBLE, 2))), 6) AS low, round(list_sum(list_transform(range(9, 33), lambda i: pow(embedding[i]::DOUBLE, 2))), 6) AS mid, round(list_sum(list_transform(range(33, 65), lambda i: pow(embedding[i]::DOUBLE, 2))), 6) AS high FROM embeddings WHERE embedding IS NOT NULL""")
def band_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power of each row's bins between band edges, a row being half a spectrum."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            power = np.stack(b["x"].to_list()) ** 2 if len(b) else np.zeros((0, 64))
            bands = signal.band_power(power, 126, (0, 8, 32, 64))
            yield pd.DataFrame({"vec_id": b["vec_id"], "low": bands[:, 0], "mid": bands[:, 1], "high": bands[:, 2]})

    out = _spectra(spark, sf_dir).mapInPandas(run, "vec_id long, low double, mid double, high double")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("low", "mid", "high")])


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, 5), lambda k: pow(embedding[(4 + vec_id % 12) * k + 1]::DOUBLE, 2))), 6) AS energy FROM embeddings WHERE embedding IS NOT NULL""")
def harmonic_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power at the first four harmonics of each row's pitch."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            power = np.stack(b["x"].to_list()) ** 2 if len(b) else np.zeros((0, 64))
            hz = 4.0 + (b["vec_id"].to_numpy() % 12)
            yield pd.DataFrame({"vec_id": b["vec_id"], "energy": signal.harmonic_energy(power, 126, 69 + 12 * np.log2(hz / 440))})

    return _spectra(spark, sf_dir).mapInPandas(run, "vec_id long, energy double").withColumn("energy", F.round("energy", 6))


@query()
def decode_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of posteriorgrams: sixteen rows in order are the frames of a clip, their values in size the posteriors."""
    e = _spectra(spark, sf_dir).withColumn("clip", F.floor(F.col("vec_id") / 16))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = np.abs(np.stack(g["x"].to_list()))
        top = x / max(1e-9, x.max())
        found = signal.decode_posteriors(top, np.maximum(np.diff(top, axis=0, prepend=0), 0), 0.2, 0.1, 2, 2)
        return pd.DataFrame([(g["clip"].iloc[0], a, b, p, round(s, 6)) for a, b, p, s in found], columns=["clip", "first", "after", "pitch", "level"])

    return kernels.per_group(e, ["clip"], ["vec_id"], run, "clip long, first long, after long, pitch long, level double")


@query()
def drop_doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats without doubled ones, judged in pairs against the reference pulse."""
    from ..operators.windows import reference_pulse

    b = ragged(spark, sf_dir).where("not implied").select("track", "t")
    both = b.join(reference_pulse(b), ["track", "t"], "left")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        t = g["t"].to_numpy()
        return pd.DataFrame({"track": g["track"].iloc[0], "t": signal.drop_doubled(t, g["pulse"].to_numpy()[:-1])})

    return kernels.per_group(both, ["track"], ["t"], run, "track long, t double")


@query(NOTES + "SELECT note_id, round_even(1200.0 * log2(440.0 * pow(2.0, (pitch - 69.0) / 12.0) / 32.70319566257483) / 20.0, 0)::INT AS bin FROM notes")
def hz_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pitch bin of each note, twenty cents wide."""
    return notes(spark, sf_dir).select("note_id", S.hz_to_bin(S.midi_to_hz(F.col("pitch"))).alias("bin"))


@query()
def refined_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likely path through pitch bins of each track's frames, each bin refined by the weights around it."""

    def weigh(p: np.ndarray) -> np.ndarray:
        return np.exp(-0.5 * ((np.arange(50)[None, :] + 1 - np.nan_to_num(p, nan=25.0)[:, None] - 0.3) / np.where(np.isnan(p), 50.0, 2.0)[:, None]) ** 2)

    def run(groups: list[pd.DataFrame]) -> pd.DataFrame:
        weights = [weigh(g["pitch"].to_numpy(dtype=float)) for g in groups]
        paths = kernels.viterbi_many([np.log(w + 1e-9) for w in weights], 0.02)
        return pd.concat(groups)[["track", "frame"]].assign(cents=np.concatenate([np.round(kernels.refine_bins(w, path), 4) for w, path in zip(weights, paths, strict=True)]))

    return kernels.per_groups(frames(spark, sf_dir), ["track"], ["frame"], run, "track long, frame long, cents double")


@query()
def flux_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each clip of sixteen rows where the summed rises of log power peak."""
    e = _spectra(spark, sf_dir).withColumn("clip", F.floor(F.col("vec_id") / 16))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        at = signal.flux_onsets(np.stack(g["x"].to_list()) ** 2, 2, 3, 0.05)
        return pd.DataFrame({"clip": [g["clip"].iloc[0]] * len(at), "frame": at}, columns=["clip", "frame"])

    return kernels.per_group(e, ["clip"], ["vec_id"], run, "clip long, frame long")


@query(FRAMES + """, b AS (SELECT track, frame // 4 AS bar, avg(pitch) AS mean, max(pitch) - min(pitch) AS width FROM frames WHERE periodicity >= 0.08 GROUP BY ALL), n AS (SELECT track, unnest(range(max(frame) // 4 + 1)) AS bar FROM frames GROUP BY track)
SELECT n.track, n.bar, round(last_value(mean IGNORE NULLS) OVER w, 6) AS mean, round(last_value(width IGNORE NULLS) OVER w, 6) AS width, b.mean IS NULL AS carried FROM n LEFT JOIN b ON b.track = n.track AND b.bar = n.bar WINDOW w AS (PARTITION BY n.track ORDER BY n.bar ROWS UNBOUNDED PRECEDING)""")
def pool_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of bars of four frames; a bar without any has those of the one before."""
    from pyspark.sql import Window

    f = frames(spark, sf_dir).withColumn("bar", F.floor(F.col("frame") / 4))
    b = f.where("periodicity >= 0.08").groupBy("track", "bar").agg(F.avg("pitch").alias("mean"), (F.max("pitch") - F.min("pitch")).alias("width"))
    every = f.select("track", "bar").distinct()
    so_far = Window.partitionBy("track").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.round(F.last(c, ignorenulls=True).over(so_far), 6).alias(c)
    return every.join(b, ["track", "bar"], "left").select("track", "bar", last("mean"), last("width"), F.col("mean").isNull().alias("carried"))
