"""Column expressions of pitch, time and rhythm; all stay within code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TICK = 1e-6
INF = float("inf")


def ratio(a: Column, b: Column) -> Column:
    """a / b as floating point has it: by zero it is infinite, or NaN for 0 / 0, and doesn't raise."""
    return F.when(b == 0, a * F.lit(INF)).otherwise(a / b)


def hz_to_midi(hz: Column) -> Column:
    return F.lit(69.0) + 12.0 * F.log2(hz / 440.0)


def midi_to_hz(pitch: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (pitch - 69.0) / 12.0)


def hz_to_bin(hz: Column, lowest_hz: float = 32.70319566257483, cents: float = 20.0) -> Column:
    """The index of the pitch bin above the lowest."""
    return F.bround(1200.0 * F.log2(hz / lowest_hz) / cents).cast("int")


def chroma(pitch: Column) -> Column:
    return F.pmod(pitch.cast("int"), F.lit(12))


def bur_from_phase(phase: Column) -> Column:
    """The beat-upbeat ratio; infinite from phase 1 on."""
    return F.when(phase < 1, phase / (1 - phase)).otherwise(F.lit(INF))


def phase_from_bur(bur: Column) -> Column:
    return bur / (1 + bur)


def warp_phase(phase: Column, star: Column) -> Column:
    """The piecewise-linear map of (0, star, 1) to (0, 1/2, 1); the identity outside (0, 1) and for star 1/2."""
    bent = F.when(phase <= star, phase / star * 0.5).otherwise(0.5 + (phase - star) / (1 - star) * 0.5)
    return F.when((star <= 0) | (star >= 1) | (star == 0.5) | (phase <= 0) | (phase >= 1), phase).otherwise(bent)


def unwarp_phase(phase: Column, star: Column) -> Column:
    bent = F.when(phase <= 0.5, phase / 0.5 * star).otherwise(star + (phase - 0.5) / 0.5 * (1 - star))
    return F.when((star <= 0) | (star >= 1) | (star == 0.5) | (phase <= 0) | (phase >= 1), phase).otherwise(bent)


def snap(position: Column, divisions: int) -> tuple[Column, Column]:
    """The nearest of the divisions (halves to even) and the signed rest."""
    near = F.bround(position * divisions) / divisions
    return near, position - near


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def snap_value(duration: Column, gap: Column, values: tuple[float, ...]) -> Column:
    """The nearest of the values no longer than the gap, ties to the smaller; the gap if none fits."""
    fits = F.filter(F.array(*[F.lit(v) for v in values]), lambda v: v <= gap + TICK)
    best = F.array_min(F.transform(fits, lambda v: F.struct(F.abs(v - duration).alias("d"), v.alias("v"))))["v"]
    return F.coalesce(best, gap)


#: Names of the twelve pitch classes with sharps and with flats, as (step, alteration).
SHARPS = (("C", 0), ("C", 1), ("D", 0), ("D", 1), ("E", 0), ("F", 0), ("F", 1), ("G", 0), ("G", 1), ("A", 0), ("A", 1), ("B", 0))
FLATS = (("C", 0), ("D", -1), ("D", 0), ("E", -1), ("E", 0), ("F", 0), ("G", -1), ("G", 0), ("A", -1), ("A", 0), ("B", -1), ("B", 0))


def spell(pitch: Column, flats: Column) -> Column:
    """(step, alter, octave) of a MIDI pitch, with flats or with sharps."""
    pick = lambda names: F.element_at(F.array(*[F.struct(F.lit(s).alias("step"), F.lit(a).alias("alter")) for s, a in names]), chroma(pitch) + 1)
    name = F.when(flats, pick(FLATS)).otherwise(pick(SHARPS))
    return F.struct(name["step"].alias("step"), name["alter"].alias("alter"), (F.floor(pitch / 12) - 1).cast("int").alias("octave"))


def tempo_class(bpm: Column) -> Column:
    return F.when(bpm.isNull(), None).when(bpm < 100, "SLOW").when(bpm < 140, "MEDIUM").when(bpm < 200, "MEDIUM UP").otherwise("UP")


def place_name(position: Column) -> Column:
    """The rhythmic place of a position within its beat, on a lattice of 24."""
    at = F.pmod(F.bround(F.pmod(position, F.lit(1.0)) * 24).cast("int"), F.lit(24))
    return (
        F.when(at == 0, "beat").when(at == 12, "half").when(at.isin(6, 18), "quarter").when(at.isin(8, 16), "third")
        .when(at.isin(4, 20), "sixth").when(at.isin(3, 9, 15, 21), "eighth").otherwise("other")
    )


def normal_title(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def title_tokens(text: Column, stop: tuple[str, ...] = ("the", "and", "for", "with")) -> Column:
    """Sorted distinct words of three letters or more, less stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_except(F.filter(words, lambda w: F.length(w) > 2), F.array(*[F.lit(s) for s in stop])))


def db(mean_square: Column, least: float = 1e-12) -> Column:
    return 10.0 * F.log10(F.greatest(mean_square, F.lit(least)))


def ramp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def meaningful(shared: Column, a: Column, b: Column, least: float = 0.06, share: float = 0.3) -> Column:
    """An overlap of `least` or more, or of that share of the shorter."""
    return (shared >= least) | (shared >= share * F.least(a, b))


def hash_share(key: Column, salt: str) -> Column:
    """A share in [0, 1) from a salted digest: the same for a key in every run and table."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.lit("\0"), key).cast("binary"), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def swing_position(position: Column, late: float) -> Column:
    """A notated position with its beat's offbeat that much later, linear within either half."""
    beat = F.floor(position)
    part = position - beat
    return beat + F.when(part <= 0.5, part * (0.5 + late) / 0.5).otherwise(0.5 + late + (part - 0.5) * (0.5 - late) / 0.5)


def is_faint(duration: Column, confidence: Column, longest: float = 0.08, most: float = 0.4) -> Column:
    """Short and unsure."""
    return (duration < longest) & (confidence < most)


def fifths(semitones: Column) -> Column:
    """How far a key signature moves with a part that many semitones up, from five flats to six sharps."""
    return F.pmod(7 * F.pmod(semitones, F.lit(12)) + 5, F.lit(12)) - 5


def parse_chart(charts: DataFrame) -> DataFrame:
    """(chart, bar, place, symbol, root, quality, bass) of charts (chart, text): bars between |, symbols between spaces; % is the bar before."""
    bars = F.filter(F.transform(F.split("text", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    b = charts.select("chart", F.posexplode(bars).alias("bar", "body")).withColumn("bar", F.col("bar") + 1)
    so_far = Window.partitionBy("chart").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("body", F.last(F.when(F.col("body") != "%", F.col("body")), ignorenulls=True).over(so_far))
    s = b.select("chart", "bar", F.posexplode(F.split("body", " ")).alias("place", "symbol")).withColumn("place", F.col("place") + 1)
    part = lambda i: F.regexp_extract("symbol", r"^([A-G])(#|b)?(.*?)(?:/([A-G](?:#|b)?))?$", i)
    root = F.instr(F.lit("C.D.EF.G.A.B"), part(1)) - 1
    sign = F.when(part(2) == "#", 1).when(part(2) == "b", -1).otherwise(0)
    return s.select("chart", "bar", "place", "symbol", F.pmod(root + sign, F.lit(12)).cast("int").alias("root"), part(3).alias("quality"), part(4).alias("bass"))


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """The chance of k or more of n, each with chance p: terms in log space, each from the one before. Null if an input is null."""
    odds = F.ln(p) - F.log1p(-p)
    choose = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, i: a + F.ln((n - k + i) / i))
    first = choose + k * F.ln(p) + (n - k) * F.log1p(-p)
    zero = F.struct(first.alias("term"), F.exp(first).alias("sum"))
    more = F.when(k < n, F.sequence(F.least(k + 1, n), n)).otherwise(F.array().cast("array<bigint>"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.ln((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (a["sum"] + F.exp(term)).alias("sum"))

    sum_ = F.aggregate(more, zero, step)["sum"]
    return F.when((k <= 0) | (p >= 1), F.lit(1.0)).when((p <= 0) | (k > n), F.lit(0.0)).otherwise(F.least(F.lit(1.0), sum_))


#: Ticks of a quarter that count as on the grid: within half a tick of one of so many parts of it.
GRID = 24


def on_grid(tick: Column, division: Column) -> Column:
    rest = F.pmod(tick * GRID, division)
    return 2 * F.least(rest, division - rest) <= GRID


def timing_kind(n: Column, hits: Column, division: Column, quantized: float = 0.9, rare: float = 1e-3) -> list[Column]:
    """[share, chance, kind] of n onsets of which `hits` are on the grid of a clock of `division` ticks a quarter: performed, quantized,
    or unknown, where the clock can't tell (no onsets, frames instead of quarters, or ticks so coarse that chance would do it)."""
    told = (n > 0) & (division > 0) & (division < 0x8000)
    ticks = F.sequence(F.lit(0), F.greatest(division, F.lit(1)) - 1)
    chance = F.size(F.filter(ticks, lambda t: on_grid(t, division))) / division
    share = hits / n
    kind = F.when(~F.coalesce(told, F.lit(False)), "unknown").when(share < quantized, "performed").when(binomial_tail(n, hits, chance) < rare, "quantized").otherwise("unknown")
    return [F.when(told, share), F.when(told, chance), kind]
