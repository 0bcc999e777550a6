"""Where an excerpt or a score sits in a page or a recording: seeds, extension, clocks and anchors.

Sequences are notes (id columns, place, pitch, ...) with place from 0. Seeds are runs of intervals that both sides have, whatever
the transposition; they meet on a hash of the run, of each excerpt only its rarest, so what is common doesn't multiply. What meets
by chance grows with excerpts times pages; it is counted where it meets and never stored: a task takes a block of either and leaves a
row an excerpt. Only the winner of the vote is extended, in a band around its chain of seeds, so an extension costs the excerpt's
length times the band.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import by
from .joins import asof_join
from .kernels import per_groups
from .lineage import settled
from .stats import inlier_line, theil_sen

#: Notes of a seed, and seeds of an excerpt that are looked for.
GRAM, SEEDS = 5, 64


def grams(notes: DataFrame, key: str, size: int = GRAM) -> DataFrame:
    """(key, place, pitch, gram): a hash of the intervals of each run of `size` notes."""
    notes = notes.withColumn("pitch", F.col("pitch").cast("int"))  # equal intervals have equal hashes only in one type
    w = Window.partitionBy(key).orderBy("place")
    run = [F.col("pitch"), *[F.lead("pitch", i).over(w) for i in range(1, size)]]
    g = notes.select(key, "place", "pitch", *[x.alias(f"__p{i}") for i, x in enumerate(run)]).where(" and ".join(f"__p{i} is not null" for i in range(size)))
    return g.select(key, "place", "pitch", F.xxhash64(F.array(*[F.col(f"__p{i}") - F.col(f"__p{i - 1}") for i in range(1, size)])).alias("gram"))


def first_of_equal(pages: DataFrame, page: str) -> DataFrame:
    """(page) of pages without those that have the places and pitches of a lesser one, told apart by their number of notes and two 64-bit sums."""
    h = F.xxhash64("place", F.col("pitch").cast("int"))
    each = pages.groupBy(page).agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.xxhash64(h, F.lit(1)).cast("decimal(38,0)")).alias("s"))
    return each.groupBy("n", "x", "s").agg(F.min(page).alias(page)).select(page)


def rarest(g: DataFrame, h: DataFrame, key: str, most: int = SEEDS) -> DataFrame:
    """(key, place, pitch, gram) of an excerpt's grams `g` that are fewest among those of pages, `h`."""
    found = g.join(h.groupBy("gram").agg(F.count("*").alias("n")), "gram")
    return found.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("n", "gram", "place"))).where(F.col("r") <= most).select(key, "place", "pitch", "gram")


def _sought(excerpts: DataFrame, pages: DataFrame, key: str, page: str, size: int, most: int) -> tuple[DataFrame, DataFrame]:
    """An excerpt's rarest grams, and (page, theirs, p, gram) of the pages that are looked in."""
    h = grams(pages, page, size)
    at = h.join(first_of_equal(pages, page), page, "left_semi").select(page, F.col("place").alias("theirs"), F.col("pitch").alias("p"), "gram")
    return rarest(grams(excerpts, key, size), h, key, most), at


def _met(rare: DataFrame, at: DataFrame, on: list[str], key: str, page: str) -> DataFrame:
    return rare.join(at, on).select(key, page, (F.col("p") - F.col("pitch")).alias("shift"), F.col("place").alias("own"), "theirs")


def seeds(excerpts: DataFrame, pages: DataFrame, key: str, page: str, size: int = GRAM, most: int = SEEDS) -> DataFrame:
    """(key, page, shift, own, theirs): places where an excerpt's rarest grams stand in pages; page pitch is own pitch and shift.

    Of equal pages only the least is looked in: all get the same votes, and it wins. So copies of pages don't multiply. Where pages
    differ these rows still grow with excerpts times pages; best_seeds() has those of the winners without making the others.
    """
    return _met(*_sought(excerpts, pages, key, page, size, most), ["gram"], key, page)


#: Seeds and grams of pages of a task of the vote, and pairs of them that it holds at once.
SEED_ROWS, PAGE_ROWS, PAIRS = 1_000_000, 2_000_000, 4_000_000


def leaders(own: np.ndarray, own_gram: np.ndarray, own_pitch: np.ndarray, row: np.ndarray, gram: np.ndarray, pitch: np.ndarray, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(own, row, shift, votes): for each `own` (in order, one entry a seed), the row and shift that most of its seeds share.

    A row has a gram and pitch once. Of equal votes the smaller shift wins, up before down, then the lesser row. Pairs of equal grams
    are made for as many owns at once as have no more than `pairs` of them (one own at least).
    """
    order = np.argsort(gram, kind="stable")
    row, gram, pitch = row[order].astype(np.int64), gram[order], pitch[order].astype(np.int64)
    own_pitch = own_pitch.astype(np.int64)
    known, low, many = np.unique(gram, return_index=True, return_counts=True)
    out: list[tuple[np.ndarray, ...]] = [(own[:0], row[:0], pitch[:0], row[:0])]
    if len(known) and len(own):
        at = np.minimum(np.searchsorted(known, own_gram), len(known) - 1)
        count = np.where(known[at] == own_gram, many[at], 0)
        low = low[at]
        rows = int(row.max()) + 1
        turns = 2 * int(max(abs(pitch.max() - own_pitch.min()), abs(pitch.min() - own_pitch.max()))) + 1
        begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        number = np.cumsum(np.r_[False, own[1:] != own[:-1]])
        ends, upto = np.r_[begins[1:], len(own)], np.cumsum(count)
        i = 0
        while i < len(begins):
            first = begins[i]
            before = upto[first] - count[first]
            j = max(i + 1, min(int(np.searchsorted(upto[ends - 1], before + pairs, side="right")), i + 2**62 // (turns * rows)))
            s = slice(first, ends[j - 1])
            c = count[s]
            k = np.repeat(low[s] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            shift = pitch[k] - np.repeat(own_pitch[s], c)
            # one number a pair, in the order in which equal votes go: own, shift, row
            code = (np.repeat(number[s] - i, c) * turns + (2 * np.abs(shift) - (shift > 0))) * rows + row[k]
            code.sort()
            each = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
            code, votes = code[each], np.diff(np.r_[each, len(code)])
            who = code // (turns * rows)
            if len(who):
                begin = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                top = np.flatnonzero(votes == np.repeat(np.maximum.reduceat(votes, begin), np.diff(np.r_[begin, len(who)])))
                top = top[np.unique(who[top], return_index=True)[1]]
                turn = code[top] // rows % turns
                out.append((own[begins[i + who[top]]], code[top] % rows, np.where(turn % 2, turn + 1, -turn) // 2, votes[top]))
            i = j
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def best_pages(rare: DataFrame, at: DataFrame, key: str, page: str, seed_rows: int = SEED_ROWS, page_rows: int = PAGE_ROWS) -> DataFrame:
    """(key, page): the page that voted() puts first for each excerpt, of all pairs of equal grams.

    Excerpts and pages are dealt into blocks of about so many seeds and grams, and a task counts the votes of one block of each; a page
    is in one block, so its votes are whole there, and an excerpt leaves its first of each block of pages.
    """
    a, b = (max(1, -(-x.count() // most)) for x, most in ((rare, seed_rows), (at, page_rows)))
    block = lambda k, n: F.pmod(F.xxhash64(k), F.lit(n)).cast("int")  # of the type of the other side's, or equal blocks have unequal hashes
    split = lambda rows, k, v: rows.groupBy(k).agg(v.alias("s")).select(k, F.col("s.gram").alias("gram"), F.col("s.v").alias("pitch"))
    ours = split(rare, key, F.collect_list(F.struct("gram", F.col("pitch").alias("v")))).withColumns({"a": block(key, a), "b": F.explode(F.sequence(F.lit(0), F.lit(b - 1)))})
    theirs = split(at, page, F.collect_set(F.struct("gram", F.col("p").alias("v")))).withColumns({"a": F.explode(F.sequence(F.lit(0), F.lit(a - 1))), "b": block(page, b)})
    columns = [key, page, "shift", "votes"]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({c: [] for c in columns})
        y = y.sort_values(page)
        flat = lambda t: (np.repeat(np.arange(len(t)), t["gram"].map(len)), np.concatenate(t["gram"].to_numpy()), np.concatenate(t["pitch"].to_numpy()))
        own, row, shift, votes = leaders(*flat(x), *flat(y))
        return pd.DataFrame(dict(zip(columns, (x[key].to_numpy()[own], y[page].to_numpy()[row], shift, votes), strict=True)))

    kinds = dict(rare.dtypes)[key], dict(at.dtypes)[page]
    first = ours.groupBy("a", "b").cogroup(theirs.groupBy("a", "b")).applyInPandas(run, f"`{key}` {kinds[0]}, `{page}` {kinds[1]}, shift int, votes long")
    most = F.min(F.struct(-F.col("votes"), F.abs(F.col("shift")), -F.col("shift"), F.col(page).alias("page")))
    return first.groupBy(key).agg(most.alias("m")).select(key, F.col("m.page").alias(page))


def best_seeds(excerpts: DataFrame, pages: DataFrame, key: str, page: str, size: int = GRAM, most: int = SEEDS) -> DataFrame:
    """seeds() of each excerpt on the page that voted() puts first."""
    rare, at = map(settled, _sought(excerpts, pages, key, page, size, most))
    return _met(rare.join(best_pages(rare, at, key, page), key), at, [page, "gram"], key, page)


def voted(hits: DataFrame, key: str, page: str, shifts: int = 1) -> DataFrame:
    """(key, page, shift, votes, rank) of each excerpt: of the page and shift with most seeds, and its next shifts on that page.

    A seed of an excerpt votes once for a page and shift. Of equal votes the smaller shift wins, up before down, then the lesser page.
    """
    n = hits.groupBy(key, page, "shift").agg(F.countDistinct("own").alias("votes"))
    order = [F.desc("votes"), F.abs(F.col("shift")), F.desc("shift"), page]
    first = n.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("r = 1").select(key, page)
    return n.join(first, [key, page]).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= shifts)


def _chain(hits: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """(our place, their place) of the longest chain of hits (their place, our place) that rises on both sides."""
    rows = sorted({(o, t) for t, o in hits}, key=lambda x: (x[0], -x[1]))
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, t) in enumerate(rows):
        j = bisect_left(tails, t)
        back.append(ends[j - 1] if j else -1)
        tails[j : j + 1], ends[j : j + 1] = [t], [k]
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(rows[k])
        k = back[k]
    return chain[::-1]


def _lowest(chain: list[tuple[int, int]], m: int, half: int) -> np.ndarray:
    """The page place before which the band of each of our m places, and of the beginning, begins; it moves by its width at most."""
    o, t = np.array(chain).T
    e = np.arange(m + 1)
    mid = np.interp(e, o, t)
    mid = np.where(e < o[0], t[0] - (o[0] - e), np.where(e > o[-1], t[-1] + (e - o[-1]), mid)).round().astype(int)
    most = (2 * half + 1) * e
    return np.minimum.accumulate(np.maximum.accumulate(mid - half) - most) + most


def extend(theirs: np.ndarray, ours: np.ndarray, hits: Sequence[tuple[int, int]], half: int = 48) -> list[tuple[int, int]]:
    """(their place, our place) of equal notes in the best alignment of all of ours with some stretch of theirs, within a band.

    The band follows the longest chain of hits that rises on both sides. A pair of equal notes counts 1; one of unequal notes, or a
    note of either side without a partner, takes 1 off; what is before and after the stretch costs nothing.
    """
    return extend_many([(theirs, ours, hits)], half)[0]


def extend_many(found: Sequence[tuple[np.ndarray, np.ndarray, Sequence[tuple[int, int]]]], half: int = 48, cells: int = 20_000_000) -> list[list[tuple[int, int]]]:
    """extend() of each (theirs, ours, hits): a place of all of ours at once, of so many as have that many cells of their bands (one at least)."""
    out: list[list[tuple[int, int]]] = [[] for _ in found]
    chains = {k: c for k, (_, ours, hits) in enumerate(found) if len(ours) and (c := _chain(hits))}
    width = 2 * half + 1
    left = sorted(chains, key=lambda k: -len(found[k][1]))
    while left:
        size = max(1, cells // (width * (len(found[left[0]][1]) + 1)))
        some, left = left[:size], left[size:]
        for k, pairs in zip(some, _extend([found[k][0] for k in some], [found[k][1] for k in some], [chains[k] for k in some], half), strict=True):
            out[k] = pairs
    return out


def _extend(theirs: list[np.ndarray], ours: list[np.ndarray], chains: list[list[tuple[int, int]]], half: int) -> list[list[tuple[int, int]]]:
    """The longest of ours come first, so those that go on at a place are the first ones."""
    sizes, n = np.array([len(x) for x in ours]), np.array([len(x) for x in theirs])
    width, never = 2 * half + 1, -(10**9)
    low = np.zeros((len(ours), sizes[0] + 1), dtype=int)
    own, page = np.zeros((len(ours), sizes[0]), dtype=int), np.zeros((len(ours), n.max()), dtype=int)
    for k, (x, y, c) in enumerate(zip(ours, theirs, chains, strict=True)):
        low[k, : len(x) + 1], own[k, : len(x)], page[k, : len(y)] = _lowest(c, len(x), half), x, y
    steps, n = np.arange(width), n[:, None]
    at = low[:, :1] + steps
    total = np.full((len(ours), width + 1), never)  # the last column stands for what is beside the band
    total[:, :width] = np.where((at >= 0) & (at <= n), 0, never)
    came = np.zeros((sizes[0] + 1, len(ours), width), dtype=np.int8)  # 0: pair, 1: ours alone, 2: theirs alone
    for i in range(1, sizes[0] + 1):
        k = int(np.searchsorted(-sizes, -i, side="right"))
        at = low[:k, i : i + 1] + steps  # so many of theirs are passed
        moved = at - low[:k, i - 1 : i]
        over = np.take_along_axis(total[:k], np.minimum(moved, width), axis=1) - 1
        before = moved - 1
        diag = np.take_along_axis(total[:k], np.where((before < 0) | (before > width), width, before), axis=1)
        same = (at >= 1) & (at <= n[:k]) & (np.take_along_axis(page[:k], np.clip(at - 1, 0, n[:k] - 1), axis=1) == own[:k, i - 1 : i])
        pair = diag + np.where(same, 1, -1)
        best = np.where((at < 0) | (at > n[:k]), never, np.maximum(pair, over))
        total[:k, :width] = np.maximum.accumulate(best + steps, axis=1) - steps
        paired, alone = (before >= 0) & (before < width), moved < width  # what doesn't come from beside the band
        came[i, :k] = np.where((total[:k, :width] > best) | ~(paired | alone), 2, np.where(paired & (~alone | (pair >= over)), 0, 1))
    out = []
    for j, last in enumerate(total[:, :width].argmax(axis=1)):
        pairs, i, k = [], int(sizes[j]), int(last)
        way, begins = came[:, j], low[j].tolist()
        while i:
            if way[i, k] == 2:
                k -= 1
                continue
            t = begins[i] + k
            if way[i, k] == 0:
                t -= 1
                if 0 <= t < len(theirs[j]) and theirs[j][t] == ours[j][i - 1]:
                    pairs.append((t, i - 1))
            k = t - begins[i - 1]
            i -= 1
        out.append(pairs[::-1])
    return out


def matches(excerpts: DataFrame, pages: DataFrame, hits: DataFrame, won: DataFrame, key: str, page: str, half: int = 48) -> DataFrame:
    """(key, shift, own, theirs) of the equal notes of each row of `won`, by extend(). A group is an excerpt and one page, and those of a batch are extended together."""
    ids = dict(excerpts.dtypes)[key], dict(pages.dtypes)[page]
    ours = excerpts.select(key, F.lit(0).alias("side"), F.lit(None).cast("int").alias("shift"), F.col("place").cast("long").alias("a"), F.col("pitch").cast("long").alias("b"))
    theirs = pages.join(won.select(key, page).distinct(), page).select(key, F.lit(1), F.lit(None).cast("int"), F.col("place").cast("long"), F.col("pitch").cast("long"))
    some = hits.join(won.select(key, page, "shift"), [key, page, "shift"]).select(key, F.lit(2), F.col("shift").cast("int"), F.col("own").cast("long"), F.col("theirs").cast("long"))
    rows = ours.join(won.select(key).distinct(), key, "left_semi").unionAll(theirs).unionAll(some)

    def run(groups: list[pd.DataFrame]) -> pd.DataFrame:
        names, found = [], []
        for g in groups:
            a, b = g["a"].to_numpy(), g["b"].to_numpy()
            i, j = np.searchsorted(g["side"].to_numpy(), [1, 2])
            shifts = g["shift"].to_numpy()[j:].astype(int)
            for shift in np.unique(shifts):
                s = slice(j + np.searchsorted(shifts, shift), j + np.searchsorted(shifts, shift, side="right"))
                names.append((g[key].iloc[0], int(shift)))
                found.append((b[i:j], b[:i] + shift, list(zip(b[s].tolist(), a[s].tolist(), strict=True))))
        out = [(*name, o, t) for name, pairs in zip(names, extend_many(found, half), strict=True) for t, o in pairs]
        return pd.DataFrame(out, columns=[key, "shift", "own", "theirs"])

    return per_groups(rows, [key], ["side", "shift", "a", "b"], run, f"`{key}` {ids[0]}, shift int, own long, theirs long")


def _commonest(values: str) -> F.Column:
    """(n, first, x): of an array in order, its commonest value x, and how often it occurs; of several, the one that comes first."""
    v = F.col(values)
    return F.array_max(F.transform(F.array_distinct(v), lambda x: F.struct(F.size(F.filter(v, lambda y: y == x)).alias("n"), (-F.array_position(v, x)).alias("first"), x.alias("x"))))


#: Before and after an excerpt's own notes: just under half a quarter.
MARGIN = 0.5 - 1 / 48


def locate(excerpts: DataFrame, pages: DataFrame, key: str, page: str, edge: float = 0.25, window: int = 15, covered: float = 0.5, clocked: float = 0.6, margin: float = MARGIN) -> DataFrame:
    """(key, page, transposition, lo, hi, matched, clock_share, coverage, recall, page_notes, first_bar, last_bar, same_take).

    excerpts: (key, place, position, pitch), pages: (page, place, position, pitch, bar); positions in quarters. Each match votes for
    its page position less its own, in whole quarters; the commonest of the first `edge` of an excerpt's matches places its
    beginning, that of the last its end, so a bar that one side leaves out costs only itself. clock_share: the matches whose vote is
    the commonest of those around them. coverage: of the page's notes between both ends, those that match; recall: of the excerpt's.
    An excerpt without a match has no row; pages and excerpts are found by their notes alone.
    """
    hits = settled(best_seeds(excerpts, pages, key, page))
    won = settled(voted(hits, key, page))
    m = settled(matches(excerpts, pages, hits, won, key, page)).join(won.select(key, page), key)
    m = m.join(excerpts.select(key, F.col("place").alias("own"), F.col("position").alias("at")), [key, "own"]).join(pages.select(page, F.col("place").alias("theirs"), F.col("position").alias("there")), [page, "theirs"])
    m = m.withColumn("vote", F.bround(F.col("there") - F.col("at")).cast("long"))
    w = by(key, "own")
    m = m.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    every = m.groupBy(key, "vote").agg(F.count("*").alias("c"), F.min("i").alias("f")).groupBy(key).agg(F.max_by("vote", F.struct("c", -F.col("f"))).alias("overall"))
    m = m.join(every, key).withColumn("__near", F.collect_list("vote").over(w.rowsBetween(-window, window)))
    m = m.withColumn("__top", _commonest("__near"))
    local = F.when(F.size(F.filter("__near", lambda y: y == F.col("overall"))) == F.col("__top.n"), F.col("overall")).otherwise(F.col("__top.x"))
    m = m.withColumn("local", local).withColumn("edge", F.greatest(F.lit(1), F.bround(F.col("n") * edge)))
    ends = m.groupBy(key, page, "shift").agg(
        F.avg((F.col("vote") == F.col("local")).cast("double")).alias("clock_share"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("i") < F.col("edge"), F.struct("i", "vote")))), lambda x: x["vote"]).alias("__first"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("i") >= F.col("n") - F.col("edge"), F.struct("i", "vote")))), lambda x: x["vote"]).alias("__last"),
    )
    size = excerpts.groupBy(key).agg(F.min_by("position", "place").alias("p0"), F.max_by("position", "place").alias("p1"), F.count("*").alias("notes"))
    placed = ends.join(size, key).withColumn("lo", F.col("p0") + _commonest("__first")["x"] - margin).withColumn("hi", F.col("p1") + _commonest("__last")["x"] + margin)
    spans = placed.select(key, page, "lo", "hi")
    inside = pages.select(page, F.col("place").alias("theirs"), "position", "bar").join(spans, page).where("position between lo and hi")
    inside = inside.join(m.select(key, "theirs", F.lit(1).alias("hit")), [key, "theirs"], "left").groupBy(key).agg(F.count("*").alias("page_notes"), F.count("hit").alias("matched"), F.min_by("bar", "theirs").alias("first_bar"), F.max_by("bar", "theirs").alias("last_bar"))
    out = placed.join(inside, key, "left").fillna(0, ["page_notes", "matched", "first_bar", "last_bar"])
    coverage = F.when(F.col("page_notes") > 0, F.col("matched") / F.col("page_notes")).otherwise(F.lit(0.0))
    out = out.withColumn("coverage", coverage).withColumn("recall", F.col("matched") / F.col("notes"))
    out = out.withColumn("same_take", (F.col("coverage") >= covered) & (F.col("clock_share") >= clocked))
    return out.select(key, page, F.col("shift").alias("transposition"), "lo", "hi", "matched", "clock_share", "coverage", "recall", "page_notes", "first_bar", "last_bar", "same_take")


def crop(pages: DataFrame, spans: DataFrame, key: str, page: str) -> DataFrame:
    """(key, *columns of pages) of the notes between lo and hi of each row of spans (key, page, lo, hi); positions stay the page's."""
    return pages.join(spans.select(key, page, "lo", "hi"), page).where("position between lo and hi").select(key, *pages.columns)


def locate_score(scores: DataFrame, recordings: DataFrame, key: str, rec: str, quarters: DataFrame, shifts: int = 3, near: float = 1.0, least: int = 20, on_line: float = 0.5, placed: float = 0.3, votes: int = 4) -> DataFrame:
    """(key, rec, transposition, start, end, seconds_per_quarter, matched, anchors, on_line, placed, residual, votes, trusted).

    scores: (key, place, position, pitch); recordings: (rec, place, onset, pitch); quarters: (key, quarters), the score's length. Of
    the shifts with most seeds, the one with most matches on its clock wins (of equal ones the smaller): the line through its matches'
    positions and onsets, again through those within `near` of it where there are `least`. A score without a rising clock has no row.
    An extension keeps to its band, which a clock can always be laid through, so `votes` seeds are asked for before it is trusted.
    """
    hits = settled(best_seeds(scores, recordings, key, rec))
    won = settled(voted(hits, key, rec, shifts))
    m = settled(matches(scores, recordings, hits, won, key, rec)).join(won.select(key, rec).distinct(), key)
    m = m.join(scores.select(key, F.col("place").alias("own"), F.col("position").alias("x")), [key, "own"]).join(recordings.select(rec, F.col("place").alias("theirs"), F.col("onset").alias("y")), [rec, "theirs"])
    enough = m.groupBy(key, "shift").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    m = m.join(enough.drop("n"), [key, "shift"])
    line = inlier_line(m.select(key, "shift", "x", "y"), [key, "shift"], "x", "y", near, least).where("slope > 0")
    rest = F.abs(F.col("y") - (F.col("slope") * F.col("x") + F.col("intercept")))
    on = m.join(line, [key, "shift"]).withColumn("rest", F.round(rest, 9))
    on = on.groupBy(key, rec, "shift", "slope", "intercept").agg(F.count("*").alias("matched"), F.count_if(F.col("rest") <= near).alias("anchors"), F.percentile(F.when(F.col("rest") <= near, F.col("rest")), 0.5).alias("residual"))
    best = on.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("anchors"), F.abs(F.col("shift")), F.desc("shift")))).where("r = 1")
    size = scores.groupBy(key).agg(F.count("*").alias("notes"))
    out = best.join(size, key).join(quarters, key).join(won.select(key, "shift", "votes"), [key, "shift"]).withColumn("on_line", F.col("anchors") / F.col("matched")).withColumn("placed", F.col("anchors") / F.col("notes"))
    trusted = (F.col("anchors") >= least) & (F.col("on_line") >= on_line) & (F.col("placed") >= placed) & (F.col("votes") >= votes)
    return out.select(key, rec, (-F.col("shift")).alias("transposition"), F.col("intercept").alias("start"), (F.col("intercept") + F.col("slope") * F.col("quarters")).alias("end"), F.col("slope").alias("seconds_per_quarter"), "matched", "anchors", "on_line", "placed", "residual", "votes", trusted.alias("trusted"))


#: Delays of the offbeat that are tried, in quarters.
DELAYS = tuple(i / 100 for i in range(21))


def delayed(position: F.Column, delay: F.Column) -> F.Column:
    """A position in quarters with the half of its beat moved later by the delay, and what lies between in proportion."""
    beat = F.floor(position)
    part = position - beat
    return beat + F.when(part <= 0.5, part * (0.5 + delay) / 0.5).otherwise(0.5 + delay + (part - 0.5) * (0.5 - delay) / 0.5)


def _distinct(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Of anchors (keys, x, t) with one x, the first in time."""
    return anchors.groupBy(*keys, "x").agg(F.min("t").alias("t"))


def fit_delay(anchors: DataFrame, key: str, least: int = 20, delays: Sequence[float] = DELAYS) -> DataFrame:
    """(key, delay): that under which anchors (key, position, t) place each other best, by the mean of their left-out errors.

    Of equal ones the least delay; 0 for fewer than `least` anchors.
    """
    if not all(0 <= d < 0.5 for d in delays):
        raise ValueError("delays are from 0 up to, but without, half a beat")  # so positions keep their order, whatever the delay
    w = by(key, "x")
    near = _distinct(anchors.select(key, F.col("position").alias("x"), "t"), [key])
    near = near.select(key, "x", "t", *[f(c).over(w).alias(c + end) for f, end in ((F.lag, "0"), (F.lead, "1")) for c in ("x", "t")])

    def error(d: float) -> Column:
        x, x0, x1 = (delayed(F.col(c), F.lit(d)) for c in ("x", "x0", "x1"))
        return F.abs(F.col("t0") + F.try_divide((F.col("t1") - F.col("t0")) * (x - x0), x1 - x0) - F.col("t"))

    cost = near.groupBy(key).agg(*[F.round(F.coalesce(F.avg(error(d)), F.lit(0.0)), 12).alias(f"c{i}") for i, d in enumerate(delays)])
    best = cost.select(key, F.array_min(F.array(*[F.struct(F.col(f"c{i}").alias("cost"), F.lit(d).alias("delay")) for i, d in enumerate(delays)])).alias("b"))
    n = anchors.groupBy(key).agg(F.count("*").alias("n"))
    return n.join(best, key).select(key, F.when(F.col("n") >= least, F.col("b.delay")).otherwise(F.lit(0.0)).alias("delay"))


def without_wild(x: Sequence[float], t: Sequence[float], wild: float) -> list[int]:
    """The places that stay when the point that its neighbours put furthest from where it is goes, again and again, until no point is
    further off than `wild` or three are left. Only the two beside a point that goes are read again."""
    n = len(x)
    before, after, stamp = list(range(-1, n - 1)), list(range(1, n + 1)), [0] * n
    gone = [False] * n

    def error(k: int) -> float:
        a, b = before[k], after[k]
        return abs(t[a] + (t[b] - t[a]) * (x[k] - x[a]) / (x[b] - x[a]) - t[k])

    heap = [(-error(k), k, 0) for k in range(1, n - 1)]
    heapify(heap)
    left = n
    while heap and left > 3:
        e, k, s = heappop(heap)
        if gone[k] or s != stamp[k]:
            continue
        if -e <= wild:
            break
        gone[k] = True
        left -= 1
        a, b = before[k], after[k]
        after[a], before[b] = b, a
        for j in (a, b):
            if 0 < j < n - 1:
                stamp[j] += 1
                heappush(heap, (-error(j), j, stamp[j]))
    return [k for k in range(n) if not gone[k]]


def drop_wild(anchors: DataFrame, key: str, wild: float = 0.25) -> DataFrame:
    """(key, x, t) of anchors without the wild ones, by without_wild(); of anchors of one x the first. A group is one score."""
    kind = dict(anchors.dtypes)[key]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("x")
        return g.iloc[without_wild(g["x"].tolist(), g["t"].tolist(), wild)]

    return _distinct(anchors, [key]).groupBy(key).applyInPandas(run, f"`{key}` {kind}, x double, t double")


def place_on_anchors(notes: DataFrame, anchors: DataFrame, key: str, wild: float = 0.25, least: int = 20) -> DataFrame:
    """(key, note, onset, duration, delay, seconds_per_quarter) of notes (key, note, position, duration), from anchors (key, position, t).

    Positions are delayed by the fit, wild anchors go, and a note lies on the line between the anchors around it; beyond the ends the
    slope of the line through all goes on. A key with fewer than two anchors left, or whose slope doesn't rise, has no rows.
    """
    delay = settled(fit_delay(anchors, key, least))
    kept = settled(drop_wild(anchors.join(delay, key).select(key, delayed(F.col("position"), F.col("delay")).alias("x"), "t"), key, wild))
    slope = theil_sen(kept, [key], "x", "t").where("slope > 0").select(key, "slope")
    w = by(key, "x")
    ends = kept.groupBy(key).agg(F.min("x").alias("x_first"), F.min_by("t", "x").alias("t_first"), F.max("x").alias("x_last"), F.max_by("t", "x").alias("t_last"), F.count("*").alias("n")).where("n >= 2")
    lines = kept.select(key, F.col("x").alias("__x"), F.col("t").alias("__t"), F.lead("x").over(w).alias("__x1"), F.lead("t").over(w).alias("__t1"))
    marks = notes.join(delay, key).select(key, "note", "delay", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("position").alias("p")), F.struct(F.lit(1).alias("end"), (F.col("position") + F.col("duration")).alias("p")))).alias("m"))
    marks = marks.select(key, "note", "delay", "m.end", delayed(F.col("m.p"), F.col("delay")).alias("at"))
    at = asof_join(marks, lines, [key], "at", "__x", ["__x", "__t", "__x1", "__t1"]).join(ends, key).join(slope, key)
    when = (
        F.when(F.col("at") <= F.col("x_first"), F.col("t_first") - F.col("slope") * (F.col("x_first") - F.col("at"))).when(F.col("at") >= F.col("x_last"), F.col("t_last") + F.col("slope") * (F.col("at") - F.col("x_last")))
        .otherwise(F.col("__t") + (F.col("__t1") - F.col("__t")) * (F.col("at") - F.col("__x")) / (F.col("__x1") - F.col("__x")))
    )
    both = at.groupBy(key, "note", "delay", "slope").agg(F.max(F.when(F.col("end") == 0, when)).alias("onset"), F.max(F.when(F.col("end") == 1, when)).alias("stop"))
    return both.select(key, "note", "onset", (F.col("stop") - F.col("onset")).alias("duration"), "delay", F.col("slope").alias("seconds_per_quarter"))
