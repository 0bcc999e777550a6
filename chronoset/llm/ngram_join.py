"""Near-duplicate documents by the exact Jaccard similarity of their word shingles, with signature trees.

Linked sets share one of their rarest tokens at least (a prefix in one order of all tokens), so only documents that share such a
token meet. The order counts tokens in a sketch of fixed size over all documents and breaks ties by hash: any order gives the
same links, a good one puts what many documents share last. Exact copies count as one set from there on. Tokens that the same
sets hold make one block. Then, in two steps,

1. each block's bitmaps go through a signature tree, which leaves a forest of pairs that can be linked; its components are small
   neighbourhoods, and most documents are in none;
2. the whole sets of a neighbourhood go through a signature tree with an exact check of the pairs that are left.

A block of more than `most` sets is taken to be one neighbourhood. A neighbourhood beyond the token budget is cut by size and hash
into tiles; each tile is joined in itself, then the least sets of what is linked, and last the sets outside the largest component
against all tiles of like sizes. Nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as X
from .common import components, cut, fold, grouped
from .signature_tree import bitmap, links, set_links

SKETCH = 1 << 18
#: Tokens that one task compares at once; 8 bytes each.
BUDGET = 1 << 21
#: Sets of a block whose bitmaps one task compares at once.
MOST = 8192
#: A list of ids up to this long is broadcast (16 bytes each); a longer one is joined by a shuffle.
BROADCAST_ROWS = 400_000


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sketch(docs: DataFrame, size: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(SKETCH, dtype=np.int64)
        for b in batches:
            for s in X.slices(b.column(0)):
                sets = [x for x in X.shingle_sets(s.data, s.off, size) if len(x)]
                if sets:
                    total += np.bincount((np.concatenate(sets) >> np.uint64(46)).astype(np.int64), minlength=SKETCH)
        return total

    return fold(docs.select("text"), count, SKETCH)


def _prefixes(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, node, n, prefix, bits): node is a 128-bit digest of the set, null if it is empty."""
    held = docs.sparkSession.sparkContext.broadcast(_sketch(docs, size))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for b in batches:
            for s in X.slices(b.column(1)):
                sets = X.shingle_sets(s.data, s.off, size)
                prefix = []
                for x in sets:
                    p = len(x) + (num * len(x)) // -den + 1 if len(x) else 0
                    if p < len(x):
                        common = counts[(x >> np.uint64(46)).astype(np.int64)]
                        x = x[np.lexsort((x, common))[:p]]
                    prefix.append(x[:p].view(np.int64))
                off = np.zeros(len(sets) + 1, dtype=np.int32)
                np.cumsum([len(p) for p in prefix], out=off[1:])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.lo, s.hi - s.lo), pa.array([X.set_key(x) if len(x) else None for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(prefix))), pa.array([bitmap(x).tobytes() if len(x) else None for x in sets], pa.binary())],
                    ["doc_id", "node", "n", "prefix", "bits"],
                )

    return cut(docs.mapInArrow(rows, "doc_id long, node binary, n long, prefix array<long>, bits binary"))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.slices(b.column(0)):
                sets = [x for x in X.shingle_sets(s.data, s.off, size) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([X.set_key(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "tokens"])

    return docs.select("text").mapInArrow(rows, "node binary, tokens binary")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it is found to have no more than so many rows of a few numbers."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _possible(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """A forest of the pairs of a block whose bitmaps and sizes leave room for a link."""

    def join(rows: list[tuple]) -> Iterable[tuple]:
        found = links([np.frombuffer(x[6], dtype=np.uint64) for x in rows], [x[5] for x in rows], num, den)
        return [(rows[i][4], rows[j][4]) for i, j in found]

    keys = ["sum", "m", "least", "greatest"]
    return grouped(blocks.select(*keys, "h", "n", "bits"), keys, join, "a long, b long", order=["h"])


def _compare(df: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """Links within each group. df has the keys, node, tokens, and may have label and side."""
    extra = [c for c in ("label", "side") if c in df.columns]
    k = len(keys)

    def join(rows: list[tuple]) -> Iterable[tuple]:
        rows = list({(x[k], *x[k + 3 :]): x for x in rows}.values())
        if "side" in extra:  # a set on both sides counts on the right one
            best: dict[bytes, tuple] = {}
            for x in rows:
                if x[k] not in best or x[-1]:
                    best[x[k]] = x
            rows = list(best.values())
        sets = [np.frombuffer(x[k + 1], dtype=np.uint64) for x in rows]
        found = set_links(sets, num, den, [x[k + 2] for x in rows] if extra else None, np.array([x[k + 3] for x in rows]) if "side" in extra else None)
        return [(rows[i][k], rows[j][k]) for i, j in found]

    return grouped(df.select(*keys, "node", "tokens", *extra), keys, join, "a binary, b binary", order=["node"])


def _large(sets: DataFrame, num: int, den: int, budget: int) -> DataFrame:
    """Links that give the components of neighbourhoods beyond the budget. sets: (cluster, node, n, tokens)."""
    step = math.log(den / num) if num < den else 1e-9
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)) if num < den else F.col("n")
    sets = sets.withColumn("band", band.cast("long"))
    tiles = sets.groupBy("cluster", "band").agg(F.ceil(F.sum("n") / budget).cast("long").alias("tiles"))
    sets = cut(sets.join(tiles, ["cluster", "band"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles"))).dropDuplicates(["node"]))
    found = cut(_compare(sets, ["cluster", "band", "tile"], num, den))
    alone = sets.select(F.col("node").alias("a"), F.col("node").alias("b"))

    def labelled(links: DataFrame) -> DataFrame:
        return cut(components(links.union(alone)).withColumnRenamed("component", "label"))

    label = labelled(found)
    first = sets.join(label.where("node = label").select("node"), "node")
    several = first.groupBy("cluster").agg(F.count("*").alias("m"), F.ceil(F.sum("n") / budget).cast("long").alias("parts")).where("m > 1").select("cluster", "parts")
    first = first.join(several, "cluster").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    found = cut(found.union(_compare(first, ["cluster", "part"], num, den)))
    label = labelled(found)
    named = sets.join(label, "node")
    sizes = named.groupBy("cluster", "label").agg(F.count("*").alias("m"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("m", F.col("label").alias("main")))["main"].alias("main"))
    rest = named.join(main, "cluster").where("label != main").drop("main", "tile", "tiles")
    parts = rest.groupBy("cluster", "band").agg(F.ceil(F.sum("n") / budget).cast("long").alias("parts")).select("cluster", F.col("band").alias("rest_band"), "parts")
    rest = rest.withColumnRenamed("band", "rest_band").join(parts, ["cluster", "rest_band"]).withColumn("part", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("parts")))
    pairs = parts.join(tiles, "cluster").where("abs(band - rest_band) <= 1").select("cluster", "rest_band", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "tiles")
    pairs = pairs.select("cluster", "rest_band", "band", "part", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    keys = ["cluster", "rest_band", "band", "part", "tile"]
    a = rest.join(pairs, ["cluster", "rest_band", "part"]).select(*keys, "node", "tokens", "label", F.lit(True).alias("side"))
    b = named.join(pairs, ["cluster", "band", "tile"]).select(*keys, "node", "tokens", "label", F.lit(False).alias("side"))
    return found.union(_compare(a.union(b), keys, num, den))


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, budget: int = BUDGET, most: int = MOST, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text; other columns don't matter).

    Words are runs of `[^\\x20\\x09-\\x0D]`, A-Z lower-cased; a set has the distinct runs of `size` words, or the whole sequence of
    fewer. Rows link where den * |intersection| >= num * |union|. component_id: the smallest doc_id that links reach.
    A null or empty text has an empty set and links with nothing. A row with a null doc_id takes part and gets the component's
    smallest doc_id, null if there is none. Repeated rows each give a row. An empty table gives none.
    Sets of one 128-bit digest are one set, words of one 64-bit hash one word.
    """
    docs = _texts(docs)
    table = _prefixes(docs, size, num, den)
    nodes = cut(table.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.max("n").alias("n"), F.count("*").alias("rows")))
    # exact copies but the first are left out from here on; rows of equal doc_id and text stay, and meet in one set
    copies = table.where("node is not null").select("doc_id", "node").join(_small(nodes.where("rows > 1").select("node", "doc"), broadcast_rows), "node").where("not (doc_id <=> doc)").select(F.col("doc_id").alias("d"), F.col("node").alias("k")).distinct()
    copies = _small(cut(copies), broadcast_rows)
    single = table.where("node is not null").join(copies, table["doc_id"].eqNullSafe(copies["d"]) & (table["node"] == copies["k"]), "left_anti")
    # blocks hold 64-bit hashes of nodes: nodes of one hash go together, which only adds to what is checked exactly
    single = single.withColumn("h", F.xxhash64("node"))
    own = Window.partitionBy("token")
    tokens = single.select(F.explode("prefix").alias("token"), "h").withColumn("least", F.min("h").over(own)).withColumn("greatest", F.max("h").over(own))
    tokens = tokens.withColumn("m", F.count("*").over(own)).withColumn("sum", F.bit_xor(F.xxhash64("h")).over(own)).where("least != greatest")
    blocks = cut(tokens.select("sum", "m", "least", "greatest", "h").distinct())
    stars = blocks.where(F.col("m") > most).select(F.col("h").alias("a"), F.col("least").alias("b"))
    blocks = blocks.where(F.col("m") <= most).select("sum", "m", "least", "greatest", "h")
    bits = single.join(_small(blocks.select("h").distinct(), broadcast_rows), "h", "left_semi").select("node", "h", "n", "bits").dropDuplicates(["node"]).drop("node")
    near = components(_possible(blocks.join(bits, "h"), num, den).union(stars)).withColumnRenamed("component", "cluster").withColumnRenamed("node", "h")
    members = cut(near.join(nodes.select("node", "doc", "n", F.xxhash64("node").alias("h")), "h").drop("h"))
    weight = members.groupBy("cluster").agg(F.sum("n").alias("total"))
    members = members.join(weight, "cluster")
    ids = _small(members.select(F.col("doc").alias("member")).distinct(), broadcast_rows)
    held = docs.join(ids, docs["doc_id"].eqNullSafe(ids["member"]), "left_semi")
    sets = _sets(held, size).join(_small(members.select("node", "cluster", "n", "total"), broadcast_rows), "node")
    found = _compare(sets.where(F.col("total") <= budget), ["cluster"], num, den)
    if not weight.where(F.col("total") > budget).isEmpty():
        found = found.union(_large(sets.where(F.col("total") > budget).drop("total"), num, den, budget))
    linked = components(found)
    named = nodes.join(linked, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("label"))
    least_id = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    named = named.join(least_id, "label").select("node", "component_id")
    some = table.where("node is not null").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.union(table.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without what is linked to a smaller doc_id, and with one row of each doc_id; rows without a doc_id stay.

    Texts without words are linked with nothing. Which of several rows of one doc_id stays is told by a hash of all columns.
    """
    gone = cut(near_duplicates(docs, size, num, den).where("doc_id is not null"))
    worse = gone.where("component_id < doc_id").select(F.col("doc_id").alias("worse_id")).distinct()
    kept = docs.join(worse, docs["doc_id"] == worse["worse_id"], "left_anti")
    if gone.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    names = docs.columns  # a row number can't meet a column of that name
    plain = kept.toDF(*[f"c{i}" for i in range(len(names))])
    key = plain.columns[names.index("doc_id")]
    order = Window.partitionBy(key).orderBy(F.xxhash64(*[F.col(c) for c in plain.columns]))
    once = plain.where(F.col(key).isNotNull()).withColumn("row", F.row_number().over(order)).where("row = 1").drop("row")
    return once.union(plain.where(F.col(key).isNull())).toDF(*names)


#: DuckDB: the rows of near_duplicates() for runs of 4 words and a similarity of 85 in 100, by counting what each two sets share.
LINKS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 3), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r
), p AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r
), e AS (SELECT x, y FROM p JOIN n u ON u.r = x JOIN n v ON v.r = y WHERE 100 * shared >= 85 * (u.n + v.n - shared)
), links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), reach(a, b) AS (SELECT r, r FROM n UNION SELECT reach.a, links.y FROM reach JOIN links ON links.x = reach.b
), c AS (SELECT a AS r, min(d.doc_id) AS component FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, CASE WHEN n.n IS NULL THEN doc_id ELSE c.component END AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)
"""
