"""What the operators share: tables cut from their lineage, counts folded over partitions, groups walked in sorted partitions."""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there, so that a lost executor costs no more than its tasks.

    The folder is that of spark.checkpoint.dir; only where neither that nor a checkpoint folder is set and all tasks run on this
    machine, as in tests, a new one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


#: Rows of a few numbers or short strings that are broadcast, at most: some tens of MB.
BROADCAST_ROWS = 200_000


def keyed_join(big: DataFrame, small: DataFrame, keys: str | list[str], how: str = "inner", rows: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """big joined with small (cut from its lineage, one row a key) on keys that aren't null.

    Small is broadcast if it is found to have no more than `rows` rows. Else both are shuffled, each key dealt over `salts` parts by
    a hash of big's other columns, so that a key that many rows of big have is not one task.
    """
    keys = [keys] if isinstance(keys, str) else keys
    if small.limit(rows + 1).count() <= rows:
        return big.join(F.broadcast(small), keys, how)
    rest = [c for c in big.columns if c not in keys]
    dealt = big.withColumn("__salt", F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
    return dealt.join(small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, "__salt"], how).drop("__salt")


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with place, from 0 in their group's order, and n, the rows of the group (not null), by a range sort of all rows.

    No group is one task: what is summed by group has a row for each partition of the sorted rows that holds some of it.
    """
    at = cut(rows.orderBy(group, *order)).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    runs = at.groupBy(group, "__part").agg(F.count("*").alias("rows"), F.min("__at").alias("first"))
    own = Window.partitionBy(group).orderBy("__part")
    ahead = F.coalesce(F.sum("rows").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.select(group, "__part", (ahead - F.col("first")).alias("__shift"), F.sum("rows").over(Window.partitionBy(group)).alias("n")))
    return keyed_join(at, runs, [group, "__part"]).withColumn("place", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


#: Rows and bytes of an Arrow batch, at most: texts are long, and a task's memory shouldn't follow them.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless they are smaller already."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) > most or int(now) == 0:
            spark.conf.set(key, str(most))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n; null if the key is null."""
    return F.crc32(key.cast("string").cast("binary")) % n


def held_out(key: Column, n: int, which: int) -> Column:
    """True for rows that no label is learnt from; false if the key is null (such rows are not learnt from either)."""
    return F.coalesce(remainder(key, n) == which, F.lit(False))


CHUNK = 1 << 14
_FOLDED = "chunk int, part binary"


def fold(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int, dtype: str = "int64", chunk: int = CHUNK, add: Callable = np.add) -> np.ndarray:
    """The sum (or what `add` makes) over partitions of a vector of fixed length; what reaches the driver doesn't grow with the input.

    count: makes one partition's vector. Vectors travel in compressed chunks, and chunks are added up on executors.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.asarray(count(batches), dtype=dtype)
        keys = [k for k in range(0, length, chunk) if full[k : k + chunk].any()]
        for k in keys:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(full[k : k + chunk].tobytes(), 1)], pa.binary())], ["chunk", "part"])

    def total(rows: list[tuple]) -> Iterable[tuple]:
        yield (rows[0][0], zlib.compress(reduce(add, (np.frombuffer(zlib.decompress(x[1]), dtype=dtype) for x in rows)).tobytes(), 1))

    out = np.zeros(length, dtype=dtype)
    for k, part in grouped(df.mapInArrow(parts, _FOLDED), ["chunk"], total, _FOLDED, batch=1).collect():
        one = np.frombuffer(zlib.decompress(part), dtype=dtype)
        out[k : k + len(one)] = one
    return out


def grouped(df: DataFrame, keys: list[str], f: Callable[[list[tuple]], Iterable[tuple]], schema: str, order: list[str] | None = None, batch: int = 2000) -> DataFrame:
    """f of the rows of each key, as tuples; the caller bounds the size of a group. Many small groups cost one stream of rows."""
    from pyspark.sql.types import StructType

    spark = df.sparkSession
    names = df.columns
    at = [names.index(k) for k in keys]
    kind = StructType.fromDDL(schema)
    arrow = _arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _runs(batches, at):
            out.extend(f(rows))
            if len(out) >= batch:
                yield _batch(out, arrow)
                out = []
        if out:
            yield _batch(out, arrow)

    assert spark is not None
    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, kind)


def _runs(batches: Iterator[pa.RecordBatch], at: list[int]) -> Iterator[list[tuple]]:
    rows: list[tuple] = []
    key: Any = None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            k = tuple(row[i] for i in at)
            if rows and k != key:
                yield rows
                rows = []
            key = k
            rows.append(row)
    if rows:
        yield rows


def _arrow(kind: Any) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def components(edges: DataFrame, most: int = 200) -> DataFrame:
    """(node, component): the least node that links (a, b) reach; nodes are those of edges, self-links included, of any type with an
    order.

    Alternates large and small stars until nothing moves; every round is a bounded number of shuffles of at most two rows a link.
    Rounds grow with the logarithm of a component's size; after `most` of them without an end it raises.
    """
    now = cut(edges.select("a", "b").where("a is not null and b is not null").selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
    nodes = now
    state = None
    for _ in range(most):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a > b").distinct()
        now = cut(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components still change after {most} rounds")
    every = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return every.join(now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
