"""Merkle manifest of a dataset: a leaf a row, a subroot a group, a root, and for each row the siblings that lead to the root.

Rows of a group are ranked by a range sort and cut into large blocks of consecutive leaves (arity ** depth). Executors reduce each
block to one node, so that only a small top tree is left: the driver builds it, up to the root, and broadcasts each block's path
through it; executors go through their blocks again and finish each row's proof. A top of more than `most` nodes is itself reduced
by blocks first, as often as it takes, and its paths are then joined to their blocks; so the driver's part is bounded at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, grouped, ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 16
#: Levels that a block is reduced by: 4,096 leaves of some hundred bytes are a task's memory.
DEPTH = 3
#: Nodes whose paths are broadcast, at most: about 1 KB for each of at most seven levels of a path.
TOP_NODES = 4096


def leaf(*fields: Column) -> Column:
    """sha256 in hex of the fields one after another: `-` for null, else the bytes of its text in UTF-8, `:`, its text."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts]).cast("binary"), 256)


def _levels(digests: list[str], depth: int | None, arity: int) -> list[list[str]]:
    """The nodes and what is above them, level by level: `depth` levels, or (None) until one node is left."""
    out = [digests]
    while len(out[-1]) > 1 if depth is None else len(out) <= depth:
        last = out[-1]
        out.append([hashlib.sha256("".join(last[i : i + arity]).encode()).hexdigest() for i in range(0, len(last), arity)])
    return out


def _siblings(tree: list[list[str]], i: int, arity: int) -> tuple[list[str], list[str]]:
    """For node i of the lowest level: at each level, the run's digests before and after the one on its path."""
    before, after = [], []
    for level in tree[:-1]:
        first = i // arity * arity
        before.append("".join(level[first:i]))
        after.append("".join(level[i + 1 : first + arity]))
        i //= arity
    return before, after


def _top(nodes: Iterable[tuple], arity: int) -> dict[tuple[str, int], tuple[list[str], list[str], str, str]]:
    """(before, after, subroot, root) of each node (group, place, digest): the paths through the top tree."""
    trees = {g: _levels([x[2] for x in own], None, arity) for g, own in groupby(sorted(nodes), key=lambda x: x[0])}
    over = _levels([t[-1][0] for t in trees.values()], None, arity)
    out = {}
    for k, (g, tree) in enumerate(trees.items()):
        ends = _siblings(over, k, arity)
        for i in range(len(tree[0])):
            before, after = _siblings(tree, i, arity)
            out[g, i] = (before + ends[0], after + ends[1], tree[-1][0], over[-1][0])
    return out


def _paths(nodes: DataFrame, carry: list[str], arity: int, depth: int, most: int) -> DataFrame:
    """(g, place, digest, *carry, before, after, subroot, root) of nodes (g, place, n, digest, *carry)."""
    size = arity**depth
    types = dict(nodes.dtypes)
    dealt = nodes.select("g", F.expr(f"place div {size}").alias("block"), "place", "n", "digest", *carry)

    def tree_of(rows: list[tuple]) -> list[list[str]]:
        return _levels([r[4] for r in rows], None if rows[0][3] <= size else depth, arity)

    def reduce(rows: list[tuple]) -> Iterable[tuple]:
        n = rows[0][3]
        yield (rows[0][0], rows[0][1], -(-n // size), tree_of(rows)[-1][0])

    blocks = cut(grouped(dealt.select("g", "block", "place", "n", "digest"), ["g", "block"], reduce, "g string, place long, n long, digest string", ["place"]))
    top = None
    if blocks.limit(most + 1).count() <= most:
        top = nodes.sparkSession.sparkContext.broadcast(_top([(x.g, x.place, x.digest) for x in blocks.collect()], arity))
    else:
        if blocks.where("n > 1").isEmpty():  # many groups, each with its subroot: what is left is the tree over them
            over = ranked(blocks.select(F.lit("").alias("g"), F.col("g").alias("group"), "digest"), "g", ["group"])
            above = _paths(over, ["group"], arity, depth, most)
            above = above.select(F.col("group").alias("g"), F.lit(0).cast("long").alias("block"), "before", "after", F.col("digest").alias("subroot"), "root")
        else:
            above = _paths(blocks, [], arity, depth, most).select("g", F.col("place").alias("block"), "before", "after", "subroot", "root")
        dealt = dealt.unionByName(above.withColumn("place", F.lit(-1).cast("long")), allowMissingColumns=True)

    def finish(rows: list[tuple]) -> Iterable[tuple]:
        before, after, subroot, root = top.value[rows[0][:2]] if top else rows[0][-4:]
        own = rows if top else rows[1:]
        tree = tree_of(own)
        for i, r in enumerate(own):
            left, right = _siblings(tree, i, arity)
            yield (r[0], r[2], *r[4 : 5 + len(carry)], left + before, right + after, subroot, root)

    kinds = "".join(f", `{c}` {types[c]}" for c in carry)
    return grouped(dealt, ["g", "block"], finish, f"g string, place long, digest string{kinds}, before array<string>, after array<string>, subroot string, root string", ["place"])


def manifest(docs: DataFrame, group: str = "source", order: str = "doc_id", fields: Sequence[str] = FIELDS, carry: dict[str, Column] | None = None, arity: int = ARITY, depth: int = DEPTH, most: int = TOP_NODES) -> DataFrame:
    """(order, group, *carry, leaf, place, before, after, subroot, root), a row for each row of docs.

    A group's leaves stand by `order` (null first), of equal keys by leaf, which makes no difference. Groups stand by their text,
    bytewise; null is the first group. While more than one node is left, each run of `arity` (the last may be shorter, even one node)
    becomes the sha256 of its digests; a lone leaf is its subroot, a lone subroot the root. before and after hold the run's other
    digests at each level, up to the root: see folded(). Repeated rows are leaves of their own, an empty table gives no rows. Columns
    of docs that aren't named have no part in it; carry names further columns of the result, made from docs' columns, that must
    not be named like one of the result's other columns.
    """
    carry = carry or {}
    taken = docs.select(F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("g"), F.col(order).alias("__order"), leaf(*[F.col(c) for c in fields]).alias("digest"), *[c.alias(name) for name, c in carry.items()])
    out = _paths(ranked(cut(taken), "g", ["__order", "digest"]), ["__order", *carry], arity, depth, most)
    return out.select(F.col("__order").alias(order), F.when(F.col("g") != "", F.substring("g", 2, 2**31 - 1)).alias(group), *carry, F.col("digest").alias("leaf"), "place", "before", "after", "subroot", "root")


def folded(start: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and its siblings lead to; a row is unchanged if it is the manifest's root."""
    return F.aggregate(F.arrays_zip(before.alias("a"), after.alias("b")), start, lambda acc, x: F.sha2(F.concat(x["a"], acc, x["b"]).cast("binary"), 256))


def proof_digest(before: Column, after: Column) -> Column:
    """sha256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(before, after, lambda a, b: F.concat(a, b)), "").cast("binary"), 256)


def _sql(group_levels: int = 6, source_levels: int = 4) -> str:
    """DuckDB: the rows of op12_merkle_manifest for up to 16 ** group_levels documents a source and 16 ** source_levels sources."""
    field = "COALESCE(strlen({0}::VARCHAR) || ':' || {0}, '-')"
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    all_but_text = " || ".join(field.format(c) for c in FIELDS[:-1])
    out = f"""
WITH shifts AS (
  SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, k) ORDER BY k) AS shift FROM range(256) t(k)
), keyed AS (
  SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, shift[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc
  FROM documents, shifts
), leaves AS (
  SELECT doc_id, COALESCE('+' || source, '') AS g, sha256({all_but_text} || {field.format("text")}) AS leaf,
         CASE WHEN crc % 5 = 0 THEN sha256({all_but_text} || {field.format(text)}) END AS other FROM keyed
), r0 AS (
  SELECT doc_id, g, leaf, row_number() OVER (PARTITION BY g ORDER BY doc_id ASC NULLS FIRST, leaf) - 1 AS i, COALESCE(other, leaf) AS f, '' AS p FROM leaves
), n0 AS (SELECT g, i, leaf AS h FROM r0)"""
    level = 0
    for k in range(group_levels + source_levels):
        if k == group_levels:  # from here, the nodes are the subroots
            out += f""", s0 AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS j FROM n{k}), n{k}s AS (SELECT '' AS g, j AS i, subroot AS h FROM s0
), r{k}s AS (SELECT r.doc_id, '' AS g, r.leaf, s.j AS i, r.f, r.p, s.subroot FROM r{k} r JOIN s0 s USING (g))"""
        own, sub = (f"{k}s", ", r.subroot") if k == group_levels else (f"{k}", ", r.subroot" if k > group_levels else "")
        out += f""", c{k} AS (
  SELECT g, i, h, count(*) OVER (PARTITION BY g) AS c, COALESCE(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
         COALESCE(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM n{own} WINDOW w AS (PARTITION BY g, i // 16 ORDER BY i)
), n{k + 1} AS (
  SELECT g, i // 16 AS i, CASE WHEN min(c) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM c{k} GROUP BY g, i // 16
), r{k + 1} AS (
  SELECT r.doc_id, r.g, r.leaf, r.i // 16 AS i, CASE WHEN c = 1 THEN r.f ELSE sha256(a || r.f || b) END AS f, CASE WHEN c = 1 THEN r.p ELSE r.p || a || b END AS p{sub}
  FROM r{own} r JOIN c{k} c ON r.g = c.g AND r.i = c.i)"""
        level = k + 1
    return out + f"""
SELECT r.doc_id, r.leaf, r.subroot, n.h AS root, sha256(r.p) AS proof_sha256, r.f AS folded_root, r.f = n.h AS verified FROM r{level} r, n{level} n
"""


MANIFEST_SQL = _sql()
