"""A Merkle manifest of a dataset: a hash for each row, a tree for each group, a root over the groups, and proofs.

A row is a leaf. In a group the leaves lie in the order of their key; every `FANOUT` neighbours are hashed to a node, until one
is left, the group's subroot. The subroots, in the order of the groups, are the leaves of one more tree, whose top is the root.

Rows get their place from a range sort, whose parts are counted: a group may lie in any number of parts. Aligned blocks of
`FANOUT ** LEVELS` places are then gathered. A block is a contiguous matrix of hex digests, which is reshaped by the fanout and hashed
level by level; a place's siblings are found by index arithmetic. Blocks' tops are the leaves of the next round of blocks, so
a block never has more than `FANOUT ** LEVELS` rows, and a group of any size is spread over blocks. Siblings above a block
go down the same way. Everything between is a written table; the driver gets the largest group's size, and the root.

Odd input: a null field is hashed as `-`; a null group is a group, before all others; null keys come first in their group, rows that share a
key follow their leaf, and rows that are the same in all fields are leaves of their own. An empty table has no leaves and gives no rows.
Columns beside the key, the group and the fields aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import lower_az, map_batches, written

FANOUT = 8
#: Levels of a block, which has FANOUT ** LEVELS places.
LEVELS = 4

SIDES = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def encoded(column: Column) -> Column:
    """A field's bytes in its leaf: their count and a colon before them, or `-` for null. Integers are decimal."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """The lower-case hex SHA-256 of the encoded fields."""
    return F.sha2(F.concat(*(encoded(f) for f in fields)), 256)


# --- one block, in NumPy ---


def climbed(nodes: np.ndarray, levels: int | None) -> list[np.ndarray]:
    """The levels of a block, from its (n, 64) hex digests up: so many levels, or until one node is left."""
    found = [nodes]
    while len(found[-1]) > 1 if levels is None else len(found) <= levels:
        below = found[-1]
        whole = len(below) // FANOUT * FANOUT
        rows = [*below[:whole].reshape(-1, 64 * FANOUT)]
        if whole < len(below):
            rows.append(below[whole:].reshape(-1))
        found.append(_matrix("".join(sha256(row).hexdigest() for row in rows).encode()))
    return found


def _matrix(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, dtype=np.uint8).reshape(-1, 64)


class Block:
    """A block's levels as contiguous bytes, and the siblings of every place."""

    def __init__(self, nodes: np.ndarray, levels: int | None):
        climb = climbed(nodes, levels)
        self.sizes = [len(m) for m in climb]
        self.flat = [m.tobytes() for m in climb]
        self.top = self.flat[-1]

    def sides(self, level: int, at: int) -> tuple[bytes, bytes]:
        """What lies left and right of a node in its run."""
        run = at - at % FANOUT
        flat = self.flat[level]
        return flat[64 * run : 64 * at], flat[64 * at + 64 : 64 * min(run + FANOUT, self.sizes[level])]

    def path(self, at: int) -> list[tuple[bytes, bytes]]:
        return [self.sides(level, at // FANOUT**level) for level in range(len(self.flat) - 1)]

    def proofs(self, above: bytes) -> list[bytes]:
        """All siblings of each place in the order of levels, and what lies above the block; a node's part is made once for all places below it."""
        known = [above]
        for level in range(len(self.flat) - 2, -1, -1):
            known = [b"".join((*self.sides(level, at), known[at // FANOUT])) for at in range(self.sizes[level])]
        return known


def folded(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The top that a node gives with the siblings of its path."""
    for left, right in path:
        node = sha256(left + node + right).hexdigest().encode()
    return node


def _hex(blob: bytes) -> np.ndarray:
    return _matrix(blob.hex().encode())


def _block(row: dict, levels: int) -> Block:
    """A row's block. A group of one block ends where one node is left; blocks of larger groups all have so many levels."""
    return Block(_hex(row["leaves"]), None if row["n"] <= FANOUT**levels else levels)


# --- places, blocks, paths ---


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows (a table) with `pos`, their place in their group in this order, and `n`, the group's size. The group isn't null.

    The parts of a range sort are counted by group: (parts + groups) rows. A group's places begin in a part where its earlier parts end.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc(), *(F.col(c).asc_nulls_first() for c in order)]
    ordered = written(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    spans = ordered.groupBy(F.col(group).alias("_g2"), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_k"))
    mine = Window.partitionBy("_g2")
    before = F.coalesce(F.sum("_k").over(mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = written(spans.select("_g2", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_k").over(mine).alias("n")), "spans")
    joined = ordered.join(spans, (F.col(group) == F.col("_g2")) & (part == F.col("_part")))
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def gathered(nodes: DataFrame, key: T.DataType, levels: int) -> DataFrame:
    """A written row for each aligned block: (g, n, block, ids, leaves, seen, top). nodes: (g, n, pos, id, node, seen), digests as 32 bytes.

    seen is what is checked in the node's place, or null for the node itself.
    """
    fields = T.StructType.fromDDL("g string, n bigint, block bigint").add("ids", T.ArrayType(key)).add("leaves", "binary").add("seen", "binary").add("top", "string")
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(fields)

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        leaves = b"".join(table["node"].to_pylist())
        seen = b"".join(s or x for s, x in zip(table["seen"].to_pylist(), table["node"].to_pylist(), strict=True))
        row = {"g": table["g"][0].as_py(), "n": table["n"][0].as_py(), "block": table["block"][0].as_py(), "ids": table["id"].to_pylist(), "leaves": leaves, "seen": seen if seen != leaves else None}
        row["top"] = _block(row, levels).top.decode()
        return pa.table([pa.array([row[f.name]], f.type) for f in target], schema=target)

    return written(nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**levels)).groupBy("g", "block").applyInArrow(block, fields), "blocks")


def built(nodes: DataFrame, key: T.DataType, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """(tables of blocks, lowest first; tops (g, node) of all groups)."""
    tables, tops, most_places = [gathered(nodes, key, levels)], None, FANOUT**levels
    while True:
        done = tables[-1].where(F.col("n") <= most_places).select("g", F.col("top").alias("node"))
        tops = done if tops is None else tops.unionByName(done)
        most = tables[-1].agg(F.max("n")).first()[0] or 0
        if most <= most_places:
            return tables, tops
        above = tables[-1].where(F.col("n") > most_places)
        size = F.ceil(F.col("n") / most_places)
        tables.append(gathered(above.select("g", size.alias("n"), F.col("block").alias("pos"), F.lit(None).cast("long").alias("id"), F.unhex("top").alias("node"), F.lit(None).cast("binary").alias("seen")), T.LongType(), levels))


def _node_paths(blocks: DataFrame, ups: DataFrame, key: T.DataType, levels: int) -> DataFrame:
    """(g, pos, id, up) of every node of the blocks; up: siblings of the levels above it. ups: (g, block, up)."""
    fields = T.StructType.fromDDL("g string, pos bigint").add("id", key).add("up", SIDES)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for row in batch.to_pylist():
                block = _block(row, levels)
                own = range(block.sizes[0])
                ups = [[{"left": a.decode(), "right": b.decode()} for a, b in block.path(i)] + row["up"] for i in own]
                yield {"g": [row["g"]] * len(own), "pos": [row["block"] * FANOUT**levels + i for i in own], "id": row["ids"], "up": ups}

        return work

    return map_batches(blocks.join(ups, ["g", "block"]).select("g", "n", "block", "ids", "leaves", "up"), make, fields)


def block_paths(tables: list[DataFrame], ups: DataFrame, levels: int) -> DataFrame:
    """(g, block, up) for the lowest blocks, from ups (g, up) of the groups' tops: down through the tables above."""
    down = None
    for i in range(len(tables) - 1, -1, -1):
        # groups whose top is a block of this table
        here = tables[i].where(F.col("n") <= FANOUT**levels).select("g", "block").join(ups, "g")
        down = written(here if down is None else here.unionByName(down), "paths")
        if i:
            down = _node_paths(tables[i], down, T.LongType(), levels).select("g", F.col("pos").alias("block"), "up")
    return down


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), seen: Column | None = None, paths: bool = False, levels: int = LEVELS) -> DataFrame:
    """A row for each row of docs: key, leaf, subroot, root, proof_sha256, folded_root, verified[, path].

    seen: the leaf of the copy to verify, over docs' columns; null where it is the row's own. folded_root is what it gives with the row's
    siblings, and verified whether that is the root. proof_sha256 is the hash of all siblings in order; with `paths`, path has them as
    (left, right) of each level. A block has `levels` levels. The group is taken as a string. Odd input: see the module.
    """
    kind = docs.schema[key].dataType
    sealed = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))  # null first, and never null
    own = leaf(*(F.col(f) for f in fields))
    check = F.lit(None).cast("string") if seen is None else F.nullif(seen, own)
    # a row's number tells apart rows that are the same, so that a range sort can split any number of them
    rows = written(docs.select(sealed.alias("g"), F.col(key).alias("id"), F.unhex(own).alias("node"), F.unhex(check).alias("seen"), F.monotonically_increasing_id().alias("row")), "leaves")
    tables, tops = built(placed(rows, "g", ["id", "node", "seen", "row"]), kind, levels)
    subroots = written(tops.select(F.lit("").alias("g"), F.col("g").alias("id"), F.unhex("node").alias("node"), F.lit(None).cast("binary").alias("seen")), "subroots")
    above, root = built(placed(subroots, "g", ["id"]), T.StringType(), levels)
    top = root.select("node").first()
    none = root.select("g", F.array().cast(SIDES).alias("up"))
    ups = _node_paths(above[0], block_paths(above, none, levels), T.StringType(), levels).select(F.col("id").alias("g"), "up")
    lowest = block_paths(tables, written(ups, "ups"), levels).join(subroots.select(F.col("id").alias("g"), F.lower(F.hex("node")).alias("subroot")), "g")
    return _proved(tables[0].join(lowest, ["g", "block"]), key, kind, top[0] if top else "", paths, levels)


def _proved(blocks: DataFrame, key: str, kind: T.DataType, root: str, paths: bool, levels: int) -> DataFrame:
    fields = T.StructType([T.StructField(key, kind)]).add("leaf", "string").add("subroot", "string").add("root", "string").add("proof_sha256", "string").add("folded_root", "string").add("verified", "boolean")
    if paths:
        fields = fields.add("path", SIDES)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for row in batch.to_pylist():
                block = _block(row, levels)
                up = [(x["left"].encode(), x["right"].encode()) for x in row["up"]]
                n, leaves = block.sizes[0], block.flat[0].decode()
                seen = leaves if row["seen"] is None else row["seen"].hex()
                roots: dict[bytes, str] = {}  # of what the block's top turns out to be
                folds = []
                for at in range(n):
                    reached = folded(seen[64 * at : 64 * at + 64].encode(), block.path(at))
                    if reached not in roots:
                        roots[reached] = folded(reached, up).decode()
                    folds.append(roots[reached])
                proofs = [sha256(p).hexdigest() for p in block.proofs(b"".join(a + b for a, b in up))]
                out = {key: row["ids"], "leaf": [leaves[64 * i : 64 * i + 64] for i in range(n)], "subroot": [row["subroot"]] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folds, "verified": [x == root for x in folds]}
                if paths:
                    out["path"] = [[{"left": a.decode(), "right": b.decode()} for a, b in [*block.path(i), *up]] for i in range(n)]
                yield out

        return work

    return map_batches(blocks.select("n", "ids", "leaves", "seen", "up", "subroot"), make, fields)


def tampered_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of documents, verified against a copy whose texts are in lower case (A to Z) where 3 divides the crc32 of the decimal doc_id. Null ids aren't tampered with."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, seen=F.when(hit, leaf(*columns, lower_az(F.col("text")))), levels=levels)


#: DuckDB SQL for tampered_manifest() over the table documents.
SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang,
    concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(octet_length(encode(doc_id::VARCHAR)), ':', doc_id) END,
      CASE WHEN source IS NULL THEN '-' ELSE concat(octet_length(encode(source)), ':', source) END,
      CASE WHEN lang IS NULL THEN '-' ELSE concat(octet_length(encode(lang)), ':', lang) END,
      CASE WHEN n_chars IS NULL THEN '-' ELSE concat(octet_length(encode(n_chars::VARCHAR)), ':', n_chars) END) AS head,
    CASE WHEN text IS NULL THEN '-' ELSE concat(octet_length(encode(text)), ':', text) END AS body,
    (WITH bits AS (SELECT list_prepend(4294967295::BIGINT, flatten([[ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for c in string_split(doc_id::VARCHAR, '')])) AS b)
     SELECT 4294967295 - list_reduce(b, lambda a, v: CASE WHEN xor(a, v) % 2 = 1 THEN xor(xor(a, v) >> 1, 3988292384::BIGINT) ELSE xor(a, v) >> 1 END) FROM bits) AS crc
  FROM documents
), e AS (
  SELECT r, doc_id, lang, sha256(concat(head, body)) AS leaf,
    sha256(concat(head, CASE WHEN crc % 3 = 0 THEN translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE body END)) AS seen
  FROM d
), leaves AS (
  SELECT *, coalesce('1' || lang, '0') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM e
), below AS (
  SELECT g, 0 AS lvl, pos, leaf AS h FROM leaves
  UNION ALL
  SELECT g, any_value(lvl) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM below) WHERE c > 1 GROUP BY g, pos // 8
), subroots AS (
  SELECT g, max(lvl) AS depth, arg_max(h, lvl) AS h, row_number() OVER (ORDER BY g) - 1 AS pos FROM below GROUP BY g
), above AS (
  SELECT 0 AS lvl, pos, h FROM subroots
  UNION ALL
  SELECT any_value(lvl) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS c FROM above) WHERE c > 1 GROUP BY pos // 8
), top AS (
  SELECT max(lvl) AS depth, arg_max(h, lvl) AS h FROM above
), sides AS (
  SELECT a.g, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lo, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS hi
  FROM below a JOIN below b ON a.g = b.g AND a.lvl = b.lvl AND a.pos // 8 = b.pos // 8 JOIN subroots s ON s.g = a.g AND a.lvl < s.depth GROUP BY a.g, a.lvl, a.pos
), tops AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lo, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS hi
  FROM above a JOIN above b ON a.lvl = b.lvl AND a.pos // 8 = b.pos // 8 WHERE a.lvl < (SELECT depth FROM top) GROUP BY a.lvl, a.pos
), steps AS (
  SELECT l.r, s.lvl, s.lo, s.hi FROM leaves l JOIN sides s ON s.g = l.g AND s.pos = l.pos // (8 ** s.lvl)::BIGINT
  UNION ALL
  SELECT l.r, u.depth + t.lvl, t.lo, t.hi FROM leaves l JOIN subroots u ON u.g = l.g JOIN tops t ON t.pos = u.pos // (8 ** t.lvl)::BIGINT
), fold AS (
  SELECT r, 0 AS lvl, seen AS h FROM leaves
  UNION ALL
  SELECT f.r, f.lvl + 1, sha256(concat(s.lo, f.h, s.hi)) FROM fold f JOIN steps s ON s.r = f.r AND s.lvl = f.lvl
), reached AS (
  SELECT r, arg_max(h, lvl) AS h FROM fold GROUP BY r
), proofs AS (
  SELECT r, string_agg(concat(lo, hi), '' ORDER BY lvl) AS p FROM steps GROUP BY r
)
SELECT l.doc_id, l.leaf, u.h AS subroot, top.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, f.h AS folded_root, f.h = top.h AS verified
FROM leaves l JOIN subroots u ON u.g = l.g JOIN reached f ON f.r = l.r LEFT JOIN proofs p ON p.r = l.r, top
"""
