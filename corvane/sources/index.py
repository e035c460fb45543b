"""The point index: points and their postings in Parquet, by index version and bucket, with a pointer file to what is in use.

A point lies in the bucket that its document's hash gives; a document of very many chunks is spread over several. A write reads and
rewrites the buckets it touches and no others: their new files go to a fresh folder (a generation), and renaming a small
pointer over the old one makes them valid, so a reader sees the old state or the new one. The pointer names the generation of each
(version, bucket). Files that neither it nor the pointer before it names are deleted. There is one writer at a time.

Beside its points a bucket has their postings: for each term of the hashed vocabulary blocks of at most BLOCK postings in the order
of the points, with the block's largest weight, sharded by term, so that a search reads the shards of its terms only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.functions.vectors import is_valid
from corvane.schemas import POINT, POSTED

#: Chunks of a document that share a bucket, and postings in a block.
SPREAD, BLOCK = 4096, 128
#: Properties that a collection is made with, and their defaults.
PROPERTIES = {"dimension": None, "distance": "cosine", "weighting": "none", "vocabulary": 1 << 20}

_PLACED = T.StructType([*POINT.fields, T.StructField("ord", T.IntegerType()), T.StructField("bucket", T.IntegerType())])


#: What files are packed with.
CODEC = "zstd"
#: Points whose postings are put into blocks at once, and documents that a deletion broadcasts at most.
TOGETHER, BROADCAST_IDS = 20_000, 1_000_000


def _blocks(points: pa.Table, shards: int, target: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Postings of points of one part, as rows of POSTED: blocks of at most BLOCK postings of a term, numbered from the place of the first point here."""
    points = points.sort_by("ord").combine_chunks()
    sparse = points.column("sparse").combine_chunks()
    sparse = sparse.chunk(0) if isinstance(sparse, pa.ChunkedArray) else sparse
    places = points.column("ord").to_numpy()
    lengths = pc.fill_null(pc.list_value_length(sparse), 0).to_numpy(zero_copy_only=False)
    each = sparse.flatten()
    if not len(each):
        return
    ord, idx, weight = np.repeat(places, lengths), each.field(0).to_numpy(zero_copy_only=False), each.field(1).to_numpy(zero_copy_only=False)
    order = np.argsort(idx, kind="stable")
    ord, idx, weight = ord[order].astype(np.int32), idx[order], weight[order]
    nth = np.arange(len(idx)) - np.searchsorted(idx, idx)
    first = np.flatnonzero(nth % BLOCK == 0)
    bounds = pa.array(np.append(first, len(idx)).astype(np.int32))
    n = len(first)
    given = {
        "idx": pa.array(idx[first]), "block": pa.array((places[0] + nth[first] // BLOCK).astype(np.int32)), "best": pa.array(np.maximum.reduceat(weight, first)),
        "ords": pa.ListArray.from_arrays(bounds, pa.array(ord)), "weights": pa.ListArray.from_arrays(bounds, pa.array(weight)), "shard": pa.array((idx[first] % shards).astype(np.int32)),
        **{c: pa.array([points.column(c)[0].as_py()] * n) for c in ("index_version", "bucket")},
    }
    yield pa.RecordBatch.from_arrays([given[f.name].cast(f.type) for f in target], schema=target)


class PointIndex:
    """Points under a root folder: root/points and root/postings by generation, index version and bucket; root/STATE."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, shards: int = 8):
        """buckets and shards count for a new index; an index keeps those it was made with. A bucket should hold some 50,000 points at most."""
        self.spark, self.root, self._new = spark, root.rstrip("/"), {"buckets": buckets, "shards": shards}
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    # --- the pointer ---

    def state(self) -> dict:
        # between the two renames of a commit only the old pointer is there
        path = next((p for p in (self._path(f"{self.root}/{n}") for n in ("STATE", ".STATE-old", "STATE")) if self._fs.exists(p)), None)
        if path is None:
            return {"active": None, "parts": {}, "before": {}, **PROPERTIES, **self._new}
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, state: dict, **changes) -> dict:
        state = state | changes
        draft, final = self._path(f"{self.root}/.STATE-{uuid.uuid4().hex}"), self._path(f"{self.root}/STATE")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        old = self._path(f"{self.root}/.STATE-old")
        if self._fs.exists(final):
            self._fs.delete(old, False)
            self._fs.rename(final, old)
        if not self._fs.rename(draft, final):
            raise OSError(f"can't move the pointer of {self.root}")
        return state

    # --- provisioning ---

    def ensure(self, version: int, dimension: int, **properties) -> dict:
        """Create the index where there is none. A dimension, distance or vocabulary other than the stored one is an error; another weighting of sparse vectors is taken over, as it only says how they are read."""
        state = self.state()
        if state["active"] is None:
            unknown = properties.keys() - PROPERTIES.keys()
            if unknown:
                raise ValueError(f"no such properties: {sorted(unknown)}")
            return self._commit(state, active=version, dimension=dimension, **properties)
        asked = {"dimension": dimension, **properties}
        drift = {k: v for k, v in asked.items() if state.get(k) != v}
        if "dimension" in drift:
            raise ValueError(f"the index has {state['dimension']} dimensions, not {dimension}")
        if drift.keys() - {"weighting"}:
            raise ValueError(f"the index has other properties: {({k: state.get(k) for k in drift})}, not {drift}")
        return self._commit(state, **drift) if drift else state

    def drift(self, **expected) -> DataFrame:
        """(property, expected, actual) where the stored description differs from what is expected; an index that isn't there differs in all."""
        state = self.state()
        stored = state if state["active"] is not None else {}
        rows = [(k, json.dumps(v), json.dumps(stored.get(k))) for k, v in sorted(expected.items()) if k not in stored or stored[k] != v]
        return self.spark.createDataFrame(rows, "property string, expected string, actual string")

    def drop(self) -> None:
        self._fs.delete(self._path(self.root), True)

    # --- reading ---

    def _read(self, kind: str, schema: T.StructType, parts: dict[str, str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{kind}/gen={gen}/index_version={name.split('/')[0]}/bucket={name.split('/')[1]}" for name, gen in sorted(parts.items())]
        found = [p for p in paths if self._fs.exists(self._path(p))] if kind == "postings" else paths  # a bucket without terms has no postings
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*found).select(*schema.names)

    def _version_parts(self, version: int | None) -> dict[str, str]:
        parts = self.state()["parts"]
        return parts if version is None else {k: g for k, g in parts.items() if k.startswith(f"{version}/")}

    def placed(self, version: int | None = None) -> DataFrame:
        """Points with their bucket and their place (ord) in it, of one version or all. Only the version's folders are listed."""
        return self._read("points", _PLACED, self._version_parts(version))

    def postings(self, version: int) -> DataFrame:
        """(idx, block, best, ords, weights, index_version, bucket, shard) of one version."""
        return self._read("postings", POSTED, self._version_parts(version))

    def points(self) -> DataFrame:
        return self.placed().select(*POINT.names)

    def active(self) -> DataFrame:
        """Points of the active version; files of others aren't even listed."""
        return self.placed(self.state()["active"]).select(*POINT.names)

    def retrieve(self, ids: DataFrame) -> DataFrame:
        return self.points().join(ids.select("id").distinct(), "id", "left_semi")

    def counts(self, *keys: str) -> DataFrame:
        return self.points().groupBy(*keys).agg(F.count("*").alias("n"))

    # --- writing ---

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("document_id", F.floor(F.col("chunk_index") / SPREAD)), F.lit(buckets)).cast("int").alias("bucket")

    def _swap(self, state: dict, rows: DataFrame, touched: list[str], **changes) -> dict:
        """Write the rows of the touched parts as a new generation and point to it. rows have a bucket and an ord, and hold all that these parts are to have."""
        gen = uuid.uuid4().hex
        rows.sortWithinPartitions("index_version", "bucket", "ord").write.partitionBy("index_version", "bucket").option("compression", CODEC).parquet(f"{self.root}/points/gen={gen}")
        there = {p: gen for p in touched if self._fs.exists(self._path(f"{self.root}/points/gen={gen}/index_version={p.split('/')[0]}/bucket={p.split('/')[1]}"))}
        if there:
            self._write_postings(self._read("points", _PLACED, there), gen, state["shards"])
        parts = {k: g for k, g in state["parts"].items() if k not in touched} | there
        new = self._commit(state, parts=parts, before=state["parts"], **changes)
        self._vacuum(new)
        return new

    def _write_postings(self, placed: DataFrame, gen: str, shards: int) -> None:
        """Postings of the stored points, made where these are read: a part's file has its points in their order, so none is shuffled. Blocks of a part that several tasks read are numbered apart."""
        target = to_arrow_schema(POSTED)

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def flush() -> Iterator[pa.RecordBatch]:
                if held:
                    yield from _blocks(pa.Table.from_batches(held), shards, target)
                    held.clear()

            size = 0
            for batch in batches:
                where = np.stack([batch.column(c).to_numpy() for c in ("index_version", "bucket")])
                cuts = [0, *(np.flatnonzero((np.diff(where) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    part = batch.slice(lo, hi - lo)
                    if held and (size >= TOGETHER or any(part.column(c)[0] != held[0].column(c)[0] for c in ("index_version", "bucket"))):
                        yield from flush()
                        size = 0
                    held.append(part)
                    size += len(part)
            yield from flush()

        order = ["index_version", "bucket", "shard"]
        rows = placed.select("index_version", "bucket", "ord", "sparse").mapInArrow(blocks, POSTED)
        rows.sortWithinPartitions(*order, "idx", "block").write.partitionBy(*order).option("compression", CODEC).parquet(f"{self.root}/postings/gen={gen}")

    def _vacuum(self, state: dict) -> None:
        """Delete the folders of parts that neither the pointer nor the one before it names."""
        live = {(g, *k.split("/")) for parts in (state["parts"], state["before"]) for k, g in parts.items()}
        name = lambda status: status.getPath().getName()
        for kind in ("points", "postings"):
            top = self._path(f"{self.root}/{kind}")
            for gen in self._fs.listStatus(top) if self._fs.exists(top) else []:
                g = name(gen).partition("=")[2]
                if not any(x[0] == g for x in live):
                    self._fs.delete(gen.getPath(), True)
                    continue
                for version in self._fs.listStatus(gen.getPath()):
                    for bucket in self._fs.listStatus(version.getPath()) if version.isDirectory() else []:
                        if (g, name(version).partition("=")[2], name(bucket).partition("=")[2]) not in live:
                            self._fs.delete(bucket.getPath(), True)

    def _staged(self, rows: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.root}/staged/{uuid.uuid4().hex}"
        rows.write.option("compression", CODEC).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), path

    def upsert(self, new: DataFrame) -> dict:
        """Add points; those whose id is there are replaced. Repeated ids in new keep one row. Bad vectors are an error.

        new is computed once, into a staged copy. The buckets it touches are rewritten, the files of all others stay as they are.
        """
        state = self.state()
        staged, path = self._staged(new.select(*POINT.names, self._bucket(state["buckets"])))
        try:
            dimension = state["dimension"]
            if dimension is not None and not staged.where(~is_valid(F.col("dense"), dimension)).isEmpty():
                raise ValueError("INVALID_DIMENSION: a dense vector has the wrong size or a number that isn't finite")
            touched = [f"{r[0]}/{r[1]}" for r in staged.select("index_version", "bucket").distinct().collect()]  # versions x buckets at most
            if not touched:
                return state
            old = self._read("points", _PLACED, {k: g for k, g in state["parts"].items() if k in touched})
            # one shuffle, by bucket; an id's new row stands before its old ones, of whatever version
            rows = old.select(*POINT.names, "bucket", F.lit(False).alias("_new")).unionByName(staged.withColumn("_new", F.lit(True)))
            # sparse vectors travel as two plain arrays: a third of the size of an array of structs
            rows = rows.withColumns({"_idx": F.col("sparse.idx"), "_weight": F.col("sparse.weight")}).drop("sparse").repartition(len(touched), "bucket")
            id = ["index_version", "bucket", "id"] if len({t.split("/")[0] for t in touched}) == 1 else ["bucket", "id"]
            same = Window.partitionBy(*id).orderBy(F.desc("_new"))
            rows = rows.withColumn("_first", F.first("_new").over(same)).withColumn("_nth", F.row_number().over(same)).where(~F.col("_first") | (F.col("_nth") == 1))
            own = Window.partitionBy("index_version", "bucket").orderBy("id")
            rows = rows.withColumn("ord", F.row_number().over(own) - 1).withColumn("sparse", F.arrays_zip("_idx", "_weight").cast(POINT["sparse"].dataType))
            return self._swap(state, rows.select(*_PLACED.names), touched)
        finally:
            self._fs.delete(self._path(path), True)

    def delete_documents(self, documents: DataFrame, version: int | None = None) -> dict:
        """Delete the points of documents (document_id), of one version or of all. Missing ones do no harm. Only buckets that hold points of theirs are rewritten."""
        state = self.state()
        gone, path = self._staged(documents.select("document_id").distinct())
        try:
            if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
                gone = F.broadcast(gone)  # points then stay where they are, and keep their places
            mine = self.placed(version).select("document_id", "index_version", "bucket").join(gone, "document_id", "left_semi")
            touched = [f"{r[0]}/{r[1]}" for r in mine.select("index_version", "bucket").distinct().collect()]
            if not touched:
                return state
            old = self._read("points", _PLACED, {k: g for k, g in state["parts"].items() if k in touched})
            return self._swap(state, old.join(gone, "document_id", "left_anti").select(*_PLACED.names), touched)
        finally:
            self._fs.delete(self._path(path), True)

    def restore(self, state: dict) -> dict:
        """Point to the parts of an earlier state again, if there has been one write since at most: its files are then still there."""
        now = self.state()
        if now["parts"] != state["parts"] and now["before"] != state["parts"]:
            raise ValueError("the earlier state's files are gone")
        new = self._commit(now, active=state["active"], parts=state["parts"], before=now["parts"])
        self._vacuum(new)
        return new

    def verify(self, document: str, version: int, expected: int, sample: list[str]) -> bool:
        """Whether a document has as many points as it should, the sampled ids among them."""
        mine = self.placed(version).where(F.col("document_id") == document)
        return mine.count() == expected and mine.where(F.col("id").isin(*sample)).count() == len(set(sample))

    def counted(self, documents: DataFrame, version: int) -> DataFrame:
        """documents (document_id, expected) with n, their points in a version, and whether that is what is expected."""
        n = self.placed(version).groupBy("document_id").agg(F.count("*").alias("n"))
        found = documents.join(n, "document_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        return found.withColumn("whole", F.col("n") == F.col("expected"))

    def cutover(self, target: int, drop_source: bool = True) -> dict:
        """Make a version the active one, if every document of the old one is in it; then drop the old, which takes no rewriting."""
        state = self.state()
        source = state["active"]
        if source == target:
            return state
        missing = self.placed(source).select("document_id").distinct().join(self.placed(target).select("document_id"), "document_id", "left_anti")
        if not missing.isEmpty():
            raise ValueError("documents of the active version are missing in the target")
        keep = {k: g for k, g in state["parts"].items() if not (drop_source and k.startswith(f"{source}/"))}
        new = self._commit(state, active=target, parts=keep, before=state["parts"])
        self._vacuum(new)
        return new
