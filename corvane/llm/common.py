"""What the operators of this subpackage share: scratch tables, Arrow helpers, normal forms."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: White space of the word rules: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\v\f\r"

LOWER_AZ = {ord(a): b for a, b in zip(_UPPER, _LOWER, strict=True)}


def lower_az(column: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(column, _UPPER, _LOWER)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder of the cluster.

    spark.checkpoint.dir names that folder. Where it is unset on one machine (tests),
    a temporary folder is made once and set; on a cluster that is an error, as its executors don't share local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/corvane-{name}-{uuid.uuid4().hex}"
    atexit.register(partial(_remove, spark, path))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder when the driver ends, if its JVM still runs."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has gone; the folder is the cluster's to clean
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to a scratch folder and read it again.

    This cuts the lineage: a lost executor costs the tasks it was running,
    and nothing upstream is computed twice.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """Write df to a scratch folder as a table bucketed by key. Two such tables of as many buckets are joined on the key without a shuffle."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "uncompressed").saveAsTable(table)
    atexit.register(partial(_drop, spark, table))
    return spark.table(table)


def _drop(spark: SparkSession, table: str) -> None:
    """Drop a scratch table when the driver ends, if its session still runs."""
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # noqa: BLE001  the session has gone, and a catalog in memory with it
        pass


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A written copy of df with a number for each row in the column `name`. Every job reads the same numbers, however its scan is split."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


#: A key with over 1 / HOT_KEYS of all rows is hot, so there are fewer than HOT_KEYS hot keys whatever the input.
HOT_KEYS = 2000


def hot_join(rows: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """rows joined with `one`, which has a row for each key and in the column _m how many rows have that key (taken off again).

    The rows of hot keys meet them by broadcast where they stand, all others by a shuffle on the key: no task gets over
    1 / HOT_KEYS of the rows for one key. Both sides are read more than once, so they should be tables. Rows without a partner are dropped.
    """
    total = one.agg(F.sum("_m")).first()[0] or 0
    few = F.col("_m") * HOT_KEYS <= total
    hot = F.broadcast(one.where(~few))  # fewer than HOT_KEYS rows
    rest = rows.where(F.col(key).isNotNull()).join(hot.select(key), key, "left_anti")
    return rest.join(one.where(few), key).unionByName(rows.join(hot, key)).drop("_m")


def release() -> None:
    """Give memory that a finished task no longer needs back to the system: a Python worker lives on for the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: T.StructType) -> DataFrame:
    """mapInArrow with state for each task.

    make() runs once in a task and returns a function from a record batch to
    dicts of column lists (or Arrow arrays) that follow the schema. Batches
    are sliced so that a slice holds about 8 MB at most, whatever the texts' lengths.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def out(columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in sliced(batch, 8 << 20):
                yield from map(out, work(part))
        finish = getattr(work, "finish", None)
        if finish is not None:
            yield from map(out, finish())
        del work, finish
        release()

    return df.mapInArrow(run, schema)


def text_column(make: Callable[[], Callable[[list[str]], list[list | pa.Array]]], fields: T.StructType) -> Callable[[Column], Column]:
    """A column function from texts to a struct, with state for each task. Null reads as empty.

    Only the texts go to Python and only the structs come back; the rows' other columns stay in the JVM.
    make() runs once in a task and returns a function from texts to a list of column values for each field.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(fields)

    @F.arrow_udf(fields)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            parts = [work([x or "" for x in part.column(0).to_pylist()]) for part in sliced(pa.RecordBatch.from_arrays([batch], ["text"]), 8 << 20)] or [[[] for _ in target]]
            columns = [pa.concat_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c in (p[i] for p in parts)]) for i, f in enumerate(target)]
            yield pa.StructArray.from_arrays(columns, fields=list(target))
        del work
        release()

    return run


def sliced(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about most bytes, a row at least."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, int(rows * most / max(most, batch.nbytes)))
    for at in range(0, rows, step):
        yield batch.slice(at, min(step, rows - at))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def with_plain_names(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with its columns named c0, c1 and so on but for the text, so that none clashes with what an operator adds. Undo it with toDF(*docs.columns)."""
    return docs.toDF(*(c if c == text else f"c{i}" for i, c in enumerate(docs.columns)))
