"""What several training-data operators share: staging in the shared folder and distributed running totals."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse
from weakref import WeakKeyDictionary

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and bytes in an Arrow batch: bound the Python workers' memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20
#: Lets Spark drop a query's shuffle files when the query is over; nothing else reads those of a table that has been written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Of a folder in a plain file system: no checksum files, each of which starts processes in the executor to set its permissions.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Bytes of a row group that a worker gathers before it writes them.
GROUP_BYTES = 4 << 20
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches of this session small enough for long texts: a setting of the session, which stays set, as plans run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where none is set and the master is local, as in tests."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        there = spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def _simple(kind: T.DataType) -> bool:
    """Whether Arrow and Spark write the same Parquet type for this one."""
    if isinstance(kind, T.StructType):
        return all(_simple(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _simple(kind.elementType)
    return type(kind) in (T.LongType, T.IntegerType, T.StringType, T.BinaryType, T.DoubleType, T.BooleanType)


def _part_writer(folder: str, made):
    """Write what ``made`` makes of a task's batches to one hidden file in the folder and put out its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, size, out = f"_{uuid.uuid4().hex}", [], 0, None
        try:
            for b in made(batches):
                if not b.num_rows:
                    continue
                held.append(b)
                size += b.nbytes
                if out is None:
                    out = pq.ParquetWriter(f"{folder}/{name}", b.schema, compression="zstd")
                if size >= GROUP_BYTES:
                    out.write_table(pa.Table.from_batches(held))
                    held, size = [], 0
            if held:
                out.write_table(pa.Table.from_batches(held))
        finally:
            if out is not None:
                out.close()
            del held
            pa.default_memory_pool().release_unused()
        if out is not None:
            yield pa.RecordBatch.from_pydict({"name": pa.array([name], pa.string())})

    return run


def _write_plain(df: DataFrame, schema: T.StructType, path: str, made=iter) -> None:
    """Write what ``made`` makes of df's batches to a plain folder by Arrow: Spark's client for such folders starts a process for each
    file to set its permissions, which shares the executor's memory until it runs. A lost or repeated task leaves hidden files only:
    the driver shows those of tasks that count.
    """
    folder = Path(unquote(urlparse(path).path))
    folder.mkdir(parents=True)
    pq.write_table(to_arrow_schema(schema).empty_table(), folder / "empty.parquet")  # so that a table without rows can be read
    for r in df.mapInArrow(_part_writer(str(folder), made), "name string").collect():
        os.rename(folder / r["name"], folder / f"part-{r['name'][1:]}.parquet")


def stage(df: DataFrame, name: str, parts: int | None = None, arrow: bool = False, mapped: tuple | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    parts: files at most, where the size of what is written is known: many small files cost more than the rows in them.
    arrow: write tables of simple types in plain folders by Arrow, where a job writes so many that the processes for permissions tell.
    mapped: (function, schema) of a mapInArrow between df and the table, done by the worker that writes it.
    """
    spark = df.sparkSession
    df = df.coalesce(parts) if parts else df
    path = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        schema = T.StructType.fromDDL(mapped[1]) if mapped else df.schema
        if arrow and path.startswith("file:") and _simple(schema):
            _write_plain(df, schema, path, *(mapped or ())[:1])
        else:
            out = (df.mapInArrow(*mapped) if mapped else df).write.option("compression", "zstd").option("parquet.block.size", 32 << 20)
            (out.options(**PLAIN_FILES) if path.startswith("file:") else out).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    _PLACES[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no plan will read again."""
    for t in tables:
        if path := _PLACES.pop(t, None):
            context = t.sparkSession.sparkContext
            there = context._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(context._jsc.hadoopConfiguration()).delete(there, True)


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, out: str, buckets: int = 256) -> DataFrame:
    """Add ``out``, the sum of ``value`` over the rows that come earlier in the same group, without one task for a whole group.

    Rows of a group are split by a hash of ``order`` into buckets; bucket sums give each bucket's start, and a window within
    (group, bucket) gives the rest. The order is by bucket, then ``order``. Group columns must not be null. Rows equal in
    ``order`` stand in an arbitrary order, so they should be interchangeable (count them first).
    """
    b = "__bucket"
    df = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, b).agg(F.sum(value).alias("__sum"))
    starts = sums.select(*group, b, F.coalesce(F.sum("__sum").over(before), F.lit(0)).cast("long").alias("__start"))
    within = Window.partitionBy(*group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(starts, [*group, b])
        .withColumn(out, F.col("__start") + F.coalesce(F.sum(value).over(within), F.lit(0)).cast("long"))
        .drop(b, "__start")
    )


def repeat_rows(df: DataFrame, times: str, out: str, chunk: int = 1024, parts: int | None = None) -> DataFrame:
    """Each row ``times`` times, numbered from 0 in ``out``; a hot row is dealt out again in chunks, never as one long array.

    parts: how many partitions the chunks go to, where the planner can't tell that few rows become many.
    """
    n = F.col(times)
    small = df.where(n <= chunk).withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    parts_ = (
        df.where(n > chunk)
        .withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{times}` - 1) div {chunk}"))))
        .withColumn("__spread", F.xxhash64("__part", times))
    )
    parts_ = parts_.repartition(parts, "__spread") if parts else parts_.repartition("__spread")
    first = F.col("__part") * chunk
    large = parts_.withColumn(out, F.explode(F.sequence(first, F.least(n, first + chunk) - 1))).drop("__part", "__spread")
    return small.unionByName(large)
