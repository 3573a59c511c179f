"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space of the contracts: \x20 and \x09 to \x0D.
SPACE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only. ``lower`` is much faster than ``translate`` and the same on text that is all ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def hash128(*cs: Column, name: str = "h") -> list[Column]:
    """Two independent 64-bit hashes as columns <name>1 and <name>2. The seeds differ because a hash starts from the
    one of the column before it."""
    return [F.xxhash64(*cs).alias(f"{name}1"), F.xxhash64(F.lit(1), *cs).alias(f"{name}2")]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir. Where it is unset a local one does in local mode
    (tests), and anything else is an error, as other machines would not see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="thresher-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder, so that a lost executor costs only the tasks that it ran."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def without_rows(docs: DataFrame, id_: Column, digest: Column, lost: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs without the rows whose (id, digest) is in lost; of those in repeated one row each. Both have the columns id
    and digest."""
    i, d = unused(docs, "id", "digest")

    def named(x: DataFrame) -> DataFrame:
        return x.select(F.col("id").alias(i), F.col("digest").alias(d))

    on = id_.eqNullSafe(F.col(i)) & (digest == F.col(d))
    left = docs.join(named(lost), on, "left_anti")
    if repeated.isEmpty():
        return left
    once = left.join(named(repeated), on, "left_semi").withColumns({i: id_, d: digest}).dropDuplicates([i, d]).drop(i, d)
    return left.join(named(repeated), on, "left_anti").unionByName(once)


def map_texts(df: DataFrame, keep: tuple[str, ...], text: Column, made: list[tuple[str, T.DataType]], f: Callable[[pa.Array], list[pa.Array]], rows: int = 512) -> DataFrame:
    """The columns in keep, and those named in made, which f makes of slices of text. A made column takes the place of a
    kept one of its name; other columns may have any name."""
    new = {n.lower() for n, _ in made}
    keep = tuple(c for c in keep if c.lower() not in new)
    source = df.select(*(quoted(c).alias(f"k{i}") for i, c in enumerate(keep)), text.alias("x"))
    schema = T.StructType([*(T.StructField(f"k{i}", source.schema[f"k{i}"].dataType) for i in range(len(keep))), *(T.StructField(f"m{i}", t) for i, (_, t) in enumerate(made))])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns[:-1], *f(b.column(b.num_columns - 1))], names=schema.names)

    return source.mapInArrow(by_row(run, rows), schema).toDF(*keep, *(n for n, _ in made))


def by_row(f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], rows: int = 512):
    """For mapInArrow: give f slices of at most so many rows, which bounds what Python holds at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield f(b.slice(at, rows))

    return run


def texts(b: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as Python strings, null as the empty string."""
    return [x or "" for x in b.column(b.schema.get_field_index(name)).to_pylist()]


def publish(spark: SparkSession, name: str, data: bytes) -> None:
    """Give every executor the file ``name`` (SparkFiles.get finds it): written once to the shared folder, from where
    Spark fetches it also for executors that start later. The name must follow from the content."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{sc.getCheckpointDir()}/{name}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()
    sc.addFile(fs.makeQualified(path).toString())
