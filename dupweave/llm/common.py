"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh(df: DataFrame, base: str) -> str:
    """A name, made from `base`, with which no column of `df` begins (case-insensitively): names that begin with it are free, too."""
    name = f"__{base}"
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def ref(name: str) -> Column:
    """The column of exactly this name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def put(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with `name` set to `value` as its last column; a clashing input column is replaced."""
    kept = [ref(c) for c in df.columns if c.lower() != name.lower()]
    return df.select(*kept, value.alias(name))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A string that names a row: its id, or for a null id a digest of its text."""
    return F.coalesce(ref(id_col).cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(ref(text_col), F.lit("")))))


def hex_fraction(digest: Column, start: int, digits: int) -> Column:
    """`digits` hex digits of `digest` from 1-based `start`, as a long."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir; set a folder where none is named and all tasks run in this process' machine (tests)."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().isDefined():
        return
    if not context.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="dupweave-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, for tables that later steps read again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that shared_folder() named."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
