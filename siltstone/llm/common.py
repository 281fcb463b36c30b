"""What the operators of this subpackage share."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import ASCII_LOWER, ASCII_UPPER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, as in local tests, a temporary one is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not root:
        root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="siltstone-")
        shared_dir.own = root
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return posixpath.join(shared_dir(spark), f"siltstone-{kind}-{uuid.uuid4().hex}")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


def written(df: DataFrame, kind: str) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = scratch(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of `written` that no later job reads."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, by fixed names; null text is kept."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names with a tail that makes them differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    tail = next(k for k in range(len(taken) + 1) if not {f"__{n}{k}" for n in names} & taken)
    return [f"__{n}{tail}" for n in names]
