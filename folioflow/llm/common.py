"""Helpers that the corpus operators share: word rules, staged tables and shipping of the package."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship  # noqa: F401

#: Characters that separate words, and the same as a regular expression.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and all else kept; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/folioflow/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def staged(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage. Files of few rows (0: of any
    number) let work that is heavy for its bytes spread over the cores."""
    path = shared_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


class Own:
    """A caller's table with its columns named by place (o0, o1, ...), so that names with dots, in other case or equal to a helper's can't clash."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"o{i}" for i in range(len(self.names))])
        self.columns = self.df.columns

    def at(self, name: str) -> str:
        """The place of a column: of this very name, else of the name in another case."""
        exact = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if not exact:
            raise ValueError(f"no column {name} among {self.names}")
        return f"o{exact[0]}"

    def has(self, name: str) -> bool:
        return name.lower() in [n.lower() for n in self.names]

    def back(self, df: DataFrame, *added: str) -> DataFrame:
        """df with the caller's names; the added columns come last and replace the caller's of these names."""
        new = [a.lower() for a in added]
        kept = [i for i, n in enumerate(self.names) if n.lower() not in new]
        return df.select(*[f"o{i}" for i in kept], *added).toDF(*[self.names[i] for i in kept], *added)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
