"""What the operators share: staged tables, column names and batch helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's own checkpoint folder.

    Where neither is set, a folder of our own on a single machine; a cluster needs one that all can see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='redactlake-')}"
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage there."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def unstage(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        fs, p = hadoop(df.sparkSession, df._staged)
        fs.delete(p, True)
        _made.remove((df.sparkSession, df._staged))


def hadoop(spark: SparkSession, path: str):
    """Hadoop's file system of a path, with the path object."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@atexit.register
def _drop_staged() -> None:
    for spark, path in _made:
        try:
            fs, p = hadoop(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner clears it
            return


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slim(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key as doc_id and the text as text, null texts empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def in_fold(id_col: str = "doc_id"):
    """True for rows that are held out: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def row_key(df: DataFrame, *first):
    """One text that tells rows apart: the given columns and a hash of the whole row, so that rows with one key are copies of each other."""
    plain = [F.col(f"`{f.name}`").cast("string") if f.dataType.typeName() == "variant" else F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.concat_ws("/", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in first), F.hex(F.xxhash64(*plain)))
