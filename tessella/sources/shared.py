"""Tables in the folder that all executors share, for what several steps of a plan read."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_SENT: set[str] = set()
_NOTED: list[list[DataFrame]] = []


def prepare(spark: SparkSession) -> None:
    """Let the executors import this package, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SENT:
        _SENT.add(sc.applicationId)
        package = Path(__file__).resolve().parents[1]
        sc.addPyFile(shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="tessella-")) / "tessella"), "zip", package.parent, package.name))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's own; a single machine without either gets one, a cluster raises."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not place:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file:///tmp/checkpoints/tessella"
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df from a Parquet table in the shared folder: computed once, with short plans behind it, safe when executors go."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._place = path
    for tables in _NOTED:
        tables.append(out)
    return out


@contextmanager
def noted() -> Iterator[list[DataFrame]]:
    """The tables that are written inside, for a loop to discard what a turn leaves."""
    tables: list[DataFrame] = []
    _NOTED.append(tables)
    try:
        yield tables
    finally:
        _NOTED[:] = [t for t in _NOTED if t is not tables]


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._place)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(ids: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """ids with name: 0, 1, ... within each group in the order of key, ranked in range partitions side by side."""
    parts = written(ids.repartitionByRange(group, key).withColumn("_part", F.spark_partition_id()), "numbered")
    ranked = parts.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(group, key)))
    # One row a partition and one a group: small beside ids.
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    at = ranked.join(before, "_part").withColumn("_at", F.col("_before") + F.col("_in") - 1)
    first = at.groupBy(group).agg(F.min("_at").alias("_first"))
    return at.join(first, group).withColumn(name, (F.col("_at") - F.col("_first")).cast("int")).drop("_part", "_in", "_before", "_at", "_first")
