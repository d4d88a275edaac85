"""Files written by tasks and merged in order, on whatever file system a path names.

Lines are sorted into range partitions and written by Spark's text writer into a folder beside the target, task by task, with
its commits; a task that is run again leaves no second copy. The parts, in order, are then copied behind one another into one
file on the same file system, a buffer at a time, and that file takes the target's name only when it is whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_lines(lines: DataFrame, path: str, order: list[str], header: str | None = None) -> str:
    """Write the column `line` of lines, in order, to one file; header is its first line. Replaces a file of that name."""
    spark = lines.sparkSession
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("line").alias("value")).write.text(folder)
    target, fs = _place(spark, path)
    made, _ = _place(spark, f"{folder}/_whole")
    out = fs.create(made, True)
    if header is not None:
        out.write(bytearray(f"{header}\n".encode()))
    parts = sorted(str(x.getPath().toString()) for x in fs.listStatus(_place(spark, folder)[0]) if x.getPath().getName().startswith("part-"))
    copy = spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    for part in parts:
        source = fs.open(_place(spark, part)[0])
        copy(source, out, 65536, False)
        source.close()
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(made, target):
        raise OSError(f"could not write {path}")
    fs.delete(_place(spark, folder)[0], True)
    return path


def fields(columns):
    """One tab-separated line of columns; null is an empty field."""
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
