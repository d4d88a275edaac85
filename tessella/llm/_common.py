"""What the operators share: shipping the package, shared tables, corpus-wide samples and connected components."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Python code holds at once of the Arrow batches handed to it, at most; bounds a worker's memory.
ARROW_ROWS = 1000
_LOCK = threading.Lock()
#: What operators keep in this worker, by the operator's name.
_KEPT: dict[str, dict] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    with _LOCK:
        if sc.applicationId in _SHIPPED:
            return
        _SHIPPED.add(sc.applicationId)
        root = Path(__file__).resolve().parents[2]
        place = os.path.realpath(tempfile.mkdtemp(prefix="ship-"))
        stage = os.path.join(place, "stage")
        shutil.copytree(root / "tessella", os.path.join(stage, "tessella"), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(os.path.join(place, "tessella_package"), "zip", stage))


def kept(name: str) -> dict:
    """What the operator of that name keeps in this worker from one task to the next. One worker serves all operators and
    outlives their tasks, so what others kept in it goes."""
    for other in [x for x in _KEPT if x != name]:
        del _KEPT[other]
    return _KEPT.setdefault(name, {})


def give_back() -> None:
    """Return to the system what this worker has freed: all workers' memory counts with their executor's."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def batches_of(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, without a copy; the session's own batch size stays as it is."""
    give_back()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b
        give_back()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's own.

    Where neither is set a single machine gets one of its own (tests); a cluster raises, as its executors' own disks
    would each hold a part of what is written.
    """
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not place:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file:///tmp/checkpoints/tessella"
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def table(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write df to the shared folder and read it back: it cuts lineage, is computed once, and outlives executors. options
    are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of jobs that are over. It does so once the driver's JVM has collected what refers
    to them, which may be long after; until then they hold disk on every executor."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that names each row, and that column's name, which docs has not.

    The name is the row's place in its Parquet file (file and row number), so it is the same on every evaluation, whatever
    partitions or lost executors. What is no scan of Parquet is written to the shared folder first.
    """
    name = "row"
    while name in docs.columns:
        name += "_"
    key = F.struct(F.unhex(F.md5(F.col("_metadata.file_path").cast("binary"))).alias("file"), F.col("_metadata.row_index").alias("at")).alias(name)
    try:
        return docs.select("*", key), name
    except AnalysisException:
        return table(docs, "rows").select("*", key), name


def fold(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 5; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(0))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows of df (all, if it has fewer), by a hash of key: the same rows on every run, without a shuffle."""
    n = df.select(key).count()
    if n <= most:
        return df
    scale = 1 << 30
    return df.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(scale)) < int(scale * most / n))


def joined_by(big: DataFrame, small: DataFrame, *keys: str, parts: int = 64) -> DataFrame:
    """The inner join of big with small (keys unique, nulls equal, and rows: how many of big's rows each key has).

    A key with one of `parts` equal shares of all rows or more would fill one task; there are at most `parts` such keys, so
    their rows of small are broadcast and big's rows of them stay where they are. The others meet in a shuffle.
    """
    own = [f"_{k}" for k in keys]
    named = small.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], *[c for c in small.columns if c not in keys])
    n = named.agg(F.sum("rows").alias("n")).first()["n"] or 0
    meet = lambda b: [b[k].eqNullSafe(F.col(o)) for k, o in zip(keys, own)]
    hot, cold = named.filter(F.col("rows") * parts >= n), named.filter(F.col("rows") * parts < n)
    rest = big.join(F.broadcast(hot.select(*own)), meet(big), "left_anti")
    return big.join(F.broadcast(hot), meet(big)).union(rest.join(cold, meet(rest))).drop(*own, "rows")


def _stars(e: DataFrame) -> bool:
    """Whether every u of e (u, v) has one edge and none is a v too."""
    ends = e.select("u", F.lit(1).alias("n")).union(e.select(F.col("v"), F.lit(None).cast("int")))
    return not ends.groupBy("u").agg(F.count("n").alias("up"), F.count(F.when(F.col("n").isNull(), 1)).alias("down")).filter("up > 1 OR up = 1 AND down > 0").take(1)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of edges (u, v) reaches.

    Alternating large-star and small-star rounds over the edge list. A node's edges are never gathered: its least
    neighbour is an aggregate, joined back. Each round is written to the shared folder. The rounds end when the edges,
    each from a larger to a smaller node, are stars: every u has one edge and no v is a u, so each v is its set's least.
    """
    e = table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    for _ in range(most_rounds):
        if _stars(e):
            break
        # Large star: every larger neighbour of a node goes to the node's least neighbour.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        big = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        big = table(big, "cc-large")
        low = table(big.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = big.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        old, e = e, table(small, "cc")
        discard(old, least, big, low)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
