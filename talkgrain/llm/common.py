"""Shared helpers: table access, scratch tables in the cluster's shared folder, connected components."""

from __future__ import annotations

import atexit
import gc
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain.session import shared_dir

#: One word: a maximal run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables written to the shared folder, so that lineage ends there and a lost
    executor costs a re-read only. drop() removes those that nothing needs any more; tables that
    a returned (lazy) DataFrame still reads stay until the session ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def _close(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session has ended already
            pass

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables, and lets Spark remove the shuffle files that nothing refers to any more."""
        for f in frames:
            _delete(self.spark, f._scratch_path)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


#: At most so many nodes are hubs, 16 bytes each; a node of at most LIGHT edges never is one.
HUBS, LIGHT = 10_000, 500


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): rows (node, component), the component being the smallest node.

    Alternating large-star and small-star contraction (Kiveris et al. 2014). Every round is one
    shuffle of the edge list, each node's minimum is pre-aggregated, and the list never grows by
    more than a factor of two. A node that holds one in HUBS of the edges or more is a hub; there are at most HUBS of
    them, so all tasks know their minima and a hub's edges stay where they are, instead of meeting in one task. No other part
    of the list reaches the driver but the two counters that tell whether a round changed anything. Self loops and repeated edges are allowed.
    """

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    def with_min(df: DataFrame, n: int) -> DataFrame:
        low = df.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_c"))
        most = max(LIGHT, math.ceil(n / HUBS))
        hubs = F.broadcast(low.filter(F.col("_c") > most).drop("_c"))
        light = df.join(hubs.select("a"), "a", "left_anti").join(low.filter(F.col("_c") <= most).drop("_c"), "a")
        return df.join(hubs, "a").unionByName(light)

    cur = scratch.write(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    seen = signature(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            with_min(both, 2 * seen[0])
            .filter("b > a")
            .select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
            .distinct()
        )
        large = scratch.write(large, "large")
        small = with_min(large, 2 * seen[0])
        small = (
            small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        new = scratch.write(small, "small")
        scratch.drop(cur, large)
        cur, was, seen = new, seen, signature(new)
        if was == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def slices(batches, column: str = "text", chars: int = 2_000_000):
    """Record batches of at most so many bytes of text (one row at least), so that what a task holds is bounded whatever the rows' sizes."""
    import pyarrow.compute as pc

    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        i, held = 0, 0
        for j, n in enumerate(size.tolist()):
            if held + n > chars and j > i:
                yield b.slice(i, j - i)
                i, held = j, 0
            held += n
        if b.num_rows > i:
            yield b.slice(i)
