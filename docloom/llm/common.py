"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task joins up; more are contracted by rounds over all tasks.
LOCAL_EDGES = 2_000_000
#: A key is heavy if it holds more than one of HEAVY rows and more than HEAVY_ROWS: at most HEAVY keys are.
HEAVY, HEAVY_ROWS = 1000, 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests) a folder of our own is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends here, and a lost
    executor costs no recomputation of what came before. The table stays until drop() is called; those that
    a returned result reads stay for the caller to remove with the folder.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote; nothing may read them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def heavy_join(big: DataFrame, small: DataFrame, key: str, share: int = HEAVY, least: int = HEAVY_ROWS) -> DataFrame:
    """Inner join on key, of which small has each value once at most.

    Rows of heavy keys stay where they are and get small's rows sent - share rows at most, as each heavy key holds
    more than one of share of big's rows -, so no task meets all rows of one key; the rest is shuffled. big is
    read twice: it should be a written table.
    """
    limit = max(least, big.count() // share)
    heavy = [r[0] for r in big.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > limit).select(key).collect()]
    if not heavy:
        return big.join(small, key)
    held = F.col(key).isin([bytes(h) if isinstance(h, bytearray) else h for h in heavy])
    return big.where(held).join(F.broadcast(small.where(held)), key).unionByName(big.where(~held).join(small, key))


def _joined(edges: DataFrame) -> DataFrame:
    """(a, b) with b the smallest node that a reaches over the task's own edges; only nodes that reach a smaller one."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = reached(len(nodes), places[: len(a)], places[len(a) :])
        far = np.flatnonzero(root != np.arange(len(nodes)))
        for at in range(0, len(far), 100_000):
            some = far[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def reached(n: int, a, b):
    """The smallest place that each of n places reaches over the links (a, b)."""
    import numpy as np

    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
    return root


def components(edges: DataFrame, limit: int = 60, local: int = LOCAL_EDGES) -> DataFrame:
    """Connected components of undirected edges (a, b: bigint): (node, root), every node that has an edge and
    its component's smallest node.

    Each task first joins up its own edges, after which there are no more of them than nodes. If at most
    `local` are left, one task joins up the rest. Else alternating large and small stars follow: minima are
    aggregated with map-side combine, and what is sent back to the edges of a hub goes by heavy_join(). The
    number of rounds grows with the logarithm of the longest chain.
    """
    now = cut(edges.where("a <> b"), "edges")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before, now = now, cut(_joined(now), "forest")
    drop(before)
    before = now
    if now.count() <= local:
        now = cut(_joined(now.coalesce(1)), "joined")
        drop(before)
    else:
        now = cut(now.distinct(), "stars")
        drop(before)

        def mark(df: DataFrame) -> tuple:
            return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

        seen = mark(now)
        for _ in range(limit):
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = cut(heavy_join(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = heavy_join(large, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
            before, now = now, cut(small, "stars")
            drop(before, large)
            was, seen = seen, mark(now)
            if was == seen:
                break
        else:
            raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def text_batches(batch, size: int = 4_000_000):
    """Slices of an Arrow batch whose text column holds about size bytes each; one long text is a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    lens = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        end = at + max(1, int(np.searchsorted(np.cumsum(lens[at:]), size)))
        yield batch.slice(at, end - at)
        at = end
