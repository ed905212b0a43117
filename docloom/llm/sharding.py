"""Sharding by sampled splitters, in DataFrame operations alone.

Rows are ordered by (hash of the text, hash of the doc_id, ...), so equal texts are neighbours. A
sample drawn with a chance in proportion to size gives splitters, quantiles of the sampled keys; the
ranges between them are measured exactly, and a range over its share - a hot group of equal texts -
is divided again by the second hash. A shard then is a stretch of equal bytes of the whole order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS = 24
SAMPLE = 40_000
#: Rows that a range should hold, and at least how many ranges there are.
RANGE_ROWS, RANGES = 50_000, 192


def _range_of(key: str, splitters: list[int]) -> Column:
    """How many splitters are at most the key: a balanced tree of comparisons."""

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) < splitters[mid], pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(splitters))


def shards(docs: DataFrame, n: int = SHARDS, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): law `bytes`, shards of near-equal bytes.

    size: UTF-8 bytes of the text and 8 more. Shards differ by about one document's size. Equal texts
    share a shard unless a boundary falls into their group (at most n - 1 do). A null text has size 8
    and the crc of an empty one; null doc_ids and repeated rows are placed like others; an empty table
    gives no rows; other columns are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("k"),
        F.xxhash64("doc_id", F.lit(1)).alias("k2"),
    )
    rows = cut(rows, "sizes")
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    if not total["rows"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    # A row is drawn with a chance in proportion to its size; the draw is a hash, so a retried task draws the same.
    chance = F.col("size") * F.lit(min(1.0, sample / total["rows"]) * total["rows"] / total["bytes"])
    draw = F.shiftrightunsigned(F.xxhash64("k", "k2", F.lit(2)), 11) / F.lit(float(1 << 53))
    ranges = max(RANGES, min(4096, -(-total["rows"] // RANGE_ROWS)))
    drawn = rows.where(draw < chance).select("k")
    found = drawn.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], F.lit(8 * ranges))).first()[0] or []
    splitters = sorted(set(found))
    placed = rows.withColumn("r", _range_of("k", splitters))
    # Ranges over twice their share are divided by a hash that tells equal texts apart.
    measured = placed.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("c")).collect()  # a row a range
    share_b, share_c = total["bytes"] / ranges, total["rows"] / ranges
    parts = {m["r"]: max(1, round(max(m["b"] / share_b, m["c"] / share_c))) for m in measured}
    over = sorted((r, p) for r, p in parts.items() if p > 2)
    sub = F.lit(0)
    if over:
        many = F.create_map(*[F.lit(v) for pair in over for v in pair])
        sub = F.coalesce(F.pmod(F.col("k2"), F.element_at(many, F.col("r")).cast("bigint")).cast("int"), F.lit(0))
    placed = placed.withColumn("s", sub)
    order = ["k", "k2", "size", "text_crc32"]
    per = placed.groupBy("r", "s").agg(F.sum("size").alias("b"))
    before = Window.orderBy("r", "s").rowsBetween(Window.unboundedPreceding, -1)  # a row a range or part
    bases = per.select("r", "s", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("r", "s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = placed.join(F.broadcast(bases), ["r", "s"]).withColumn("at", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # The middle of a row decides, so no shard is over or under by more than half a row at each end.
    shard = F.least(F.lit(n - 1), F.floor((F.col("at") * 2 + F.col("size")) * F.lit(n) / F.lit(2.0 * total["bytes"])).cast("int"))
    at = at.withColumn("shard", shard)
    place = F.row_number().over(Window.partitionBy("r", "s", "shard").orderBy(*order)) - 1
    at = cut(at.withColumn("place", place.cast("bigint")), "placed")
    held = at.groupBy("shard", "r", "s").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("shard").orderBy("r", "s").rowsBetween(Window.unboundedPreceding, -1)
    firsts = held.select("shard", "r", "s", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("first"))
    out = at.join(F.broadcast(firsts), ["shard", "r", "s"])  # a row a range, part and shard: bounded by ranges and n
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n: int = SHARDS) -> None:
    """The documents themselves, a folder shard=N for each shard, in slot order."""
    key = ["doc_id", F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32")]
    placed = shards(docs, n).select("doc_id", "text_crc32", "shard", "slot").dropDuplicates(["doc_id", "text_crc32"])
    full = docs.withColumn("text_crc32", key[1])
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_crc32") == F.col("b.text_crc32"))
    joined = full.alias("a").join(placed.alias("b"), same).select("a.*", "b.shard", "b.slot").drop("text_crc32")
    joined.repartition(n * 4, "shard", F.pmod("slot", F.lit(4))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
