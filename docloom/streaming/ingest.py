"""Documents as they arrive: a folder watched as a stream, each file once, through the corpus' products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.corpus import Corpus
from ..sources.store import Policy


def arriving(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """(doc_id, path, arrived, content) of new files; doc_id is a hash of the path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", per_trigger).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.col("modificationTime").alias("arrived"), "content")


def once(files: DataFrame, late: str = "1 day") -> DataFrame:
    """A file that is delivered again within the watermark is read once."""
    return files.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["path"])


def opened(files: DataFrame, policy: Policy | None = None) -> DataFrame:
    """The status rows of a stream of files."""
    return Corpus(files, policy).opened()


def product(files: DataFrame, name: str, policy: Policy | None = None) -> DataFrame:
    """runs, marks, pages, objects, content or xref of a stream of files."""
    if name not in ("runs", "marks", "pages", "objects", "content", "xref"):
        raise TypeError("no product of single documents")
    return getattr(Corpus(files, policy), name)()


def statuses_by_hour(files: DataFrame, policy: Policy | None = None, late: str = "1 hour") -> DataFrame:
    """(hour, status, n): how many documents of each hour opened how; late ones count until the watermark has passed."""
    from ..plans.corpus import opened_row

    chosen = policy or Policy()

    @F.arrow_udf("string")
    def status(contents):
        import pyarrow as pa

        return pa.array(["blocked" if c is None else opened_row(c, (), chosen)["status"] for c in contents.to_pylist()], pa.string())

    hours = files.withWatermark("arrived", late).select("arrived", status("content").alias("status"))
    return hours.groupBy(F.window("arrived", "1 hour").alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "status", "n")
