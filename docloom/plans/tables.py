"""The driver's text tables as corpora, runs and fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal

LINES, TOP, LEFT, STEP = 48, 720, 72, 14
# Rows taken from a batch at once, bytes of PDFs handed on at once, tasks a core.
STRETCH, BYTES, TASKS = 32, 4_000_000, 4


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """How many tasks kernels are dealt to: more than cores, so that none lags and each is small."""
    return max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pdf_batches(batches, make=None):
    """Arrow batches of rows to ones of (doc_id, PDF) that end with the document that fills them, whatever the size of those that come in."""
    import pyarrow as pa

    from ..sources.synth import text_pdf

    packed = lambda ids, made: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "content"])
    for batch in batches:
        ids, made, size = [], [], 0
        for k in range(0, batch.num_rows, STRETCH):
            for r in batch.slice(k, STRETCH).to_pylist():
                made.append(make(r) if make else text_pdf(r["text"], title=f"{r['source']} {r['lang']}"))
                ids.append(r["doc_id"])
                size += len(made[-1])
                if size >= BYTES:
                    yield packed(ids, made)
                    ids, made, size = [], [], 0
        yield packed(ids, made)


def pdf_corpus(spark: SparkSession, sf_dir: str, make=None, columns: tuple[str, ...] = ("doc_id", "text", "lang", "source")) -> DataFrame:
    """(doc_id, content): a PDF of each document, made by make(row) (default: its text, with lang and source for a title)."""

    def run(batches):
        return pdf_batches(batches, make)

    # A kernel's work is per document, whatever the files' splits.
    return read(spark, sf_dir, "documents").select(*columns).repartition(tasks(spark)).mapInArrow(run, "doc_id bigint, content binary")


def text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as runs with the writer's geometry."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("parts"))
    lines = docs.select("doc_id", F.filter(F.transform("parts", normal), lambda t: t != "").alias("parts")).select("doc_id", F.posexplode("parts").alias("k", "text"))
    on, at = (F.floor(F.col("k") / LINES) + 1).cast("int"), (F.col("k") % LINES).cast("int")
    return lines.select("doc_id", on.alias("page_number"), F.concat_ws("-", F.lit("run"), on, at + 1).alias("id"), at.alias("content_order"), "text", F.lit(float(LEFT)).alias("x"), (TOP - STEP * at).cast("double").alias("y"), F.lit(12.0).alias("font_size"), F.lit(True).alias("starts_new_line"), F.lit("horizontal").alias("writing_mode"))


def turn_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as fragments: a page a turn, the role tells the channel."""
    t = read(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.when(F.col("role") == "user", "visible").otherwise("accessibility").alias("channel"), F.concat_ws("-", F.lit("turn"), "conv_id", "turn", "role").alias("id"), "text")
