"""Times of the headline queries, as one JSON line. BENCH_SF_DIR, BENCH_CPUS: the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = ("pdf_extract_runs", "pdf_open_status", "pdf_operators", "pdf_fragment_channels", "search_literal", "read_bounded", "line_grouping", "repeated_boundaries", "text_predicates", "layout_blocks", "chunks_420", "chunk_citations", "knowledge_markdown", "permission_bits", "table_dedupe_best", "filters_round_trip")


def main() -> None:
    from pyspark.sql import SparkSession

    from docloom import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, times = catalog.queries(), {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
