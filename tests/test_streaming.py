from docloom.sources.synth import text_pdf
from docloom.streaming import ingest


def test_arriving(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.pdf").write_bytes(text_pdf(f"document {i}") if i else b"junk")
    files = ingest.once(ingest.arriving(spark, str(folder)))
    for k, df in enumerate((ingest.product(files, "runs"), ingest.opened(files))):
        q = df.writeStream.format("memory").queryName(f"t{k}").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted(r["text"] for r in spark.table("t0").collect()) == ["document 1", "document 2"]
    assert sorted(r["status"] for r in spark.table("t1").collect()) == ["completed", "completed", "failed"]
