"""Work and memory follow the input: what is made once is made once, what goes on goes on in bounded parts."""

import time

import pyarrow as pa
import pytest

from docloom.functions import columns, numerals
from docloom.operators import content, knowledge, layout, regions
from docloom.plans import corpus as C
from docloom.plans import tables, variants
from docloom.plans.queries import QUERIES
from docloom.sources.crypto import Aes, rc4
from docloom.sources.store import Document, Policy
from docloom.sources.synth import Writer, text_pdf

SF = "/root/testdata/sf0.001"
LONG = "\n".join(f"line {k} of many" for k in range(480))
ROW = {"doc_id": 1, "text": LONG, "lang": "en", "source": "s"}


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["pdf_decrypt", "pdf_images", "pdf_admission", "pdf_attachments", "pdf_revisions", "pdf_layers"])
def test_documents_are_made_and_parsed_once(spark, name):
    shown = plan(QUERIES[name](spark, SF))
    assert shown.count("MapInArrow") == 2 and "Join" not in shown


def test_ciphers_keep_pace():
    began = time.process_time()
    key = bytes(range(16))
    sealed = Aes(key).cbc_encrypt(key, bytes(160_000))
    assert Aes(key).cbc_decrypt(key, sealed) == bytes(160_000) and rc4(key, rc4(key, sealed)) == sealed
    assert Aes(bytes.fromhex("000102030405060708090a0b0c0d0e0f")).cbc_encrypt(bytes(16), bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert time.process_time() - began < 1.5


def test_fonts_are_made_once_a_document(monkeypatch):
    made = []
    monkeypatch.setattr(content, "Font", lambda *a, _of=content.Font: made.append(1) or _of(*a))
    doc = Document(text_pdf(LONG))
    assert len(doc.pages()) == 10 and len(list(C._runs(doc))) == 480 and len(made) == 1


def test_instructions_are_kept_only_where_asked_for():
    doc = Document(text_pdf(LONG))
    assert all(not seen.operators for _, seen in C._observed(doc))
    assert sum(len(seen.operators) for _, seen in C._observed(doc, listed=True)) == 2 * 480 + 3 * 10


def test_pdfs_go_on_in_parts(monkeypatch):
    monkeypatch.setattr(tables, "BYTES", 20_000)
    rows = pa.RecordBatch.from_pylist([{**ROW, "doc_id": k} for k in range(100)])
    made = list(tables.pdf_batches([rows], variants.rich))
    assert [d for b in made for d in b.column("doc_id").to_pylist()] == list(range(100))
    most = max(len(variants.rich({**ROW, "doc_id": k})) for k in range(100))
    assert len(made) > 10 and max(b.column("content").nbytes for b in made) < 20_000 + 2 * most


def test_entries_at_once_and_step_by_step_are_the_same():
    raw = text_pdf(LONG)
    at = raw.rfind(b"xref\n", 0, raw.rfind(b"startxref"))
    other = raw[:at] + raw[at:].replace(b" n \n", b" n\t\n")  # no row of the standard's, but readable
    assert [e.__dict__ for e in Document(raw).entries] == [e.__dict__ for e in Document(other).entries]
    assert [r["text"] for r in C._runs(Document(raw))] == LONG.split("\n")


def test_odd_tokens():
    w = Writer()
    w.put(1, "<</Type/Catalog/Pages 2 0 R/A#20b[true null -1.5 +7 (x) <4 1 4> % a\n 3 0 R]>>")
    w.put(2, "<</Type/Pages/Kids[4 0 R]/Count 1>>")
    w.put(3, "<</Type/Font/Subtype/Type1/Encoding/WinAnsiEncoding>>")
    w.put(4, "<</Type/Page/Parent 2 0 R/Contents 5 0 R/Resources<</Font<</F#31 3 0 R>>>>>>")
    w.stream(5, b"BT% c\n/F#31 12 Tf 1 0 0 1 72.5 7e2 Tm" .replace(b"7e2", b"700.") + b" <4 1> Tj (\\101\x81) Tj/F1 2 Tf<4142>Tj ET")
    doc = Document(w.file())
    assert doc.catalog["A b"][:6] == [True, None, -1.5, 7, b"x", b"A@"] and doc.catalog["A b"][6].obj == 3
    runs = list(C._runs(doc))
    assert [(r["text"], r["complete"], r["mapped_units"]) for r in runs] == [("A", True, 1), ("A\ufffd", False, 1), ("AB", True, 2)]


def test_judged_documents(spark):
    rows = [(k, bytearray(variants.mixed({**ROW, "doc_id": k}))) for k in range(8)] + [(8, None)]
    judged = C.Corpus(spark.createDataFrame(rows, "doc_id bigint, content binary"), Policy()).judged()
    assert {r["doc_id"]: r["status"] for r in judged.collect()} == dict(enumerate("completed completed partial failed blocked blocked completed completed blocked".split()))


@pytest.mark.parametrize("name", ["layout_tables", "layout_regions", "cell_citations", "table_compact_rows", "table_run_sequence"])
def test_lineitems_are_dealt_once(spark, name):
    shown = plan(QUERIES[name](spark, SF))
    assert shown.count("Relation [") == 1 and "Join" not in shown and "Union" not in shown
    physical = QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    executed = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange") == 1, physical


def test_lists_inside_a_page_are_not_null(spark):
    """Null lists make Spark's Arrow writer walk over a whole batch for each of its rows."""
    blocks = spark.createDataFrame([(1, 1, "block-1-1", 0, "a", 1.0, 1.0, 12.0)], "doc_id long, page_number int, id string, reading_order int, text string, x double, y double, font_size double")
    shown = knowledge.tables(blocks)._jdf.queryExecution().analyzed().toString()
    assert "null as array<string>) AS run_ids" in shown and "coalesce(" in shown


def lines(page, text):
    return [{"id": f"b-{page}-{k}", "text": text(k), "x": 72.0 + 100 * (k % 3), "y": 700.0 - 20 * (k // 3), "font_size": 12.0, "numeric": k > 2, "sentence": False, "labels": 0, "words": 1, "reading_order": k, "role": None, "run_ids": []} for k in range(12)]


def test_pages_alike_share_one_search(monkeypatch):
    searched = []
    monkeypatch.setattr(regions, "_search", lambda rows, _of=regions._search: searched.append(1) or _of(rows))
    regions._shape.cache_clear()
    knowledge._grids.cache_clear()
    for page in range(50):
        rows = lines(page, lambda k: ("abc"[k % 3] if k < 3 else str(page + k)[-1]) * 2)
        (region,) = regions.page_regions(rows)
        assert region["block_ids"] == [b["id"] for b in rows] and region["header_ids"] == [b["id"] for b in rows[:3]]
        (t,) = knowledge.page_tables(rows)
        assert t["headers"] == ["aa", "bb", "cc"] and [b["text"] for r in t["rows"] for _, b in r] == [b["text"] for b in rows[3:]]
    assert len(searched) == 1 and knowledge._grids.cache_info().misses == 1
    twice = [b | {"id": "same"} for b in lines(0, lambda k: "ab" if k < 3 else "11")]
    assert regions.page_regions(twice) == regions._search(twice)


def test_ids_of_a_batch():
    texts = ["", "a", "\u00e9" * 70, "x" * 500, "\U0001f600b", "\ud800"] + [f"text {k}" * (k % 7) for k in range(60)]
    assert numerals.fnv1a_all(texts).tolist() == [numerals.fnv1a(t) for t in texts]
    parts = [[t, None, 3] for t in texts]
    assert numerals.stable_id_all("p", texts, parts) == [numerals.stable_id("p", t, p) for t, p in zip(texts, parts)]
    assert numerals.stable_id_all("p", [], []) == []


def test_values_by_columns():
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.string()), ("c", pa.list_(pa.string()))]))
    array = pa.array([[{"a": 1, "b": "x", "c": ["p", None]}, {"a": None, "b": None, "c": None}], None, [], [None, {"a": 3, "b": "y", "c": []}]], kind)
    for part in (array, array.slice(1), array.slice(2, 2), array.slice(0, 1), array.slice(4)):
        assert columns.values(part) == part.to_pylist()


def test_pages_are_ordered_in_stretches():
    import tracemalloc

    kind = pa.struct([("id", pa.string()), ("text", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("font_size", pa.float64()), ("numeric", pa.bool_()), ("sentence", pa.bool_()), ("labels", pa.int32()), ("words", pa.int32()), ("vertical", pa.bool_())])
    page = [{"id": f"block-1-{k}", "text": f"words of line {k}", "x": 72.0, "y": 720.0 - 14 * k, "font_size": 12.0, "numeric": False, "sentence": False, "labels": 0, "words": 4, "vertical": False} for k in range(10)]
    pages = pa.array([page] * 2000, pa.list_(kind))
    tracemalloc.start()
    made = layout.page_places(pages)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.to_pylist() == [[{"at": k, "part": None} for k in range(10)]] * 2000
    assert most < 6_000_000  # all pages at once are about 20 MB


def test_evidence_is_told_once(spark):
    runs = spark.createDataFrame([(1, 1, "run-1-1", 0, "a", 1.0, 1.0, 12.0, True, "horizontal")], "doc_id long, page_number int, id string, content_order int, text string, x double, y double, font_size double, starts_new_line boolean, writing_mode string")
    found = knowledge.tables(layout.blocks(runs))
    assert "update_fields" not in found._jdf.queryExecution().analyzed().toString()
