"""The corpus API and the registered queries: on the smallest data against their SQL."""

import os

import pytest

import __spark_entry__ as entry
from docloom import catalog
from docloom.operators import fragments, knowledge, layout
from docloom.plans.corpus import Corpus
from docloom.plans.variants import mixed
from docloom.sources.store import Policy

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ("pdf_extract_runs", "pdf_open_status", "pdf_decrypt", "pdf_revisions", "search_literal", "search_word", "read_bounded", "word_lines", "body_font_size", "text_predicates", "chunks_420", "stable_ids", "markdown_tables", "layout_tables", "form_fields", "table_dedupe_best", "layout_regions", "table_compact_rows", "table_run_sequence", "form_labels", "cell_citations", "sentence_tails", "projection_nodes", "decode_gaps", "known_limits", "reachable_objects", "structure_pages")

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@needs_data
@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = c.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    want = sorted((tuple(row[columns.index(k)] for k in sorted(columns)) for row in r.fetchall()), key=repr)
    df = catalog.queries()[name](spark, SF)
    got = sorted((tuple(row[k] for k in sorted(columns)) for row in df.collect()), key=repr)
    assert sorted(df.columns) == sorted(columns) and got == want


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def corpus(spark, **policy):
    rows = [(i, bytearray(mixed({"doc_id": i, "text": f"first line {i}\nsecond line\n1. item", "source": "s", "lang": "en"}))) for i in range(8)] + [(8, None), (9, bytearray())]
    return Corpus(spark.createDataFrame(rows, "doc_id bigint, content binary"), Policy(**policy))


def test_statuses(spark):
    got = {r["doc_id"]: (r["status"], r["code"]) for r in corpus(spark).opened().collect()}
    assert got[0] == ("completed", None) and got[2] == ("partial", "structure-repaired") and got[3][0] == "failed" and got[4][0] == got[5][0] == "blocked" and got[8][0] == "blocked" and got[9][0] == "failed"
    assert {r["doc_id"] for r in corpus(spark).admitted().table.collect()} == {0, 1, 2, 6, 7}


def test_products(spark):
    c = corpus(spark, javascript="report")
    assert c.runs().where("doc_id = 1").count() == 3 and c.stream(4, decode=True).count() > 0
    assert [r["doc_id"] for r in c.features("active").collect()] == [4]
    hits = c.search("LINE", mode="word", limit=1).collect()
    assert {r["doc_id"] for r in hits} == {0, 1, 2, 4, 6, 7} and all(r["truncated"] and r["text"] == "line" for r in hits)
    with pytest.raises(TypeError):
        c.search("")
    with pytest.raises(TypeError):
        c.features("nothing")
    assert c.verify_signatures().count() == 0 and c.images().count() == 0
    assert {r["role"] for r in c.knowledge().where("doc_id = 0").collect()} >= {"list"}


def test_find():
    assert fragments.find("ﬁne Fine", "fi") == [(0, 1), (4, 6)]
    assert fragments.find("ét été", "é") == [(0, 2), (4, 5), (6, 7)]
    assert fragments.find("cat concat cat_ cat", "cat", "word") == [(0, 3), (16, 19)]
    assert fragments.find("Aa", "a", case_sensitive=True) == [(1, 2)]


def fragment_table(spark):
    rows = [(1, 1, "visible", "a", "abcdef"), (1, 1, "visible", "b", "ghij"), (1, 2, "hidden", "c", "no"), (1, None, "accessibility", "m", "zz"), (2, 1, "visible", "a", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, page_number int, channel string, id string, text string")


def test_read(spark):
    got = [(r["doc_id"], r["id"], r["text"], r["next_id"], r["next_offset"]) for r in fragments.read(fragment_table(spark), 5).orderBy("doc_id", "page_number", "id").collect()]
    assert got == [(1, "m", "zz", "a", 3), (1, "a", "abc", "a", 3), (2, "a", "x", None, None)]
    more = fragments.read(fragment_table(spark).where("doc_id = 1"), 100, cursor=("a", 3)).orderBy("page_number", "id").collect()
    assert [(r["id"], r["text"]) for r in more] == [("a", "def"), ("b", "ghij")] and more[0]["next_id"] is None


def runs_of(spark, rows):
    return spark.createDataFrame([(1, 1, f"run-{i}", i, t, float(x), float(y), float(s), False, "horizontal") for i, (t, x, y, s) in enumerate(rows)], "doc_id bigint, page_number int, id string, content_order int, text string, x double, y double, font_size double, starts_new_line boolean, writing_mode string")


def test_columns(spark):
    rows = [(f"left {i} text", 72, 700 - 14 * i, 12) for i in range(6)] + [(f"right {i} text", 330, 700 - 14 * i, 12) for i in range(6)]
    mixed_up = [rows[i // 2 + (6 if i % 2 else 0)] for i in range(12)]
    got = layout.ordered(layout.lines(runs_of(spark, mixed_up))).orderBy("reading_order").collect()
    assert [r["text"] for r in got] == [r[0] for r in rows]


def test_layout_roles(spark):
    rows = [("OVERVIEW OF RESULTS", 72, 720, 18), ("This is a long body line, with a comma and at least eight words.", 72, 690, 12), ("- an item", 72, 676, 12), ("body goes on here, and it is a sentence of eight or more words.", 72, 662, 12), ("wrapped hyphen-", 72, 648, 12), ("ated word", 72, 634, 12)]
    got = layout.blocks(runs_of(spark, rows)).orderBy("reading_order").collect()
    assert [r["role"] for r in got][:4] == ["heading", "body", "list", "body"]
    text = layout.document_texts(layout.blocks(runs_of(spark, rows))).first()["text"]
    assert "hyphenated" in text and text.startswith("OVERVIEW OF RESULTS\n\n")
    md = knowledge.markdown(knowledge.chunks(layout.blocks(runs_of(spark, rows)))).first()["markdown"]
    assert md.startswith("## OVERVIEW OF RESULTS\n\n") and "- an item" in md


def test_tables_in_markdown(spark):
    """A table stands where its first block stood, and its blocks' text is said once; equal texts are cited at their own places."""
    cells = [("Name", 72, 700), ("Size", 200, 700), ("Place", 330, 700)] + [(f"{c}{i}", x, 700 - 20 * i) for i in (1, 2, 3) for c, x in (("n", 72), ("s", 200), ("p", 330))]
    rows = [("before the table", 72, 760), *cells, ("after the table", 72, 560), ("after the table", 72, 540)]
    blocks = spark.createDataFrame([(1, 1, f"block-1-{k}", k, "body", t, float(x), float(y), 12.0, [f"run-{k}"]) for k, (t, x, y) in enumerate(rows)], "doc_id bigint, page_number int, id string, reading_order int, role string, text string, x double, y double, font_size double, run_ids array<string>")
    found = knowledge.tables(blocks)
    chunks = knowledge.chunks(knowledge.outside(blocks, found))
    md = knowledge.markdown(chunks, found).first()["markdown"]
    assert md.index("| Name | Size | Place |") < md.index("after the table") and md.count("n1") == 1 and "p3 |" in md
    places = sorted((r["start"], r["end"], r["text"]) for r in knowledge.citations(knowledge.chunks(blocks.where("reading_order > 12")), blocks).collect())
    assert places == [(0, 15, "after the table"), (16, 31, "after the table")]
