"""Regions, tables told by runs, label forms, split lines, citations of cells, and what a page's objects reach."""

import itertools

import pytest

from docloom.operators import knowledge, labels, layout, regions, sequences
from docloom.plans import corpus as corpora
from docloom.plans.corpus import Corpus
from docloom.sources.store import Policy
from docloom.plans.variants import locked

ROW = "doc_id bigint, page_number int, id string, content_order int, text string, x double, y double, font_size double, starts_new_line boolean, writing_mode string"


def runs_of(spark, rows):
    return spark.createDataFrame([(1, 1, f"run-{k + 1}", k, t, float(x), float(y), float(s), False, "horizontal") for k, (t, x, y, s) in enumerate(rows)], ROW)


def found(spark, rows, roles=None):
    runs = runs_of(spark, rows)
    blocks = layout.lines(runs).selectExpr("*", "line - 1 as reading_order", "'body' as role")
    for number, role in (roles or {}).items():
        blocks = blocks.selectExpr("* except (role)", f"case when line = {number} then '{role}' else role end as role")
    return knowledge.tables(blocks, runs), blocks


def test_compact_rows(spark):
    texts = ["Sample Measurements", "Item Nominal Width Measured Width Result", "Alpha 10.0 mm 10.4 mm pass", "Beta 12.0 mm 11.1 mm review", "Gamma 8.0 mm 8.0 mm pass"]
    made, blocks = found(spark, [(t, 72, 720 - 14 * k, 12) for k, t in enumerate(texts)])
    (t,) = made.collect()
    assert t["heuristic"] == "row-sequence" and t["headers"] == ["Item", "Nominal Width", "Measured Width", "Result"]
    assert [c["text"] for c in t["cells"]][:4] == ["Alpha", "10.0 mm", "10.4 mm", "pass"] and len(t["cells"]) == 12 and len(t["block_ids"]) == 4
    cited = {(c["row_index"], c["col_index"]): c for c in knowledge.cell_citations(made, blocks).collect()}
    c = cited[0, 1]
    assert (c["text"], c["run_ids"], texts[2][c["start"] : c["end"]]) == ("10.0 mm", ["run-3"], "10.0 mm") and len(cited) == 12


def test_header_split_is_the_best_of_all():
    """Against every way to deal the words, as worth is defined."""
    for text, numeric in (("Item Nominal Width Measured Width Result", [False, True, True, False]), ("A Total B Count Size", [True, False, True]), ("One Two Three Four", [False, True, True, False])):
        words, m = text.split(), len(numeric)

        def worth(cells):
            out, last = 0, [sequences.bare(c.split()[-1]) for c in cells]
            for j, c in enumerate(cells):
                n = len(c.split())
                out += 2 + ((2 if j in (0, m - 1) else 0) if n == 1 else 3 if n == 2 else -2 * (n - 2))
                out += numeric[j] * (4 * (n > 1) + 3 * (last[j] in sequences.MEASURES)) + 4 * (j > 0 and numeric[j] and numeric[j - 1] and last[j] == last[j - 1])
            return out

        ways = []
        for cut in itertools.combinations(range(1, len(words)), m - 1):
            at = (0, *cut, len(words))
            ways.append([" ".join(words[a:b]) for a, b in zip(at, at[1:])])
        assert sequences.split_header(text, numeric) == max(ways, key=worth)  # of equals the first, as here


def test_run_sequence_and_stack(spark):
    rows = [(t, 72, 720 - 14 * k, 10) for k, t in enumerate(("Alpha", "10", "Pass", "Beta", "12", "Review"))] + [(t, 72, 600 - 16 * k, 14) for k, t in enumerate(("Item", "Count", "Result"))]
    (t,) = found(spark, rows)[0].collect()
    assert t["headers"] == ["Item", "Count", "Result"] and [c["text"] for c in t["cells"]] == ["Alpha", "10", "Pass", "Beta", "12", "Review"]
    runs = [{"id": f"r{k}", "text": t, "font_size": s, "content_order": k} for k, (t, s) in enumerate([*((t, 10) for t in ("1", "Printer", "Nova Limited", "1200", "Completed", "2", "Scanner", "Orion Services", "900", "Ongoing")), *((t, 15) for t in ("Serial", "Description", "Contractor", "Amount", "Status", "Notes"))])]
    heads = [("Serial\nDescription", 72, ("r10", "r11")), ("Contractor", 190, ("r12", "r15")), ("Amount", 320, ("r13",)), ("Status", 430, ("r14",))]
    of = {r: {"id": f"head-{k}", "text": t, "x": x, "y": 720} for k, (t, x, own) in enumerate(heads) for r in own}
    t = sequences.stacked_table(runs, of)
    assert t["headers"] == ["Serial", "Description", "Contractor", "Amount", "Status"] and [c["text"] for _, c in t["rows"][1]] == ["2", "Scanner", "Orion Services", "900", "Ongoing"]
    assert sequences.rows_of(list("abcdefg"), 3) == [] and sequences.rows_of(list("abcde"), 3) == [["a", "b", "c"], ["d", "e"]] and sequences.rows_of([], 3) == []


def test_label_form(spark):
    texts = ["Registration Form", "Name:", "Department:", "Contact:", "Reviewer:", "Closing paragraph"]
    rows = [(t, 72, 740 - 24 * k, 22 if k == 0 else 12) for k, t in enumerate(texts)]
    (t,) = found(spark, rows, {1: "heading"})[0].collect()
    assert t["heuristic"] == "field-label-form" and t["headers"] == ["Registration Form"] and [c["text"] for c in t["cells"]] == ["Name:", "Department:", "Contact:", "Reviewer:", "Closing paragraph"][: len(t["cells"])]
    assert found(spark, rows[:4], {1: "heading"})[0].count() == 0 and found(spark, rows)[0].count() == 0
    assert labels.label("2. Name") is None and labels.label("* Due date:") == "Due date:" and labels.label("Ends here.") is None and labels.label("Name of Owner") == "Name of Owner"


def test_regions(spark):
    grid = [(t, x, 700 - 20 * r, 12) for r, line in enumerate((("Name", "Size", "Place"), ("a", "1", "x"), ("b", "2", "y"))) for t, x in zip(line, (72, 180, 300))]
    blocks = layout.ordered(layout.lines(runs_of(spark, grid)))
    (r,) = regions.regions(blocks).collect()
    assert r["kind"] == "table" and len(r["block_ids"]) == 9 and len(r["header_ids"]) == 3 and len(r["run_ids"]) == 9 and r["confidence"] == pytest.approx(0.815)
    roles = {b["text"]: (b["role"], b["method"]) for b in layout.blocks(runs_of(spark, grid)).collect()}
    assert roles["Name"] == ("heading", "table-header") and roles["a"] == ("body", "table-body")
    form = [("Name:", 72, 700, 12), ("Ada", 160, 700, 12), ("Town:", 72, 600, 12), ("Paris", 72, 580, 12)]
    (r,) = regions.regions(layout.lines(runs_of(spark, form)).selectExpr("*", "line - 1 as reading_order")).collect()
    assert r["kind"] == "form-like" and len(r["block_ids"]) == 4 and r["confidence"] == pytest.approx(0.59)
    assert regions.regions(blocks.limit(0)).count() == 0


def test_split_tails(spark):
    rows = [("The first line goes on", 72, 700, 12), ("to its end. Another sentence starts", 72, 686, 12), ("and ends here.", 72, 672, 12), ("So this. Is whole", 72, 658, 12), ("as Dr. No is", 72, 644, 12)]
    got = layout.split_tails(layout.ordered(layout.lines(runs_of(spark, rows)))).orderBy("reading_order").collect()
    assert [(b["text"], b["tail_part"]) for b in got] == [("The first line goes on", None), ("to its end.", "tail"), ("Another sentence starts", "body"), ("and ends here.", None), ("So this. Is whole", None), ("as Dr. No is", None)]
    assert [b["reading_order"] for b in got] == list(range(6))
    of = {r["run_id"]: r["block_id"] for r in layout.run_blocks(layout.split_tails(layout.ordered(layout.lines(runs_of(spark, rows))))).collect()}
    assert of["run-2"] == "block-1-2-body" and len(of) == 5


def test_projection(spark):
    rows = [(1, 1, 0, 0, "c0", "heading", "Title\nmore words"), (1, 1, 1, 1, "c1", "list", "- one\n* two"), (1, 1, 2, 2, "c2", "body", "a | b\nc | d"), (1, 1, 3, 3, "c3", "mixed", "plain\n text"), (1, 1, 4, 4, "c4", "body", " ")]
    chunks = spark.createDataFrame(rows, "doc_id bigint, page_number int, at int, ord int, id string, role string, text string")
    got = [(r["kind"], r["text"] or r["items"] or r["rows"]) for r in knowledge.projection(chunks).orderBy("at", "part").collect()]
    assert got == [("heading", "Title"), ("paragraph", "more words"), ("list", ["one", "two"]), ("table", [["a", "b"], ["c", "d"]]), ("paragraph", "plain\ntext")]


def test_tables_choose():
    """The larger grid under the same headers stays; a commonest width, the larger of equals."""
    cells = [("Code", 72, 720), ("Label", 180, 720), ("Amount", 300, 720)] + [(f"{c}{r}", x, 720 - 20 * r) for r in range(1, 4) for c, x in zip("abc", (72, 180, 300))]
    rows = [{"id": f"b{k}", "reading_order": k, "text": t, "x": float(x), "y": float(y), "font_size": 12.0, "role": "body", "run_ids": None, "numeric": False, "sentence": False, "labels": 0, "words": 1} for k, (t, x, y) in enumerate(cells)]
    (t,) = knowledge.page_tables(rows)
    assert t["heuristic"] == "layout-grid" and len(t["rows"]) == 3
    assert knowledge.commonest([2, 3, 3, 2]) == 3 and knowledge.commonest([]) == 0 and knowledge.commonest([4]) == 4


def test_gate_and_closure(spark):
    rows = [(k, bytearray(locked({"doc_id": k, "text": "one line"})), "user") for k in (2, 3)]
    table = spark.createDataFrame(rows, "doc_id bigint, content binary, password string")
    assert {r["doc_id"] for r in Corpus(table).runs().collect()} == {2, 3}
    strict = Corpus(table, Policy(permissions="enforce"))
    assert {r["doc_id"] for r in strict.runs().collect()} == {3} == {r["doc_id"] for r in strict.fragments().collect()}
    with pytest.raises(TypeError):
        Policy(permissions="no")
    assert strict.reachable([9]).groupBy("doc_id").count().collect()[0]["count"] == 1
    run = Corpus(table).runs().first()
    assert run["source_units"] == run["mapped_units"] == 8


def test_pruned():
    rows = [{"id": i, "parent_id": p, "page_number": n} for i, p, n in (("a", None, 1), ("b", "a", 2), ("c", "b", 3), ("d", "a", None), ("e", None, 1))]
    assert [r["id"] for r in corpora.pruned(rows, [3])] == ["a", "b", "c", "d"] and [r["id"] for r in corpora.pruned(rows, [1])] == ["a", "d", "e"]
