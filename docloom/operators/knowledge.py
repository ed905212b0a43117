"""Knowledge: chunks, tables, forms, citations and Markdown from laid-out blocks."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.columns import offsets, stretches, unswept, values
from ..functions.numerals import stable_id_all
from .labels import label_form
from .layout import PAGE
from .regions import evidence, page_regions
from .sequences import compact_table, font_table, plain, stacked_table

TARGET = 420


def stable_ids(prefix: str, name, parts):
    """Ids from the given parts; an Arrow kernel, since they hash UTF-16 units."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def made(names, listed):
        import pyarrow as pa

        return pa.array(stable_id_all(prefix, [n or "" for n in names.to_pylist()], values(listed)), pa.string())

    return made(name, parts)


def chunk_numbers(blocks: DataFrame, target: int = TARGET) -> DataFrame:
    """blocks without headers and footers, and `chunk`, from 0 in each document.

    A heading or list item is a chunk of its own; body text of one page is gathered while it stays within
    the target. The sum starts anew at each cut, so it is a fold over a page's blocks, not a window. Where
    blocks have a `part` (see outside()), a chunk ends with it.
    """
    kept = blocks.where("role not in ('header', 'footer')")
    own = [c for c in blocks.columns if c not in (*PAGE, "reading_order")]
    rows = kept.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("reading_order", *own))).alias("rows"))
    part = lambda row: row["part"] if "part" in own else F.lit(0)
    start = F.struct(F.lit(-1).alias("chunk"), F.lit(0).alias("size"), F.lit("").alias("role"), F.lit(0).alias("part"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc, row):
        n = F.length(row["text"])
        alone = row["role"].isin("heading", "list") | acc["role"].isin("heading", "list")
        new = (acc["chunk"] < 0) | alone | (acc["size"] + n > target) | (acc["part"] != part(row))
        chunk = F.when(new, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(new, n).otherwise(acc["size"] + n).alias("size"), row["role"].alias("role"), part(row).alias("part"), F.array_append(acc["out"], chunk).alias("out"))

    numbers = F.aggregate("rows", start, step, lambda acc: acc["out"])
    each = rows.select(*PAGE, F.explode(F.arrays_zip(F.col("rows").alias("r"), numbers.alias("c"))).alias("z"))
    each = each.select(*PAGE, "z.r.reading_order", *(F.col(f"z.r.{c}").alias(c) for c in own), F.col("z.c").alias("chunk"))
    # Numbers go on from page to page: the rank of (page, number) in the document.
    return each.withColumn("chunk", (F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page_number", "chunk")) - 1).cast("int"))


def chunks(blocks: DataFrame, target: int = TARGET) -> DataFrame:
    """(doc_id, ord, id, text, role, page_number, at, block_ids, run_ids): role mixed where blocks differ, at the first block's place in its page's reading order."""
    rows = F.array_sort(F.collect_list(F.struct("reading_order", "id", "text", "role", "run_ids")))
    grouped = chunk_numbers(blocks, target).groupBy("doc_id", "page_number", "chunk").agg(rows.alias("rows"))
    kinds = F.array_distinct(F.col("rows.role"))
    out = grouped.select("doc_id", F.col("chunk").alias("ord"), F.array_join(F.col("rows.text"), "\n").alias("text"), F.when(F.size(kinds) == 1, kinds[0]).otherwise("mixed").alias("role"), "page_number", F.col("rows.reading_order")[0].cast("int").alias("at"), F.col("rows.id").alias("block_ids"), F.flatten(F.col("rows.run_ids")).alias("run_ids"))
    parts = F.concat(F.array("text", "role"), F.col("block_ids"))
    return out.withColumn("id", stable_ids("chunk", F.substring("text", 1, 80), parts))


def citations(chunk_table: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, owner_id, id, page_number, block_id, run_ids, text, start, end): each chunk's blocks, and where their text stands in it."""
    each = chunk_table.select("doc_id", F.col("id").alias("owner_id"), F.posexplode("block_ids").alias("at", "block_id"))
    joined = each.join(blocks.select("doc_id", "page_number", F.col("id").alias("block_id"), "text", "run_ids"), ["doc_id", "block_id"])
    # A chunk's text is its blocks' in turn, a character between: places are sums, the same text twice has two.
    before = Window.partitionBy("doc_id", "owner_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")).withColumn("end", F.col("start") + F.length("text"))
    parts = F.concat(F.array("owner_id", "block_id", "text"), F.col("run_ids"))
    return out.withColumn("id", stable_ids("citation", F.col("block_id"), parts)).select("doc_id", "owner_id", "id", "page_number", "block_id", "run_ids", "text", "start", "end")


def uncited(chunk_table: DataFrame, cited: DataFrame) -> DataFrame:
    """Chunks that no citation supports: none, if all is well."""
    return chunk_table.join(cited.select("doc_id", F.col("owner_id").alias("id")), ["doc_id", "id"], "left_anti")


# Tables


def grid_rows(rows: list[dict]) -> list[list[dict]]:
    """A page's blocks as visual rows, top down, each from left to right."""
    out: list[list[dict]] = []
    for b in sorted((b for b in rows if b["x"] is not None and b["y"] is not None), key=lambda b: (-b["y"], b["x"])):
        if out and abs(out[-1][0]["y"] - b["y"]) <= max(8.0, 0.9 * (b["font_size"] or 12.0)) * 0.75:
            out[-1].append(b)
        else:
            out.append([b])
    return [sorted(r, key=lambda b: b["x"]) for r in out]


def assign(xs: list[float], texts: list[str], columns: list[float], numeric: list[bool]) -> list[int] | None:
    """The cheapest order-keeping assignment of a row's blocks to columns: distance, and a penalty where kinds of text differ."""
    n, m = len(xs), len(columns)
    if n > m:
        return None
    cost = lambda i, j: abs(xs[i] - columns[j]) + ((40 if bool(re.search(r"\d", texts[i])) != numeric[j] else 0) if numeric[j] is not None else 0)
    best = [[0.0] * (m + 1)] + [[float("inf")] * (m + 1) for _ in range(n)]
    took = [[False] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(i, m + 1):
            use, skip = best[i - 1][j - 1] + cost(i - 1, j - 1), best[i][j - 1]
            best[i][j], took[i][j] = (use, True) if use <= skip else (skip, False)
    out, i, j = [], n, m
    while i:
        if took[i][j]:
            out.append(j - 1)
            i -= 1
        j -= 1
    return out[::-1]


def grid_tables(rows: list[dict]) -> list[dict]:
    """Tables of a page: a header row of three or more short texts over at least two rows that fit its columns.

    Of a text only its length counts and whether it begins with a digit, so pages that are alike in that and in their
    blocks' places share one search.
    """
    found = _grids(tuple([(b["x"], b["y"], b["font_size"], len(b["text"]), b["text"][:1].isdecimal()) for b in rows]))
    return [{"heuristic": "layout-grid", "headers": [rows[k]["text"] for k in head], "rows": [[(p, rows[k]) for p, k in r] for r in body], "blocks": [rows[k]["id"] for k in head] + [rows[k]["id"] for r in body for _, k in r], "confidence": sure} for head, body, sure in found]


@lru_cache(1024)
def _grids(blocks: tuple) -> list[tuple]:
    """(header, rows of (column, block), confidence) of blocks of which no more than this is known, by their places in the tuple."""
    out, k = [], 0
    lines = grid_rows([{"id": i, "x": x, "y": y, "font_size": size, "text": "0" * digit + "x" * (n - digit)} for i, (x, y, size, n, digit) in enumerate(blocks)])
    while k < len(lines):
        head = lines[k]
        fit = len(head) >= 3 and head[-1]["x"] - head[0]["x"] >= 60 and all(len(b["text"]) <= 48 and b["text"][:1] != "0" for b in head)
        body = []
        if fit:
            columns = [b["x"] for b in head]
            for line in lines[k + 1 :]:
                places = assign([b["x"] for b in line], [b["text"] for b in line], columns, [None] * len(columns))
                if places is None or len(line) < 2 or max(abs(b["x"] - columns[p]) for b, p in zip(line, places)) > 36:
                    break
                body.append([(p, b["id"]) for p, b in zip(places, line)])
        if fit and len(body) >= 2:
            out.append(([b["id"] for b in head], body, min(0.93, 0.68 + min(0.2, 0.015 * sum(map(len, body))))))
            k += 1 + len(body)
            continue
        k += 1
    return out


def commonest(counts: list[int]) -> int:
    """The commonest of counts, the larger of equals; 0 of none."""
    return max(set(counts), key=lambda n: (counts.count(n), n), default=0)


def bar_table(rows: list[dict]) -> dict | None:
    """Lines parted by bars, of which those with the commonest number of cells are rows."""
    barred = [b for b in sorted(rows, key=lambda b: b["reading_order"]) if b["text"].count("|") >= 2]
    if len(barred) < 2:
        return None
    parted = [(b, [c.strip() for c in b["text"].strip("| ").split("|")]) for b in barred]
    n = commonest([len(cells) for _, cells in parted])
    parted = [(b, cells) for b, cells in parted if len(cells) == n]
    if len(parted) < 2:
        return None
    return {"heuristic": "text-rows", "headers": parted[0][1], "rows": [[(j, {**b, "text": c}) for j, c in enumerate(cells)] for b, cells in parted[1:]], "blocks": [b["id"] for b, _ in parted], "confidence": 0.8}


def page_tables(rows: list[dict], runs: list[dict] | None = None) -> list[dict]:
    """A page's tables: those inside its regions, then grids, bars, and sequences of runs, then a form of labels.

    Of two that share a block the first stays, but a grid gives way to a larger one under the same headers.
    """
    rows = sorted(rows, key=lambda b: b["reading_order"])
    owner = {i: b for b in rows for i in b["run_ids"] or ()}
    runs = sorted((r for r in runs or () if plain(r["text"])), key=lambda r: r["content_order"])
    kept: list[dict] = []

    def offer(t: dict | None) -> None:
        if t is None:
            return
        for k, o in enumerate(kept):
            if set(o["blocks"]) & set(t["blocks"]):
                grids = o["heuristic"] == t["heuristic"] == "layout-grid" and [h.lower() for h in o["headers"]] == [h.lower() for h in t["headers"]]
                if grids and sum(map(len, t["rows"])) > sum(map(len, o["rows"])):
                    kept[k] = t
                return
        kept.append(t)

    for region in page_regions(rows):
        ids = set(region["block_ids"])
        own = [b for b in rows if b["id"] in ids]
        if region["kind"] == "table":
            for t in (*grid_tables(own), bar_table(own)):
                offer(t)
        else:
            offer(label_form(own, runs, {i: b for i, b in owner.items() if b["id"] in ids}))
    for t in (*grid_tables(rows), bar_table(rows), compact_table(runs, owner) or font_table(runs, owner), stacked_table(runs, owner), label_form(rows, runs, owner)):
        offer(t)
    return kept


RUN = "struct<id:string,text:string,font_size:double,content_order:int>"
SOURCE = "struct<text:string,run_ids:array<string>>"
CELL = "struct<row_index:int,col_index:int,text:string,block_id:string,run_id:string>"
TABLE = f"doc_id bigint, page_number int, id string, at int, heuristic string, headers array<string>, block_ids array<string>, confidence double, cells array<{CELL}>"


def tables(blocks: DataFrame, runs: DataFrame | None = None, sources: bool = False) -> DataFrame:
    """(doc_id, page_number, id, at, heuristic, headers, block_ids, confidence, cells[, sources]): the tables found on each page, at the place of their first block.

    With the runs the blocks were made of, tables that only the order of runs tells are found too; blocks and runs
    of a page meet in one shuffle. Blocks that hold their own runs (lines(keep=True)) need none. sources: the text
    and runs of each cell's block.
    """
    for name, kind in (("role", "string"), ("run_ids", "array<string>")):
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(None).cast(kind))
    own = F.struct("reading_order", "id", "text", "x", "y", "font_size", "role", "run_ids")
    if runs is None:
        held = F.flatten(F.collect_list("runs")) if "runs" in blocks.columns else F.expr(f"cast(array() as array<{RUN}>)")
        packed = blocks.groupBy(*PAGE).agg(F.collect_list(own).alias("rows"), held.alias("runs"))
        packed = packed.withColumn("rows", F.filter("rows", lambda b: b["text"] != "")) if "runs" in blocks.columns else packed
    else:
        told = runs.select(*PAGE, F.struct("id", "text", "font_size", "content_order").alias("run"))
        both = blocks.select(*PAGE, own.alias("block")).unionByName(told, allowMissingColumns=True)
        packed = both.groupBy(*PAGE).agg(F.collect_list("block").alias("rows"), F.collect_list("run").alias("runs"))
    return tables_of(packed, sources)


def tables_of(pages: DataFrame, sources: bool = False) -> DataFrame:
    """The same of pages whose blocks are the structs of rows, and whose runs, if there are any, those of runs."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    names = [f.name for f in pages.schema["rows"].dataType.elementType.fields]

    # Lists inside are empty, not null: for each row Spark asks Arrow for its batch's size, and Arrow walks over all null lists again.
    nothing = F.expr("cast(array() as array<string>)")

    def seen(b):
        role = b["role"] if "role" in names else F.lit(None).cast("string")
        runs = F.coalesce(b["run_ids"], nothing) if "run_ids" in names else nothing
        return evidence(b, b["reading_order"].alias("reading_order"), role.alias("role"), runs.alias("run_ids"))

    told = F.col("runs") if "runs" in pages.columns else F.expr(f"cast(array() as array<{RUN}>)")
    packed = pages.select(*PAGE, F.transform("rows", seen).alias("rows"), told.alias("runs"))
    schema = TABLE + f", sources array<{SOURCE}>" * sources
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for part in stretches(batch):
                with unswept():
                    made = _packed_tables(part, arrow)
                yield made

    return packed.mapInArrow(run, schema)


def _packed_tables(pages, arrow):
    """The tables of some pages as a batch, built by columns."""
    import pyarrow as pa

    found, cells, origins = [], [], []
    for doc_id, page, rows, told in zip(*(values(pages.column(c)) for c in ("doc_id", "page_number", "rows", "runs"))):
        of = {b["id"]: b for b in rows}
        for t in page_tables(rows, told):
            found.append((doc_id, page, t, min((of[i]["reading_order"] for i in t["blocks"]), default=0), len(cells)))
            for i, r in enumerate(t["rows"]):
                for j, b in r:
                    cells.append((i, j, b["text"], b["id"], b.get("run")))
                    origins.append(of.get(b["id"]))
    made = [t for _, _, t, _, _ in found]
    ends = [f[4] for f in found[1:]] + [len(cells)]
    sizes = [b - f[4] for f, b in zip(found, ends)]
    texts = [c[2] for c in cells]
    ids = stable_id_all("table", [" ".join(t["headers"]) for t in made], [[t["heuristic"], *t["headers"], *t["blocks"], *texts[f[4] : b]] for t, f, b in zip(made, found, ends)])
    lists = lambda rows, kind: pa.ListArray.from_arrays(offsets([len(r) for r in rows]), pa.array([v for r in rows for v in r], kind))

    def structs(name, columns):
        item = arrow.field(name).type.value_type
        whole = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, item)]
        return pa.ListArray.from_arrays(offsets(sizes), pa.StructArray.from_arrays(whole, fields=list(item)))

    columns = {
        "doc_id": [f[0] for f in found], "page_number": [f[1] for f in found], "id": ids, "at": [f[3] for f in found], "heuristic": [t["heuristic"] for t in made],
        "headers": lists([t["headers"] for t in made], pa.string()), "block_ids": lists([t["blocks"] for t in made], pa.string()), "confidence": [t["confidence"] for t in made],
        "cells": structs("cells", list(zip(*cells)) or [()] * 5),
    }
    if "sources" in arrow.names:
        columns["sources"] = structs("sources", [[b and b["text"] for b in origins], [b and b["run_ids"] for b in origins]])
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in arrow], names=arrow.names)


def cell_citations(table_rows: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_number, table_id, row_index, col_index, id, block_id, run_ids, text, start, end): where each cell's text stands in its block.

    The cell's own text if the block holds it, else the block's or its first line that the cell holds; cells of which
    neither is true have no row. Tables with sources need no blocks, and no join.
    """
    own = ("c.row_index", "c.col_index", F.col("c.text").alias("cell"), "c.block_id", "c.run_id")
    if blocks is None:
        each = table_rows.select(*PAGE, F.col("id").alias("table_id"), F.explode(F.arrays_zip(F.col("cells").alias("c"), F.col("sources").alias("s"))).alias("z"))
        joined = each.select(*PAGE, "table_id", F.col("z.c").alias("c"), F.col("z.s").alias("s")).select(*PAGE, "table_id", *own, F.col("s.text").alias("whole"), "s.run_ids")
    else:
        cells = table_rows.select(*PAGE, F.col("id").alias("table_id"), F.explode("cells").alias("c")).select(*PAGE, "table_id", *own)
        joined = cells.join(blocks.select(*PAGE, F.col("id").alias("block_id"), F.col("text").alias("whole"), "run_ids"), [*PAGE, "block_id"])
    line = F.filter(F.split("whole", "\n"), lambda t: (t != "") & F.contains(F.col("cell"), t))
    said = F.when(F.contains("whole", F.col("cell")), F.col("cell")).when(F.contains("cell", F.col("whole")), F.col("whole")).otherwise(F.try_element_at(line, F.lit(1)))
    rows = joined.withColumn("text", said).where("text <> ''")
    rows = rows.withColumn("start", F.expr("locate(text, whole)") - 1).withColumn("end", F.col("start") + F.length("text"))
    rows = rows.withColumn("run_ids", F.when(F.col("run_id").isNull(), F.col("run_ids")).otherwise(F.filter("run_ids", lambda r: r == F.col("run_id"))))
    parts = F.concat(F.array(F.lit("table-cell"), "table_id", F.col("row_index").cast("string"), F.col("col_index").cast("string"), "text", "block_id"), F.coalesce("run_ids", F.expr("cast(array() as array<string>)")))
    return rows.withColumn("id", stable_ids("citation", F.col("block_id"), parts)).select(*PAGE, "table_id", "row_index", "col_index", "id", "block_id", "run_ids", "text", "start", "end")


def projection(chunk_table: DataFrame, table_rows: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_number, at, ord, part, kind, text, items, rows, owner_id): headings, paragraphs, lists and tables in reading order.

    A chunk whose lines all have as many cells between bars is a table; what follows a heading's first line is a paragraph.
    """
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), T.normal), lambda t: t != "")
    cells = F.filter(F.transform(F.col("_lines"), lambda t: F.filter(F.transform(F.split(t, r"\|"), T.normal), lambda c: c != "")), lambda c: F.size(c) > 0)
    strings, nothing = "cast(null as array<string>)", "cast(null as array<array<string>>)"
    node = lambda kind, text=None, items=None, rows=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if text is None else text).alias("text"), (F.expr(strings) if items is None else items).alias("items"), (F.expr(nothing) if rows is None else rows).alias("rows"))
    widths = F.transform("_cells", lambda c: F.size(c))
    literal = (F.size("_cells") >= 2) & (F.array_min(widths) >= 2) & (F.array_min(widths) == F.array_max(widths))
    head, rest = F.col("_lines")[0], F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(1)))
    listed = F.filter(F.transform("_lines", lambda t: F.trim(F.regexp_replace(t, r"^[-*]\s*", ""))), lambda t: t != "")
    whole = F.array_join("_lines", "\n")
    nodes = (
        F.when(literal, F.array(node("table", rows=F.col("_cells"))))
        .when((F.col("role") == "heading") & (F.size("_lines") > 1), F.array(node("heading", head), node("paragraph", F.array_join(rest, "\n"))))
        .when(F.col("role") == "heading", F.array(node("heading", head)))
        .when(F.col("role") == "list", F.array(node("list", items=listed)))
        .otherwise(F.array(node("paragraph", whole)))
    )
    rows = chunk_table.withColumn("_lines", lines).where("size(_lines) > 0").withColumn("_cells", cells)
    out = rows.select("doc_id", "page_number", "at", "ord", F.col("id").alias("owner_id"), F.posexplode(nodes).alias("part", "n"))
    out = out.select("doc_id", "page_number", "at", "ord", "part", "n.kind", "n.text", "n.items", "n.rows", "owner_id")
    if table_rows is None:
        return out
    numbers = F.array_sort(F.array_distinct(F.transform("cells", lambda c: c["row_index"])))
    body = F.transform(numbers, lambda i: F.filter(F.transform(F.filter("cells", lambda c: c["row_index"] == i), lambda c: T.normal(c["text"])), lambda t: t != ""))
    found = table_rows.withColumn("rows", F.filter(F.concat(F.array("headers"), body), lambda r: F.size(r) > 0)).where("size(rows) > 0")
    return out.unionByName(found.select("doc_id", "page_number", "at", F.lit(-1).alias("ord"), F.lit(0).alias("part"), F.lit("table").alias("kind"), F.lit(None).cast("string").alias("text"), F.expr(strings).alias("items"), "rows", F.col("id").alias("owner_id")))


def best_tables(candidates: DataFrame) -> DataFrame:
    """Of candidates (doc_id, page_number, signature, n_headers, n_cells, confidence, seen) the best of each signature: more headers, more cells, surer, seen first."""
    order = Window.partitionBy(*PAGE, "signature").orderBy(F.desc("n_headers"), F.desc("n_cells"), F.desc("confidence"), "seen")
    return candidates.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def fields(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_number, form_id, id, name, value, block_id): `name: value` lines with one colon, on pages with at least two, and labels over values."""
    order = Window.partitionBy(*PAGE).orderBy("reading_order")
    inline = (T.label_marks(F.col("text")) == 1) & F.col("text").rlike(r"^[^:]{1,48}:\s*\S") & ~F.col("text").rlike(r"^[a-z][a-z0-9+.-]*://") & ~T.is_sentence(F.col("text"))
    label = F.col("text").rlike(r"^[^:]{1,48}:$")
    after, x, y = F.lead("text").over(order), F.lead("x").over(order), F.lead("y").over(order)
    below = label & (T.label_marks(after) == 0) & (F.abs(x - F.col("x")) <= 12) & (F.col("y") - y).between(0.001, 40)
    rows = blocks.withColumn("_value", F.when(inline, F.trim(F.regexp_extract("text", r"^[^:]*:\s*(.*)$", 1))).when(below, after)).where("_value is not null")
    rows = rows.withColumn("name", F.trim(F.regexp_extract("text", r"^([^:]*):", 1)))
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*PAGE))).where("_n >= 2")
    form = F.concat_ws("-", F.lit("region-form"), F.col("page_number"), F.first("id").over(Window.partitionBy(*PAGE).orderBy("reading_order")))
    return rows.withColumn("form_id", form).withColumn("block_id", F.col("id")).withColumn("id", stable_ids("field", F.col("name"), F.array("block_id", "name", "_value"))).select("doc_id", "page_number", "form_id", "id", "name", F.col("_value").alias("value"), "block_id")


def outside(blocks: DataFrame, table_rows: DataFrame) -> DataFrame:
    """The blocks that no table owns - their text is said by the table -, and `part`: how many owned ones stand before on the page. No chunk crosses a table."""
    owned = table_rows.select(*PAGE, F.explode("block_ids").alias("id"), F.lit(1).alias("owned")).distinct()
    before = Window.partitionBy(*PAGE).orderBy("reading_order")
    rows = blocks.join(owned, [*PAGE, "id"], "left").withColumn("part", F.count("owned").over(before).cast("int"))
    return rows.where("owned is null").drop("owned")


def markdown(chunk_table: DataFrame, table_rows: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown): headings as `## `, lists as `- `, tables of bars, in order; what bars and backslashes mean is escaped.

    With tables the chunks are those of outside(); both stand where their first blocks do.
    """
    line = T.escape_markdown(F.regexp_replace("text", "\n", " "))
    bare = F.regexp_replace(line, T.LIST, "")
    shown = F.when(F.col("role") == "heading", F.concat(F.lit("## "), line)).when(F.col("role") == "list", F.concat(F.lit("- "), bare)).otherwise(line)
    rows = chunk_table.select("doc_id", "page_number", "at", "ord", shown.alias("md"))
    if table_rows is not None:
        rows = rows.unionByName(table_rows.select("doc_id", "page_number", "at", F.lit(-1).alias("ord"), table_markdown("headers", "cells").alias("md")))
    packed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "at", "ord", "md"))).alias("rows"))
    return packed.select("doc_id", F.array_join(F.col("rows.md"), "\n\n").alias("markdown"))


def table_markdown(headers, cells):
    """A header line, a rule, and a line for each row; cells that are missing are empty."""
    bar = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
    head = F.transform(headers, T.escape_markdown)
    rule = F.transform(headers, lambda h: F.lit("---"))
    numbers = F.sequence(F.lit(0), F.coalesce(F.array_max(F.transform(cells, lambda c: c["row_index"])), F.lit(0)))
    columns = F.sequence(F.lit(0), F.size(headers) - 1)

    def row(i):
        return bar(F.transform(columns, lambda j: T.escape_markdown(F.coalesce(F.array_join(F.transform(F.filter(cells, lambda c: (c["row_index"] == i) & (c["col_index"] == j)), lambda c: c["text"]), " "), F.lit("")))))

    return F.concat_ws("\n", bar(head), bar(rule), F.array_join(F.transform(numbers, row), "\n"))
