"""Regions of a page: the lines that stand in a table, and those that look like a form.

Finding rows and columns among the few lines of a page is greedy, so it is a kernel, page by page; what a
single text tells - numbers, sentences, labels - comes with the lines as Columns.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil
from statistics import fmean, median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.columns import STRETCH, offsets, unswept, values
from .layout import PAGE

# Tolerances in points and in font sizes, lengths in characters, confidences.
ROW, ROW_SIZES = 3.0, 0.38
BAND, BAND_SIZES, BAND_TEXT = 5.0, 0.9, 40
COLUMN, COLUMN_SIZES = 10.0, 1.5
SHORT_CELL, LONG_CELL, BODY_CELL, HEADER_CELL = 24, 36, 80, 100
ROW_STEP = 36.0
HEADER_LINE, HEADER_WORDS, HEADER_REACH = (8, 120), (3, 12), 20
LABEL_TEXT, VALUE_TEXT, FIELD_TEXT = 180, 96, 80
TABLE_SURE, FORM_SURE = (0.68, 0.015, 0.2, 0.93), (0.5, 0.045, 0.72)

REGIONS = "array<struct<kind:string,block_ids:array<string>,header_ids:array<string>,confidence:double>>"


def evidence(row: Column, *more: Column) -> Column:
    """What the kernels see of a line, and more; one struct, as withField() would tell the evidence anew for each field."""
    text = row["text"]
    own = [row[c].alias(c) for c in ("id", "text", "x", "y", "font_size")]
    return F.struct(*own, T.has_numbers(text).alias("numeric"), T.is_sentence(text).alias("sentence"), T.label_marks(text).cast("int").alias("labels"), F.size(T.words(text)).alias("words"), *more)


def size_of(line: dict) -> float:
    return line["font_size"] or 12.0


def visual_rows(lines: list[dict]) -> list[list[dict]]:
    """Placed lines as rows, top down, each from left to right: on one level, or short ones in one band."""
    rows: list[list[dict]] = []
    for b in sorted((b for b in lines if b["x"] is not None and b["y"] is not None), key=lambda b: (-b["y"], b["x"])):
        last = rows[-1] if rows else []
        level = bool(last) and abs(fmean(o["y"] for o in last) - b["y"]) <= max(ROW, ROW_SIZES * size_of(b))
        band = len(b["text"]) <= BAND_TEXT and any(len(o["text"]) <= BAND_TEXT and abs(o["y"] - b["y"]) <= max(BAND, BAND_SIZES * max(size_of(o), size_of(b))) for o in last)
        if level or band:
            last.append(b)
        else:
            rows.append([b])
    return [sorted(r, key=lambda b: b["x"]) for r in rows]


def is_grid(rows: list[list[dict]]) -> bool:
    """Two rows or more of several cells keep to the widest row's columns, and the cells are short or numeric."""
    many = [r for r in rows if len(r) > 1]
    if len(many) < 2:
        return False
    cells, widest = [b for r in many for b in r], max(many, key=len)
    numeric, n = sum(b["numeric"] for b in cells), len(cells)
    if not numeric and (len(widest) < 3 or sum(len(b["text"]) <= SHORT_CELL for b in cells) < ceil(0.8 * n)):
        return False
    if sum(len(b["text"]) > LONG_CELL for b in cells) >= ceil(0.3 * n) and (len(widest) < 3 or numeric < ceil(0.4 * n)):
        return False
    kept = lambda b: any(abs(b["x"] - o["x"]) <= max(COLUMN, COLUMN_SIZES * size_of(b)) for o in widest)
    return sum(all(map(kept, r)) for r in many) >= 2


def _grid(rows: list[list[dict]]):
    many = [r for r in rows if len(r) > 1]
    if not is_grid(rows):
        return None
    head, *body = [r for r in many if len(r) >= max(2, max(map(len, many)) - 1)]
    if not body:
        return None
    at = [fmean(b["y"] for b in r) for r in (head, *body)]
    close = median(abs(a - b) for a, b in zip(at, at[1:])) <= ROW_STEP
    compact = sum(all(len(b["text"]) <= BODY_CELL for b in r) for r in body)
    if any(b["numeric"] for r in body for b in r) or close and compact >= 2:
        return [b for r in (head, *body) for b in r], head
    return None


def _under_header(lines: list[dict], rows: list[list[dict]]):
    for head in rows:
        names = sum(not b["numeric"] for b in head)
        if len(head) < 2 or any(b["sentence"] or len(b["text"]) > HEADER_CELL for b in head) or names < ceil(0.6 * len(head)):
            continue
        floor, taken, seen = min(b["y"] for b in head) - 2, [], 0
        for b in sorted((b for b in lines if b["y"] is not None and b["y"] < floor), key=lambda b: (-b["y"], b["x"] or 0.0)):
            if b["sentence"] and seen >= 2:
                break
            cell = b["numeric"] or 0 < len(b["text"]) <= HEADER_CELL and not b["sentence"]
            if cell or taken and seen:
                taken.append(b)
                seen += b["numeric"]
        if seen >= 2:
            return head + taken, head
    return None


def _after_header(lines: list[dict]):
    for k, b in enumerate(lines):
        named = HEADER_LINE[0] <= len(b["text"]) <= HEADER_LINE[1] and HEADER_WORDS[0] <= b["words"] <= HEADER_WORDS[1]
        if named and not b["sentence"] and not b["numeric"]:
            data = [j for j in range(k + 1, min(len(lines), k + HEADER_REACH)) if lines[j]["numeric"]]
            if len(data) >= 2:
                return lines[k : data[-1] + 1], [b]
    return None


def table_lines(lines: list[dict]) -> tuple[list[dict], list[dict]]:
    """(all lines of the page's table, its header's), of lines in reading order; none if there is no table."""
    rows = visual_rows(lines)
    return _grid(rows) or _under_header(lines, rows) or _after_header(lines) or ([], [])


def form_lines(lines: list[dict], taken: set) -> tuple[list[dict], int]:
    """(lines of the page's form, how many are labels): labels, rows of short texts, and each label's nearest value."""
    free = [(k, b) for k, b in enumerate(lines) if b["id"] not in taken]
    labels = [(k, b) for k, b in free if b["labels"] > 0 and len(b["text"]) <= LABEL_TEXT]
    bands = [r for r in visual_rows([b for _, b in free]) if len(r) > 1 and all(0 < len(b["text"]) <= FIELD_TEXT and not b["numeric"] for b in r)]
    if len(labels) < 2 and len(bands) < 2:
        return [], 0
    chosen = {b["id"] for _, b in labels} | {b["id"] for r in bands for b in r}
    for at, label in labels:
        near = [b for k, b in free if b["id"] not in chosen and (_level(label, b) or k > at and _below(label, b))]
        if near:
            chosen.add(min(near, key=lambda b: abs(b["x"] - label["x"]) + abs(b["y"] - label["y"]))["id"])
    return [b for _, b in free if b["id"] in chosen], len(labels)


def _placed(*lines: dict) -> bool:
    return all(b["x"] is not None and b["y"] is not None for b in lines)


def _level(label: dict, b: dict) -> bool:
    return _placed(label, b) and abs(label["y"] - b["y"]) <= max(4.0, 0.5 * max(size_of(label), size_of(b)))


def _below(label: dict, b: dict) -> bool:
    size = max(size_of(label), size_of(b))
    fits = not b["labels"] and 0 < len(b["text"]) <= VALUE_TEXT and _placed(label, b)
    return fits and abs(label["x"] - b["x"]) <= max(12.0, size) and 0 < label["y"] - b["y"] <= max(40.0, 3.5 * size)


def page_regions(lines: list[dict]) -> list[dict]:
    """The table and the form of a page, if it has them.

    Of a text only its length and its evidence count, so pages that are alike in that and in their lines' places share one search.
    """
    ids = [b["id"] for b in lines]
    if len(set(ids)) < len(ids):
        return _search(lines)
    found = _shape(tuple([(b["x"], b["y"], b["font_size"], len(b["text"]), b["numeric"], b["sentence"], b["labels"], b["words"]) for b in lines]))
    return [{"kind": kind, "block_ids": [ids[k] for k in own], "header_ids": [ids[k] for k in head], "confidence": sure} for kind, own, head, sure in found]


@lru_cache(1024)
def _shape(lines: tuple) -> list[tuple]:
    """Regions of lines of which no more than this is known, by the lines' places in the tuple."""
    names = ("x", "y", "font_size", "text", "numeric", "sentence", "labels", "words")
    rows = [{"id": k} | dict(zip(names, (*line[:3], "x" * line[3], *line[4:]))) for k, line in enumerate(lines)]
    return [tuple(r.values()) for r in _search(rows)]


def _search(lines: list[dict]) -> list[dict]:
    out = []
    table, head = table_lines(lines)
    if table:
        base, each, more, most = TABLE_SURE
        out.append({"kind": "table", "block_ids": [b["id"] for b in table], "header_ids": [b["id"] for b in head], "confidence": min(most, base + min(more, each * len(table)))})
    form, labels = form_lines(lines, {b["id"] for b in table})
    if form:
        base, each, most = FORM_SURE
        out.append({"kind": "form-like", "block_ids": [b["id"] for b in form], "header_ids": [], "confidence": min(most, base + each * labels)})
    return out


def regions(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_number, id, kind, block_ids, header_ids, confidence[, run_ids]): at most a table and a form a page."""
    with_runs = "run_ids" in blocks.columns
    rows = F.array_sort(F.collect_list(F.struct("reading_order", "id", "text", "x", "y", "font_size", *(["run_ids"] if with_runs else []))))
    return regions_of(blocks.groupBy(*PAGE).agg(rows.alias("rows")), with_runs)


def regions_of(pages: DataFrame, with_runs: bool = False) -> DataFrame:
    """The same of pages whose lines, in reading order, are the structs of rows."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(REGIONS)
    def found(pages):
        import pyarrow as pa

        item = pa.struct([("kind", pa.string()), ("block_ids", pa.list_(pa.string())), ("header_ids", pa.list_(pa.string())), ("confidence", pa.float64())])
        made = []
        for k in range(0, len(pages), STRETCH):
            with unswept():
                of = [page_regions(p) for p in values(pages.slice(k, STRETCH))]
                each = [r for p in of for r in p]
            lists = [pa.ListArray.from_arrays(offsets([len(r[c]) for r in each]), pa.array([i for r in each for i in r[c]], pa.string())) for c in ("block_ids", "header_ids")]
            rows = pa.StructArray.from_arrays([pa.array([r["kind"] for r in each], pa.string()), *lists, pa.array([r["confidence"] for r in each], pa.float64())], fields=list(item))
            made.append(pa.ListArray.from_arrays(offsets([len(p) for p in of]), rows))
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(item))

    each = pages.withColumn("r", F.explode(found(F.transform("rows", lambda b: evidence(b)))))
    owned = F.filter("rows", lambda b: F.array_contains(F.col("r.block_ids"), b["id"]))
    runs = [F.array_distinct(F.flatten(F.transform(owned, lambda b: b["run_ids"]))).alias("run_ids")] if with_runs else []
    kind = F.when(F.col("r.kind") == "table", "region-table").otherwise("region-form")
    return each.select(*PAGE, F.concat_ws("-", kind, "page_number", F.col("r.block_ids")[0]).alias("id"), "r.kind", "r.block_ids", "r.header_ids", "r.confidence", *runs)
