"""Layout: runs to lines, reading order, roles and paragraphs.

Lines, roles and paragraphs are windows over (doc_id, page_number); only reading order, a greedy search for
columns, is a kernel, page by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.columns import STRETCH, offsets, unswept, values

PAGE = ("doc_id", "page_number")

# A sentence's end before another sentence, and abbreviations that end no sentence; what is known to be heuristic.
TAIL = r"(?s)^(.{2,24}?[.!?])\s+([\p{Lu}\p{Lt}].+)$"
ABBREVIATED = r"(?i)(?:^|\s)(?:Dr|Mr|Mrs|Ms|Prof|Sr|Jr|St|No|Fig|Eq|Sec|Ch|vs|e\.g|i\.e)\.$"
TAIL_WORDS, TAIL_GAP, TAIL_SIZES = 3, 48.0, 4.2
LAYOUT_LIMITS = ("layout-block-heuristic", "layout-role-heuristic", "layout-reading-order-heuristic", "layout-region-heuristic")
KNOWLEDGE_LIMITS = ("knowledge-chunk-heuristic", "knowledge-markdown-heuristic", "table-projection-heuristic")


def by_page(*order):
    return Window.partitionBy(*PAGE).orderBy(*order)


def page_modes(runs: DataFrame) -> DataFrame:
    """(doc_id, page_number, vertical): all runs that have a mode are vertical, and most have one."""
    known = F.count("writing_mode")
    return runs.groupBy(*PAGE).agg(((known >= F.ceil(F.count("*") * 0.6)) & F.coalesce(F.bool_and(F.col("writing_mode") == "vertical"), F.lit(False))).alias("vertical"))


def with_lines(runs: DataFrame) -> DataFrame:
    """runs and `line`, the number of the visual line on its page, from 1."""
    order = by_page("content_order")
    whole = Window.partitionBy(*PAGE)
    text = T.normal(F.col("text"))
    known = F.count("writing_mode").over(whole)
    vertical = (known >= F.ceil(F.count("*").over(whole) * 0.6)) & F.coalesce(F.bool_and(F.col("writing_mode") == "vertical").over(whole), F.lit(False))
    back = lambda c: F.lag(c).over(order)
    size = F.greatest(F.coalesce(back("font_size"), F.lit(12.0)), F.coalesce("font_size", F.lit(12.0)))
    x, y, px, py, before = F.col("x"), F.col("y"), back("x"), back("y"), back(text)
    right = px + F.length(before) * size * 0.45
    across = (F.abs(py - y) > F.greatest(F.lit(2.5), size * 0.3)) | (x < px - F.greatest(F.lit(4.0), size * 0.4)) | T.is_short_tail(before) & T.begins_sentence(text) | (x - right > F.greatest(F.lit(20.0), size * 2))
    down = (F.abs(px - x) > F.greatest(F.lit(3.0), size * 0.4)) | (y > py + F.greatest(F.lit(4.0), size * 0.5)) | F.col("starts_new_line")
    placed = F.when(x.isNull() | px.isNull() | y.isNull() | py.isNull(), F.coalesce("starts_new_line", F.lit(False))).when(vertical, down).otherwise(across)
    new = F.when(F.row_number().over(order) == 1, True).otherwise(F.coalesce(placed, F.lit(False)))
    marked = runs.withColumn("_new", new.cast("int")).withColumn("_vertical", vertical)
    return marked.withColumn("line", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def lines(runs: DataFrame, keep: bool = False) -> DataFrame:
    """(doc_id, page_number, id, line, text, run_ids, x, y, font_size, vertical[, runs]): one row a line; the commonest font size, the larger of equals.

    keep: lines hold their runs as they came, and those without text stay, with an empty one.
    """
    raw = [F.col("text").alias("raw")] if keep else []
    rows = F.array_sort(F.collect_list(F.struct("content_order", "id", T.normal(F.col("text")).alias("text"), "x", "y", "font_size", *raw)))
    grouped = with_lines(runs).groupBy(*PAGE, "line").agg(rows.alias("rows"), F.first("_vertical").alias("vertical"))
    sizes = F.filter(F.col("rows.font_size"), lambda s: s.isNotNull())
    counts = F.transform(F.array_distinct(sizes), lambda s: F.struct(F.size(F.filter(sizes, lambda o: o == s)).alias("n"), s.alias("size")))
    out = grouped.select(*PAGE, F.concat_ws("-", F.lit("block"), "page_number", "line").alias("id"), "line", T.joined(F.col("rows.text")).alias("text"), F.col("rows.id").alias("run_ids"), F.col("rows")[0]["x"].alias("x"), F.col("rows")[0]["y"].alias("y"), F.array_max(counts)["size"].alias("font_size"), "vertical", *(["rows"] if keep else []))
    if keep:
        held = F.transform("rows", lambda r: F.struct(r["id"].alias("id"), r["raw"].alias("text"), r["font_size"].alias("font_size"), r["content_order"].alias("content_order")))
        return out.withColumn("runs", held).drop("rows")
    return out.where("text <> ''")


def page_order(xs: list, ys: list, sizes: list, texts: list, vertical: bool) -> list[int]:
    """Places of a page's lines in reading order: by columns where white gaps part them, else by lines, else as they came."""
    n = len(xs)
    placed = [i for i in range(n) if xs[i] is not None and ys[i] is not None]
    if n < 2 or len(placed) < max(2, -(-6 * n // 10)):
        return list(range(n))
    if vertical:
        return sorted(range(n), key=lambda i: (-(xs[i] if xs[i] is not None else 0), -(ys[i] if ys[i] is not None else 0)))
    size = sorted((sizes[i] or 12.0) for i in placed)[len(placed) // 2]
    # Starts that many lines share and that a wide gap parts are columns, if both sides run down the page.
    starts: list[list[float]] = []
    for x in sorted(xs[i] for i in placed):
        if starts and x - starts[-1][-1] <= max(24.0, 2 * size):
            starts[-1].append(x)
        else:
            starts.append([x])
    wide = [s for s in starts if len(s) >= max(2, len(placed) // (4 * len(starts)))]
    column = {}
    if len(wide) > 1 and len(wide) <= 4:
        edges = [s[0] for s in wide]
        for i in placed:
            column[i] = max((k for k, e in enumerate(edges) if xs[i] >= e - 1e-6), default=0)
        tall = [[ys[i] for i in placed if column[i] == k] for k in range(len(edges))]
        overlap = min(map(max, tall)) - max(map(min, tall)) > 0
        rights = [max(xs[i] + len(texts[i]) * (sizes[i] or 12.0) * 0.45 for i in placed if column[i] == k) for k in range(len(edges) - 1)]
        if not overlap or any(r > e + 2 * size for r, e in zip(rights, edges[1:])) or _rows_match(tall, size):
            column = {}
    row = {}
    last = None
    for i in sorted(placed, key=lambda i: -ys[i]):
        if last is None or abs(ys[last] - ys[i]) > max(4.0, min(9.0, 1.2 * min(sizes[last] or 12.0, sizes[i] or 12.0))):
            last = i
        row[i] = -ys[last]
    return sorted(range(n), key=lambda i: (column.get(i, 0), row.get(i, float("inf")), xs[i] if xs[i] is not None else 0.0, i))


def _rows_match(tall: list[list[float]], size: float) -> bool:
    """Columns whose lines stand side by side in short rows are a grid, read row by row."""
    if len(tall) < 3:
        return False
    level = [sum(any(abs(y - o) <= 0.4 * size for o in other) for y in tall[0]) for other in tall[1:]]
    return all(m >= 0.4 * len(tall[0]) for m in level)


def page_places(rows):
    """Of each page of an Arrow array the places of its lines in reading order, and their parts of its table; a stretch of pages at a time is Python's."""
    import pyarrow as pa

    from .regions import table_lines

    made = []
    for k in range(0, len(rows), STRETCH):
        orders, parts = [], []
        with unswept():
            pages = values(rows.slice(k, STRETCH))
        for page in pages:
            order = page_order([r["x"] for r in page], [r["y"] for r in page], [r["font_size"] for r in page], [r["text"] for r in page], bool(page[0]["vertical"]))
            table, head = table_lines([page[i] for i in order])
            of = {b["id"]: "body" for b in table} | {b["id"]: "header" for b in head}
            orders.append(order)
            parts += [of.get(page[i]["id"]) for i in order]
        each = pa.StructArray.from_arrays([pa.array([i for o in orders for i in o], pa.int32()), pa.array(parts, pa.string())], names=["at", "part"])
        made.append(pa.ListArray.from_arrays(offsets([len(o) for o in orders]), each))
    return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.struct([("at", pa.int32()), ("part", pa.string())])))


def ordered(table: DataFrame) -> DataFrame:
    """lines, reading_order, from 0 on each page, and table_part: header or body of the page's table."""
    from pyspark.sql.functions import arrow_udf

    from .regions import evidence

    @arrow_udf("array<struct<at:int,part:string>>")
    def places(rows):
        return page_places(rows)

    own = [c for c in table.columns if c not in PAGE]
    packed = table.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line", *(c for c in own if c != "line")))).alias("rows"))
    seen = F.transform("rows", lambda r: evidence(r, r["vertical"].alias("vertical")))
    packed = packed.withColumn("order", places(seen))
    each = packed.select(*PAGE, F.posexplode(F.transform("order", lambda o: F.struct(F.element_at("rows", o["at"] + 1).alias("r"), o["part"].alias("part")))).alias("reading_order", "z"))
    return each.select(*PAGE, *(F.col(f"z.r.{c}").alias(c) for c in own), "reading_order", F.col("z.part").alias("table_part"))


def split_tails(table: DataFrame) -> DataFrame:
    """Ordered lines, of which those that begin with the end of the line before are two; tail_part: tail or body of such a line, else null.

    What a line is compared with is the line before or that line's body half: they have one place and one end, so
    a window does.
    """
    order = by_page("reading_order")
    back = lambda c: F.lag(c).over(order)
    size = F.greatest(F.coalesce(back("font_size"), F.lit(12.0)), F.coalesce("font_size", F.lit(12.0)))
    column = F.coalesce(F.abs(back("x") - F.col("x")) <= F.greatest(F.lit(18.0), size * 1.6), F.lit(True))
    near = F.coalesce(F.abs(back("y") - F.col("y")), F.lit(0.0)) <= F.greatest(F.lit(TAIL_GAP), F.coalesce("font_size", F.lit(12.0)) * TAIL_SIZES)
    tail, body = F.trim(F.regexp_extract("text", TAIL, 1)), F.trim(F.regexp_extract("text", TAIL, 2))
    fit = ~F.coalesce("vertical", F.lit(False)) & (tail != "") & (F.size(F.split(tail, r"\s+")) <= TAIL_WORDS) & ~tail.rlike(ABBREVIATED) & back("text").isNotNull() & ~T.ends_sentence(back("text")) & column & near
    rows = table.withColumn("_fit", F.coalesce(fit, F.lit(False)))
    half = lambda part, text: F.struct(F.concat_ws("-", "id", F.lit(part)).alias("id"), text.alias("text"), F.lit(part).alias("tail_part"))
    whole = F.struct("id", "text", F.lit(None).cast("string").alias("tail_part"))
    each = rows.select("*", F.posexplode(F.when(F.col("_fit"), F.array(half("tail", tail), half("body", body))).otherwise(F.array(whole))).alias("_part", "_half"))
    places = F.row_number().over(by_page("reading_order", "_part")) - 1
    own = [F.col(f"_half.{c}").alias(c) if c in ("id", "text") else F.col(c) for c in table.columns if c != "reading_order"]
    return each.select(*own, F.col("_half.tail_part").alias("tail_part"), places.alias("reading_order"))


def run_blocks(table: DataFrame) -> DataFrame:
    """(doc_id, page_number, run_id, block_id): the block of each run, the last in reading order where several list it."""
    each = table.select(*PAGE, F.explode("run_ids").alias("run_id"), "reading_order", "id")
    return each.groupBy(*PAGE, "run_id").agg(F.max_by("id", "reading_order").alias("block_id"))


def decode_gaps(runs: DataFrame) -> DataFrame:
    """(doc_id, page_number, decode_gap): a run of the page lost most of its text, or several lost more than a little. From complete, source_units and mapped_units."""
    units, mapped = F.coalesce("source_units", F.lit(0)), F.coalesce("mapped_units", F.lit(0))
    lost, share = units - mapped, mapped / units
    none = (mapped == 0) | (units == 0)
    slight = (lost == 1) & (mapped >= 8) | (lost <= 2) & (mapped >= 24)
    material = none | (lost > 0) & ~slight & ((mapped < 4) | (share < 0.9))
    severe = none | (lost > 0) & ((lost >= 2) & (mapped < 8) | (share < 0.7))
    gap = ~F.coalesce("complete", F.lit(True)) & material
    return runs.groupBy(*PAGE).agg((F.coalesce(F.bool_or(gap & severe), F.lit(False)) | (F.count_if(gap) > 1)).alias("decode_gap"))


def known_limits(runs: DataFrame, stage: str = "knowledge") -> DataFrame:
    """(doc_id, known_limits): what a document's layout or knowledge cannot promise; knowledge's are sorted."""
    if stage not in ("layout", "knowledge"):
        raise TypeError("a stage is layout or knowledge")
    gaps = decode_gaps(runs).groupBy("doc_id").agg(F.bool_or("decode_gap").alias("gap"))
    seen = F.when(F.col("gap"), F.array(F.lit("native-text-unicode-mapping-incomplete"))).otherwise(F.expr("cast(array() as array<string>)"))
    more = LAYOUT_LIMITS + (KNOWLEDGE_LIMITS if stage == "knowledge" else ())
    both = F.array_distinct(F.concat(seen, F.array(*map(F.lit, more))))
    return gaps.select("doc_id", (F.array_sort(both) if stage == "knowledge" else both).alias("known_limits"))


def repeated_keys(table: DataFrame) -> DataFrame:
    """(doc_id, key): what stands among the first or last two lines of at least two pages, digits apart."""
    at = F.row_number().over(by_page("reading_order"))
    n = F.count("*").over(Window.partitionBy(*PAGE))
    edge = table.withColumn("_at", at).withColumn("_n", n).where("_at <= 2 or _at > _n - 2").select(*PAGE, T.boundary_key(F.col("text")).alias("key")).where("key is not null")
    return edge.groupBy("doc_id", "key").agg(F.count_distinct("page_number").alias("pages")).where("pages >= 2").select("doc_id", "key")


def body_font_sizes(table: DataFrame) -> DataFrame:
    """(doc_id, page_number, body_font_size): the median over the longer half of a page's lines."""
    rank = F.row_number().over(by_page(F.desc(F.length("text")), "reading_order"))
    n = F.count("*").over(Window.partitionBy(*PAGE))
    longer = table.where("font_size is not null").withColumn("_rank", rank).withColumn("_n", n).where(F.col("_rank") <= F.greatest(F.lit(1), F.ceil(F.col("_n") / 2)))
    return longer.groupBy(*PAGE).agg(F.median("font_size").alias("body_font_size"))


def _bands(table: DataFrame) -> DataFrame:
    """table and `band`: header or footer for lines beyond the first wide gap near a page's edge, in no more than body size."""
    fit = F.col("x").isNotNull() & F.col("y").isNotNull()
    down = by_page(F.desc_nulls_last(F.when(fit, F.col("y"))), "reading_order")
    whole = Window.partitionBy(*PAGE)
    out = table.withColumn("_at", F.row_number().over(down)).withColumn("_n", F.count_if(fit).over(whole)).withColumn("_size", F.coalesce(F.median(F.when(fit, F.col("font_size"))).over(whole), F.lit(12.0)))
    out = out.withColumn("_gap", F.coalesce(fit & (F.col("y") - F.lead(F.when(fit, F.col("y"))).over(down) > F.greatest(F.lit(22.0), F.col("_size") * 2.1)), F.lit(False)))
    small = fit & (F.coalesce("font_size", "_size") <= F.col("_size") * 1.12)
    top = F.min(F.when(F.col("_gap") & (F.col("_at") <= F.least(F.lit(2), F.col("_n") - 1)), F.col("_at"))).over(whole)
    bottom = F.max(F.when(F.col("_gap") & (F.col("_at") >= F.greatest(F.lit(1), F.col("_n") - 2)) & (F.col("_at") < F.col("_n")), F.col("_at"))).over(whole)
    out = out.withColumn("_top", top).withColumn("_bottom", bottom)
    band = F.when(F.col("_n") < 4, None).when(small & (F.col("_at") > F.col("_bottom")), "footer").when(small & (F.col("_at") <= F.col("_top")), "header")
    return out.withColumn("band", band).drop("_at", "_n", "_size", "_gap", "_top", "_bottom")


def roles(table: DataFrame) -> DataFrame:
    """Ordered lines and role, role_confidence, method: table header and body, list, repeated heading, header, footer, heading or body.

    All evidence comes from windows over the same rows, so the runs below are made once: pages share one
    partitioning, and only the repeated keys of a document need another.
    """
    whole = Window.partitionBy(*PAGE)
    rank = F.row_number().over(by_page(F.desc(F.when(F.col("font_size").isNotNull(), F.length("text"))), "reading_order"))
    rows = _bands(table).withColumn("_rank", rank).withColumn("_sized", F.count("font_size").over(whole))
    half = (F.col("_rank") <= F.greatest(F.lit(1), F.ceil(F.col("_sized") / 2))) & F.col("font_size").isNotNull()
    rows = rows.withColumn("body_font_size", F.median(F.when(half, F.col("font_size"))).over(whole))
    edge = (F.row_number().over(by_page("reading_order")) <= 2) | (F.row_number().over(by_page(F.desc("reading_order"))) <= 2)
    rows = rows.withColumn("key", T.boundary_key(F.col("text"))).withColumn("_edge", edge)
    pages = F.size(F.collect_set(F.when(F.col("_edge") & F.col("key").isNotNull(), F.col("page_number"))).over(Window.partitionBy("doc_id", "key")))
    rows = rows.withColumn("repeated", pages >= 2)
    ratio = F.when(F.col("body_font_size") > 0, F.coalesce("font_size", "body_font_size") / F.col("body_font_size")).otherwise(1.0)
    index, n = F.col("reading_order"), F.count("*").over(Window.partitionBy(*PAGE))
    following = F.lead("text").over(by_page("reading_order"))
    again = F.coalesce("repeated", F.lit(False))
    heading = T.is_heading(F.col("text"), ratio, index, following)
    foot = (F.coalesce("band", F.lit("")) == "footer") | (index >= n - F.greatest(F.lit(1), F.ceil(n * 0.2)))
    numeric = F.sum(T.has_numbers(F.col("text")).cast("int")).over(Window.partitionBy(*PAGE)) - T.has_numbers(F.col("text")).cast("int")
    compact = (F.length("text") <= 64) & ~T.is_sentence(F.col("text")) & ~T.has_numbers(F.col("text")) & (F.size(T.words(F.col("text"))) >= 2)
    edge = again | F.col("band").isNotNull()

    def verdict(role, confidence, method):
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(lit(role).alias("role"), lit(confidence).cast("double").alias("confidence"), lit(method).alias("method"))

    part = F.col("table_part") if "table_part" in table.columns else F.lit(None).cast("string")
    kind = (
        F.when(part == "header", verdict("heading", 0.88, "table-header"))
        .when(part == "body", verdict("body", 0.9, "table-body"))
        .when(T.is_list(F.col("text")), verdict("list", 0.86, "list-prefix"))
        .when(again & (ratio >= 1.25) & heading, verdict("heading", 0.86, "repeated-boundary-heading"))
        .when(again & compact & (numeric >= 2), verdict("heading", 0.86, "repeated-boundary-table-heading"))
        .when(edge, verdict(F.when(foot, "footer").otherwise("header"), F.when(again, 0.9).otherwise(0.74), F.when(again, "repeated-boundary").otherwise("page-band")))
        .when(heading, verdict("heading", F.least(F.lit(0.94), 0.72 + F.greatest(F.lit(0.0), ratio - 1) * 0.18), "typographic-heading"))
        .otherwise(verdict("body", 0.72, "body-flow"))
    )
    out = rows.withColumn("_kind", kind)
    return out.select(*table.columns, F.col("_kind.role").alias("role"), F.col("_kind.confidence").alias("role_confidence"), F.col("_kind.method").alias("method"))


def paragraphs(table: DataFrame) -> DataFrame:
    """Lines with roles and starts_paragraph."""
    order = by_page("reading_order")
    back = lambda c: F.lag(c).over(order)
    size = F.greatest(F.coalesce(back("font_size"), F.lit(12.0)), F.coalesce("font_size", F.lit(12.0)))
    column = F.coalesce(F.abs(back("x") - F.col("x")) <= F.greatest(F.lit(18.0), size * 1.6), F.lit(True))
    gap = F.coalesce(F.abs(back("y") - F.col("y")), F.lit(0.0))
    compact = (F.length("text") <= 32) & ~T.is_sentence(F.col("text"))
    rows = table.withColumn("_compact", compact).withColumn("_column", column).withColumn("_gap", gap).withColumn("_size", size).withColumn("_before", back("role")).withColumn("_tail", back("text"))
    # Compact lines that follow each other closely are islands; from three on they are entries.
    joins = F.col("_compact") & F.coalesce(F.lag("_compact").over(order), F.lit(False)) & F.col("_column") & (F.col("_gap") <= F.greatest(F.lit(24.0), F.col("_size") * 2))
    rows = rows.withColumn("_island", F.sum((~joins).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    entries = F.col("_compact") & (F.count("*").over(Window.partitionBy(*PAGE, "_island")) >= 3)
    starts = (F.row_number().over(order) == 1) | (F.col("role") != "body") | (F.col("_before") != "body") | entries | ~F.col("_column") | (F.col("_gap") > F.greatest(F.lit(18.0), F.col("_size") * 1.75)) | T.is_short_tail(F.col("_tail")) & T.begins_sentence(F.col("text"))
    if "tail_part" in table.columns:
        starts = F.when(F.col("tail_part") == "tail", False).when(F.col("tail_part") == "body", True).otherwise(starts)
    return rows.withColumn("starts_paragraph", F.coalesce(starts, F.lit(False))).select(*table.columns, "starts_paragraph")


def blocks(runs: DataFrame) -> DataFrame:
    """The whole layout of runs: lines in reading order with roles and paragraph starts."""
    return paragraphs(roles(split_tails(ordered(lines(runs)))))


def page_texts(table: DataFrame) -> DataFrame:
    """(doc_id, page_number, text): a page's blocks as text; paragraphs, headings and lists stand apart, wrapped words are made whole."""
    b = F.struct("reading_order", "text", "starts_paragraph", "role", "x", "y", "font_size")
    grouped = table.where("role is not null").groupBy(*PAGE).agg(F.array_sort(F.collect_list(b)).alias("rows"))

    def step(acc, row):
        prev, out, text = acc["prev"], acc["out"], row["text"]
        size = F.greatest(F.coalesce(prev["font_size"], F.lit(12.0)), F.coalesce(row["font_size"], F.lit(12.0)))
        dropped = prev["y"] - row["y"]
        wrapped = prev["text"].rlike(T.WRAPPED) & text.rlike(r"^\p{Ll}") & (dropped > 0) & (dropped <= F.greatest(F.lit(24.0), size * 2.4)) & (F.abs(prev["x"] - row["x"]) <= F.greatest(F.lit(36.0), size * 4))
        apart = row["starts_paragraph"] | row["role"].isin("heading", "list") | (prev["role"] == "heading")
        tight = prev["text"].endswith("-") | text.rlike(r"^[,.;:!?]")
        more = F.when(out == "", text).when(F.coalesce(wrapped, F.lit(False)), F.concat(out.substr(F.lit(1), F.length(out) - 1), text)).when(apart, F.concat(out, F.lit("\n\n"), text)).when(tight, F.concat(out, text)).otherwise(F.concat(out, F.lit(" "), text))
        return F.struct(more.alias("out"), row.alias("prev"))

    first = F.struct(F.lit("").alias("out"), F.col("rows")[0].alias("prev"))
    return grouped.select(*PAGE, F.aggregate("rows", first, step, lambda acc: F.trim(acc["out"])).alias("text"))


def document_texts(table: DataFrame) -> DataFrame:
    """(doc_id, text): pages two line ends apart."""
    rows = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return page_texts(table).where("text <> ''").groupBy("doc_id").agg(rows.alias("rows")).select("doc_id", F.array_join(F.col("rows.text"), "\n\n").alias("text"))
