"""Fragments of eight channels, and search and bounded reading over them.

A fragment is (doc_id, page_number or null, channel, id, text). Fragments of a document are ordered by
page (none first) and id.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHANNELS = ("visible", "hidden", "accessibility", "annotations", "forms", "metadata", "attachments", "scripts")
DEFAULT = ("visible", "accessibility")
LIMIT = 100
BOUND = r"[\p{L}\p{N}\p{M}_]"


def place():
    """What fragments of a document are ordered by."""
    return F.coalesce(F.col("page_number"), F.lit(0)), F.col("id")


def document_fragments(marks, catalog):
    """(page_number, channel, id, text) of all channels of a document. marks: its marks; catalog(name): the rows of one of its catalogs."""
    for m in marks:
        if m["kind"] == "text":
            yield m["page_number"], "hidden" if m["visibility"] == "hidden" else "visible", m["id"], m["text"]
        elif m["kind"] == "marked-content":
            yield m["page_number"], "accessibility", f"{m['id']}-actual-text", m["actual_text"]
    for s in catalog("structure"):
        for c in ("actual_text", "alternate_text", "title"):
            yield s["page_number"], "accessibility", f"{s['id']}-{c.replace('_', '-')}", s[c]
    for a in catalog("annotation"):
        yield a["page_number"], "annotations", a["id"], a["contents"]
    for f in catalog("field"):
        yield f["page_number"], "forms", f["id"], f["value"]
    for m in catalog("metadata"):
        yield None, "metadata", f"metadata-{m['key']}", m["value"]
    for a in catalog("attachment"):
        yield None, "attachments", f"{a['id']}-description", a["description"]
    for a in catalog("active"):
        yield a["page_number"], "scripts", f"{a['id']}-payload", a["payload"]


def select(fragments: DataFrame, channels=DEFAULT, pages: list[int] | None = None, element_ids: list[str] | None = None) -> DataFrame:
    """Fragments of some channels, pages and elements."""
    if unknown := set(channels) - set(CHANNELS):
        raise TypeError(f"unknown channel {unknown}")
    out = fragments.where(F.col("channel").isin(list(channels)))
    if pages is not None:
        out = out.where(F.col("page_number").isin(pages))
    return out.where(F.col("id").isin(element_ids)) if element_ids is not None else out


def page_range(first: int, last: int) -> list[int]:
    if not 1 <= first <= last:
        raise ValueError("a page range is from 1 on and not empty")
    return list(range(first, last + 1))


def find(text: str, query: str, mode: str = "literal", case_sensitive: bool = False) -> list[tuple[int, int]]:
    """(start, end) of all matches in text, compared by clusters of base and marks in compatibility form."""

    def fold(s):
        s = unicodedata.normalize("NFKC", s)
        return s if case_sensitive else s.lower()

    clusters = [(m.start(), m.end(), fold(m[0])) for m in re.finditer(r".[̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿︀-️︠-︯]*", text, re.S)]
    joined = "".join(c for *_, c in clusters)
    whose = [k for k, (*_, c) in enumerate(clusters) for _ in c]
    want, out, at = fold(query), [], 0
    word = lambda c: c == "_" or unicodedata.category(c)[0] in "LNM"
    while want and (at := joined.find(want, at)) >= 0:
        end = at + len(want)
        if mode == "literal" or not (at and word(joined[at - 1])) and not (end < len(joined) and word(joined[end])):
            out.append((clusters[whose[at]][0], clusters[whose[end - 1]][1]))
        at = end
    return out


def _simple(query: str) -> bool:
    """Plain ASCII without a repeated edge: counting and places agree between engines."""
    return query.isascii() and not any(query.lower().endswith(query.lower()[:k]) for k in range(1, len(query)))


def search(fragments: DataFrame, query: str, mode: str = "literal", case_sensitive: bool = False, limit: int = LIMIT, channels=DEFAULT, pages: list[int] | None = None) -> DataFrame:
    """(doc_id, page_number, channel, fragment_id, id, start, end, text, truncated): at most limit matches a document, in fragment order.

    truncated: the document has more. Matches never cross fragments.
    """
    if not query:
        raise TypeError("an empty query")
    if mode not in ("literal", "word") or not isinstance(limit, int) or limit < 1:
        raise TypeError("mode is literal or word, limit a positive integer")
    chosen = select(fragments, channels, pages)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hits = [(k, s, e) for k, t in enumerate(batch.column("text").to_pylist()) for s, e in find(t, query, mode, case_sensitive)]
            at = pa.array([h[0] for h in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array([h[1] for h in hits], pa.int32()), pa.array([h[2] for h in hits], pa.int32())], names=[*batch.schema.names, "start", "end"])

    # A fragment without the query's rarest plain character run cannot match; the JVM drops it before the kernel.
    if _simple(query):
        chosen = chosen.where(F.expr("text").contains(query) if case_sensitive else F.lower("text").contains(query.lower()) | ~F.col("text").rlike(r"^[\x00-\x7f]*$"))
    found = chosen.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in chosen.dtypes)}, start int, end int")
    order = Window.partitionBy("doc_id").orderBy(*place(), "start")
    ranked = found.withColumn("_rank", F.row_number().over(order))
    # The first match beyond the limit tells that there are more; the window stops there.
    ranked = ranked.where(F.col("_rank") <= limit + 1).withColumn("truncated", F.max("_rank").over(Window.partitionBy("doc_id")) > limit)
    return ranked.where(F.col("_rank") <= limit).select("doc_id", "page_number", "channel", F.col("id").alias("fragment_id"), F.concat_ws("-", F.lit("search"), "id", F.col("start").cast("string"), F.col("end").cast("string")).alias("id"), "start", "end", F.expr("substring(text, start + 1, end - start)").alias("text"), "truncated")


def count_words(fragments: DataFrame, query: str) -> DataFrame:
    """(doc_id, n): whole-word matches, ignoring case, by regular expression alone; for plain words."""
    if not re.fullmatch(r"\w+", query):
        raise TypeError("a single word")
    pattern = f"(?i)(?<!{BOUND}){re.escape(query)}(?!{BOUND})"
    return fragments.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(pattern))).cast("bigint").alias("n"))


def read(fragments: DataFrame, max_characters: int, cursor: tuple[str, int] | None = None, channels=DEFAULT, pages: list[int] | None = None, element_ids: list[str] | None = None) -> DataFrame:
    """(doc_id, page_number, channel, id, text, start, character_count, next_id, next_offset): as much as fits, the last fragment cut.

    cursor: (fragment id, offset) that an earlier read gave back. next_id and next_offset are the same for all rows of a document, null at its end.
    """
    if not isinstance(max_characters, int) or max_characters < 1:
        raise TypeError("max_characters is a positive integer")
    chosen = select(fragments, channels, pages, element_ids)
    own = Window.partitionBy("doc_id").orderBy(*place())
    if cursor is not None:
        here = F.max(F.when(F.col("id") == cursor[0], F.struct(*place()))).over(Window.partitionBy("doc_id"))
        chosen = chosen.withColumn("_from", here).where(F.struct(*place()) >= F.col("_from")).drop("_from")
        chosen = chosen.withColumn("_skip", F.when(F.col("id") == cursor[0], F.lit(cursor[1])).otherwise(0))
    else:
        chosen = chosen.withColumn("_skip", F.lit(0))
    size = F.length("text") - F.col("_skip")
    upto = F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0))
    got = chosen.withColumn("_size", size).withColumn("_before", upto - F.col("_size"))
    taken = F.least(F.col("_size"), F.lit(max_characters) - F.col("_before"))
    whole = Window.partitionBy("doc_id")
    # The first fragment that isn't taken whole is where the next read starts.
    got = got.withColumn("_taken", F.greatest(taken, F.lit(0)))
    rest = F.when(F.col("_taken") < F.col("_size"), F.struct(F.col("_before"), F.col("id"), (F.col("_skip") + F.col("_taken")).alias("offset")))
    got = got.withColumn("_next", F.min(rest).over(whole)).withColumn("character_count", F.sum("_taken").over(whole))
    kept = got.where((F.col("_taken") > 0) | (F.col("_size") == 0) & (F.col("_before") < max_characters))
    return kept.select("doc_id", "page_number", "channel", "id", F.expr("substring(text, _skip + 1, cast(_taken as int))").alias("text"), F.col("_skip").alias("start"), "character_count", F.col("_next.id").alias("next_id"), F.col("_next.offset").alias("next_offset"))
