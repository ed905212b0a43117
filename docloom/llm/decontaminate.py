"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters with an error budget of k edits is cut into k + 1 pieces: wherever the item
occurs with at most k edits, one piece occurs unchanged. One automaton finds all pieces of all items in
a text; round each find Myers' bit-parallel recurrence measures the item's edit distance.
Both sides are lower-cased and have white space runs made one blank.

Items are sent to the tasks in blocks of at most BLOCK_BYTES; a larger test set takes more passes.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

RATE = 0.08
SHORT = 25
BLOCK_BYTES = 8_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(m: int, rate: float = RATE) -> int:
    """Edits allowed in m characters; items under SHORT characters must occur as they are."""
    return int(rate * m) if m >= SHORT else 0


def distances(pattern: str, text: str):
    """For each end in text, the fewest edits between the pattern and some stretch that ends there (Myers)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << m - 1
    has: dict[str, int] = {}
    for i, c in enumerate(pattern):
        has[c] = has.get(c, 0) | 1 << i
    plus, minus, score = full, 0, m
    for c in text:
        eq = has.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(across | plus), plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        plus, minus = (down | ~(vertical | up)) & full, up & vertical & full
        yield score


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items = [(i, t, budget(len(t), rate)) for i, t in ((i, normal(t)) for i, t in items) if t]
        found = defaultdict(list)
        for n, (_, t, k) in enumerate(self.items):
            edges = [round(j * len(t) / (k + 1)) for j in range(k + 2)]
            for s, e in zip(edges, edges[1:]):
                found[t[s:e]].append((n, s))
        self.pieces = ahocorasick.Automaton()
        for piece, where in found.items():
            self.pieces.add_word(piece, (len(piece), where))
        if found:
            self.pieces.make_automaton()

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each item hit, the stretches of text that can hold it."""
        starts = defaultdict(set)
        for end, (size, where) in self.pieces.iter(text):
            for n, s in where:
                starts[n].add(end + 1 - size - s)
        out = {}
        for n, at in starts.items():
            _, t, k = self.items[n]
            spans: list[list[int]] = []
            for a in sorted(at):
                lo, hi = max(0, a - k), min(len(text), a + len(t) + k)
                if spans and a - k <= spans[-1][2] + k:
                    spans[-1][1], spans[-1][2] = hi, a
                else:
                    spans.append([lo, hi, a])
            out[n] = [(lo, hi) for lo, hi, _ in spans]
        return out

    def matches(self, text: str | None, first: bool = False) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best occurrence of each item, in the normalised text; first: of one item only."""
        text, out = normal(text), []
        if not text or not len(self.pieces):
            return out
        for n, spans in self.windows(text).items():
            item, t, k = self.items[n]
            best = (k + 1, 0)
            for lo, hi in spans:
                exact = text.find(t, lo, hi)
                if exact >= 0:
                    best = min(best, (0, exact + len(t)))
                    continue
                for at, d in enumerate(distances(t, text[lo:hi]), lo + 1):
                    if d < best[0]:
                        best = (d, at)
            d, end = best
            if d <= k:
                back = text[max(0, end - len(t) - k) : end][::-1]
                start = end - next(i for i, e in enumerate(distances(t[::-1], back), 1) if e == d) if d else end - len(t)
                out.append((item, d, start, end))
                if first:
                    break
        return out


def _blocks(items: DataFrame, block_bytes: int):
    """Lists of (item_id, text), each of about block_bytes at most."""
    items = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 if size <= block_bytes else -(-2 * size // block_bytes)
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, start, end): each pair of a document and an item that it holds within the item's budget.

    start and end are places in the normalised text. Null and empty texts and items match nothing;
    items with a null id are left out; repeated rows of docs give repeated rows; an empty table on
    either side gives none; other columns are not looked at.
    """

    def scan(block):
        def run(batches):
            import pyarrow as pa

            tool = Matcher(block, rate)
            for batch in batches:
                for part in text_batches(batch):
                    rows = [(d, *m) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()) for m in tool.matches(t)]
                    columns = list(zip(*rows)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "start", "end"])

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint, distance bigint, start bigint, end bigint")

    return reduce(DataFrame.unionByName, [scan(block) for block in _blocks(items, block_bytes)])


def keep_uncontaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    for block in _blocks(items, block_bytes):

        def run(batches, block=block):
            import pyarrow as pa

            tool = Matcher(block, rate)
            for batch in batches:
                for part in text_batches(batch):
                    yield part.filter(pa.array([not tool.matches(t, first=True) for t in part.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
