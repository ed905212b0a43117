"""Tables told by the order of a page's runs: compact rows under a header line, and cells before a larger header."""

from __future__ import annotations

import re
from functools import lru_cache

# Least and most counts, units that go with a number, last words of headers over numbers.
LEAST_COLUMNS, LEAST_ROWS, MOST_HEADER_WORDS, MOST_ROW_WORDS, MOST_COLUMNS = 3, 2, 18, 32, 8
HEADER_TEXT, HEADER_CELL, EASY_CELL, HEADER_RUN, DATA_RUN, MERGED_LINE = 120, 48, 32, 24, 40, 24
UNITS = frozenset("% a cm ft g gb hz in kb kg khz lb m mb mhz min mm ms oz ppm pt px s sec v w".split())
MEASURES = frozenset("amount count height length measure measured nominal quantity rate score size total value weight width".split())
NUMBER = re.compile(r"[+-]?(?:[0-9]+(?:[.,][0-9]+)?|[.,][0-9]+)%?")
NUMERIC = re.compile(r"[0-9\s.,$()%+-]+")
DIGIT, STOPS, PARTS, FILES = (re.compile(p, re.I) for p in ("[0-9]", "[.:]", "[/:]", r"[/:]|\.(?:json|pdf)$"))

# Texts come again from page to page, so what a text alone tells is kept for the last of them.


@lru_cache(1 << 14)
def plain(text: str | None) -> str:
    return " ".join((text or "").split())


@lru_cache(1 << 14)
def bare(word: str) -> str:
    """A word without what stands around its letters and digits, in lower case."""
    inner = [k for k, c in enumerate(word) if c.isalnum() or c == "%"]
    return word[inner[0] : inner[-1] + 1].lower() if inner else ""


def has_digit(text: str) -> bool:
    return DIGIT.search(text) is not None


def row_cells(text: str) -> list[str] | None:
    """A compact row's cells: a number with its unit is one, the words between two numbers are one."""
    return None if (cells := _row_cells(text)) is None else list(cells)


@lru_cache(1 << 14)
def _row_cells(text: str) -> list[str] | None:
    words = text.split()
    if not LEAST_COLUMNS <= len(words) <= MOST_ROW_WORDS:
        return None
    cells, last, numbers = [], "", 0
    for w in words:
        if NUMBER.fullmatch(w):
            cells.append(w)
            last, numbers = "number", numbers + 1
        elif last == "number" and bare(w) in UNITS:
            cells[-1] += " " + w
            last = "unit"
        elif last == "words":
            cells[-1] += " " + w
        else:
            cells.append(w)
            last = "words"
    return cells if numbers and LEAST_COLUMNS <= len(cells) <= MOST_COLUMNS else None


@lru_cache(1 << 12)
def is_header_line(text: str) -> bool:
    words = text.split()
    fit = 0 < len(text) <= HEADER_TEXT and not STOPS.search(text) and LEAST_COLUMNS <= len(words) <= MOST_HEADER_WORDS
    return fit and not any(NUMERIC.fullmatch(w) for w in words) and any(w.lstrip("(\"'[")[:1].isupper() or w.lstrip("(\"'[")[:1].istitle() for w in words)


def split_header(text: str, numeric: list[bool]) -> list[str] | None:
    """The header's words dealt to the columns: the best sum of cells' worth, found from the last column on; of equals, the one with shorter first cells."""
    return None if (cells := _split_header(text, tuple(numeric))) is None else list(cells)


@lru_cache(1 << 12)
def _split_header(text: str, numeric: tuple[bool, ...]) -> list[str] | None:
    words, m = text.split(), len(numeric)
    n, folded = len(words), [bare(w) for w in words]
    if not m <= n <= MOST_HEADER_WORDS:
        return None

    def worth(j: int, a: int, b: int) -> float | None:
        cell, wide = " ".join(words[a:b]), b - a
        if len(cell) > HEADER_CELL or NUMERIC.fullmatch(cell) or PARTS.search(cell):
            return None
        value = 2 if len(cell) <= EASY_CELL else -8
        value += (2 if j in (0, m - 1) else 0) if wide == 1 else 3 if wide == 2 else -2 * (wide - 2)
        if numeric[j]:
            value += 4 * (wide > 1) + 3 * (folded[b - 1] in MEASURES)
            value += 4 * (j > 0 and numeric[j - 1] and folded[a - 1] == folded[b - 1] != "")
        return value

    best: dict[tuple[int, int], tuple[float, int]] = {(m, n): (0, n)}
    for j in range(m - 1, -1, -1):
        for a in range(j, n - (m - j) + 1):
            for b in range(a + 1, n - (m - j - 1) + 1):
                own, rest = worth(j, a, b), best.get((j + 1, b))
                if own is not None and rest and ((j, a) not in best or own + rest[0] > best[j, a][0]):
                    best[j, a] = (own + rest[0], b)
    if (0, 0) not in best:
        return None
    out, a = [], 0
    for j in range(m):
        b = best[j, a][1]
        out.append(" ".join(words[a:b]))
        a = b
    return out


def measures(headers: list[str], numeric: list[bool]) -> bool:
    """Some column of numbers is named like one, or like a neighbour that holds numbers too."""
    last = [bare(h.split()[-1]) if h else "" for h in headers]
    alike = lambda j, o: 0 <= o < len(last) and numeric[o] and last[o] == last[j]
    return any(n and last[j] and (last[j] in MEASURES or alike(j, j - 1) or alike(j, j + 1)) for j, n in enumerate(numeric))


def _table(heuristic: str, headers: list[str], head: list[dict], rows: list[list[tuple[str, dict]]], of: dict, confidence: float) -> dict:
    """A candidate; cells are (text, run), blocks are those of the runs."""
    ids = [of[r["id"]]["id"] for r in head + [r for row in rows for _, r in row] if r["id"] in of]
    cells = [[(j, {"text": t, "id": of[r["id"]]["id"] if r["id"] in of else None, "run": r["id"]}) for j, (t, r) in enumerate(row)] for row in rows]
    return {"heuristic": heuristic, "headers": headers, "rows": cells, "blocks": list(dict.fromkeys(ids)), "confidence": round(confidence, 2)}


def compact_table(runs: list[dict], of: dict) -> dict | None:
    """A header line over two or more runs that each hold a row of as many cells; the widest, then longest, then first."""
    texts = [plain(r["text"]) for r in runs]
    cells = [row_cells(t) for t in texts]
    reach = [0] * (len(runs) + 1)  # rows alike from here on
    for k in range(len(runs) - 1, -1, -1):
        if cells[k]:
            more = reach[k + 1] if k + 1 < len(runs) and cells[k + 1] and len(cells[k + 1]) == len(cells[k]) else 0
            reach[k] = more + 1
    best, score = None, -1
    for k in range(len(runs) - 1):
        n = reach[k + 1]
        if n < LEAST_ROWS or not is_header_line(texts[k]):
            continue
        body = range(k + 1, k + 1 + n)
        numeric = [any(has_digit(cells[i][j]) for i in body) for j in range(len(cells[k + 1]))]
        headers = split_header(texts[k], numeric)
        if headers and measures(headers, numeric) and 10 * len(headers) + n > score:
            score = 10 * len(headers) + n
            best = _table("row-sequence", headers, [runs[k]], [[(t, runs[i]) for t in cells[i]] for i in body], of, min(0.7, 0.46 + 0.025 * len(headers) + 0.025 * n))
    return best


def header_runs(runs: list[dict]) -> tuple[int, int] | None:
    """(start, end) of the runs of one size above the page's middle size that read as headers: the largest, then longest, then first."""
    sizes = sorted(r["font_size"] for r in runs if (r["font_size"] or 0) > 0)
    middle, best, score, k = sizes[len(sizes) // 2] if sizes else 0, None, -1.0, 0
    named = [0 < len(plain(r["text"])) <= HEADER_RUN and ":" not in r["text"] and not NUMERIC.fullmatch(plain(r["text"])) for r in runs]
    while k < len(runs):
        size, end = runs[k]["font_size"] or 0, k + 1
        while end < len(runs) and named[end] and (runs[end]["font_size"] or 0) == size:
            end += 1
        if size > middle + 1 and end - k >= LEAST_COLUMNS and 10 * size + end - k > score:
            best, score = (k, end), 10 * size + end - k
        k = end
    return best


def data_runs(runs: list[dict], before: int) -> list[dict]:
    """The runs right before a header that read as cells."""
    k = before
    while k and len(text := plain(runs[k - 1]["text"])) <= DATA_RUN and not FILES.search(text):
        k -= 1
    return runs[k:before]


def rows_of(cells: list, width: int) -> list[list]:
    """Cells dealt to rows of a width; the last may be shorter, but not a single cell: then there are no rows."""
    rows = [cells[k : k + width] for k in range(0, len(cells), width)]
    return rows if rows and len(rows[-1]) > 1 else []


def font_table(runs: list[dict], of: dict) -> dict | None:
    """Cells, row after row, before a run of larger headers."""
    span = header_runs(runs)
    if not span:
        return None
    head = runs[span[0] : span[1]]
    data = data_runs(runs, span[0])
    rows = rows_of(data, len(head)) if len(data) >= 2 * len(head) - 1 else []
    if len(rows) < LEAST_ROWS:
        return None
    return _table("row-sequence", [plain(r["text"]) for r in head], head, [[(plain(r["text"]), r) for r in row] for row in rows], of, min(0.72, 0.44 + 0.03 * len(head) + 0.025 * len(rows)))


def stacked_headers(blocks: list[dict]) -> list[str]:
    """Header texts from left to right; the first block of several lines names several columns, the others one each."""
    placed = sorted((b for b in blocks if b["x"] is not None and b["y"] is not None), key=lambda b: b["x"])
    stack = next((b for b in placed if "\n" in b["text"]), None)
    if len(placed) < 2 or stack is None:
        return []
    out = []
    for b in placed:
        lines = [t for t in map(plain, b["text"].split("\n")) if t]
        if b is stack and len(lines) >= 4 and all(len(t) <= MERGED_LINE and not NUMERIC.fullmatch(t) for t in lines[:2]):
            lines[:2] = [" ".join(lines[:2])]
        out += lines if b is stack else lines[:1]
    return [t for t in out if not NUMERIC.fullmatch(t)]


def stacked_table(runs: list[dict], of: dict) -> dict | None:
    """Numbered rows before larger headers of which one block stacks several."""
    span = header_runs(runs)
    if not span:
        return None
    head = runs[span[0] : span[1]]
    names = stacked_headers(list({of[r["id"]]["id"]: of[r["id"]] for r in head if r["id"] in of}.values()))
    data = data_runs(runs, span[0])
    if not LEAST_COLUMNS <= len(names) < len(head) or len(data) < 2 * len(names) - 1:
        return None
    rows = [[(plain(r["text"]), r) for r in row] for row in rows_of(data, len(names))]
    numbered = lambda row, least: len(row) >= least and bool(NUMERIC.fullmatch(row[0][0])) and not NUMERIC.fullmatch(row[1][0])
    if len(rows) < LEAST_ROWS or not all(numbered(row, 3 if k == len(rows) - 1 else 4) for k, row in enumerate(rows)):
        return None
    return _table("stacked-header-sequence", names, head, rows, of, min(0.74, 0.48 + 0.03 * len(names) + 0.025 * len(rows)))
