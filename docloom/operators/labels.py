"""Forms of labels under a title, whose values are left to be filled in."""

from __future__ import annotations

import re

from .regions import size_of
from .sequences import NUMERIC, plain

# Least number of labels, the width of a column of labels, lengths, and the small words of titles.
LEAST_LABELS, COLUMN, BESIDE, FOLLOWING = 4, 72.0, 48.0, 30.0
TITLE_TEXT, TITLE_SIZE, LABEL_TEXT, LABEL_WORDS, MORE_WORDS, COMPACT_TEXT, COMPACT_WORDS = 80, 18, 64, 5, 8, 32, 3
SMALL = frozenset("a an and as at by de for from in into of on or the to und von with".split())
PAGE_MARK = re.compile(r"page \d+ of \d+", re.I)
TECHNICAL = re.compile(r"\bv?\d+\.\d+\.\d+\b|\b\d{4}-\d{2}-\d{2}(?:[T\s]\d{2}:\d{2})?\b|(?:^|\s)(?:[\w.-]+/){2,}[\w.-]+(?:$|\s)", re.I | re.A)
NUMBERED = re.compile(r"[0-9]+(?:\.[0-9]+)*[.)]\s+")
NAME = re.compile(r"[^\W\d_](?:[^\W\d_]|['’/-]){0,19}")


def lettered(text: str) -> list[str]:
    return [w for w in text.split() if any(c.isalpha() for c in w)]


def odd(text: str) -> bool:
    """A page's number, a version, a date or a path, or nothing but figures."""
    return bool(NUMERIC.fullmatch(text) or PAGE_MARK.fullmatch(text) or TECHNICAL.search(text))


def label(text: str) -> str | None:
    """A label as it is shown: with a colon, or up to five words in sentence or title case."""
    text = plain(text)
    if not 0 < len(text) <= LABEL_TEXT or odd(text) or NUMBERED.match(text):
        return None
    if text.endswith(":"):
        name = re.sub(r"^\*\s*", "", text[:-1]).strip()
        return f"{name}:" if name else None
    words = lettered(text)
    if text[-1] in ".!?" or re.search("[0-9]", text) or not 0 < len(words) <= LABEL_WORDS or not any(c.islower() for c in text):
        return None
    inner = [w.strip("(\"'[])].,:;!?") for w in words]
    sentence = inner[0][:1].isupper() and all(w.lower() in SMALL or w[:1].islower() for w in inner[1:])
    title = all(w[:1].isupper() or w.lower() in SMALL for w in inner)
    return text if sentence or title else None


def title_block(blocks: list[dict]) -> dict | None:
    """The heading of largest size, then first, that can name a form."""

    def fit(b: dict) -> bool:
        if b["role"] != "heading":
            return False
        text = plain(b["text"])
        named = 0 < len(text) <= TITLE_TEXT and not odd(text) and len(lettered(text)) >= 2
        return named and not ((b["font_size"] or 0) < TITLE_SIZE and label(text))

    return min(filter(fit, blocks), key=lambda b: (-(b["font_size"] or 0), b["reading_order"]), default=None)


def values(blocks: list[dict]) -> set:
    """Ids of blocks that stand beside a label, or in a row of single names."""
    placed = [b for b in blocks if b["x"] is not None and b["y"] is not None]
    named = [b for b in placed if plain(b["text"]).endswith(":") and len(plain(b["text"])) > 1]
    ids = {b["id"] for b in named}
    out, rows = set(), []
    for b in placed:
        size = lambda o: max(size_of(o), size_of(b))
        if b["id"] not in ids and any(b["x"] > o["x"] + max(8.0, 0.6 * size(o)) and abs(b["y"] - o["y"]) <= max(5.0, 0.6 * size(o)) for o in named):
            out.add(b["id"])
        row = next((r for r in rows if abs(r[0]["y"] - b["y"]) <= max(5.0, 0.6 * size_of(b))), None)
        row.append(b) if row else rows.append([b])
    for row in rows:
        if len(row) > 1 and all(b["id"] not in ids and NAME.fullmatch(plain(b["text"])) for b in row):
            out |= {b["id"] for b in row}
    return out


def _explicit(found: list[tuple[str, dict]]) -> list[tuple[str, dict]]:
    """Where enough labels have colons, only those, and short texts well below them in their column."""
    sure = [b for t, b in found if t.endswith(":")]
    if len(sure) < LEAST_LABELS:
        return found
    placed = [b for b in sure if b["x"] is not None and b["y"] is not None]

    def more(t: str, b: dict) -> bool:
        if not placed or b["x"] is None or b["y"] is None or t[-1] in ".!?:" or not 0 < len(lettered(t)) <= MORE_WORDS:
            return False
        return min(o["y"] for o in placed) - b["y"] >= FOLLOWING and any(abs(o["x"] - b["x"]) <= BESIDE for o in placed)

    return [(t, b) for t, b in found if t.endswith(":") or more(t, b)]


def _coherent(found: list[tuple[str, dict]]) -> list[tuple[str, dict]]:
    """The labels of the fullest column and what is level with them; all, if two rows hold several labels or too few have places."""
    placed = [(t, b) for t, b in found if b["x"] is not None and b["y"] is not None]
    near = lambda y, b: abs(b["y"] - y) <= max(5.0, 0.6 * size_of(b))
    bands: list[list] = []
    for t, b in placed:
        band = next((o for o in bands if near(o[0], b)), None)
        if band:
            band[1] += 1
        else:
            bands.append([b["y"], 1])
    if len(placed) < LEAST_LABELS or sum(n > 1 for _, n in bands) >= 2:
        return found
    column = max(([o for o in placed if abs(o[1]["x"] - b["x"]) <= COLUMN] for _, b in placed), key=len)
    if len(column) < LEAST_LABELS:
        return []
    return [(t, b) for t, b in found if (t, b) in column or (b["y"] is not None and any(near(o["y"], b) for _, o in column))]


def label_form(blocks: list[dict], runs: list[dict], of: dict) -> dict | None:
    """At least four labels under a title, one row each."""
    title = title_block(blocks)
    if title is None:
        return None
    valued, filled, found, seen = values(blocks), _has_fields(blocks), [], set()
    for r in sorted((r for r in runs if r["id"] in of), key=lambda r: of[r["id"]]["reading_order"]):
        b = of[r["id"]]
        short = not filled and len(plain(b["text"])) <= COMPACT_TEXT and len(plain(b["text"]).split()) <= COMPACT_WORDS and plain(b["text"])[-1:] not in ".!?"
        if b["id"] == title["id"] or b["id"] in valued or b["role"] == "header" or b["role"] == "heading" and not short:
            continue
        t = label(r["text"])
        if t and t not in seen:
            seen.add(t)
            found.append((t, b | {"run": r["id"]}))
    kept = _coherent(_explicit(found))
    if len(kept) < LEAST_LABELS:
        return None
    rows = [[(0, {"text": t, "id": b["id"], "run": b["run"]})] for t, b in kept]
    return {"heuristic": "field-label-form", "headers": [plain(title["text"])], "rows": rows, "blocks": list(dict.fromkeys([title["id"], *(b["id"] for _, b in kept)])), "confidence": round(min(0.76, 0.48 + 0.03 * len(kept)), 2)}


def _has_fields(blocks: list[dict]) -> bool:
    """Two lines or more of `name: value`."""
    return sum(b["text"].count(":") == 1 and re.match(r"[^:]{1,48}:\s+\S", b["text"]) is not None for b in blocks) >= 2
