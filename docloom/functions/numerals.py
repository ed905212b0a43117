"""Page-label numerals, and stable identifiers."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
STYLES = {"D": "decimal", "R": "upper-roman", "r": "lower-roman", "A": "upper-letters", "a": "lower-letters"}


def roman(n: int) -> str:
    out = ""
    for value, letters in ROMAN:
        out += letters * (n // value)
        n %= value
    return out


def letters(n: int) -> str:
    """A to Z, then AA, BB, ..."""
    return chr(65 + (n - 1) % 26) * ((n - 1) // 26 + 1) if n > 0 else ""


def label(style: str | None, n: int) -> str:
    text = {"decimal": str, "upper-roman": roman, "lower-roman": lambda k: roman(k).lower(), "upper-letters": letters, "lower-letters": lambda k: letters(k).lower()}
    return text[style](n) if style in text else ""


FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def fnv1a(text: str) -> int:
    """FNV-1a of 64 bits over UTF-16 units."""
    h, raw = FNV_BASIS, text.encode("utf-16-le", "surrogatepass")
    for k in range(0, len(raw), 2):
        h = (h ^ (raw[k] | raw[k + 1] << 8)) * FNV_PRIME & (1 << 64) - 1
    return h


def fnv1a_all(texts: list[str]):
    """fnv1a of each text, as an array: the n-th units of all texts at once, the last few texts each on its own."""
    import numpy as np

    raws = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(r) // 2 for r in raws), np.int64, len(raws))
    order = np.argsort(-sizes, kind="stable")
    units, sizes = np.frombuffer(b"".join([raws[i] for i in order]), np.uint16).astype(np.uint64), sizes[order]
    starts, h, prime = np.cumsum(sizes) - sizes, np.full(len(raws), FNV_BASIS, np.uint64), np.uint64(FNV_PRIME)
    left, k = int((sizes > 0).sum()), 0
    while left > 8:
        h[:left] = (h[:left] ^ units[starts[:left] + k]) * prime
        k += 1
        while left and sizes[left - 1] <= k:
            left -= 1
    for i in range(left):
        own = int(h[i])
        for u in units[starts[i] + k : starts[i] + sizes[i]].tolist():
            own = (own ^ u) * FNV_PRIME & (1 << 64) - 1
        h[i] = own
    out = np.empty_like(h)
    out[order] = h
    return out


@lru_cache(1 << 14)
def slug(text: str) -> str:
    """Lower-case letters and digits with single hyphens, at most 56 characters."""
    plain = unicodedata.normalize("NFKD", text).lower()
    return re.sub(r"[^a-z0-9]+", "-", "".join(c for c in plain if not unicodedata.combining(c))).strip("-")[:56].strip("-")


def stable_id_all(prefix: str, names: list[str], parts: list[list]) -> list[str]:
    """stable_id of each name and its parts."""
    import numpy as np

    h = fnv1a_all(["\x1f".join(map(str, p)) for p in parts])
    shown = np.empty((len(h), 13), np.uint8)
    for k in range(12, -1, -1):
        h, d = np.divmod(h, np.uint64(36))
        shown[:, k] = d
    text = np.frombuffer(DIGITS.encode(), np.uint8)[shown].tobytes().decode()
    return ["-".join([x for x in (prefix, slug(n), text[13 * k : 13 * k + 13]) if x]) for k, n in enumerate(names)]


def stable_id(prefix: str, name: str, parts: list) -> str:
    """prefix-slug-hash: the same parts give the same id in every run."""
    h, text = fnv1a("\x1f".join(str(p) for p in parts)), ""
    for _ in range(13):
        h, d = divmod(h, 36)
        text = DIGITS[d] + text
    return "-".join(x for x in (prefix, slug(name), text) if x)
