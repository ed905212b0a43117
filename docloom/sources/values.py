"""PDF values in Python, and their one canonical text form.

null None, boolean bool, integer int, real float, name Name, string Text (bytes), array list,
dictionary dict (source order, the last of equal keys wins), reference Ref, stream Stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

SAFE = 2**53 - 1


class PdfError(Exception):
    """code: resource-limit and policy-blocked block a document, the rest fail it."""

    def __init__(self, message: str, code: str = "document-invalid"):
        super().__init__(message)
        self.code = code


class Name(str):
    __slots__ = ()


class Text(bytes):
    """A string's bytes; hexadecimal ones remember their form."""

    hexadecimal = False


class Ref(NamedTuple):
    obj: int
    gen: int


@dataclass
class Stream:
    items: dict
    raw: bytes
    start: int = 0
    end: int = 0


@dataclass
class Entry:
    """One line of a cross-reference section."""

    revision: int
    section_offset: int
    section_kind: str
    seq: int
    kind: str  # free, uncompressed, compressed
    obj: int
    gen: int
    offset: int | None = None
    objstm: int | None = None
    objstm_index: int | None = None
    next_free: int | None = None


@dataclass
class Object:
    ref: Ref
    value: object
    start: int
    end: int
    revision: int = 0
    encrypted: bool = field(default=True)


REGULAR = frozenset(range(33, 127)) - frozenset(b"()<>[]{}/%#")


def format_value(value, depth: int = 0) -> str:
    """The canonical text of a value: single blanks, names re-escaped, strings in the form they had."""
    if depth > 64:
        raise PdfError("value nested too deeply", "resource-limit")
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, Ref):
        return f"{value.obj} {value.gen} R"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return format_number(value)
    if isinstance(value, Name):
        return "/" + "".join(chr(b) if b in REGULAR else f"#{b:02X}" for b in value.encode("utf-8", "surrogateescape"))
    if isinstance(value, Text):
        if value.hexadecimal:
            return f"<{value.hex().upper()}>"
        shown = {40: "\\(", 41: "\\)", 92: "\\\\", 10: "\\n", 13: "\\r", 9: "\\t", 8: "\\b", 12: "\\f"}
        return "(" + "".join(shown.get(b) or (chr(b) if 32 <= b < 127 else f"\\{b:03o}") for b in value) + ")"
    if isinstance(value, list):
        return "[" + " ".join(format_value(v, depth + 1) for v in value) + "]"
    if isinstance(value, Stream):
        return format_value(value.items, depth)
    if isinstance(value, dict):
        return "<<" + " ".join(f"{format_value(k)} {format_value(v, depth + 1)}" for k, v in value.items()) + ">>"
    raise TypeError(type(value))


def format_number(x: float) -> str:
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    text = f"{x:.10f}".rstrip("0").rstrip(".")
    return text if text not in ("-0", "") else "0"
