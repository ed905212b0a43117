"""Random-access sources: only the parts of a large file that are asked for are read."""

from __future__ import annotations

from collections.abc import Callable

HEAD, TAIL = 1024, 65536


class Ranges:
    """A file behind read(offset, length), kept as merged stretches. size: its length."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size, self.parts, self.fetched = read, size, [], 0
        self.get(0, min(HEAD, size))
        self.get(max(0, size - TAIL), size)

    def missing(self, start: int, end: int) -> list[tuple[int, int]]:
        out, at = [], start
        for s, raw in self.parts:
            if s + len(raw) <= at or s >= end:
                continue
            if s > at:
                out.append((at, s))
            at = max(at, s + len(raw))
        return out + [(at, end)] if at < end else out

    def get(self, start: int, end: int) -> bytes:
        """The bytes from start to end."""
        start, end = max(0, start), min(end, self.size)
        for s, e in self.missing(start, end):
            raw = self.read(s, e - s)
            if len(raw) != e - s:
                raise ValueError("a source gave another number of bytes than asked for")
            self.fetched += len(raw)
            self._merge(s, raw)
        s, raw = next(p for p in self.parts if p[0] <= start and p[0] + len(p[1]) >= end) if end > start else (start, b"")
        return raw[start - s : end - s]

    def _merge(self, start: int, raw: bytes) -> None:
        keep = []
        for s, r in self.parts:
            if s + len(r) == start:
                start, raw = s, r + raw
            elif s == start + len(raw):
                raw += r
            else:
                keep.append((s, r))
        self.parts = sorted([*keep, (start, raw)])
