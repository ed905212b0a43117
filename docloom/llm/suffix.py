"""Removal of repeated passages by suffix arrays with two-stage sorting.

Every string of LENGTH bytes that starts anywhere else too - in another document or at another place of
the same one - is removed wherever it occurs; runs of words can be looked for in the same way. Texts are
not sorted whole against each other: a string holds a smallest K-symbol gram (by hash), equal strings hold
the same one, so the stretches of starts that share a smallest gram form a group and only grams found twice
or more matter. The stretches of some groups together make a block; its suffix array is built in two stages
(only suffixes smaller than their successors are sorted, the rest are induced by scans over buckets), the
common prefixes of neighbours are computed, and those that reach LENGTH mark repeated starts.

Equal stretches meet once, with a count. Members of a group lie over each other at their gram, and each is
sorted only as far as it agrees with another there, if that is LENGTH at least.
A group of more than CROWD different stretches is dealt again by longer grams, down to single strings, so
no task holds an unbounded group.

Words are told apart by 64-bit codes of their lower case; where words are sorted, a code's lowest byte
stands for it, and the common prefixes are those of the codes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, heavy_join, text_batches

LENGTH = 400
GRAMS = (128, 320, 384, 400)  # in parts of LENGTH for other lengths
CROWD = 512
BLOCK = 600_000
STRETCH = 1 << 20
LONGEST_RUN = 2048
#: Starts from one place of a gram to its next from which on they are stretches of their own.
PERIOD = 24
#: Bytes of a word's code, where runs of words are looked for.
CODE = 8
#: White space as UTF-8: single bytes, and longer ones.
BLANK = np.zeros(256, dtype=bool)
BLANK[[*range(9, 14), 32]] = True
WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    found = _powers.get(base)
    if found is None or len(found) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            found = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, dtype=np.uint64)])
        _powers[base] = found
    return found[:n]


def _sums(t: np.ndarray) -> np.ndarray:
    """Prefix sums of the symbols times powers of BASE."""
    s = np.zeros(len(t) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = t.astype(np.uint64)
        x += np.uint64(1)
        x *= _power(BASE, len(t))
        np.cumsum(x, out=s[1:])
    return s


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def _between(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the strings from starts to ends, s their text's _sums()."""
    with np.errstate(over="ignore"):
        return _mixed((s[ends] - s[starts]) * _power(BASE_INVERSE, len(s))[starts])


def gram_hashes(t: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k symbols from each place on."""
    n = len(t) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    s = _sums(t)
    with np.errstate(over="ignore"):
        return _mixed((s[k:] - s[:-k]) * _power(BASE_INVERSE, n))


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours."""
    if w == 1:
        return x
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def _flat_stretches(t: np.ndarray, sizes: np.ndarray, k: int, length: int, longest: int):
    """stretches() of texts that lie behind each other in t: (text, key, first start, starts, place of the gram)."""
    if len(t) < length:
        return (np.zeros(0, np.int64),) * 5
    low = np.uint64((1 << 24) - 1)
    h = gram_hashes(t, k)
    by = h & ~low
    by |= np.arange(len(h), dtype=np.uint64)
    left = _sliding_least(by, length - k + 1)
    left &= low
    moved = np.flatnonzero(left[1:] != left[:-1]) + 1
    other = h[left[moved]] != h[left[moved - 1]]
    # A gram that comes again and again, as in repeated lines, begins a stretch each time, but for short periods.
    far = np.diff(np.r_[0, moved, len(left)])
    moved = moved[other | (far[:-1] >= PERIOD) & (far[1:] >= PERIOD)]
    # Edges also where a text begins and where its last string has begun.
    ends = np.cumsum(sizes)
    begins = ends - sizes
    over = np.maximum(begins, ends - (length - 1))
    edge = np.unique(np.concatenate([moved, begins, over]))
    edge = edge[edge < len(left)]
    n = np.diff(np.r_[edge, len(left)])
    row = np.searchsorted(begins, edge, side="right") - 1
    inside = edge < over[row]
    first, n, row = edge[inside], n[inside], row[inside]
    if len(n) and n.max() > longest:
        parts = -(-n // longest)
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        stop = np.repeat(first + n, parts)
        first, row = np.repeat(first, parts) + nth * longest, np.repeat(row, parts)
        n = np.minimum(longest, stop - first)
    gram = left[first].astype(np.int64)
    return row, h[gram].view(np.int64), first - begins[row], n, np.where(left[first] == left[first + n - 1], gram - first, -1)


def stretches(texts: list[np.ndarray], k: int, length: int = LENGTH, longest: int = LONGEST_RUN):
    """Stretches of starts with one smallest k-gram, of all texts: (text, the gram's hash, first start, starts, place of the gram from the first start on).

    The place is -1 where the gram may lie there more than once.
    """
    found = []
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush():
        row, key, a, n, p = _flat_stretches(np.concatenate([x[2] for x in held]), np.array([len(x[2]) for x in held]), k, length, longest)
        rows, offsets = np.array([x[0] for x in held]), np.array([x[1] for x in held])
        found.append((rows[row], key, a + offsets[row], n, p))

    for i, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, STRETCH):
            piece = t[at : at + STRETCH + length - 1]
            held.append((i, at, piece))
            size += len(piece)
            if size >= STRETCH:
                flush()
                held, size = [], 0
    if held:
        flush()
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 5


def _direct(buf: bytes, places: np.ndarray, word: np.ndarray, rest: np.ndarray, window: np.ndarray, length: int) -> np.ndarray:
    """places in the order of the suffixes there, by their first `length` symbols."""
    order = places[np.argsort(word[places], kind="stable")]
    tie = np.zeros(len(order) + 1, dtype=bool)  # is this one equal to the one before, so far
    tie[1:-1] = word[order[1:]] == word[order[:-1]]
    for depth in range(8, length, 8):
        tied = np.flatnonzero(tie[:-1] | tie[1:])
        if not len(tied):
            return order
        # A group of equal windows is in order as it stands.
        group = np.cumsum(~tie[tied]) - 1
        w = window[order[tied]]
        some = np.zeros(int(group[-1]) + 1, dtype=bool)
        some[group[1:][(w[1:] != w[:-1]) & (group[1:] == group[:-1])]] = True
        live = some[group]
        tied, group = tied[live], group[live]
        if not len(tied):
            return order
        if depth > 64 or len(tied) < 512:  # a few: by the rest of their bytes
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            for s, e in zip(tied[first].tolist(), (tied[np.r_[first[1:], len(tied)] - 1] + 1).tolist()):
                order[s:e] = sorted(order[s:e].tolist(), key=lambda i: buf[i : i + min(length, int(rest[i]))])
            return order
        w = np.where(rest[order[tied]] > depth, word[np.minimum(order[tied] + depth, len(word) - 1)], np.uint64(0))
        by = np.lexsort((w, group))
        order[tied], w = order[tied][by], w[by]
        tie[tied[1:]] &= (w[1:] == w[:-1]) | (group[1:] != group[:-1])
    return order


def _words(t: np.ndarray, extra: int) -> np.ndarray:
    """The eight symbols from each place on as one number, and from `extra` places behind the end."""
    padded = np.zeros(len(t) + extra + 8, dtype=np.uint8)
    padded[: len(t)] = t
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(t) + extra].copy().view(">u8").ravel().astype(np.uint64)


def suffix_array(t: np.ndarray, length: int = LENGTH, rest: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of t (bytes) in the order of their suffixes' first `length` symbols (equal ones next to each other); also _words() and the hashes of `length` symbols from each place on.

    rest: of each place, after how many symbols its stretch ends; suffixes are looked at up to there, and
    eight zeros part stretches. last: of each stretch, the last place whose suffix holds `length` symbols; of
    the places behind it only those are ordered from which others follow.
    Two stages: suffixes smaller than their successors are sorted directly. The others follow from them:
    scanning buckets of equal first bytes upwards, the place before each entry, if its byte is larger, takes
    the next free place at the front of that byte's bucket.
    """
    n = len(t)
    rest = np.arange(n, 0, -1) if rest is None else rest
    word, at = _words(t, length), np.arange(n)
    window = _between(_sums(t), at, at + np.minimum(rest, length))
    if n < 2:
        return np.arange(n), word, window
    # Smaller than the successor: by the next different byte; a run at the end is larger.
    new = np.r_[np.flatnonzero(t[1:] != t[:-1]), n - 1]
    rises = np.r_[t[new[:-1] + 1] > t[new[:-1]], False]
    small = np.repeat(rises, np.diff(np.r_[-1, new]))
    some = np.flatnonzero(small)
    if last is not None and len(some):
        next_ = some[np.minimum(np.searchsorted(some, last), len(some) - 1)]
        some = np.union1d(some[rest[some] >= length], next_)
    direct = _direct(t.tobytes(), some, word, rest, window, length)
    bucket = np.searchsorted(t[direct], np.arange(257))
    front: list[list[np.ndarray]] = [[] for _ in range(256)]
    front[t[-1]].append(np.array([n - 1]))
    out = []
    for c in np.flatnonzero(np.bincount(t, minlength=256)).tolist():
        got = [np.concatenate(front[c])] if front[c] else []
        more = got[0] if got else np.zeros(0, dtype=np.int64)
        while len(more):  # a run of the same byte fills its own bucket
            more = more[more > 0] - 1
            more = more[t[more] == c]
            got.append(more)
        mine = np.concatenate([*got, direct[bucket[c] : bucket[c + 1]]])
        out.append(mine)
        before = mine[mine > 0] - 1
        byte = t[before]
        larger = byte > c
        before, byte = before[larger], byte[larger]
        if len(before):
            by = np.argsort(byte, kind="stable")
            before, byte = before[by], byte[by]
            edge = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
            for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(byte)]):
                front[byte[s]].append(before[s:e])
    return np.concatenate(out), word, window


def _leading(x: np.ndarray) -> np.ndarray:
    """Zero bytes at the front of each 64-bit word."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(s)
    return (64 - np.bitwise_count(x).astype(np.int64)) >> 3


def common_prefixes(order: np.ndarray, word: np.ndarray, codes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of each two neighbours in order, how many symbols of codes they share from the front, `length` at most.

    Neighbours that share more than a few words of eight symbols come in runs - a place and the next, at one
    distance - and a run is compared once: the place behind shares one symbol less.
    """
    a, b = order[:-1], order[1:]
    shared, live = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    for depth in range(0, min(40, length), 8):
        x = word[a[live] + depth] ^ word[b[live] + depth]
        shared[live] = np.minimum(length, depth + _leading(x))
        live = live[x == 0]
    live = live[shared[live] < length] if codes.dtype == np.uint8 else live
    if not len(live):
        return shared
    low, high = np.minimum(a[live], b[live]), np.maximum(a[live], b[live])
    by = np.lexsort((low, high - low))
    live, low, high = live[by], low[by], high[by]
    first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1] + 1) | (high[1:] != high[:-1] + 1)])
    last = np.r_[first[1:], len(low)]
    padded = np.concatenate([codes, np.zeros(length, dtype=codes.dtype)])
    for s, e, x, y in zip(first.tolist(), last.tolist(), low[first].tolist(), high[first].tolist()):
        m = e - s
        differ = np.flatnonzero(padded[x : x + m + length - 1] != padded[y : y + m + length - 1])
        if not len(differ):
            shared[live[s:e]] = length
            continue
        place = np.arange(m)
        nearest = np.r_[differ, 1 << 40][np.searchsorted(differ, place)]
        shared[live[s:e]] = np.minimum(length, nearest - place)
    return shared


def _extents(codes: np.ndarray, s: np.ndarray, begin: np.ndarray, end: np.ndarray, group: np.ndarray, back: bool) -> np.ndarray:
    """How many symbols of codes[begin:end] each stretch shares with another of its group - from the front, or back: from the end. s: _sums() of codes."""
    texts = [codes[b:e][::-1].tobytes() if back else codes[b:e].tobytes() for b, e in zip(begin.tolist(), end.tolist())]
    order = np.array(sorted(range(len(texts)), key=lambda i: (group[i], texts[i])), dtype=np.int64)
    a, b = order[:-1], order[1:]
    most = np.where(group[a] == group[b], np.minimum((end - begin)[a], (end - begin)[b]), 0)
    shared = np.zeros(len(a), dtype=np.int64)
    step = 1 << int(most.max(initial=0)).bit_length()
    while step := step >> 1:
        live = np.flatnonzero(shared + step <= most)
        x, y, m = a[live], b[live], shared[live] + step
        if back:
            same = _between(s, end[x] - m, end[x]) == _between(s, end[y] - m, end[y])
        else:
            same = _between(s, begin[x], begin[x] + m) == _between(s, begin[y], begin[y] + m)
        shared[live[same]] += step
    out = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(out, a, shared)
    np.maximum.at(out, b, shared)
    return out


def repeated_starts(codes: np.ndarray, sizes: np.ndarray, n: np.ndarray, p: np.ndarray, count: np.ndarray, group: np.ndarray, k: int, length: int = LENGTH) -> np.ndarray:
    """Which places of codes - stretches of `sizes` symbols behind each other - begin a string found elsewhere too.

    n: starts of each stretch, p: place of its gram (-1: unknown), count: how often it occurs, group: numbers
    in ascending order. Members of a group lie over each other at their gram, so each is sorted only as far as
    it agrees with another; where a gram's place isn't known the whole group is.
    """
    base = np.cumsum(sizes) - sizes
    hit = np.repeat(count > 1, sizes)
    begin, end = base.copy(), base + sizes
    vague = np.isin(group, np.unique(group[p < 0]))
    many = np.diff(np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)])
    known = np.flatnonzero(~vague & np.repeat(many > 1, many))
    end[~vague & ~np.repeat(many > 1, many)] = 0
    if len(known):
        s, at = _sums(codes), (base + p)[known]
        begin[known] = at - _extents(codes, s, base[known], at, group[known], True)
        end[known] = at + k + _extents(codes, s, at + k, (base + sizes)[known], group[known], False)
    some = np.flatnonzero(end - begin >= length)
    if not len(some):
        return hit
    begin, size = begin[some], (end - begin)[some]
    # The stretches, eight zeros behind each.
    start = np.cumsum(size + 8) - (size + 8)
    inside = np.arange(int((size + 8).sum())) - np.repeat(start, size + 8)
    rest = np.repeat(size, size + 8) - inside
    own = np.where(rest > 0, np.repeat(begin, size + 8) + inside, len(codes))
    valid, rest = rest >= length, np.maximum(rest, 1)
    mine = np.r_[codes, codes.dtype.type(0)][own]
    t = mine if mine.dtype == np.uint8 else mine.astype(np.uint8)  # a code's lowest byte
    order, word, window = suffix_array(t, length, rest, start + size - length)
    order = order[valid[order]]
    if mine.dtype != np.uint8:  # windows of different words with equal lowest bytes
        real = gram_hashes(np.concatenate([mine, np.zeros(length - 1, dtype=mine.dtype)]), length)
        same = window[order[1:]] == window[order[:-1]]
        if (same & (real[order[1:]] != real[order[:-1]])).any():
            order = order[np.lexsort((real[order], np.cumsum(np.r_[False, ~same])))]
    reach = np.flatnonzero(common_prefixes(order, word, mine, length) >= length)
    hit[own[order[reach]]] = True
    hit[own[order[reach + 1]]] = True
    return hit


def _intervals(mask: np.ndarray) -> tuple[list[int], list[int]]:
    if mask.all():
        return [0], [len(mask)]
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def _filled(raw: bytes) -> bytes:
    """raw with white space of several bytes as so many blanks."""
    return raw if raw.isascii() else WIDE.sub(lambda m: b" " * len(m[0]), raw)


def _word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of raw, whose white space is ASCII, begin and end."""
    word = ~BLANK[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def word_codes(raws: list[bytes]) -> list[np.ndarray]:
    """A 64-bit code for each word of each text: equal words in equal turn, whatever their case and the white space between."""
    lower = [_filled(r.lower() if r.isascii() else r.decode("utf-8", "replace").lower().encode("utf-8", "replace")) for r in raws]
    pieces = [p for r in lower for p in _pieces(r)]
    counts, codes, held, size = [], [np.zeros(0, dtype=np.uint64)], [], 0

    def flush():
        flat = b" ".join(held)
        starts, ends = _word_bounds(flat)
        codes.append(_between(_sums(np.frombuffer(flat, dtype=np.uint8)), starts, ends))
        edges = np.cumsum([len(h) + 1 for h in held])
        counts.append(np.diff(np.r_[0, np.searchsorted(starts, edges)]))

    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size >= STRETCH:
            flush()
            held, size = [], 0
    if held:
        flush()
    each = np.array([sum(1 for _ in _pieces(r)) for r in lower])
    per = np.r_[0, np.cumsum(np.concatenate(counts))] if counts else np.zeros(1, np.int64)
    upto = np.r_[0, np.cumsum(each)]
    flat = np.concatenate(codes)
    return [flat[per[s] : per[e]] for s, e in zip(upto[:-1].tolist(), upto[1:].tolist())]


def _pieces(raw: bytes):
    """A very long text in pieces that end before white space."""
    at = 0
    while len(raw) - at > 4 * STRETCH and (found := re.compile(rb"[\t-\r ]").search(raw, at + 4 * STRETCH)):
        yield raw[at : found.start()]
        at = found.start()
    yield raw[at:]


def word_spans(raw: bytes, lows: np.ndarray, highs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of `words` words that start with the words in [low, high) begin and end in raw; the white space behind a run goes with it."""
    if not len(lows):
        return lows, lows
    starts, _ = _word_bounds(_filled(raw))
    bounds = np.r_[0, starts[1:], len(raw)]
    return bounds[lows], bounds[highs - 1 + words]


def covered(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in a span."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change)[:-1] > 0


def remove(raw: bytes, lows: np.ndarray, highs: np.ndarray, length: int = LENGTH, spans: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[bytes, int, int]:
    """raw without the bytes of the strings that start in [low, high), and without the spans (begins, ends): what is left, bytes and runs removed."""
    if not len(lows) and (spans is None or not len(spans[0])):
        return raw, 0, 0
    begins, ends = (lows, highs + (length - 1)) if spans is None else (np.r_[lows, spans[0]], np.r_[highs + (length - 1), spans[1]])
    gone = covered(len(raw), begins, ends)
    runs_gone = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
    return np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes(), int(gone.sum()), runs_gone


def _segments(rows: DataFrame, owner: list[str], kinds: str, cut_up, symbol: type) -> DataFrame:
    """A row (owner, at, segment) for each stretch, and one (segment, key, n, p, bytes, count) for each different stretch a task meets.

    cut_up(batch): yields (row place, symbols, [(key, first start, starts, place of the gram)], count).
    """

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        held: dict[bytes, list] = {}
        size, wide = 0, np.dtype(symbol).itemsize
        kept = [("key", pa.int64()), ("n", pa.int64()), ("p", pa.int64()), ("bytes", pa.binary()), ("count", pa.int64())]
        names = [*owner, "at", "segment", *(k for k, _ in kept)]

        def flush():
            ids = list(held)
            columns = list(zip(*held.values()))
            empty = pa.nulls(len(ids), pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(ids), t) for t in batch_types), empty, pa.array(ids, pa.binary()), *(pa.array(c, t) for c, (_, t) in zip(columns, kept))], names=names)

        for batch in batches:
            batch_types = [batch.schema.field(o).type for o in owner]
            place, at, ids = [], [], []
            for row, symbols, found, count in cut_up(batch):
                raw = symbols.tobytes()
                for key, s, m, p in found:
                    part = raw[s * wide : (s + m + tail) * wide]
                    segment = xxh3_128_digest(part)
                    place.append(row)
                    at.append(s)
                    ids.append(segment)
                    if segment in held:
                        held[segment][4] += count
                    else:
                        held[segment] = [key, m, p, part, count]
                        size += len(part) + 200
            if ids:
                yield pa.RecordBatch.from_arrays([*(batch.column(o).take(pa.array(place)) for o in owner), pa.array(at, pa.int64()), pa.array(ids, pa.binary()), *(pa.nulls(len(ids), t) for _, t in kept)], names=names)
            if size > 48_000_000:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    tail = cut_up.length - 1
    return rows.mapInArrow(run, f"{kinds}, at bigint, segment binary, key bigint, n bigint, p bigint, bytes binary, count bigint")


class _FromDocs:
    """Stretches of the documents whose grams are found twice or more."""

    def __init__(self, length: int, coded: bool):
        self.length, self.coded = length, coded

    def __call__(self, batch):
        offset = 0
        for part in text_batches(batch):
            raws = [t.as_buffer().to_pybytes() for t in part.column("text")]
            texts = word_codes(raws) if self.coded else [np.frombuffer(r, dtype=np.uint8) for r in raws]
            for row, (symbols, found) in enumerate(zip(texts, part.column("found").to_pylist()), offset):
                yield row, symbols, [(f["key"], f["a"], f["n"], f["p"]) for f in found], 1
            offset += part.num_rows


class _FromParts:
    """Stretches of stretches, by longer grams."""

    def __init__(self, k: int, length: int, symbol: type):
        self.k, self.length, self.symbol = k, length, symbol

    def __call__(self, batch):
        for row, (part, count) in enumerate(zip(batch.column("bytes").to_pylist(), batch.column("count").to_pylist())):
            symbols = np.frombuffer(part, dtype=self.symbol)
            _, *found = stretches([symbols], self.k, self.length, 64)
            yield row, symbols, list(zip(*(x.tolist() for x in found))), count


def _marked(parts: DataFrame, k: int, length: int, symbol: type) -> DataFrame:
    """(segment, lows, highs): the repeated starts of each stretch, group by group."""

    def run(batches):
        import pyarrow as pa

        wide = np.dtype(symbol).itemsize

        def done(held):
            key, segment, n, p, part, count = zip(*held)
            sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part)) // wide
            n, group = np.array(n, dtype=np.int64), np.cumsum(np.r_[0, np.diff(np.array(key, dtype=np.int64)) != 0])
            hit = repeated_starts(np.frombuffer(b"".join(part), dtype=symbol), sizes, n, np.array(p, dtype=np.int64), np.array(count, dtype=np.int64), group, k, length)
            base = np.cumsum(sizes) - sizes
            rows = [(s, *_intervals(m)) for s, m in zip(segment, (hit[b : b + x] for b, x in zip(base.tolist(), n.tolist()))) if m.any()]
            segment, lows, highs = zip(*rows) if rows else ((), (), ())
            ints = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(segment, pa.binary()), pa.array(lows, ints), pa.array(highs, ints)], names=["segment", "lows", "highs"])

        held: list[list] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "segment", "n", "p", "bytes", "count"))):
                if row[0] != last and size >= BLOCK * wide:
                    yield done(held)
                    held, size = [], 0
                last = row[0]
                if held and held[-1][1] == row[1]:
                    held[-1][5] += row[5]
                    continue
                held.append(list(row))
                size += len(row[4])
        if held:
            yield done(held)

    dealt = parts.select("key", "segment", "n", "p", "bytes", "count").repartition("key").sortWithinPartitions("key", "segment")
    return dealt.mapInArrow(run, "segment binary, lows array<bigint>, highs array<bigint>")


def _resolve(table: DataFrame, level: int, grams: tuple[int, ...], length: int, crowd: int, symbol: type) -> DataFrame:
    """(segment, lows, highs) of all stretches of a table of segments."""
    parts = table.where("bytes is not null").select("segment", "key", "n", "p", "bytes", "count")
    hot = cut(parts.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > crowd).select("key"), "crowded") if level + 1 < len(grams) else None
    if hot is None or hot.isEmpty():
        return _marked(parts, grams[level], length, symbol)
    calm = _marked(parts.join(hot, "key", "left_anti"), grams[level], length, symbol)
    # A part that several tasks met has several rows: its own stretches are taken from each, with each one's count.
    crowded = parts.join(hot, "key", "left_semi").select(F.col("segment").alias("whole"), "bytes", "count")
    deeper = cut(_segments(crowded, ["whole"], "whole binary", _FromParts(grams[level + 1], length, symbol), symbol), "segments")
    below = _resolve(deeper, level + 1, grams, length, crowd, symbol)
    refs = cut(deeper.where("whole is not null").select("whole", "at", "segment").distinct(), "references")
    up = heavy_join(refs, cut(below, "marks"), "segment").select(F.col("whole").alias("segment"), F.transform("lows", lambda x: x + F.col("at")).alias("lows"), F.transform("highs", lambda x: x + F.col("at")).alias("highs"))
    up = up.groupBy("segment").agg(F.flatten(F.collect_list("lows")).alias("lows"), F.flatten(F.collect_list("highs")).alias("highs"))
    return calm.unionByName(up)


def _found(docs: DataFrame, length: int, grams: tuple[int, ...], coded: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, d, found): for each document with grams that occur twice or more, their stretches; and the table of all grams, which it reads. coded: of its words' codes."""
    k = grams[0]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_batches(batch):
                raws = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column("text")]
                row, *found = stretches(word_codes(raws) if coded else [np.frombuffer(r, dtype=np.uint8) for r in raws], k, length)
                if len(row):
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("d").take(at), *map(pa.array, found)], names=["doc_id", "d", "key", "a", "n", "p"])

    long = docs.where(F.octet_length("text") >= (2 * length - 1 if coded else length)).select("doc_id", "d", "text")
    table = cut(long.mapInArrow(run, "doc_id bigint, d bigint, key bigint, a bigint, n bigint, p bigint"), "grams")
    twice = table.groupBy("key").agg(F.sum(F.lit(1) + (F.col("p") < 0).cast("int")).alias("c")).where("c > 1").select("key")
    return heavy_join(table, twice, "key").groupBy("doc_id", "d").agg(F.collect_set(F.struct("key", "a", "n", "p")).alias("found")), table


def _finished(docs: DataFrame, length: int, crowd: int, keep: list[str], schema: str, of, whole: bool = False, words: int = 0) -> DataFrame:
    """docs with what of(raw, lows, highs) makes of each text that has candidates; for the others nulls, or if whole the text and nulls.

    words: if not 0, runs of so many words are looked for as well, and of() gets the lows and highs of their words too.
    """
    rows = docs.withColumn("d", F.xxhash64("text"))
    # What is looked for, by the names of its columns: (length, grams, whether of the words' codes).
    kinds = {"": (length, False)} | ({"w": (words, True)} if words else {})
    kinds = {w: (n, tuple(max(1, g * n // LENGTH) for g in GRAMS), coded) for w, (n, coded) in kinds.items()}

    def merged(parts: dict[str, DataFrame], columns: list[str], agg) -> DataFrame:
        """Each kind's columns beside each other, by document."""
        rows = [df.select("doc_id", "d", *((F.col(c) if w == v else F.lit(None).cast(df.schema[c].dataType)).alias(v + c) for v in kinds for c in columns)) for w, df in parts.items()]
        one = rows[0]
        for more in rows[1:]:
            one = one.unionByName(more)
        return one.groupBy("doc_id", "d").agg(*(agg(v + c).alias(v + c) for v in kinds for c in columns))

    found = {w: _found(rows, *kind) for w, kind in kinds.items()}
    grams = [table for _, table in found.values()]
    found = merged({w: df for w, (df, _) in found.items()}, ["found"], lambda c: F.first(c, ignorenulls=True)) if words else found[""][0]
    has = lambda columns: F.coalesce(*(F.when(c.isNotNull(), F.lit(True)) for c in columns), F.lit(False))
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.d") == F.col("r.d"))
    of_found = [F.col(f"r.{w}found") for w in kinds]
    both = rows.alias("l").join(found.alias("r"), same, "left").select(*(F.col(f"l.{c}") for c in dict.fromkeys([*keep, "doc_id", "d"])), (F.col("l.text") if whole else F.when(has(of_found), F.col("l.text"))).alias("text"), *of_found)
    table = cut(both, "candidates")
    drop(*grams)
    any_found = has([F.col(f"{w}found") for w in kinds])
    some = table.where(any_found)
    hits = {}
    for w, (n, grams, coded) in kinds.items():
        symbol = np.uint64 if coded else np.uint8
        texts = some.where(f"{w}found is not null").select("doc_id", "d", F.col("text").cast("binary").alias("text"), F.col(f"{w}found").alias("found"))
        segments = cut(_segments(texts, ["doc_id", "d"], "doc_id bigint, d bigint", _FromDocs(n, coded), symbol), "segments")
        marks = cut(_resolve(segments, 0, grams, n, crowd, symbol), "marks")
        refs = cut(segments.where("bytes is null").select("doc_id", "d", "at", "segment").distinct(), "references")
        drop(segments)
        found = heavy_join(refs, marks, "segment").select("doc_id", "d", F.transform("lows", lambda x: x + F.col("at")).alias("lows"), F.transform("highs", lambda x: x + F.col("at")).alias("highs"))
        hits[w] = cut(found.groupBy("doc_id", "d").agg(F.flatten(F.collect_list("lows")).alias("lows"), F.flatten(F.collect_list("highs")).alias("highs")), "hits")
        drop(refs, marks)
    hits = merged(hits, ["lows", "highs"], lambda c: F.first(c, ignorenulls=True)) if words else hits[""]
    of_hits = [w + c for w in kinds for c in ("lows", "highs")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [of(t.as_buffer().to_pybytes(), *(np.array(m or [], dtype=np.int64) for m in marks)) for t, *marks in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in of_hits))]
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array([m[k] for m in made], f.type) for k, f in enumerate(fields))], names=[*keep, *names])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(schema)
    fields = list(to_arrow_schema(added))
    kept = StructType([f for c in keep for f in [table.schema[c]]])
    joined = some.alias("l").join(hits.alias("r"), same, "left").select(*(F.col(f"l.{c}") for c in keep), F.col("l.text").alias("text"), *(f"r.{c}" for c in of_hits))
    done = joined.mapInArrow(run, StructType([*kept.fields, *added.fields]))
    rest = table.where(~any_found).select(*keep, *((F.col("text") if whole and f.name == "text" else F.lit(None).cast(f.dataType)).alias(f.name) for f in added.fields))
    return done.unionByName(rest)


def repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, words: int = 0) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, n_run_words]) of every row of docs (doc_id, text).

    A null text is empty; a text shorter than `length` keeps all its bytes. A very long text is read whole, a
    stretch of STRETCH bytes after the other. Repeated rows are other documents with the same text, so each
    loses what it repeats; so do equal ones without a doc_id. An empty table gives no rows; other columns are
    not looked at.
    words: if not 0, n_run_words counts a document's words that lie in a run of so many that is found elsewhere
    too, in any case and with any white space; these are counted, not removed.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("whole"))

    def of(raw, lows, highs, *coded):
        left, n, spans = remove(raw, lows, highs, length)
        in_runs = int(covered(int(coded[1].max()) + words, coded[0], coded[1] + (words - 1)).sum()) if words and len(coded[0]) else 0
        return n, spans, hashlib.sha256(left).hexdigest(), in_runs

    out = _finished(rows, length, crowd, ["doc_id", "n_bytes", "whole"], "n_removed bigint, n_spans bigint, kept string, n_run_words bigint", of, words=words)
    zero = F.lit(0).cast("bigint")
    found = out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"), F.coalesce("n_run_words", zero).alias("n_run_words"))
    return found if words else found.drop("n_run_words")


def without_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, words: int = 0) -> DataFrame:
    """docs with the repeated passages cut out of their texts (bytes of a character cut in two go with it) and n_chars, if there, counted anew.

    Passages are strings of `length` bytes and, if words is not 0, runs of that many words too (of any case,
    parted by any white space). A document of which nothing is left goes; one that was null or empty before stays as it was.
    Very long texts are read whole, repeated rows lose what they repeat, other columns keep their names and values.
    """
    others = [c for c in docs.columns if c not in ("text", "doc_id")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("c"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("others"))

    def of(raw, lows, highs, *coded):
        left, n, _ = remove(raw, lows, highs, length, word_spans(raw, *coded, words) if coded else None)
        return left.decode("utf-8", "ignore"), n

    out = _finished(rows, length, crowd, ["doc_id", "others"], "text string, removed bigint", of, whole=True, words=words)
    out = out.where((F.coalesce("removed", F.lit(0)) == 0) | (F.col("text") != ""))
    held = {c: F.col("others")[f"c{i}"] for i, c in enumerate(others)}
    if "n_chars" in held:
        held["n_chars"] = F.when(F.col("removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(held["n_chars"])
    return out.select(*(F.col(c) if c in ("doc_id", "text") else held[c].alias(c) for c in docs.columns))
