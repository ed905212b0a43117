"""Stream filters: a chain of decoders with aligned parameters, each bounded in what it may put out."""

from __future__ import annotations

import re
import zlib

from .values import Name, PdfError

# Short names of filters.
ALIASES = {"AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "CCF": "CCITTFaxDecode", "Fl": "FlateDecode", "LZW": "LZWDecode", "RL": "RunLengthDecode", "DCT": "DCTDecode"}
DECODED = 256_000_000


def filter_names(items: dict, resolve=lambda v: v) -> list[str]:
    value = resolve(items.get("Filter", items.get("F")))
    names = value if isinstance(value, list) else [] if value is None else [value]
    out = []
    for n in names:
        n = resolve(n)
        if not isinstance(n, Name):
            raise PdfError("filter is not a name")
        out.append(ALIASES.get(n, str(n)))
    return out


def decode(items: dict, raw: bytes, resolve=lambda v: v, limit: int = DECODED) -> tuple[str, bytes | None, list[str]]:
    """(state, bytes, filters): available without filters, decoded, unsupported-filter or failed (no bytes)."""
    try:
        names = filter_names(items, resolve)
    except PdfError:
        return "failed", None, []
    if not names:
        return "available", raw, names
    parms = resolve(items.get("DecodeParms", items.get("DP")))
    parms = parms if isinstance(parms, list) else [parms]
    for k, name in enumerate(names):
        own = resolve(parms[k]) if k < len(parms) else None
        own = {key: resolve(v) for key, v in own.items()} if isinstance(own, dict) else {}
        decoder = DECODERS.get(name)
        if decoder is None:
            return "unsupported-filter", None, names
        try:
            raw = decoder(raw, own, limit)
        except (PdfError, zlib.error, ValueError, IndexError) as e:
            if isinstance(e, PdfError) and e.code == "resource-limit":
                raise
            return "failed", None, names
    return "decoded", raw, names


def _bounded(out, limit: int):
    if len(out) > limit:
        raise PdfError("decoded bytes over the limit", "resource-limit")
    return out


def flate(raw: bytes, parms: dict, limit: int) -> bytes:
    tool = zlib.decompressobj()
    out = tool.decompress(raw, limit + 1)
    _bounded(out, limit)
    if not tool.eof:
        raise PdfError("deflated data ends early")
    return predict(out, parms)


def lzw(raw: bytes, parms: dict, limit: int) -> bytes:
    early = parms.get("EarlyChange", 1)
    if early not in (0, 1):
        raise PdfError("bad EarlyChange")
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, known, width, held, bits = bytearray(), list(table), 9, 0, 0
    last = b""
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code = held >> bits
            held &= (1 << bits) - 1
            if code == 256:
                known, width, last = list(table), 9, b""
                continue
            if code == 257:
                return predict(bytes(out), parms)
            if code < len(known):
                entry = known[code]
            elif code == len(known) and last:
                entry = last + last[:1]
            else:
                raise PdfError("bad LZW code")
            out += entry
            _bounded(out, limit)
            if last and len(known) < 4096:
                known.append(last + entry[:1])
            last = entry
            while width < 12 and len(known) + early >= 1 << width:
                width += 1
    return predict(bytes(out), parms)


def ascii_hex(raw: bytes, parms: dict, limit: int) -> bytes:
    text = re.sub(rb"[\x00\t\n\x0c\r ]", b"", raw.partition(b">")[0])
    if not re.fullmatch(rb"[0-9A-Fa-f]*", text):
        raise PdfError("bad hexadecimal digit")
    return _bounded(bytes.fromhex((text + b"0" * (len(text) & 1)).decode()), limit)


def ascii_85(raw: bytes, parms: dict, limit: int) -> bytes:
    text = re.sub(rb"[\x00\t\n\x0c\r ]", b"", raw)
    text = text.removeprefix(b"<~").partition(b"~")[0]
    out, group = bytearray(), []
    for c in text:
        if c == 122 and not group:
            out += bytes(4)
            continue
        if not 33 <= c <= 117:
            raise PdfError("bad base-85 digit")
        group.append(c - 33)
        if len(group) == 5:
            out += _base_85(group)
            group = []
        _bounded(out, limit)
    if len(group) == 1:
        raise PdfError("base-85 group of one digit")
    if group:
        out += _base_85(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _base_85(group: list[int]) -> bytes:
    n = 0
    for d in group:
        n = n * 85 + d
    if n >> 32:
        raise PdfError("base-85 group too large")
    return n.to_bytes(4, "big")


def run_length(raw: bytes, parms: dict, limit: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n == 128:
            return bytes(out)
        size = n + 1 if n < 128 else 1
        part = raw[at + 1 : at + 1 + size]
        if len(part) < size:
            raise PdfError("run ends early")
        out += part if n < 128 else part * (257 - n)
        at += 1 + size
        _bounded(out, limit)
    return bytes(out)


def predict(raw: bytes, parms: dict) -> bytes:
    """Undo a predictor: 2 (differences of samples in a row) or 10 to 15 (a filter byte a row)."""
    import numpy as np

    kind = parms.get("Predictor", 1)
    if kind == 1:
        return raw
    colors, bits, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    if not all(isinstance(v, int) and v > 0 for v in (colors, bits, columns)) or bits not in (1, 2, 4, 8, 16):
        raise PdfError("bad predictor parameters")
    width, step = (colors * bits * columns + 7) // 8, max(1, colors * bits // 8)
    if kind == 2:
        if len(raw) % width:
            raise PdfError("rows of unequal length")
        rows = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
        samples = np.unpackbits(rows, axis=1).reshape(len(rows), -1)[:, : columns * colors * bits].reshape(len(rows), columns, colors, bits)
        values = samples @ (1 << np.arange(bits)[::-1])
        values = np.cumsum(values, axis=1) & (1 << bits) - 1
        back = (values[..., None] >> np.arange(bits)[::-1] & 1).astype(np.uint8).reshape(len(rows), -1)
        return np.packbits(np.pad(back, ((0, 0), (0, width * 8 - back.shape[1]))), axis=1).tobytes()
    if not 10 <= kind <= 15:
        raise PdfError("unknown predictor")
    if len(raw) % (width + 1):
        raise PdfError("rows of unequal length")
    out, above = bytearray(), bytes(width)
    for at in range(0, len(raw), width + 1):
        tag, row = raw[at], bytearray(raw[at + 1 : at + 1 + width])
        if tag > 4:
            raise PdfError("unknown row filter")
        if tag == 2:
            row = bytearray((np.frombuffer(bytes(row), np.uint8) + np.frombuffer(above, np.uint8)).astype(np.uint8).tobytes())
        elif tag:
            for i in range(width):
                left = row[i - step] if i >= step else 0
                if tag == 1:
                    guess = left
                elif tag == 3:
                    guess = left + above[i] >> 1
                else:
                    corner = above[i - step] if i >= step else 0
                    p = left + above[i] - corner
                    guess = min((left, above[i], corner), key=lambda v: abs(p - v))
                row[i] = row[i] + guess & 255
        above = bytes(row)
        out += row
    return bytes(out)


def fax(raw: bytes, parms: dict, limit: int) -> bytes:
    from .fax import decode_fax

    return _bounded(decode_fax(raw, parms), limit)


DECODERS = {"FlateDecode": flate, "LZWDecode": lzw, "ASCIIHexDecode": ascii_hex, "ASCII85Decode": ascii_85, "RunLengthDecode": run_length, "CCITTFaxDecode": fax}
