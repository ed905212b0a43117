"""CCITT fax decoding: group 3 in one and two dimensions, group 4."""

from __future__ import annotations

from .values import PdfError

# Code words of white and black runs, of 0 to 63 and then of 64, 128, ... 1728 pixels, and of 1792, ... 2560 of either colour.
WHITE = "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100 11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
BLACK = "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111 0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
# Modes of two-dimensional lines; numbers are the distance of a vertical mode.
MODES = {"0001": "pass", "001": "horizontal", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}
EOL = "000000000001"


def _runs(words: str) -> dict[str, int]:
    sizes = [*range(64), *range(64, 1729, 64)]
    return dict(zip(words.split(), sizes)) | dict(zip(LONG.split(), range(1792, 2561, 64)))


class Bits:
    def __init__(self, raw: bytes):
        self.text = "".join(f"{b:08b}" for b in raw)
        self.at = 0

    def code(self, table: dict, longest: int = 13):
        for n in range(1, longest + 1):
            if (found := table.get(self.text[self.at : self.at + n])) is not None and self.at + n <= len(self.text):
                self.at += n
                return found
        return None

    def eol(self) -> bool:
        """An end of line, with any fill before it."""
        one = self.text.find("1", self.at)
        if one - self.at >= 11:
            self.at = one + 1
            return True
        return False


def decode_fax(raw: bytes, parms: dict) -> bytes:
    """Rows of packed bits; 0 is black unless BlackIs1."""
    k, columns, rows = parms.get("K", 0), parms.get("Columns", 1728), parms.get("Rows", 0)
    if not isinstance(columns, int) or not 0 < columns <= 1 << 16 or not isinstance(rows, int) or rows < 0:
        raise PdfError("bad fax parameters")
    tables, bits, out, above = (_runs(WHITE), _runs(BLACK)), Bits(raw), bytearray(), [columns]
    n = 0
    while not rows or n < rows:
        if parms.get("EncodedByteAlign"):
            bits.at = bits.at + 7 & ~7
        ends = 0
        flat = k == 0
        while bits.eol():
            ends += 1
            if k > 0:
                flat = bits.text[bits.at : bits.at + 1] == "1"
                bits.at += 1
        if ends >= (2 if k < 0 else 6 if k == 0 else 6) or ends >= 2 and parms.get("EndOfBlock", True):
            break
        if bits.at >= len(bits.text) or not bits.text.find("1", bits.at) >= 0:
            break
        if k > 0 and not ends:
            flat = True
        line = _one(bits, tables, columns) if flat else _two(bits, tables, columns, above)
        if line is None:
            if parms.get("DamagedRowsBeforeError", 0) or not out:
                raise PdfError("bad fax code")
            break
        above = line
        out += _pack(line, columns, bool(parms.get("BlackIs1")))
        n += 1
    if rows and n < rows:
        out += _pack([columns], columns, bool(parms.get("BlackIs1"))) * (rows - n)
    return bytes(out)


def _length(bits: Bits, table: dict) -> int | None:
    total = 0
    while True:
        n = bits.code(table)
        if n is None:
            return None
        total += n
        if n < 64:
            return total


def _one(bits: Bits, tables, columns: int) -> list[int] | None:
    """A line as the places where its colour changes, white first, the last one its end."""
    line, at, black = [], 0, 0
    while at < columns:
        n = _length(bits, tables[black])
        if n is None or at + n > columns:
            return None
        at += n
        line.append(at)
        black ^= 1
    return line


def _two(bits: Bits, tables, columns: int, above: list[int]) -> list[int] | None:
    line, at, black = [], -1, 0
    changes = [a for a in above if a < columns]

    def next_change():
        """The first change above, right of here, to the other colour; and the one after it."""
        for i, a in enumerate(changes):
            if a > at and i % 2 == black:
                return a, changes[i + 1] if i + 1 < len(changes) else columns
        return columns, columns

    while at < columns:
        mode = bits.code(MODES, 7)
        if mode is None:
            return None
        b1, b2 = next_change()
        if mode == "pass":
            at = b2
        elif mode == "horizontal":
            for color in (black, black ^ 1):
                n = _length(bits, tables[color])
                if n is None or max(at, 0) + n > columns:
                    return None
                at = max(at, 0) + n
                line.append(at)
        else:
            to = b1 + mode
            if not max(at, 0) <= to <= columns:
                return None
            at = to
            line.append(at)
            black ^= 1
    return line if line and line[-1] == columns else [*line, columns]


def _pack(line: list[int], columns: int, black_is_1: bool) -> bytes:
    text, at, black = [], 0, 0
    for end in line:
        text.append(("1" if (black == 1) == black_is_1 else "0") * (end - at))
        at, black = end, black ^ 1
    row = "".join(text)[:columns].ljust(-(-columns // 8) * 8, "0")
    return int(row, 2).to_bytes(len(row) // 8, "big")
