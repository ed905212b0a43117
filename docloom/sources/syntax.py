"""Lexer and value parser over a byte buffer."""

from __future__ import annotations

import re
from binascii import Error, unhexlify

from .values import SAFE, Name, Object, PdfError, Ref, Stream, Text

SPACE = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*")
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
REFERENCE = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
LITERAL = re.compile(rb"[()\\\r]")
INTEGER = re.compile(rb"[+-]?\d+")
OCTAL = re.compile(rb"[0-7]{1,3}")
# The commonest forms at once; what they don't match is read step by step.
_NAME, _END = rb"/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)", rb"(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])"
_REF = rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R" + _END
PLAIN = re.compile(rb"[\x00\t\n\x0c\r ]*(?:" + _NAME + rb"|()()([+-]?\d{1,15})" + _END + rb")")
TOKEN = re.compile(rb"[\x00\t\n\x0c\r ]*(?:" + _NAME + rb"|" + _REF + rb"|([+-]?\d{1,15})" + _END + rb")")
KEY = re.compile(rb"[\x00\t\n\x0c\r ]*(?:" + _NAME + rb"|(>>))")
OPENING = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj")
ENDSTREAM = re.compile(rb"\s*endstream")
BLANK = frozenset(b"\x00\t\n\x0c\r %")
ESCAPED = re.compile(rb"#([0-9A-Fa-f]{2})")
REPAIR_RADIUS = 1 << 20
# The escapes of literal strings.
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def name_of(raw: bytes) -> Name:
    if b"#" in raw:
        raw = ESCAPED.sub(lambda m: bytes([int(m[1], 16)]), raw)
    return Name(raw.decode("utf-8", "surrogateescape"))


class Lexer:
    """A place in a buffer; read() gives the next value and moves behind it."""

    def __init__(self, data: bytes, at: int = 0, depth: int = 64):
        self.data, self.at, self.depth = data, at, depth

    def skip(self) -> None:
        if self.at < len(self.data) and self.data[self.at] not in BLANK:
            return
        self.at = SPACE.match(self.data, self.at).end()

    def word(self) -> bytes:
        found = WORD.match(self.data, self.at)
        if not found:
            raise PdfError(f"no token at {self.at}")
        self.at = found.end()
        return found[0]

    def take(self, what: bytes) -> bool:
        if self.data.startswith(what, self.at):
            self.at += len(what)
            return True
        return False

    def integer(self) -> int:
        self.skip()
        word = self.word()
        if not INTEGER.fullmatch(word):
            raise PdfError(f"integer expected at {self.at}")
        return int(word)

    def read(self, references: bool = True, level: int = 0):
        if level > self.depth:
            raise PdfError("value nested too deeply", "resource-limit")
        if found := (TOKEN if references else PLAIN).match(self.data, self.at):
            self.at, kind = found.end(), found.lastindex
            return name_of(found[1]) if kind == 1 else Ref(int(found[2]), int(found[3])) if kind == 3 else int(found[4])
        self.skip()
        data, at = self.data, self.at
        c = data[at : at + 1]
        if not c:
            raise PdfError("value expected at the end")
        if c == b"/":
            return self._name()
        if c == b"(":
            return self._literal()
        if c == b"<":
            return self._dictionary(references, level) if data[at + 1 : at + 2] == b"<" else self._hexadecimal()
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.take(b"]"):
                    return out
                out.append(self.read(references, level + 1))
        if c in b"+-.0123456789":
            if references and (found := REFERENCE.match(data, at)):
                self.at = found.end()
                return Ref(int(found[1]), int(found[2]))
            word = self.word()
            if not NUMBER.fullmatch(word):
                raise PdfError(f"bad number at {at}")
            if b"." in word:
                return float(word)
            if abs(int(word)) > SAFE:
                raise PdfError(f"integer out of range at {at}")
            return int(word)
        word = self.word()
        known = {b"true": True, b"false": False, b"null": None}
        if word in known:
            return known[word]
        raise PdfError(f"unknown token {word[:20]!r} at {at}")

    def _name(self) -> Name:
        self.at += 1
        found = WORD.match(self.data, self.at)
        raw = found[0] if found else b""
        self.at += len(raw)
        return name_of(raw)

    def _literal(self) -> Text:
        data, out, level = self.data, bytearray(), 1
        at = self.at + 1
        while True:
            found = LITERAL.search(data, at)
            if not found:
                raise PdfError("string without end")
            out += data[at : found.start()]
            at, c = found.end(), found[0]
            if c == b"(":
                level += 1
                out += c
            elif c == b")":
                level -= 1
                if not level:
                    self.at = at
                    return Text(bytes(out))
                out += c
            elif c == b"\r":
                out += b"\n"
                at += data[at : at + 1] == b"\n"
            else:
                e = data[at : at + 1]
                if octal := OCTAL.match(data, at):
                    out.append(int(octal[0], 8) & 255)
                    at = octal.end()
                    continue
                at += 1
                if e == b"\r":
                    at += data[at : at + 1] == b"\n"
                elif e != b"\n":
                    out += ESCAPES.get(e, e)

    def _hexadecimal(self) -> Text:
        end = self.data.find(b">", self.at)
        if end < 0:
            raise PdfError("hexadecimal string without end")
        try:
            out = Text(unhexlify(self.data[self.at + 1 : end]))
        except Error:  # blanks, an odd number of digits, or no digits
            raw = re.sub(rb"[\x00\t\n\x0c\r ]", b"", self.data[self.at + 1 : end])
            if not re.fullmatch(rb"[0-9A-Fa-f]*", raw):
                raise PdfError(f"bad hexadecimal digit after {self.at}") from None
            out = Text(bytes.fromhex((raw + b"0" * (len(raw) & 1)).decode()))
        self.at = end + 1
        out.hexadecimal = True
        return out

    def _dictionary(self, references: bool, level: int) -> dict:
        self.at += 2
        out: dict = {}
        while True:
            if not (found := KEY.match(self.data, self.at)):
                self.skip()
                found = KEY.match(self.data, self.at)
                if not found:
                    raise PdfError(f"key expected at {self.at}")
            self.at = found.end()
            if found.lastindex == 2:
                return out
            key = name_of(found[1])
            value = self.read(references, level + 1)
            out.pop(key, None)
            out[key] = value


def read_object(data: bytes, at: int, resolve=lambda v: v, repair: bool = True) -> Object:
    """The indirect object at a place: n g obj value [stream] endobj. resolve: finds an indirect /Length."""
    lexer = Lexer(data, at)
    if found := OPENING.match(data, at):
        start, lexer.at = found.start(1), found.end()
        ref = Ref(int(found[1]), int(found[2]))
    else:
        lexer.skip()
        start = lexer.at
        ref = Ref(lexer.integer(), lexer.integer())
        lexer.skip()
        if not lexer.take(b"obj"):
            raise PdfError(f"no object at {at}")
    value = lexer.read()
    lexer.skip()
    if isinstance(value, dict) and data.startswith(b"stream", lexer.at):
        body = lexer.at + 6
        body += 2 if data.startswith(b"\r\n", body) else data[body : body + 1] in (b"\n", b"\r")
        length = value.get("Length")
        length = resolve(length) if isinstance(length, Ref) else length
        end = body + length if isinstance(length, int) and not isinstance(length, bool) and length >= 0 else -1
        if end < 0 or end > len(data) or not ENDSTREAM.match(data, end):
            if not repair and end >= 0:
                raise PdfError(f"stream of object {ref.obj} has a wrong length")
            end = _stream_end(data, body, end)
        value = Stream(value, data[body:end], body, end)
        lexer.at = data.find(b"endstream", end) + 9
        lexer.skip()
    lexer.take(b"endobj")
    return Object(ref, value, start, lexer.at)


def _stream_end(data: bytes, body: int, declared: int) -> int:
    """Where the nearest `endstream` to the declared end lets the stream end; without a length, the first one."""
    if declared < 0:
        near = [data.find(b"endstream", body)]
    else:
        declared = min(declared, len(data))
        near = [data.rfind(b"endstream", max(body, declared - REPAIR_RADIUS), declared + 9), data.find(b"endstream", declared, declared + REPAIR_RADIUS)]
    near = [n for n in near if n >= body]
    if not near:
        raise PdfError("stream without end")
    end = min(near, key=lambda n: (abs(n - declared), n)) if declared >= 0 else near[0]
    if data[end - 2 : end] == b"\r\n" and end - 2 >= body:
        return end - 2
    return end - 1 if end > body and data[end - 1 : end] in (b"\n", b"\r") else end
