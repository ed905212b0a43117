"""A deterministic PDF writer: corpora for tests and queries are made from plain text tables.

Pages hold 48 lines, 14 points apart from y = 720 at x = 72, in 12 points. Text is shown in a composite
font whose ToUnicode map names each code point, or as single bytes where latin is asked for.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

LINES, TOP, LEFT, STEP, SIZE = 48, 720, 72, 14, 12
ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def literal(raw: bytes) -> bytes:
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


class Writer:
    """Objects in, a file out: classic cross-reference tables or streams, object streams, filters, encryption, revisions."""

    def __init__(self):
        self.objects: dict[int, bytes] = {}
        self.last = 0
        self.trailer = b""

    def put(self, number: int, body: bytes | str) -> int:
        self.objects[number] = body.encode("latin-1") if isinstance(body, str) else body
        self.last = max(self.last, number)
        return number

    def add(self, body: bytes | str) -> int:
        return self.put(self.last + 1, body)

    def stream(self, number: int | None, raw: bytes, items: str = "", filters: str = "") -> int:
        """filters: names, first one to be undone first."""
        parts = filters.split()
        for name in reversed(parts):
            raw = encode(name, raw)
        names = f"/Filter [{' '.join('/' + n for n in parts)}] " if parts else ""
        body = f"<<{items} {names}/Length {len(raw)}>>\nstream\n".encode("latin-1") + raw + b"\nendstream"
        return self.add(body) if number is None else self.put(number, body)

    def file(self, root: int = 1, extra: str = "", packed: bool = False, keep: bytes = b"", version: str = "1.7") -> bytes:
        """packed: plain objects go into an object stream and a cross-reference stream closes the file; keep: an earlier revision to add to."""
        out = bytearray(keep or f"%PDF-{version}\n%\xe2\xe3\xcf\xd3\n".encode("latin-1"))
        before = int(keep[keep.rfind(b"startxref") + 9 :].split()[0]) if keep else None
        size = max(self.objects, default=0) + 1
        where: dict[int, tuple] = {}
        plain = {n: b for n, b in self.objects.items() if packed and b"stream\n" not in b}
        if plain:
            bodies, head, at = b"", [], 0
            for k, (n, b) in enumerate(sorted(plain.items())):
                head.append(f"{n} {len(bodies)}")
                bodies += b + b" "
                where[n] = (2, size, k)
            lead = " ".join(head).encode() + b" "
            holder, size = size, size + 1
            raw = zlib.compress(lead + bodies)
            self.objects = dict(self.objects)
            self.objects[holder] = f"<</Type/ObjStm/N {len(plain)}/First {len(lead)}/Filter/FlateDecode/Length {len(raw)}>>\nstream\n".encode() + raw + b"\nendstream"
        for n, b in sorted(self.objects.items()):
            if n in plain:
                continue
            where[n] = (1, len(out), 0)
            out += f"{n} 0 obj\n".encode() + b + b"\nendobj\n"
        at = len(out)
        prev = f"/Prev {before}" if before is not None else ""
        if packed:
            where[size] = (1, at, 0)
            rows = b"".join(bytes([k]) + a.to_bytes(4, "big") + g.to_bytes(2, "big") for k, a, g in ((where.get(n, (0, 0, 65535 if n == 0 else 0))) for n in range(size + 1)))
            raw = zlib.compress(rows)
            out += f"{size} 0 obj\n<</Type/XRef/Size {size + 1}/W[1 4 2]/Root {root} 0 R{extra}{prev}/Filter/FlateDecode/Length {len(raw)}>>\nstream\n".encode("latin-1") + raw + b"\nendstream\nendobj\n"
        else:
            out += b"xref\n"
            numbers = sorted(where) if keep else range(size)
            for n in numbers:
                if keep or n == 0:
                    out += f"{n} {1 if keep else size}\n".encode()
                out += f"{where[n][1]:010d} 00000 n \n".encode() if n in where else b"0000000000 65535 f \n"
            out += f"trailer\n<</Size {size}/Root {root} 0 R{extra}{prev}>>\n".encode("latin-1")
        return bytes(out + f"startxref\n{at}\n%%EOF\n".encode())


def encode(name: str, raw: bytes) -> bytes:
    """The inverse of a filter."""
    import base64

    if name == "FlateDecode":
        return zlib.compress(raw)
    if name == "ASCIIHexDecode":
        return raw.hex().encode() + b">"
    if name == "ASCII85Decode":
        return base64.a85encode(raw) + b"~>"
    if name == "RunLengthDecode":
        out, at = bytearray(), 0
        while at < len(raw):
            n = 1
            while n < 128 and raw[at : at + 1] == raw[at + n : at + n + 1]:
                n += 1
            if n > 1:
                out += bytes([257 - n]) + raw[at : at + 1]
            else:
                n = 1
                out += b"\0" + raw[at : at + 1]
            at += n
        return bytes(out + b"\x80")
    if name == "LZWDecode":
        known, width, bits, held, out = {bytes([i]): i for i in range(256)}, 9, 0, 0, bytearray()

        def put(code):
            nonlocal bits, held
            held, bits = held << width | code, bits + width
            while bits >= 8:
                bits -= 8
                out.append(held >> bits)
                held &= (1 << bits) - 1

        put(256)
        size, word = 258, b""
        for c in raw:
            c = bytes([c])
            if word + c in known:
                word += c
                continue
            put(known[word])
            known[word + c] = size
            size += 1
            # The reader lags one entry behind and widens one code early.
            if size == 4095:
                put(256)
                known, size, width = {bytes([i]): i for i in range(256)}, 258, 9
            else:
                width = max(9, size.bit_length())
            word = c
        if word:
            put(known[word])
            size += 1
            width = min(12, max(9, size.bit_length()))
        put(257)
        if bits:
            out.append(held << 8 - bits & 255)
        return bytes(out)
    raise ValueError(name)


def unicode_map(points: list[int]) -> bytes:
    """A ToUnicode map that gives each of the code points (below U+10000) itself."""
    lines = [f"<{p:04X}> <{p:04X}>" for p in points]
    body = "".join(f"{len(lines[k : k + 100])} beginbfchar\n" + "\n".join(lines[k : k + 100]) + "\nendbfchar\n" for k in range(0, len(lines), 100))
    return ("/CIDInit /ProcSet findresource begin begincmap\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n" + body + "endcmap end").encode()


def lines_of(text: str | None) -> list[str]:
    """The lines that a document shows: blanks in a row are one, empty ones are left out."""
    return [line for line in (" ".join(raw.split()) for raw in (text or "").split("\n")) if line]


def text_pdf(text: str | None, latin: bool = False, packed: bool = False, filters: str = "FlateDecode", title: str | None = None, labels: str = "", extras=None, done=None) -> bytes:
    """A PDF of a text. extras(writer, pages): puts in more objects and gives (catalog entries, entries of page 1); done(writer): makes the file, if it isn't a plain one."""
    lines = lines_of(text)
    pages = [lines[k : k + LINES] for k in range(0, len(lines), LINES)] or [[]]
    w = Writer()
    for n in (1, 2, 3):
        w.put(n, b"")
    points = sorted(p for p in map(ord, set().union(*lines)) if p < 0x10000)
    if latin:
        w.put(3, "<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>")
    else:
        map_ = w.stream(None, unicode_map(points), filters=filters)
        below = w.add("<</Type/Font/Subtype/CIDFontType2/BaseFont/Synth/CIDSystemInfo<</Registry(Adobe)/Ordering(Identity)/Supplement 0>>>>")
        w.put(3, f"<</Type/Font/Subtype/Type0/BaseFont/Synth/Encoding/Identity-H/DescendantFonts[{below} 0 R]/ToUnicode {map_} 0 R>>")
    numbers = []
    for own in pages:
        shown = []
        for k, line in enumerate(own):
            raw = literal(line.encode("cp1252", "replace")) if latin else b"<%s>" % ASTRAL.sub("\ufffd", line).encode("utf-16-be", "surrogatepass").hex().upper().encode()
            shown.append(b"1 0 0 1 %d %d Tm %s Tj" % (LEFT, TOP - STEP * k, raw))
        content = w.stream(None, b"BT /F1 %d Tf\n" % SIZE + b"\n".join(shown) + b"\nET", filters=filters)
        numbers.append((w.add(b""), content))
    root_more, page_more = extras(w, [n for n, _ in numbers]) if extras else ("", "")
    for k, (n, content) in enumerate(numbers):
        w.put(n, f"<</Type/Page/Parent 2 0 R/Contents {content} 0 R{page_more if k == 0 else ''}>>")
    w.put(2, f"<</Type/Pages/Count {len(numbers)}/Kids[{' '.join(f'{n} 0 R' for n, _ in numbers)}]/MediaBox[0 0 612 792]/Resources<</Font<</F1 3 0 R>>>>>>")
    info = ""
    if title is not None:
        info = f"/Info {w.add('<</Title <FEFF' + title.encode('utf-16-be').hex().upper() + '>>>')} 0 R"
    w.put(1, f"<</Type/Catalog/Pages 2 0 R{labels}{root_more}>>")
    return done(w) if done else w.file(extra=info, packed=packed)


@lru_cache(1024)
def owner_entry(user: str, owner: str) -> bytes:
    """/O of revision 3 and 4, which only the passwords tell."""
    from .crypto import PADDING, rc4

    k = hashlib.md5((owner.encode("latin-1") + PADDING)[:32]).digest()
    for _ in range(50):
        k = hashlib.md5(k).digest()
    o = (user.encode("latin-1") + PADDING)[:32]
    for i in range(20):
        o = rc4(bytes(b ^ i for b in k), o)
    return o


def encrypted(w: Writer, user: str, owner: str, p: int = -4, aes: bool = False) -> bytes:
    """A file of the writer's objects under revision 3 (RC4) or 4 (AES-128); streams are encrypted, strings are hexadecimal or none."""
    from .crypto import PADDING, Aes, rc4

    file_id = hashlib.md5(repr(sorted(w.objects.items())).encode()).digest()
    o = owner_entry(user, owner)
    key = hashlib.md5((user.encode("latin-1") + PADDING)[:32] + o + (p & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()
    for _ in range(50):
        key = hashlib.md5(key).digest()
    u = hashlib.md5(PADDING + file_id).digest()
    for i in range(20):
        u = rc4(bytes(b ^ i for b in key), u)
    for n, body in list(w.objects.items()):
        head, found, rest = body.partition(b"\nstream\n")
        if found:
            raw = rest.removesuffix(b"\nendstream")
            own = hashlib.md5(key + n.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if aes else b"")).digest()
            if aes:
                fill, iv = 16 - len(raw) % 16, hashlib.md5(b"iv%d" % n).digest()
                raw = iv + Aes(own).cbc_encrypt(iv, raw + bytes([fill]) * fill)
            else:
                raw = rc4(own, raw)
            head = head[: head.rindex(b"/Length")] + b"/Length %d>>" % len(raw)
            w.objects[n] = head + found + raw + b"\nendstream"
    cf = "/V 4/R 4/CF<</StdCF<</CFM/AESV2/Length 16>>>>/StmF/StdCF/StrF/StdCF" if aes else "/V 2/R 3"
    at = w.add(f"<</Filter/Standard{cf}/Length 128/P {p}/O<{o.hex()}>/U<{u.hex()}{'00' * 16}>>>")
    return w.file(extra=f"/Encrypt {at} 0 R/ID[<{file_id.hex()}><{file_id.hex()}>]")
