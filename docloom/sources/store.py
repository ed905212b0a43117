"""A PDF file as cross-reference entries, objects and pages, read from its bytes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import filters
from .crypto import Security
from .syntax import Lexer, read_object
from .values import Entry, Name, Object, PdfError, Ref, Stream, Text

HEADER = re.compile(rb"%PDF-(\d\.\d)")
OBJECT = re.compile(rb"(?:^|(?<=[\x00\t\n\x0c\r >]))(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj(?![A-Za-z])")
LETTER = (0.0, 0.0, 612.0, 792.0)
ROWS = re.compile(rb"(?:\d{10} \d{5} [nf](?: \r| \n|\r\n))*")


@dataclass(frozen=True)
class Budget:
    """What one document may cost by default."""

    source_bytes: int = 64_000_000
    pages: int = 10_000
    objects: int = 2_000_000
    depth: int = 64
    decoded_bytes: int = 256_000_000
    operators: int = 10_000_000
    image_pixels: int = 250_000_000
    cache_bytes: int = 256_000_000

    def __post_init__(self):
        for k, v in self.__dict__.items():
            if not isinstance(v, int) or isinstance(v, bool) or not 0 < v < 2**53:
                raise TypeError(f"{k} is a positive integer")


@dataclass(frozen=True)
class Policy:
    """allow, report or deny of each kind of content; repair safe or strict; encryption allow or forbid; permissions report or enforce."""

    javascript: str = "deny"
    launch: str = "deny"
    embedded_files: str = "report"
    repair: str = "safe"
    encryption: str = "allow"
    permissions: str = "report"
    budget: Budget = field(default_factory=Budget)

    def __post_init__(self):
        for k, most in (("javascript", ("allow", "report", "deny")), ("launch", ("allow", "report", "deny")), ("embedded_files", ("allow", "report", "deny")), ("repair", ("safe", "strict")), ("encryption", ("allow", "forbid")), ("permissions", ("report", "enforce"))):
            if getattr(self, k) not in most:
                raise TypeError(f"{k} is one of {', '.join(most)}")


@dataclass
class Page:
    number: int
    ref: Ref
    items: dict
    resources: dict
    media_box: tuple
    crop_box: tuple | None
    rotate: int
    contents: list[Ref]
    annotations: list


class Document:
    """An opened file. Objects are parsed when asked for."""

    def __init__(self, data: bytes, policy: Policy | None = None, passwords: tuple[str, ...] = ()):
        self.policy = policy or Policy()
        self.budget = self.policy.budget
        if len(data) > self.budget.source_bytes:
            raise PdfError("source over the limit", "resource-limit")
        self.data, self.repaired, self.held, self.streams, self.fonts = data, False, {}, {}, {}
        self.spent = {"decoded_bytes": 0, "operators": 0, "image_pixels": 0}
        found = HEADER.search(data[:1032])
        if not found or found.start() > 1023:
            raise PdfError("no PDF header")
        self.version = found[1].decode()
        self.entries: list[Entry] = []
        self.trailer: dict = {}
        try:
            self._chain()
            if not isinstance(self.resolve(self.trailer.get("Root")), dict):
                raise PdfError("no catalog")
        except (PdfError, IndexError, ValueError) as e:
            if self.policy.repair == "strict" or isinstance(e, PdfError) and e.code != "document-invalid":
                raise
            self._repair()
        self.security: Security | None = None
        if "Encrypt" in self.trailer:
            if self.policy.encryption == "forbid":
                raise PdfError("encrypted document", "encrypted-document-denied")
            at = self.trailer["Encrypt"]
            items = self.resolve(at)
            ids = self.resolve(self.trailer.get("ID")) or [b""]
            self.security = Security(items, bytes(ids[0]) if isinstance(ids[0], bytes) else b"", passwords, self.resolve)
            self.security.own = at if isinstance(at, Ref) else None
            self.held.clear()
            self.streams.clear()
        self.catalog = self.resolve(self.trailer.get("Root"))
        if not isinstance(self.catalog, dict):
            raise PdfError("no catalog")

    # Cross-reference data

    def _chain(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise PdfError("no startxref")
        where, seen, sections = Lexer(self.data, at + 9).integer(), set(), []
        if not 0 <= where < len(self.data):
            raise PdfError("startxref outside the file")
        todo = [where]
        while todo:
            at = todo.pop(0)
            if at in seen:
                raise PdfError("cross-reference sections form a cycle")
            seen.add(at)
            kind, entries, trailer = self._section(at)
            sections.append((at, kind, entries, trailer))
            hybrid, before = trailer.get("XRefStm"), trailer.get("Prev")
            if isinstance(hybrid, int) and hybrid not in seen:
                seen.add(hybrid)
                sections.append((hybrid, *self._section(hybrid)))
                sections[-1] = (hybrid, "hybrid", *sections[-1][2:])
            if isinstance(before, int):
                todo.append(before)
        self.trailer = sections[0][3]
        self._revise(reversed(sections))

    def _revise(self, sections) -> None:
        self.entries, self.latest = [], {}
        for revision, (at, kind, entries, _) in enumerate(sections):
            for seq, e in enumerate(entries):
                e.revision, e.section_offset, e.section_kind, e.seq = revision, at, kind, seq
                self.entries.append(e)
                self.latest[e.obj] = e
        if len(self.latest) > self.budget.objects:
            raise PdfError("too many objects", "resource-limit")

    def _section(self, at: int):
        lexer = Lexer(self.data, at)
        lexer.skip()
        if lexer.take(b"xref"):
            return self._table(lexer)
        stream = read_object(self.data, at, repair=self.policy.repair == "safe").value
        if not isinstance(stream, Stream) or stream.items.get("Type") != "XRef":
            raise PdfError(f"no cross-reference data at {at}")
        return "xref-stream", self._xref_stream(stream), stream.items

    def _table(self, lexer: Lexer):
        out = []
        while True:
            lexer.skip()
            if lexer.take(b"trailer"):
                items = lexer.read()
                if not isinstance(items, dict):
                    raise PdfError("trailer is not a dictionary")
                return "classic", out, items
            first, n = lexer.integer(), lexer.integer()
            if n > self.budget.objects:
                raise PdfError("too many objects", "resource-limit")
            lexer.skip()
            if n > 0 and ROWS.fullmatch(lexer.data, lexer.at, end := lexer.at + 20 * n) and end <= len(lexer.data):
                for k, at in enumerate(range(lexer.at, end, 20)):  # rows of 20 bytes, as the standard has them
                    offset, gen = int(lexer.data[at : at + 10]), int(lexer.data[at + 11 : at + 16])
                    if lexer.data[at + 17] == 110:
                        out.append(Entry(0, 0, "", 0, "uncompressed", first + k, gen, offset=offset))
                    else:
                        out.append(Entry(0, 0, "", 0, "free", first + k, gen, next_free=offset))
                lexer.at = end
                continue
            for k in range(n):
                offset, gen = lexer.integer(), lexer.integer()
                lexer.skip()
                mark = lexer.word()
                if mark == b"n":
                    out.append(Entry(0, 0, "", 0, "uncompressed", first + k, gen, offset=offset))
                elif mark == b"f":
                    out.append(Entry(0, 0, "", 0, "free", first + k, gen, next_free=offset))
                else:
                    raise PdfError("bad cross-reference entry")

    def _xref_stream(self, stream: Stream) -> list[Entry]:
        widths = stream.items.get("W")
        if not isinstance(widths, list) or len(widths) != 3 or not all(isinstance(w, int) and 0 <= w <= 8 for w in widths) or not sum(widths):
            raise PdfError("bad widths of a cross-reference stream")
        state, raw, _ = filters.decode(stream.items, stream.raw, self.resolve if hasattr(self, "latest") else lambda v: v, self.budget.decoded_bytes)
        if raw is None:
            raise PdfError("cross-reference stream cannot be decoded")
        index = stream.items.get("Index", [0, stream.items.get("Size", 0)])
        out, at, size = [], 0, sum(widths)
        for first, n in zip(index[::2], index[1::2]):
            for obj in range(first, first + n):
                row = raw[at : at + size]
                if len(row) < size:
                    raise PdfError("cross-reference stream ends early")
                at += size
                fields, k = [], 0
                for w in widths:
                    fields.append(int.from_bytes(row[k : k + w], "big"))
                    k += w
                kind = fields[0] if widths[0] else 1
                if kind == 0:
                    out.append(Entry(0, 0, "", 0, "free", obj, fields[2], next_free=fields[1]))
                elif kind == 1:
                    out.append(Entry(0, 0, "", 0, "uncompressed", obj, fields[2], offset=fields[1]))
                elif kind == 2:
                    out.append(Entry(0, 0, "", 0, "compressed", obj, 0, objstm=fields[1], objstm_index=fields[2]))
        return out

    def _repair(self) -> None:
        """Read the whole file for objects; the last trailer, or else a catalog that is found, is the root."""
        self.repaired, self.held, self.streams = True, {}, {}
        entries = [Entry(0, 0, "", 0, "uncompressed", int(m[1]), int(m[2]), offset=m.start(1)) for m in OBJECT.finditer(self.data)]
        if not entries:
            raise PdfError("no objects")
        self._revise([(0, "repair", entries, {})])
        self.trailer = {}
        for m in re.finditer(rb"trailer", self.data):
            try:
                items = Lexer(self.data, m.end()).read()
            except PdfError:
                continue
            if isinstance(items, dict) and "Root" in items:
                self.trailer = items
        members, catalog = [], None
        for e in list(self.latest.values()):
            try:
                value = self.get(Ref(e.obj, e.gen))
            except PdfError:
                continue
            items = value.items if isinstance(value, Stream) else value
            if isinstance(value, Stream) and items.get("Type") == "XRef" and "Root" in items and not self.trailer:
                self.trailer = {k: v for k, v in items.items() if k in ("Root", "Info", "ID", "Encrypt")}
            if isinstance(value, Stream) and items.get("Type") == "ObjStm":
                members.append(e.obj)
            if isinstance(items, dict) and items.get("Type") == "Catalog":
                catalog = Ref(e.obj, e.gen)
        for holder in members:
            try:
                for k, (obj, _) in enumerate(self._object_stream(holder)):
                    if obj not in self.latest:
                        e = Entry(0, 0, "repair", len(self.entries), "compressed", obj, 0, objstm=holder, objstm_index=k)
                        self.entries.append(e)
                        self.latest[obj] = e
            except PdfError:
                continue
        if "Root" not in self.trailer:
            catalog = catalog or next((r for r in self.refs() if isinstance(v := self._quiet(r), dict) and v.get("Type") == "Catalog"), None)
            if catalog is None:
                raise PdfError("no catalog")
            self.trailer = {"Root": catalog}

    def _quiet(self, ref: Ref):
        try:
            return self.get(ref)
        except PdfError:
            return None

    # Objects

    def refs(self) -> list[Ref]:
        return sorted(Ref(e.obj, e.gen) for e in self.latest.values() if e.kind != "free")

    def object(self, ref: Ref) -> Object | None:
        """The object itself, decrypted; None where the file has none."""
        if ref in self.held:
            return self.held[ref]
        e = self.latest.get(ref.obj)
        if e is None or e.kind == "free" or e.gen != ref.gen:
            return None
        self.held[ref] = None  # a value that needs itself finds nothing
        if e.kind == "compressed":
            pairs = self._object_stream(e.objstm)
            value = dict(pairs).get(ref.obj)
            found = Object(ref, value, 0, 0, e.revision)
        else:
            if not 0 <= e.offset < len(self.data):
                raise PdfError(f"object {ref.obj} outside the file")
            found = read_object(self.data, e.offset, self.resolve, self.policy.repair == "safe")
            if found.ref != ref:
                raise PdfError(f"object {ref.obj} is not at its place")
            found.revision = e.revision
            if getattr(self, "security", None) and ref != self.security.own:
                found.value = self._decrypted(found.value, ref)
        self.held[ref] = found
        return found

    def _decrypted(self, value, ref: Ref, key: str = "", signature: bool = False):
        s = self.security
        if isinstance(value, Text):
            if signature and key == "Contents":
                return value
            out = Text(s.string(bytes(value), ref))
            out.hexadecimal = value.hexadecimal
            return out
        if isinstance(value, list):
            return [self._decrypted(v, ref, key, signature) for v in value]
        if isinstance(value, dict):
            signed = value.get("Type") in ("Sig", "DocTimeStamp") or "ByteRange" in value
            return {k: self._decrypted(v, ref, k, signed) for k, v in value.items()}
        if isinstance(value, Stream):
            if value.items.get("Type") == "XRef":
                return value
            items = self._decrypted(value.items, ref)
            plain = value.items.get("Type") == "Metadata" and not s.metadata
            return Stream(items, value.raw if plain else s.stream(value.raw, ref, items), value.start, value.end)
        return value

    def get(self, ref: Ref):
        found = self.object(ref)
        return found.value if found else None

    def resolve(self, value):
        """What a value stands for: references are followed, streams stay."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.get(value)
        raise PdfError("references form a cycle")

    def dictionary(self, value) -> dict:
        value = self.resolve(value)
        value = value.items if isinstance(value, Stream) else value
        return value if isinstance(value, dict) else {}

    def array(self, value) -> list:
        value = self.resolve(value)
        return value if isinstance(value, list) else []

    def _object_stream(self, obj: int) -> list[tuple[int, object]]:
        if obj not in self.streams:
            e = self.latest.get(obj)
            stream = self.get(Ref(obj, e.gen)) if e else None
            if not isinstance(stream, Stream):
                raise PdfError(f"object stream {obj} is missing")
            raw = self.decoded(stream)
            if raw is None:
                raise PdfError(f"object stream {obj} cannot be decoded")
            n, first = self.resolve(stream.items.get("N")), self.resolve(stream.items.get("First"))
            if not isinstance(n, int) or not isinstance(first, int):
                raise PdfError("bad object stream")
            head = Lexer(raw)
            pairs = [(head.integer(), head.integer()) for _ in range(n)]
            self.streams[obj] = [(k, Lexer(raw, first + at).read()) for k, at in pairs]
        return self.streams[obj]

    def decode(self, stream: Stream) -> tuple[str, bytes | None, list[str]]:
        left = self.budget.decoded_bytes - self.spent["decoded_bytes"]
        state, raw, names = filters.decode(stream.items, stream.raw, self.resolve, left)
        self.spent["decoded_bytes"] += len(raw or b"")
        if self.spent["decoded_bytes"] > self.budget.decoded_bytes:
            raise PdfError("decoded bytes over the limit", "resource-limit")
        return state, raw, names

    def decoded(self, stream: Stream) -> bytes | None:
        return self.decode(stream)[1]

    # Pages

    def pages(self) -> list[Page]:
        out: list[Page] = []
        root = self.catalog.get("Pages")
        if isinstance(root, Ref):
            self._visit(root, {}, set(), out, 0)
        return out

    def _visit(self, ref: Ref, inherited: dict, above: set, out: list[Page], depth: int) -> None:
        if depth > self.budget.depth:
            raise PdfError("page tree nested too deeply", "resource-limit")
        if ref in above:
            if self.policy.repair == "strict":
                raise PdfError("page tree has a cycle")
            self.repaired = True
            return
        node = self.resolve(ref)
        if not isinstance(node, dict):
            return
        inherited = inherited | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
        if "Kids" in node or node.get("Type") == "Pages":
            for kid in self.array(node.get("Kids")):
                if isinstance(kid, Ref):
                    self._visit(kid, inherited, above | {ref}, out, depth + 1)
            return
        if len(out) >= self.budget.pages:
            raise PdfError("too many pages", "resource-limit")
        rotate = self.resolve(inherited.get("Rotate"))
        rotate = rotate % 360 if isinstance(rotate, int) and rotate % 90 == 0 else 0
        out.append(Page(len(out) + 1, ref, node, self.dictionary(inherited.get("Resources")), self.box(inherited.get("MediaBox")) or LETTER, self.box(inherited.get("CropBox")), rotate, self._references(node.get("Contents")), self.array(node.get("Annots"))))

    def _references(self, value) -> list[Ref]:
        """A reference to a stream, to an array, or an array itself, as the streams' references."""
        if isinstance(value, Ref) and isinstance(self.resolve(value), Stream):
            return [value]
        return [v for v in self.array(value) if isinstance(v, Ref)]

    def box(self, value) -> tuple | None:
        """A rectangle as (x, y, width, height), whatever corners it names."""
        sides = [self.resolve(v) for v in self.array(value)]
        if len(sides) != 4 or not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in sides):
            return None
        x0, y0, x1, y1 = map(float, sides)
        return (min(x0, x1), min(y0, y1), abs(x1 - x0), abs(y1 - y0))


# Where text strings' single bytes differ from Latin-1.
PDFDOC = dict(zip(range(0x18, 0x20), "˘ˇˆ˙˝˛˚˜")) | dict(zip(range(0x80, 0x9F), "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž")) | {0xA0: "€"}


def text_of(value) -> str | None:
    """A text string: UTF-16 with a mark, UTF-8 with one, or the document encoding; names as they are."""
    if isinstance(value, Name):
        return str(value)
    if not isinstance(value, bytes):
        return None
    if value[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return value[2:].decode("utf-16-be" if value[0] == 0xFE else "utf-16-le", "replace")
    if value[:3] == b"\xef\xbb\xbf":
        return value[3:].decode("utf-8", "replace")
    return "".join(PDFDOC.get(b) or chr(b) for b in value)
