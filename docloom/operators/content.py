"""Content streams: tokens to instructions, and the graphics state machine that places text, paths and images."""

from __future__ import annotations

import math
import re
from binascii import unhexlify

from ..functions.textmap import Font, ascii_text
from ..sources.syntax import Lexer, name_of
from ..sources.values import Name, PdfError, Ref, Stream, Text, format_number, format_value

OPERATOR = re.compile(rb"[A-Za-z'\"][A-Za-z0-9*'\"]*")
# An operator, an integer, a hexadecimal string or a name at once; what it doesn't match is read step by step.
_END = rb"(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])"
COMMON = re.compile(rb"[\x00\t\n\x0c\r ]*(?:(?!(?:true|false|null)(?![A-Za-z0-9*'\"]))([A-Za-z'\"][A-Za-z0-9*'\"]*)|([+-]?\d{1,15})" + _END + rb"|<((?:[0-9A-Fa-f]{2})*)>|/([^\x00\t\n\x0c\r ()<>\[\]{}/%#]*)(?!#))")
IMAGE_END = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)")
CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")
SPACE_GAP = -120  # thousandths of the font size: a move this far left between shown strings is a blank
# Characters at a seam that keep it closed.
SHUT_BEFORE, SHUT_AFTER = "-'/(", "-'),.:;%]"
PAINT = {"S": "stroke", "s": "stroke", "f": "fill", "F": "fill", "f*": "fill", "B": "fill-stroke", "B*": "fill-stroke", "b": "fill-stroke", "b*": "fill-stroke", "n": "none"}
CLOSES = ("s", "b", "b*")
SPACES = {"g": ("device-gray", False), "G": ("device-gray", True), "rg": ("device-rgb", False), "RG": ("device-rgb", True), "k": ("device-cmyk", False), "K": ("device-cmyk", True)}
NAMED_SPACES = {"DeviceGray": "device-gray", "G": "device-gray", "DeviceRGB": "device-rgb", "RGB": "device-rgb", "DeviceCMYK": "device-cmyk", "CMYK": "device-cmyk", "CalGray": "cal-gray", "CalRGB": "cal-rgb", "Lab": "lab", "ICCBased": "icc-based", "Indexed": "indexed", "I": "indexed", "Pattern": "pattern", "Separation": "separation", "DeviceN": "device-n"}
CAPS, JOINS = ("butt", "round", "square"), ("miter", "round", "bevel")


def multiply(a, b):
    """a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def apply(m, x, y):
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def display(page) -> tuple:
    """From user space to the page as it is shown: its box moved to the origin, turned by /Rotate."""
    x, y, w, h = page.crop_box or page.media_box
    move = (1.0, 0.0, 0.0, 1.0, -x, -y)
    turn = {0: UNIT, 90: (0.0, -1.0, 1.0, 0.0, 0.0, w), 180: (-1.0, 0.0, 0.0, -1.0, w, h), 270: (0.0, 1.0, -1.0, 0.0, h, 0.0)}[page.rotate]
    return multiply(move, turn)


def instructions(parts: list[tuple[Ref, bytes]], budget: int = 10_000_000):
    """(operator, operands, stream) of all of a page's streams, which are one text with line ends between; an instruction is its start's stream's."""
    data = b"\n".join(raw for _, raw in parts)
    ends, at = [], 0
    for ref, raw in parts:
        at += len(raw) + 1
        ends.append((at, ref))
    lexer, operands, began, n, which = Lexer(data), [], None, 0, 0
    while True:
        found = COMMON.match(data, lexer.at)
        if found and (kind := found.lastindex) > 1:
            began = found.start(kind) if began is None else began
            lexer.at = found.end()
            if kind == 2:
                operands.append(int(found[2]))
            elif kind == 3:
                operands.append(value := Text(unhexlify(found[3])))
                value.hexadecimal = True
            else:
                operands.append(name_of(found[4]))
            continue
        lexer.skip()
        if lexer.at >= len(data):
            if operands:
                raise PdfError("operands without an operator")
            return
        start = lexer.at
        began = start if began is None else began
        found = OPERATOR.match(data, start)
        if not found or found[0] in (b"true", b"false", b"null"):
            operands.append(lexer.read(references=False))
            continue
        lexer.at = found.end()
        name = found[0].decode()
        n += 1
        if n > budget:
            raise PdfError("too many operators", "resource-limit")
        if name == "BI":
            operands = [_inline(lexer)]
        while which + 1 < len(ends) and ends[which][0] <= began:
            which += 1
        yield name, operands, ends[which][1]
        operands, began = [], None


def _inline(lexer: Lexer) -> Stream:
    items: dict = {}
    while True:
        lexer.skip()
        if lexer.take(b"ID"):
            break
        key = lexer.read(references=False)
        items[key] = lexer.read(references=False)
    start = lexer.at + 1
    found = IMAGE_END.search(lexer.data, start)
    if not found:
        raise PdfError("inline image without end")
    lexer.at = found.end()
    return Stream(items, lexer.data[start : found.start()], start, found.start())


def seam(left: str, right: str, gap: float | None) -> str:
    """What stands between two strings of one array: a blank where the move is wide and neither side keeps the seam closed."""
    a, b = left.rstrip(), right.lstrip()
    wide = gap is not None and gap <= SPACE_GAP
    return " " if wide and a and b and a[-1] not in SHUT_BEFORE and b[0] not in SHUT_AFTER else ""


def unreadable(text: str) -> bool:
    """Control characters and hardly any letters or digits."""
    control = sum(c < " " and c not in "\t\n" or "\x7f" <= c <= "\x9f" for c in text)
    solid = sum(c.isalnum() for c in text)
    return bool(control) and (not solid or control / len(text) > 0.25 and solid / len(text) < 0.3)


def spoken(actual: str | None, shown: str) -> str | None:
    """The replacement text of a marked span, if it is no shorter than what is shown or that cannot be read."""
    clean = re.sub(r"[^\S\n]+", " ", re.sub(r"\r\n?", "\n", actual or "")).strip()
    return clean if clean and (unreadable(shown) or len(clean) >= len(shown.strip())) else None


def normal(text: str) -> str:
    """Control characters are blanks, blanks in a row are one, none at the ends."""
    if "  " not in text and text.isprintable():
        return text.strip()
    return re.sub(r" +", " ", CONTROL.sub(" ", text)).strip()


class Visible:
    """Which optional content is shown: hidden wins over unknown over visible."""

    def __init__(self, doc):
        properties = doc.dictionary(doc.catalog.get("OCProperties"))
        config = doc.dictionary(properties.get("D"))
        self.doc = doc
        self.base = {"OFF": "hidden", "Unchanged": "unknown"}.get(config.get("BaseState"), "visible")
        self.state = {r: "visible" for r in doc.array(config.get("ON")) if isinstance(r, Ref)} | {r: "hidden" for r in doc.array(config.get("OFF")) if isinstance(r, Ref)}
        self.groups = {r for r in doc.array(properties.get("OCGs")) if isinstance(r, Ref)}

    def of(self, value, depth: int = 0) -> str:
        items = self.doc.dictionary(value)
        if items.get("Type") != "OCMD":
            if isinstance(value, Ref) and value in self.groups:
                return self.state.get(value, self.base)
            return "unknown"
        members = self.doc.resolve(items.get("OCGs"))
        members = [items["OCGs"]] if isinstance(members, dict) else members if isinstance(members, list) else []
        states = [self.of(m, depth + 1) for m in members] if depth < 32 else ["unknown"]
        if not states:
            return "visible"
        policy = items.get("P", "AnyOn")
        wanted, every = {"AllOn": ("visible", True), "AnyOn": ("visible", False), "AnyOff": ("hidden", False), "AllOff": ("hidden", True)}.get(policy, ("visible", False))
        hits = [s == wanted for s in states]
        if every:
            return "hidden" if any(not h and s != "unknown" for h, s in zip(hits, states)) else "unknown" if "unknown" in states else "visible"
        return "visible" if any(hits) else "unknown" if "unknown" in states else "hidden"


class Observer:
    """One page's text runs and marks."""

    def __init__(self, doc, page, visible: Visible | None = None, listed: bool = False):
        """listed: the instructions are kept too."""
        self.doc, self.page, self.listed = doc, page, listed
        self.visible = visible or Visible(doc)
        self.runs: list[dict] = []
        self.marks: list[dict] = []
        self.operators: list[dict] = []
        self.fallback: str | None = None
        self.gaps = 0
        self.fonts: dict = {}
        try:
            self._walk()
        except PdfError as e:
            if e.code != "document-invalid":
                raise
            self.fallback = str(e)

    def _font(self, name):
        if name in self.fonts:
            return self.fonts[name]
        value = self.doc.dictionary(self.page.resources.get("Font")).get(name)
        if name not in self.fonts:
            ref = value if isinstance(value, Ref) else None
            if ref is None or ref not in self.doc.fonts:  # a font is made once for all of the document's pages
                items = self.doc.dictionary(value)
                font = Font(self.doc, items) if items else None
                if ref:
                    self.doc.fonts[ref] = font
            self.fonts[name] = (self.doc.fonts[ref] if ref else font, ref)
        return self.fonts[name]

    def _walk(self) -> None:
        doc, page = self.doc, self.page
        parts = [(r, doc.decoded(doc.resolve(r)) or b"") for r in page.contents if isinstance(doc.resolve(r), Stream)]
        shown = display(page)
        fresh = {"ctm": UNIT, "font": None, "size": 0.0, "leading": 0.0, "rise": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "mode": 0, "fill": ("device-gray", (0.0,)), "stroke": ("device-gray", (0.0,)), "width": 1.0, "cap": "butt", "join": "miter", "dash": ((), 0.0), "alpha": 1.0, "stroke_alpha": 1.0, "blend": "Normal", "mask": False}
        state, saved, tm, tlm, path, clip, marked, fresh_line = dict(fresh), [], UNIT, UNIT, [], None, [], True
        order = 0

        def numbers(ops, n):
            out = [float(v) for v in ops if isinstance(v, (int, float)) and not isinstance(v, bool)]
            if len(out) < n:
                raise PdfError("operands missing")
            return out

        def mark(kind, **more):
            inside = [m for m in marked if m.get("id")]
            vis = "hidden" if any(m["visibility"] == "hidden" for m in marked) else "unknown" if any(m["visibility"] == "unknown" for m in marked) else "visible"
            self.marks.append({"id": f"mark-{kind}-{page.number}-{order + 1}", "content_order": order, "kind": kind, "marked_content_id": inside[-1]["id"] if inside else None, "visibility": vis, **more})

        def show(strings, stream):
            nonlocal tm, order, fresh_line
            font, ref = self._font(state["font"]) if state["font"] is not None else (None, None)
            text, complete, gap, units, mapped = "", True, None, 0, 0
            said = next((m["actual_text"] for m in reversed(marked) if m["actual_text"]), None)
            for s in strings:
                if not isinstance(s, bytes):
                    gap = s
                    continue
                got, ok, codes, known = font.decode(s) if font else ascii_text(s)
                if said and not s.hexadecimal and (better := spoken(said, got)) is not None:
                    got, ok, known = better, True, codes
                units, mapped = units + codes, mapped + known
                text, complete, gap = text + seam(text, got, gap) + got, complete and ok, None
            clean = normal(text)
            m = multiply(tm, multiply(state["ctm"], shown))
            if clean:
                x, y = apply(m, 0.0, state["rise"])
                size = abs(state["size"]) * math.hypot(m[2], m[3])
                vertical = font is not None and font.vertical or abs(m[1]) > 1.5 * abs(m[0])
                number = order + 1
                self.runs.append({"id": f"run-{page.number}-{number}", "content_order": order, "text": clean, "glyph_count": len(clean), "encoding_kind": font.kind if font else "unknown", "mapping_source": font.kind if font else None, "writing_mode": "vertical" if vertical else "horizontal", "x": x, "y": y, "font_size": size, "starts_new_line": fresh_line, "font": ref, "stream": stream, "complete": complete, "source_units": units, "mapped_units": mapped})
                self.gaps += not complete
                mark("text", text=clean, run_id=f"run-{page.number}-{number}", x=x, y=y, stream=stream, paint="invisible" if state["mode"] == 3 else "shown")
                order += 1
                fresh_line = False
            # Widths are not kept: a run moves on by half its size a character.
            advance = sum(len(s) * state["size"] * 0.5 if isinstance(s, bytes) else -s / 1000 * state["size"] for s in strings) * state["scale"]
            tm = multiply((1.0, 0.0, 0.0, 1.0, advance, 0.0), tm)

        def move(x, y):
            nonlocal tm, tlm, fresh_line
            tlm = multiply((1.0, 0.0, 0.0, 1.0, x, y), tlm)
            tm, fresh_line = tlm, True

        for index, (op, ops, stream) in enumerate(instructions(parts, doc.budget.operators)):
            doc.spent["operators"] += 1
            if doc.spent["operators"] > doc.budget.operators:
                raise PdfError("too many operators", "resource-limit")
            if self.listed:
                self.operators.append({"op_index": index, "operator": op, "operands": [self._operand(v) for v in ops], "stream": stream})
            if op == "q":
                saved.append(dict(state))
            elif op == "Q":
                state = saved.pop() if saved else dict(fresh)
            elif op == "cm":
                state["ctm"] = multiply(tuple(numbers(ops, 6)[:6]), state["ctm"])
            elif op == "BT":
                tm = tlm = UNIT
                fresh_line = True
            elif op == "Tf" and len(ops) == 2:
                state["font"], state["size"] = ops[0], numbers(ops[1:], 1)[0]
            elif op in ("TL", "Tc", "Tw", "Ts", "Tr"):
                state[{"TL": "leading", "Tc": "char", "Tw": "word", "Ts": "rise", "Tr": "mode"}[op]] = numbers(ops, 1)[0]
            elif op == "Tz":
                state["scale"] = numbers(ops, 1)[0] / 100
            elif op in ("Td", "TD"):
                x, y = numbers(ops, 2)[:2]
                if op == "TD":
                    state["leading"] = -y
                move(x, y)
            elif op == "Tm":
                tm = tlm = tuple(numbers(ops, 6)[:6])
                fresh_line = True
            elif op == "T*":
                move(0.0, -state["leading"])
            elif op == "Tj" and ops and isinstance(ops[0], Text):
                show([ops[0]], stream)
            elif op == "TJ" and ops and isinstance(ops[0], list):
                show([v for v in ops[0] if isinstance(v, (bytes, int, float))], stream)
            elif op in ("'", '"') and ops and isinstance(ops[-1], Text):
                if op == '"' and len(ops) == 3:
                    state["word"], state["char"] = numbers(ops[:2], 2)
                move(0.0, -state["leading"])
                show([ops[-1]], stream)
            elif op in ("w", "J", "j", "d"):
                if op == "w":
                    state["width"] = numbers(ops, 1)[0]
                elif op == "d" and isinstance(ops[0], list):
                    state["dash"] = (tuple(numbers(ops[0], 0)), numbers(ops[1:], 1)[0])
                else:
                    names, k = (CAPS, "cap") if op == "J" else (JOINS, "join")
                    v = int(numbers(ops, 1)[0])
                    state[k] = names[v] if 0 <= v < 3 else "unknown"
            elif op in SPACES:
                space, stroke = SPACES[op]
                state["stroke" if stroke else "fill"] = (space, tuple(numbers(ops, 1)))
            elif op in ("cs", "CS"):
                state["stroke" if op == "CS" else "fill"] = (self._space(ops[0]), ())
            elif op in ("sc", "scn", "SC", "SCN"):
                k = "stroke" if op[0] == "S" else "fill"
                state[k] = (state[k][0], tuple(numbers(ops, 0)))
            elif op == "gs":
                self._graphics(state, ops[0])
            elif op in ("m", "l", "c", "v", "y", "re"):
                path.append((op, numbers(ops, {"m": 2, "l": 2, "c": 6, "re": 4}.get(op, 4)), state["ctm"]))
            elif op == "h":
                path.append(("h", [], state["ctm"]))
            elif op in ("W", "W*"):
                clip = "even-odd" if op == "W*" else "nonzero"
            elif op in PAINT:
                if op in CLOSES and path:
                    path.append(("h", [], state["ctm"]))
                if path and (PAINT[op] != "none" or clip):
                    shape = self._shape(path, shown)
                    if clip:
                        mark("clip", rule=clip, **shape)
                        order += 1
                    if PAINT[op] != "none":
                        mark("path", paint=PAINT[op], rule="even-odd" if op.endswith("*") else "nonzero", fill=state["fill"], stroke=state["stroke"], width=state["width"], cap=state["cap"], join=state["join"], dash=state["dash"], alpha=state["alpha"], stroke_alpha=state["stroke_alpha"], blend=state["blend"], soft_mask=state["mask"], **shape)
                        order += 1
                path, clip = [], None
            elif op == "Do" and ops:
                value = doc.dictionary(page.resources.get("XObject")).get(ops[0])
                items = doc.dictionary(value)
                kind = "image" if items.get("Subtype") == "Image" else "xobject"
                m = multiply(state["ctm"], shown)
                box = doc.box(items.get("BBox")) if kind == "xobject" else (0.0, 0.0, 1.0, 1.0)
                if kind == "xobject" and len(own := [doc.resolve(v) for v in doc.array(items.get("Matrix"))]) == 6:
                    m = multiply(tuple(map(float, own)), m)
                bounds = self._bounds([apply(m, box[0] + dx * box[2], box[1] + dy * box[3]) for dx in (0, 1) for dy in (0, 1)]) if box else None
                mark(kind, name=str(ops[0]), resource=value if isinstance(value, Ref) else None, bbox=bounds, transform=m)
                order += 1
            elif op == "BI":
                m = multiply(state["ctm"], shown)
                mark("image", name=None, resource=None, inline=ops[0], stream=stream, bbox=self._bounds([apply(m, x, y) for x in (0, 1) for y in (0, 1)]), transform=m)
                order += 1
            elif op in ("BMC", "BDC"):
                tag = str(ops[0]) if ops else ""
                value = ops[1] if op == "BDC" and len(ops) > 1 else {}
                if isinstance(value, Name):
                    value = doc.dictionary(page.resources.get("Properties")).get(value)
                items = doc.dictionary(value)
                vis = self.visible.of(value) if tag == "OC" else "visible"
                own = f"mark-marked-content-{page.number}-{order + 1}"
                from ..sources.store import text_of

                marked.append({"id": own, "visibility": vis, "actual_text": text_of(doc.resolve(items.get("ActualText")))})

                kind = {"Artifact": "artifact", "Span": "span"}.get(tag, "other")
                mark("marked-content", tag=tag, content_kind=kind, mcid=items.get("MCID") if isinstance(items.get("MCID"), int) else None, actual_text=text_of(doc.resolve(items.get("ActualText"))), alternate_text=text_of(doc.resolve(items.get("Alt"))))
                self.marks[-1]["marked_content_id"] = marked[-2]["id"] if len(marked) > 1 else None
                order += 1
            elif op == "EMC" and marked:
                marked.pop()

    def _operand(self, v):
        if isinstance(v, Stream):
            return "inline-image", format_value(v.items)
        kind = "text" if isinstance(v, Text) else "name" if isinstance(v, Name) else "array" if isinstance(v, list) else "dictionary" if isinstance(v, dict) else "number" if isinstance(v, (int, float)) and not isinstance(v, bool) else "other"
        return kind, format_value(v)

    def _space(self, value):
        known = self.doc.dictionary(self.page.resources.get("ColorSpace")).get(value) if isinstance(value, Name) and value not in NAMED_SPACES else value
        known = self.doc.resolve(known)
        known = self.doc.resolve(known[0]) if isinstance(known, list) and known else known
        return NAMED_SPACES.get(known, "unknown") if isinstance(known, str) else "unknown"

    def _graphics(self, state, name) -> None:
        items = self.doc.dictionary(self.doc.dictionary(self.page.resources.get("ExtGState")).get(name))
        for key, k in (("ca", "alpha"), ("CA", "stroke_alpha"), ("LW", "width")):
            v = self.doc.resolve(items.get(key))
            if isinstance(v, (int, float)):
                state[k] = float(v)
        blend = self.doc.resolve(items.get("BM"))
        blend = blend[0] if isinstance(blend, list) and blend else blend
        state["blend"] = str(blend) if isinstance(blend, Name) else state["blend"]
        if "SMask" in items:
            state["mask"] = self.doc.resolve(items["SMask"]) != "None"

    @staticmethod
    def _bounds(points):
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        return (min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys))

    def _shape(self, path, shown):
        points, segments, closed = [], [], False
        here = (0.0, 0.0)
        for op, v, ctm in path:
            m = multiply(ctm, shown)
            if op == "re":
                x, y, w, h = v[:4]
                corners = [apply(m, a, b) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
                points += corners
                segments.append(("rect", *corners[0], w, h))
                closed, here = True, (x, y)
            elif op == "h":
                closed = True
                segments.append(("close",))
            else:
                pairs = list(zip(v[::2], v[1::2]))
                if op == "v":
                    pairs = [here, *pairs]
                elif op == "y":
                    pairs = [*pairs, pairs[-1]]
                got = [apply(m, *p) for p in pairs]
                points += got
                segments.append(({"m": "move", "l": "line"}.get(op, "curve"), *(c for p in got for c in p)))
                here = pairs[-1]
        return {"bbox": self._bounds(points) if points else None, "point_count": len(points), "closed": closed, "segments": segments}


def glyph_ids(page_number: int, content_order: int, count: int) -> list[str]:
    """The ids of a run's glyphs, which rows only count."""
    return [f"glyph-{page_number}-{content_order + 1}-{i + 1}" for i in range(count)]


def color_text(color) -> str:
    return f"{color[0]}({','.join(format_number(c) for c in color[1])})"
