"""From the bytes that a page shows to Unicode: ToUnicode maps, single-byte encodings, embedded fonts."""

from __future__ import annotations

import re
import struct
import unicodedata

from ..sources.values import Name, Stream

# CMaps

LIMIT = 262_144
HEX = r"<([0-9A-Fa-f\s]*)>"


def _code(digits: str) -> bytes:
    try:
        return bytes.fromhex(digits)
    except ValueError:  # blanks inside a pair, or none of ASCII's
        return bytes.fromhex(re.sub(r"\s", "", digits))


def _utf16(digits: str) -> str:
    if len(digits) == 4 and digits.isalnum() and not "D8" <= digits[:2].upper() <= "DF":
        return chr(int(digits, 16))
    raw = bytes.fromhex(re.sub(r"\s", "", digits).zfill(4) if len(re.sub(r"\s", "", digits)) < 4 else re.sub(r"\s", "", digits))
    return raw.decode("utf-16-be", "replace")


class Texts(dict):
    """Characters' numbers to texts, for str.translate; what has none is U+FFFD."""

    def __missing__(self, key):
        return "\ufffd"


class CMap:
    """Codes (as bytes) to text, with the lengths that codes may have."""

    def __init__(self, source: str):
        self.map: dict[bytes, str] = {}
        self.spaces: list[tuple[bytes, bytes]] = []
        clean = _code
        for body in re.findall(r"begincodespacerange(.*?)endcodespacerange", source, re.S):
            self.spaces += [(clean(a), clean(b)) for a, b in re.findall(HEX + r"\s*" + HEX, body)]
        for body in re.findall(r"beginbfchar(.*?)endbfchar", source, re.S):
            for code, text in re.findall(HEX + r"\s*" + HEX, body):
                self._put(clean(code), _utf16(text))
        for body in re.findall(r"beginbfrange(.*?)endbfrange", source, re.S):
            for low, high, direct, listed in re.findall(HEX + r"\s*" + HEX + r"\s*(?:" + HEX + r"|\[(.*?)\])", body, re.S):
                a, b = clean(low), clean(high)
                n = int.from_bytes(b, "big") - int.from_bytes(a, "big") + 1
                texts = re.findall(HEX, listed) if listed else None
                for k in range(max(0, min(n, LIMIT))):
                    code = (int.from_bytes(a, "big") + k).to_bytes(len(a), "big")
                    if texts is not None:
                        if k < len(texts):
                            self._put(code, _utf16(texts[k]))
                    elif direct:
                        base = _utf16(direct)
                        self._put(code, base[:-1] + chr(ord(base[-1]) + k) if base else "")
        self.lengths = sorted({len(c) for c in self.map} | {len(a) for a, _ in self.spaces}, reverse=True)
        # Codes of one or two bytes, none of them a surrogate, are characters that str.translate knows.
        plain = len(self.lengths) == 1 and self.lengths[0] in (1, 2) and not any("\ufffd" in t for t in self.map.values())
        self.texts = Texts({int.from_bytes(c, "big"): t for c, t in self.map.items()}) if plain else None

    def _put(self, code: bytes, text: str) -> None:
        if len(self.map) < LIMIT:
            self.map[code] = text

    def decode(self, raw: bytes) -> tuple[str, bool, int, int]:
        """(text, complete, units, mapped units): the longest code first, what no code fits is U+FFFD."""
        if self.texts is not None and len(raw) % self.lengths[0] == 0:
            try:
                codes = raw.decode("latin-1" if self.lengths[0] == 1 else "utf-16-be")
            except UnicodeDecodeError:
                codes = ""
            if len(codes) * self.lengths[0] == len(raw):
                text = codes.translate(self.texts)
                lost = text.count("\ufffd")
                return text, not lost, len(codes), len(codes) - lost
        if len(self.lengths) == 1:  # codes of one length need no search
            k, get = self.lengths[0], self.map.get
            parts = [get(raw[i : i + k]) for i in range(0, len(raw), k)]
            lost = parts.count(None)
            if not lost:
                return "".join(parts), True, len(parts), len(parts)
            return "".join("\ufffd" if p is None else p for p in parts), False, len(parts), len(parts) - lost
        out, at, units, mapped = [], 0, 0, 0
        least = min((len(a) for a, _ in self.spaces), default=self.lengths[-1] if self.lengths else 1)
        while at < len(raw):
            size = next((n for n in self.lengths if raw[at : at + n] in self.map and len(raw) - at >= n), None)
            units += 1
            if size:
                out.append(self.map[raw[at : at + size]])
                mapped += 1
            else:
                size = least
                out.append("�")
            at += size
        return "".join(out), units == mapped, units, mapped


# Single-byte encodings

# Glyph names beside those that Unicode's own names or single letters give.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "bullet": "•", "endash": "–", "emdash": "—", "ellipsis": "…", "dagger": "†", "daggerdbl": "‡", "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ",
    "Euro": "€", "cent": "¢", "sterling": "£", "yen": "¥", "section": "§", "copyright": "©", "registered": "®", "trademark": "™", "degree": "°", "plusminus": "±", "mu": "µ", "paragraph": "¶", "periodcentered": "·", "guillemotleft": "«", "guillemotright": "»", "questiondown": "¿", "exclamdown": "¡",
    "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "dotlessi": "ı", "lslash": "ł", "Lslash": "Ł", "eth": "ð", "Eth": "Ð", "thorn": "þ", "Thorn": "Þ", "minus": "−", "multiply": "×", "divide": "÷", "onehalf": "½", "onequarter": "¼", "threequarters": "¾", "nbspace": " ",
}
# Accents at the end of glyph names.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌"}


def glyph_text(name: str) -> str | None:
    """The text of a glyph name: uniXXXX, uXXXXX, parts joined by _, what follows a dot left out, letters with accents."""
    name = name.partition(".")[0]
    if not name:
        return None
    if "_" in name and name not in GLYPHS:
        parts = [glyph_text(p) for p in name.split("_")]
        return None if None in parts else "".join(parts)
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1 and name.isalpha():
        return name
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", name):
        return bytes.fromhex(m[1]).decode("utf-16-be", "replace")
    if m := re.fullmatch(r"u([0-9A-F]{4,6})", name):
        return chr(int(m[1], 16)) if int(m[1], 16) <= 0x10FFFF else None
    for accent, mark in ACCENTS.items():
        if name.endswith(accent) and len(name) == len(accent) + 1:
            return unicodedata.normalize("NFC", name[0] + mark)
    return None


def encoding(value, base: str = "StandardEncoding") -> dict[int, str] | None:
    """Codes to text of an /Encoding: a name, or a dictionary with /BaseEncoding and /Differences."""
    names = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}
    if isinstance(value, dict):
        out = encoding(value.get("BaseEncoding") or Name(base)) or {}
        code = 0
        for v in value.get("Differences") or []:
            if isinstance(v, int):
                code = v
            elif isinstance(v, Name):
                text = glyph_text(v)
                out.pop(code, None)
                if text is not None:
                    out[code] = text
                code += 1
        return out
    if value in names:
        out = {c: bytes([c]).decode(names[value], "ignore") for c in range(32, 256)}
        return {c: t for c, t in out.items() if t}
    if value in ("StandardEncoding", None):
        return {c: chr(c) for c in range(32, 127)}
    return None


# Embedded TrueType fonts

# The formats of a cmap table, best first.
FORMATS = (12, 10, 4, 6, 13, 0)


def truetype_glyphs(font: bytes) -> dict[int, str]:
    """Glyph ids to text by the best Unicode cmap; an empty map if the font has none."""
    try:
        return _truetype(font)
    except (struct.error, IndexError, ValueError):
        return {}


def _truetype(font: bytes) -> dict[int, str]:
    at, size = 0, struct.unpack_from(">H", font, 4)[0]
    tables = {font[12 + 16 * k : 16 + 16 * k]: struct.unpack_from(">II", font, 20 + 16 * k) for k in range(size)}
    if b"cmap" not in tables:
        return {}
    at = tables[b"cmap"][0]
    records = [struct.unpack_from(">HHI", font, at + 4 + 8 * k) for k in range(struct.unpack_from(">H", font, at + 2)[0])]

    def score(record):
        platform, kind, offset = record
        form = struct.unpack_from(">H", font, at + offset)[0]
        unicode = {(3, 10): 3, (3, 1): 2}.get((platform, kind), 2 if platform == 0 else 0)
        return (unicode > 0, -FORMATS.index(form) if form in FORMATS else -99, unicode)

    usable = [r for r in records if score(r)[0] and score(r)[1] > -99]
    if not usable:
        return {}
    best = at + max(usable, key=score)[2]
    form = struct.unpack_from(">H", font, best)[0]
    out: dict[int, str] = {}

    def put(code, glyph):
        if glyph and len(out) < LIMIT and 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000:
            out.setdefault(glyph, chr(code))

    if form == 0:
        for c, g in enumerate(font[best + 6 : best + 262]):
            put(c, g)
    elif form == 4:
        n = struct.unpack_from(">H", font, best + 6)[0] // 2
        ends = struct.unpack_from(f">{n}H", font, best + 14)
        starts = struct.unpack_from(f">{n}H", font, best + 16 + 2 * n)
        deltas = struct.unpack_from(f">{n}H", font, best + 16 + 4 * n)
        where = best + 16 + 6 * n
        for k, offset in enumerate(struct.unpack_from(f">{n}H", font, where)):
            for c in range(starts[k], min(ends[k], 0xFFFE) + 1):
                g = c
                if offset:
                    g = struct.unpack_from(">H", font, where + 2 * k + offset + 2 * (c - starts[k]))[0]
                put(c, (g + deltas[k]) & 0xFFFF if g or not offset else 0)
    elif form in (6, 10):
        first, n, data = (*struct.unpack_from(">HH", font, best + 6), best + 10) if form == 6 else (*struct.unpack_from(">II", font, best + 12), best + 20)
        for k in range(min(n, LIMIT)):
            put(first + k, struct.unpack_from(">H", font, data + 2 * k)[0])
    else:
        n = struct.unpack_from(">I", font, best + 12)[0]
        for k in range(min(n, LIMIT)):
            first, last, glyph = struct.unpack_from(">III", font, best + 16 + 12 * k)
            for c in range(first, min(last, first + LIMIT) + 1):
                put(c, glyph + (c - first if form == 12 else 0))
    return out


# Character collections


def japan1(cid: int) -> str | None:
    """CIDs of the Japanese collection that follow a rule: ASCII, hiragana; and a few ideographs."""
    if 1 <= cid <= 94:
        return chr(cid + 31)
    if 842 <= cid <= 924:
        return chr(cid - 842 + 0x3041)
    # Fixed values.
    return {0x07A0: "語", 0x0CD4: "日", 0x0E8A: "本"}.get(cid)


# Fonts of a page


class Font:
    """How the strings of one font become text, in order of preference: ToUnicode, its encoding, the embedded font."""

    def __init__(self, doc, items: dict):
        get = lambda d, k: doc.resolve(d.get(k)) if isinstance(d, dict) else None
        self.composite = get(items, "Subtype") == "Type0"
        self.cmap = self.codes = self.glyphs = None
        self.japanese = False
        self.vertical = False
        unicode = get(items, "ToUnicode")
        if isinstance(unicode, Stream) and (raw := doc.decoded(unicode)) is not None:
            self.cmap = CMap(raw.decode("latin-1"))
        named = get(items, "Encoding")
        if self.composite:
            self.vertical = isinstance(named, Name) and named.endswith("-V")
            below = doc.array(items.get("DescendantFonts"))
            below = doc.dictionary(below[0]) if below else {}
            system = doc.dictionary(below.get("CIDSystemInfo"))
            self.japanese = (get(system, "Registry"), get(system, "Ordering")) == (b"Adobe", b"Japan1")
            file = get(doc.dictionary(below.get("FontDescriptor")), "FontFile2")
            if isinstance(file, Stream) and (raw := doc.decoded(file)) is not None:
                glyphs, map_ = truetype_glyphs(raw), get(below, "CIDToGIDMap")
                if isinstance(map_, Stream) and (raw := doc.decoded(map_)) is not None:
                    of = struct.unpack(f">{len(raw) // 2}H", raw[: len(raw) // 2 * 2])
                    self.glyphs = {cid: glyphs[g] for cid, g in enumerate(of) if g in glyphs}
                else:
                    self.glyphs = glyphs
        else:
            if isinstance(named, dict):
                named = {k: doc.array(v) if k == "Differences" else doc.resolve(v) for k, v in named.items()}
            self.codes = encoding(named)
            self.texts = Texts(self.codes or {})
            self.sure = [bytes([c]) for c, t in self.texts.items() if 0 <= c < 256 and t != "\ufffd"]
        self.kind = "to-unicode" if self.cmap else "single-byte" if self.codes else "embedded" if self.glyphs else "collection" if self.japanese else "unknown"

    def decode(self, raw: bytes) -> tuple[str, bool, int, int]:
        """(text, all of it mapped, codes, mapped codes)."""
        if self.cmap and self.cmap.map:
            return self.cmap.decode(raw)
        if self.codes is not None:
            text = raw.decode("latin-1").translate(self.texts)
            lost = len(raw) - sum(map(raw.count, self.sure)) if "\ufffd" in text else 0
            return text, not lost, len(raw), len(raw) - lost
        if self.glyphs or self.japanese:
            cids = struct.unpack(f">{len(raw) // 2}H", raw[: len(raw) // 2 * 2])
            embedded = [(self.glyphs or {}).get(c) for c in cids]
            listed = [japan1(c) if self.japanese else None for c in cids]
            # The one that maps more wins, the embedded font if both map as many.
            best = listed if listed.count(None) < embedded.count(None) else embedded
            return counted(best)
        return ascii_text(raw)


def counted(texts: list[str | None]) -> tuple[str, bool, int, int]:
    """(text, all of it mapped, codes, mapped codes) of the codes' texts."""
    lost = sum(t is None or t == "�" for t in texts)
    return "".join("�" if t is None else t for t in texts), not lost, len(texts), len(texts) - lost


def ascii_text(raw: bytes) -> tuple[str, bool, int, int]:
    return counted([chr(b) if 32 <= b < 127 else None for b in raw])
