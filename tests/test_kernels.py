"""Syntax, filters, encryption, text maps and content, without Spark."""

import random

import pytest

from docloom.functions import numerals, textmap
from docloom.operators.content import Observer, instructions, normal
from docloom.operators.features import Features
from docloom.plans import variants
from docloom.plans.corpus import opened_row
from docloom.sources import filters
from docloom.sources.crypto import Aes, permissions, rc4
from docloom.sources.store import Budget, Document, Policy, text_of
from docloom.sources.synth import Writer, encode, encrypted, lines_of, text_pdf
from docloom.sources.syntax import Lexer
from docloom.sources.values import Name, PdfError, Ref, Text, format_value

TEXT = "Hello wörld ñ\n\n  second   line \n日本 (x)\\\n" + "\n".join(f"line {i}" for i in range(100))


@pytest.mark.parametrize(
    "raw, value, shown",
    [
        (b"/A#42c", "ABc", "/ABc"),
        (b"(a(b)\\)\\n\\101\\\nx)", b"a(b))\nAx", "(a\\(b\\)\\)\\nAx)"),
        (b"<48 65 6>", b"He`", "<486560>"),
        (b"[1 -2.50 .5 true null 3 0 R]", [1, -2.5, 0.5, True, None, Ref(3, 0)], "[1 -2.5 0.5 true null 3 0 R]"),
        (b"<< /K 1 % note\n /L [] /K 2 >>", {"L": [], "K": 2}, "<</L [] /K 2>>"),
    ],
)
def test_values(raw, value, shown):
    got = Lexer(raw).read()
    assert got == value and format_value(got) == shown


@pytest.mark.parametrize("raw", [b"<4G>", b"(open", b"[1 2", b"<</A>>", b"9007199254740993", b"junk", b"", b"[" * 100])
def test_bad_values(raw):
    with pytest.raises(PdfError):
        Lexer(raw).read()


def test_filters():
    r = random.Random(1)
    for name in ("FlateDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode", "LZWDecode"):
        for n in (0, 1, 5, 300, 20_000):
            raw = bytes(r.choice(b"abcd \n") if n % 2 else r.randrange(256) for _ in range(n))
            assert filters.decode({"Filter": Name(name)}, encode(name, raw))[:2] == ("decoded", raw)
    assert filters.decode({"Filter": [Name("A85"), Name("Fl")]}, encode("ASCII85Decode", encode("FlateDecode", b"x"))) == ("decoded", b"x", ["ASCII85Decode", "FlateDecode"])
    assert filters.decode({"Filter": Name("DCTDecode")}, b"")[0] == "unsupported-filter"
    assert filters.decode({"Filter": Name("FlateDecode")}, b"junk")[0] == "failed"
    assert filters.decode({}, b"raw") == ("available", b"raw", [])
    with pytest.raises(PdfError, match="limit"):
        filters.decode({"Filter": Name("FlateDecode")}, encode("FlateDecode", bytes(1000)), limit=10)


def test_predictors():
    rows = b"\x01\x01\x01\x01" + b"\x02\x01\x01\x01" + b"\x03\x01\x00\x00" + b"\x04\x01\x01\x01"
    assert filters.predict(rows, {"Predictor": 15, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4, 2, 2, 3, 3, 4, 5]) or filters.predict(rows, {"Predictor": 15, "Columns": 3})
    assert filters.predict(bytes([1, 1, 1]), {"Predictor": 2, "Columns": 3}) == bytes([1, 2, 3])
    assert filters.predict(bytes([0b10100000]), {"Predictor": 2, "Columns": 4, "BitsPerComponent": 1}) == bytes([0b11000000])
    assert filters.predict(bytes([0, 1, 0, 2]), {"Predictor": 2, "Columns": 2, "BitsPerComponent": 16}) == bytes([0, 1, 0, 3])
    with pytest.raises(PdfError):
        filters.predict(b"\x09\x00", {"Predictor": 12})


def test_ciphers():
    key, plain = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert Aes(key).encrypt_blocks(plain).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert Aes(bytes(range(32))).encrypt_blocks(plain).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert Aes(key).decrypt_blocks(Aes(key).encrypt_blocks(plain)) == plain
    assert rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert permissions(-4, "user")["copy"] and not permissions(0, "user")["copy"] and permissions(0, "owner")["copy"]


def runs(raw, **options):
    doc = Document(raw, **options)
    return [r["text"] for p in doc.pages() for r in Observer(doc, p).runs]


@pytest.mark.parametrize("options", [{}, {"packed": True}, {"filters": "ASCII85Decode LZWDecode"}, {"filters": ""}, {"title": "T"}])
def test_round_trip(options):
    assert runs(text_pdf(TEXT, **options)) == lines_of(TEXT)


def test_latin():
    assert runs(text_pdf("naïve café (a)", latin=True)) == ["naïve café (a)"]


def test_repair():
    broken = text_pdf(TEXT).replace(b"startxref", b"startnone")
    doc = Document(broken)
    assert doc.repaired and runs(broken) == lines_of(TEXT)
    with pytest.raises(PdfError):
        Document(broken, Policy(repair="strict"))
    assert runs(text_pdf(TEXT, packed=True).replace(b"startxref", b"startnone")) == lines_of(TEXT)
    wrong = text_pdf("one", filters="").replace(b"/Length", b"/Lengxh")
    assert runs(wrong) == ["one"]


def test_revisions():
    row = {"doc_id": 3, "text": TEXT}
    doc = Document(variants.revised(row))
    assert {e.revision for e in doc.entries} == {0, 1} and runs(variants.revised(row))[0] == "revision two of 3"


def secret(aes):
    return variants.mixed({"doc_id": 5 if aes else 13, "text": "", "source": "", "lang": ""})


@pytest.mark.parametrize("aes", [False, True])
def test_encryption(aes):
    raw = secret(aes)
    for password, who in (("user", "user"), ("owner", "owner")):
        doc = Document(raw, passwords=(password,))
        assert doc.security.credential == who and runs(raw, passwords=(password,)) == [f"secret {5 if aes else 13}"]
    for passwords, code in (((), "password-required"), (("no",), "password-invalid")):
        with pytest.raises(PdfError) as e:
            Document(raw, passwords=passwords)
        assert e.value.code == code
    with pytest.raises(PdfError) as e:
        Document(raw, Policy(encryption="forbid"))
    assert e.value.code == "encrypted-document-denied"


def test_limits():
    assert opened_row(text_pdf(TEXT), (), Policy(budget=Budget(source_bytes=10)))["code"] == "resource-limit"
    assert opened_row(text_pdf(TEXT), (), Policy(budget=Budget(pages=1)))["code"] == "resource-limit"
    assert opened_row(b"%PDF-1.4 nothing", (), Policy())["status"] == "failed"
    with pytest.raises(TypeError):
        Budget(pages=0)
    with pytest.raises(TypeError):
        Policy(launch="maybe")


def test_cycles():
    w = Writer()
    w.put(1, "<</Type/Catalog/Pages 2 0 R>>")
    w.put(2, "<</Type/Pages/Kids[3 0 R 2 0 R]/Count 2/MediaBox[0 0 10 10]/Rotate 450>>")
    w.put(3, "<</Type/Page/Parent 2 0 R>>")
    doc = Document(w.file())
    pages = doc.pages()
    assert len(pages) == 1 and doc.repaired and pages[0].rotate == 90 and pages[0].media_box == (0, 0, 10, 10)
    with pytest.raises(PdfError):
        Document(w.file(), Policy(repair="strict")).pages()


def test_fuzz():
    r = random.Random(7)
    sound = variants.rich({"doc_id": 1, "text": "a\nb", "source": "s", "lang": "en"})
    for _ in range(60):
        raw = bytearray(sound)
        for _ in range(r.randint(1, 30)):
            raw[r.randrange(len(raw))] = r.randrange(256)
        first, again = (opened_row(bytes(raw), (), Policy()) for _ in range(2))
        assert first == again and first["status"] in ("completed", "partial", "blocked", "failed")


def test_instructions():
    a, b = Ref(1, 0), Ref(2, 0)
    got = list(instructions([(a, b"[(x) -200 (y)]"), (b, b"TJ q Q")]))
    assert [(o, r) for o, _, r in got] == [("TJ", a), ("q", b), ("Q", b)]
    image = list(instructions([(a, b"BI /W 1 /H 1 ID \x00EI\x01 EI Q")]))
    assert image[0][0] == "BI" and image[0][1][0].raw == b"\x00EI\x01" and image[1][0] == "Q"
    with pytest.raises(PdfError):
        list(instructions([(a, b"1 2")]))
    assert normal(" a\x00\x01 b  ") == "a b"


def shown(content, font="<</Type/Font/Subtype/Type1/BaseFont/H/Encoding/WinAnsiEncoding>>"):
    w = Writer()
    w.put(1, "<</Type/Catalog/Pages 2 0 R>>")
    w.put(2, "<</Type/Pages/Kids[4 0 R]/Count 1/MediaBox[0 0 612 792]>>")
    w.put(3, font)
    w.put(4, "<</Type/Page/Parent 2 0 R/Contents 5 0 R/Resources<</Font<</F1 3 0 R>>>>>>")
    w.stream(5, b"BT /F1 12 Tf 72 720 Td " + content + b" ET")
    return runs(w.file())


def test_seams():
    assert shown(b"[(ab) -200 (cd) -20 (ef) -500 (,) -300 (x-) -300 (y)] TJ") == ["ab cdef, x-y"]
    assert shown(b"/Span<</ActualText(spoken words)>> BDC (sp) Tj EMC (rest) Tj") == ["spoken words", "rest"]
    assert shown(b"/Span<</ActualText(s)>> BDC (longer) Tj EMC") == ["longer"]
    japanese = "<</Type/Font/Subtype/Type0/Encoding/Identity-H/DescendantFonts[<</CIDSystemInfo<</Registry(Adobe)/Ordering(Japan1)>>>>]>>"
    assert shown(b"<0CD40E8A07A00031034B> Tj", japanese) == ["日本語Pあ"]


def test_features():
    row = {"doc_id": 3, "text": "hello\n" * 60, "source": "src1", "lang": "en"}
    doc = Document(variants.rich(row))
    found = Features(doc, doc.pages()).catalogs()
    assert [x["label"] for x in found["page_label"]] == ["i", "ii"] and found["layer"][1]["visibility"] == "hidden"
    assert [x["name"] for x in found["field"]] == ["name", "group", "group.agree"] and found["annotation"][0]["uri"].endswith("/3")
    assert opened_row(variants.mixed({**row, "doc_id": 4}), (), Policy())["code"] == "policy-javascript-denied"


def test_text_maps():
    m = textmap.CMap("1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <01> <00660069> endbfchar 2 beginbfrange <02> <04> <0041>\n<05> <06> [<0058> <0059>] endbfrange")
    assert m.decode(b"\x01\x02\x04\x06\x09") == ("fiACY�", False, 5, 4)
    codes = textmap.encoding({"BaseEncoding": Name("WinAnsiEncoding"), "Differences": [65, Name("eacute"), Name("f_i"), Name("uni20AC"), Name("nonesuch")]})
    assert [codes.get(c) for c in (65, 66, 67, 68, 0x80)] == ["é", "fi", "€", None, "€"]
    assert text_of(Text(b"\xfe\xff\x20\xac")) == "€" == text_of(Text(b"\xa0"))
    assert textmap.truetype_glyphs(b"junk") == {}


def test_numerals():
    assert [numerals.roman(n) for n in (4, 9, 1994)] == ["IV", "IX", "MCMXCIV"] and [numerals.letters(n) for n in (1, 26, 27, 53)] == ["A", "Z", "AA", "AAA"]
    assert numerals.fnv1a("a") == 0xAF63DC4C8601EC8C
    assert numerals.stable_id("x", "Héllo, World", ["a"]).startswith("x-hello-world-") and len(numerals.stable_id("x", "y", [])) == 17


def test_ranges():
    from docloom.sources.ranges import Ranges

    data = bytes(range(256)) * 2000
    source = Ranges(lambda at, n: data[at : at + n], len(data))
    assert source.fetched == 1024 + 65536
    assert source.get(5000, 9000) == data[5000:9000] and source.get(4000, 10_000) == data[4000:10_000]
    assert source.fetched == 1024 + 65536 + 6000 and source.get(0, len(data)) == data and len(source.parts) == 1
    with pytest.raises(ValueError):
        Ranges(lambda at, n: b"", 10)


def _fax_row(row, columns):
    from docloom.sources import fax

    out, at, color = "", 0, 0
    while at < columns:
        end = at
        while end < columns and row[end] == color:
            end += 1
        words, n = (fax.WHITE, fax.BLACK)[color].split(), end - at
        out += (words[63 + n // 64] if n >= 64 else "") + words[n % 64]
        at, color = end, color ^ 1
    return out


def test_fax():
    r = random.Random(3)
    for columns in (8, 17, 300):
        rows = []
        for _ in range(4):
            row, color = [], 0
            while len(row) < columns:
                row += [color] * r.choice([1, 2, 9, 70])
                color ^= 1
            rows.append(row[:columns])
        bits = "".join(_fax_row(x, columns) for x in rows)
        raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
        want = b"".join(int("".join(str(1 - v) for v in x).ljust(-(-columns // 8) * 8, "0"), 2).to_bytes(-(-columns // 8), "big") for x in rows)
        parms = {"Columns": columns, "Rows": 4}
        assert filters.decode({"Filter": Name("CCF"), "DecodeParms": parms}, raw)[1] == want
    # Group 4: a white line is one vertical mode; then a line of 3 white, 5 black by a horizontal mode.
    bits = "1" + "001" + "1000" + "0011" + "000000000001" * 2
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert filters.fax(raw, {"K": -1, "Columns": 8, "BlackIs1": True}, 100) == bytes([0, 0b00011111])


# A small key and a certificate made here, to sign with.


def _der(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def _oid(text):
    first, second, *rest = map(int, text.split("."))
    out = b""
    for n in (40 * first + second, *rest):
        part = [n & 127]
        while n := n >> 7:
            part.append(n & 127 | 128)
        out += bytes(reversed(part))
    return _der(6, out)


def _int(n):
    return _der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def _prime(r, bits):
    while True:
        p = r.getrandbits(bits) | 1 << bits - 1 | 1 << bits - 2 | 1
        if p % 65537 != 1 and all(pow(a, p - 1, p) == 1 for a in (2, 3, 5, 7)):
            return p


def _signed_pdf():
    import hashlib

    from docloom.operators import signatures as s

    r = random.Random(11)
    p, q = _prime(r, 512), _prime(r, 512)
    n, d = p * q, pow(65537, -1, (p - 1) * (q - 1))
    sha, null = _oid("2.16.840.1.101.3.4.2.1"), _der(5, b"")
    rsa = _der(0x30, _oid(s.RSA_KEY) + null)

    def sign(data):
        info = _der(0x30, _der(0x30, sha + null) + _der(4, hashlib.sha256(data).digest()))
        return pow(int.from_bytes(b"\0\1" + b"\xff" * (128 - 3 - len(info)) + b"\0" + info, "big"), d, n).to_bytes(128, "big")

    name = _der(0x30, _der(0x31, _der(0x30, _oid("2.5.4.3") + _der(12, b"Signer"))))
    key = _der(0x30, rsa + _der(3, b"\0" + _der(0x30, _int(n) + _int(65537))))
    algorithm = _der(0x30, _oid("1.2.840.113549.1.1.11") + null)
    body = _der(0x30, _der(0xA0, _int(2)) + _int(7) + algorithm + name + _der(0x30, _der(0x17, b"200101000000Z") + _der(0x17, b"400101000000Z")) + name + key)
    certificate = _der(0x30, body + algorithm + _der(3, b"\0" + sign(body)))

    def cms(data):
        attributes = _der(0x30, _oid(s.MESSAGE_DIGEST) + _der(0x31, _der(4, hashlib.sha256(data).digest())))
        signer = _der(0x30, _int(1) + _der(0x30, name + _int(7)) + _der(0x30, sha + null) + _der(0xA0, attributes) + rsa + _der(4, sign(_der(0x31, attributes))))
        inner = _der(0x30, _int(1) + _der(0x31, _der(0x30, sha)) + _der(0x30, _oid("1.2.840.113549.1.7.1")) + _der(0xA0, certificate) + _der(0x31, signer))
        return _der(0x30, _oid(s.SIGNED_DATA) + _der(0xA0, inner))

    w = Writer()
    w.put(1, "<</Type/Catalog/Pages 2 0 R/AcroForm<</Fields[4 0 R]>>>>")
    w.put(2, "<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 10 10]>>")
    w.put(3, "<</Type/Page/Parent 2 0 R>>")
    w.put(4, "<</FT/Sig/T(s)/V 5 0 R>>")
    w.put(5, f"<</Type/Sig/Filter/Adobe.PPKLite/SubFilter/adbe.pkcs7.detached/ByteRange[0 1111111111 2222222222 3333333333]/Contents<{'0' * 4000}>>>")
    raw = w.file()
    a = raw.index(b"<0000")
    b = a + 4002
    raw = raw.replace(b"1111111111 2222222222 3333333333", b"%-10d %-10d %-10d" % (a, b, len(raw) - b))
    signature = cms(raw[:a] + raw[b:]).hex().encode()
    return raw[:a] + b"<" + signature.ljust(4000, b"0") + b">" + raw[b:], certificate


def test_signatures():
    from datetime import datetime, timezone

    from docloom.operators.signatures import Trust, verify

    raw, certificate = _signed_pdf()
    doc = Document(raw)
    found = Features(doc, doc.pages()).signatures()[0]
    # Trailing zeros fill the reserved space; the DER element knows its own end.
    assert verify(raw, found) == {"status": "valid", "code": None, "signer": "Signer", "digest": "sha256"}
    assert verify(raw.replace(b"/MediaBox[0 0 10 10]", b"/MediaBox[0 0 99 10]"), found)["code"] == "signature-integrity-invalid"
    assert verify(raw + b" ", found)["code"] == "signature-integrity-invalid"
    assert verify(raw, found | {"byte_range": []})["code"] == "signature-dictionary-invalid"
    assert verify(raw, found | {"contents": b"\x30\x03\x02\x01\x01"})["code"] == "signature-cms-invalid"
    now = datetime(2026, 1, 1, tzinfo=timezone.utc)
    assert verify(raw, found, Trust((certificate,), at=now))["status"] == "valid"
    assert verify(raw, found, Trust((), at=now))["code"] == "signature-trust-anchor-missing"
    assert verify(raw, found, Trust((certificate,), at=datetime(2050, 1, 1, tzinfo=timezone.utc)))["code"] == "signature-certificate-expired"
