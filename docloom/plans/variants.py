"""PDFs of the documents table with one more thing in each, for the queries on features."""

from __future__ import annotations

import hashlib

from ..sources.synth import Writer, encrypted, literal, lines_of, text_pdf, unicode_map  # noqa: F401


def hexadecimal(text: str) -> str:
    return f"<FEFF{text.encode('utf-16-be').hex().upper()}>"


def mixed(row) -> bytes:
    """By doc_id modulo 8: plain, packed, broken, no PDF, with a script, encrypted, Latin, LZW."""
    kind, text = row["doc_id"] % 8, row["text"]
    if kind == 1:
        return text_pdf(text, packed=True)
    if kind == 2:
        return text_pdf(text).replace(b"startxref", b"startnone")
    if kind == 3:
        return b"no document at all"
    if kind == 4:
        return text_pdf(text, extras=lambda w, pages: (f"/OpenAction {w.add('<</S/JavaScript/JS(app.alert)>>')} 0 R", ""))
    if kind == 5:
        w = Writer()
        w.put(1, "<</Type/Catalog/Pages 2 0 R>>")
        w.put(2, "<</Type/Pages/Kids[4 0 R]/Count 1/MediaBox[0 0 612 792]>>")
        w.put(3, "<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>")
        w.put(4, "<</Type/Page/Parent 2 0 R/Contents 5 0 R/Resources<</Font<</F1 3 0 R>>>>>>")
        w.stream(5, b"BT /F1 12 Tf 72 720 Td " + literal(b"secret %d" % row["doc_id"]) + b" Tj ET")
        return encrypted(w, "user", "owner", p=-4 if row["doc_id"] % 16 == 5 else -20, aes=row["doc_id"] % 16 == 5)
    return text_pdf(text, latin=kind == 6, filters="LZWDecode" if kind == 7 else "FlateDecode")


def locked(row) -> bytes:
    """The whole text, encrypted: AES and leave to copy for odd doc_ids, RC4 and none for even ones."""
    odd = row["doc_id"] % 2 == 1

    def done(w: Writer) -> bytes:
        for n, body in w.objects.items():  # the only strings outside streams; encrypted() takes none
            w.objects[n] = body.replace(b"/Registry(Adobe)/Ordering(Identity)", b"")
        return encrypted(w, "user", "owner", p=-4 if odd else -20, aes=odd)

    return text_pdf(row["text"], done=done)


def rich(row) -> bytes:
    """Labels, outlines, destinations, annotations, a form, an attachment, structure, layers, an image and a path on page 1."""
    text, number = row["text"], row["doc_id"]

    def extras(w: Writer, pages: list[int]):
        first = pages[0]
        file = w.stream(None, (text or "").encode(), "/Type/EmbeddedFile/Subtype/text#2Fplain", "FlateDecode")
        spec = w.add(f"<</Type/Filespec/F(note.txt)/UF {hexadecimal('note.txt')}/Desc(about {number})/EF<</F {file} 0 R>>>>")
        link = w.add(f"<</Type/Annot/Subtype/Link/Rect[10 20 110 40]/A<</S/URI/URI(http://example.org/{number})>>>>")
        note = w.add(f"<</Type/Annot/Subtype/Text/Rect[0 0 10 10]/Contents {hexadecimal('note ' + str(row['source']))}/Dest[{pages[-1]} 0 R/Fit]>>")
        field = w.add(f"<</FT/Tx/T(name)/V {hexadecimal(str(row['source']))}>>")
        group = w.add("<</T(group)/Kids[]>>")
        kid = w.add(f"<</FT/Btn/T(agree)/V/Yes/Parent {group} 0 R>>")
        w.put(group, f"<</T(group)/Kids[{kid} 0 R]>>")
        chapters = [w.add("<<>>") for _ in pages]
        root = w.add(f"<</Type/Outlines/First {chapters[0]} 0 R/Last {chapters[-1]} 0 R/Count {len(pages)}>>")
        for k, c in enumerate(chapters):
            after = f"/Next {chapters[k + 1]} 0 R" if k + 1 < len(chapters) else ""
            w.put(c, f"<</Title(Part {k + 1})/Parent {root} 0 R/Dest[{pages[k]} 0 R/XYZ 0 792 0]{after}>>")
        shown, hidden = w.add("<</Type/OCG/Name(shown)>>"), w.add("<</Type/OCG/Name(hidden)>>")
        figure = w.add(f"<</Type/StructElem/S/Figure/Alt {hexadecimal('figure ' + str(number))}/Pg {first} 0 R/K 0>>")
        tree = w.add(f"<</Type/StructTreeRoot/K<</S/Document/T(whole)/K[{figure} 0 R]>>>>")
        image = w.stream(None, bytes([number % 256]), "/Type/XObject/Subtype/Image/Width 1/Height 1/BitsPerComponent 8/ColorSpace/DeviceGray", "FlateDecode")
        drawn = w.stream(None, f"q 12 0 0 12 144 600 cm /Im1 Do Q 1 0 0 RG 2 w 10 10 m 60 10 l 60 60 l s /OC/P1 BDC BT /F1 12 Tf 72 30 Td {'<0068>'} Tj ET EMC /Span<</ActualText {hexadecimal('spoken')}>> BDC EMC".encode())
        page_more = f"/Annots[{link} 0 R {note} 0 R]/Resources<</Font<</F1 3 0 R>>/XObject<</Im1 {image} 0 R>>/Properties<</P1 {(hidden if number % 2 else shown)} 0 R>>>>"
        labels = f"/PageLabels<</Nums[0<</S/r>>2<</S/A/P(x-)/St 3>>]>>"
        names = f"/Names<</EmbeddedFiles<</Names[(note.txt) {spec} 0 R]>>/Dests<</Names[(last)[{pages[-1]} 0 R/Fit]]>>>>"
        catalog = f"{labels}{names}/Outlines {root} 0 R/AcroForm<</Fields[{field} 0 R {group} 0 R]>>/StructTreeRoot {tree} 0 R/OCProperties<</OCGs[{shown} 0 R {hidden} 0 R]/D<</OFF[{hidden} 0 R]>>>>"
        extras.contents = drawn
        return catalog, page_more

    made = text_pdf(text, title=None, extras=lambda w, pages: _two_streams(w, pages, extras))
    return made


def _two_streams(w: Writer, pages: list[int], extras):
    """The first page shows its text and then what extras drew."""
    catalog, page_more = extras(w, pages)
    # The writer names the text's stream first; of two /Contents the last one counts.
    return catalog, f"/Contents[{pages[0] - 1} 0 R {extras.contents} 0 R]{page_more}"


def revised(row) -> bytes:
    """A first revision with the text, and a second one that replaces page 1's content."""
    first = text_pdf(row["text"], latin=True, filters="")
    w = Writer()
    # In the first revision the font is object 3 and the first page's content is object 4.
    w.stream(4, b"BT /F1 12 Tf 72 720 Td " + literal(b"revision two of %d" % row["doc_id"]) + b" Tj ET")
    return w.file(keep=first)


def digest(raw: bytes) -> str:
    return hashlib.md5(raw).hexdigest()
