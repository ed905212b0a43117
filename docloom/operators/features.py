"""Catalogs of one document: metadata, destinations, labels, structure, annotations, outlines, forms, attachments, signatures, layers, active content, images; and the findings that admission looks at."""

from __future__ import annotations

from collections.abc import Iterable

from ..functions.numerals import STYLES, label
from ..sources.store import Document, Page, text_of
from ..sources.values import Name, Ref, Stream
from .content import Observer

DEEP = 64
INFO = {"Title": "title", "Author": "author", "Subject": "subject", "Keywords": "keywords", "Creator": "creator", "Producer": "producer", "CreationDate": "creation_date", "ModDate": "modification_date"}
ACTIVE = {"JavaScript": "javascript", "Launch": "launch"}
MEDIA = {"RichMedia": "rich-media", "Movie": "movie", "Sound": "sound", "Screen": "screen", "3D": "3d"}
FIELD = {"Btn": "button", "Tx": "text", "Ch": "choice", "Sig": "signature"}
#: Not walked for actions: where the walk would leave its subject.
SKIPPED = frozenset("Parent P Kids Dest D Contents Resources AP MK Popup IRT StructParent StructParents Pg".split())


def key_of(ref: Ref | None, path: str = "") -> str:
    return f"{ref.obj}-{ref.gen}" if ref else path or "direct"


class Features:
    """Everything that can be read without interpreting pages. Each catalog is a list of flat dictionaries."""

    def __init__(self, doc: Document, pages: list[Page]):
        self.doc, self.pages = doc, pages
        self.number = {p.ref: p.number for p in pages}

    def get(self, items, key):
        return self.doc.resolve(items.get(key)) if isinstance(items, dict) else None

    def metadata(self) -> list[dict]:
        info = self.doc.dictionary(self.doc.trailer.get("Info"))
        out = [{"key": INFO.get(k, k), "value": t, "custom": k not in INFO, "source": "info"} for k, v in info.items() if (t := text_of(self.doc.resolve(v))) is not None]
        xmp = self.doc.resolve(self.doc.catalog.get("Metadata"))
        if isinstance(xmp, Stream) and (raw := self.doc.decoded(xmp)) is not None:
            out.append({"key": "xmp", "value": raw.decode("utf-8", "replace"), "custom": False, "source": "xmp"})
        return sorted(out, key=lambda r: (r["source"], r["key"]))

    def name_tree(self, value, depth: int = 0, seen=frozenset()) -> list[tuple[str, object]]:
        if depth > DEEP or isinstance(value, Ref) and value in seen:
            return []
        seen = seen | {value} if isinstance(value, Ref) else seen
        node = self.doc.dictionary(value)
        names = self.doc.array(node.get("Names"))
        out = [(text_of(self.doc.resolve(k)) or "", v) for k, v in zip(names[::2], names[1::2])]
        for kid in self.doc.array(node.get("Kids")):
            out += self.name_tree(kid, depth + 1, seen)
        return out

    def number_tree(self, value, depth: int = 0, seen=frozenset()) -> list[tuple[int, object]]:
        if depth > DEEP or isinstance(value, Ref) and value in seen:
            return []
        seen = seen | {value} if isinstance(value, Ref) else seen
        node = self.doc.dictionary(value)
        numbers = self.doc.array(node.get("Nums"))
        out = [(n, v) for n, v in zip(numbers[::2], numbers[1::2]) if isinstance(n, int)]
        for kid in self.doc.array(node.get("Kids")):
            out += self.number_tree(kid, depth + 1, seen)
        return out

    def destination(self, value) -> tuple[int | None, str | None]:
        """(page, kind of view) of a destination array or a dictionary that holds one."""
        value = self.doc.resolve(value)
        if isinstance(value, dict):
            value = self.doc.resolve(value.get("D"))
        if not isinstance(value, list) or not value:
            return None, None
        page = self.number.get(value[0]) if isinstance(value[0], Ref) else value[0] + 1 if isinstance(value[0], int) else None
        return page, str(value[1]) if len(value) > 1 and isinstance(value[1], Name) else None

    def destinations(self) -> list[dict]:
        """The old dictionary's names, then the name tree's, which win."""
        found = {k: v for k, v in self.doc.dictionary(self.doc.catalog.get("Dests")).items()}
        found |= dict(self.name_tree(self.doc.dictionary(self.doc.catalog.get("Names")).get("Dests")))
        return [{"name": str(k), "page_number": page, "view": view} for k, v in sorted(found.items()) for page, view in [self.destination(v)]]

    def page_labels(self) -> list[dict]:
        ranges = sorted(self.number_tree(self.doc.catalog.get("PageLabels")), key=lambda r: r[0])
        out = []
        for p in self.pages if ranges else []:
            below = [r for r in ranges if r[0] <= p.number - 1]
            if not below:
                continue
            first, value = below[-1]
            items = self.doc.dictionary(value)
            style, start = STYLES.get(items.get("S")), items.get("St", 1)
            prefix = text_of(self.get(items, "P")) or ""
            out.append({"page_number": p.number, "label": prefix + label(style, start + p.number - 1 - first), "style": style, "prefix": prefix})
        return out

    def structure(self) -> list[dict]:
        out: list[dict] = []
        seen: set[str] = set()
        root = self.doc.dictionary(self.doc.catalog.get("StructTreeRoot"))

        def visit(value, parent, page, path, depth):
            if depth > DEEP or len(out) > self.doc.budget.objects:
                return
            ref = value if isinstance(value, Ref) else None
            node = self.doc.resolve(value)
            if isinstance(node, list):
                for k, v in enumerate(node):
                    visit(v, parent, page, f"{path}-{k}", depth + 1)
                return
            if isinstance(node, int) and not isinstance(node, bool):
                out.append({"id": f"structure-content-{path}", "parent_id": parent, "depth": depth, "ordinal": len(out), "role": None, "page_number": page, "mcid": node, "title": None, "alternate_text": None, "actual_text": None, "obj": None, "gen": None})
                return
            if not isinstance(node, dict):
                return
            own = self.number.get(node.get("Pg"), page)
            if "S" not in node:
                if isinstance(node.get("MCID"), int):
                    visit(node["MCID"], parent, own, path, depth)
                return
            id_ = f"structure-{ref.obj}-{ref.gen}" if ref else f"structure-{path}"
            if ref and id_ in seen:
                return
            seen.add(id_)
            out.append({"id": id_, "parent_id": parent, "depth": depth, "ordinal": len(out), "role": str(self.get(node, "S")), "page_number": own, "mcid": None, "title": text_of(self.get(node, "T")), "alternate_text": text_of(self.get(node, "Alt")), "actual_text": text_of(self.get(node, "ActualText")), "obj": ref.obj if ref else None, "gen": ref.gen if ref else None})
            if "K" in node:
                visit(node["K"], id_, own, f"{path}-0", depth + 1)

        if "K" in root:
            visit(root["K"], None, None, "0", 0)
        return out

    def annotations(self) -> list[dict]:
        out = []
        for p in self.pages:
            for k, value in enumerate(p.annotations):
                items = self.doc.dictionary(value)
                if not items:
                    continue
                ref = value if isinstance(value, Ref) else None
                action = self.doc.dictionary(items.get("A"))
                target = self.destination(items.get("Dest", action.get("D") if action.get("S") == "GoTo" else None))[0]
                out.append({"id": f"annotation-{key_of(ref, f'{p.number}-{k}')}", "page_number": p.number, "subtype": str(self.get(items, "Subtype")), "contents": text_of(self.get(items, "Contents")), "uri": text_of(self.get(action, "URI")), "destination_page": target, "bbox": self.doc.box(items.get("Rect")), "obj": ref.obj if ref else None, "gen": ref.gen if ref else None})
        return out

    def outlines(self) -> list[dict]:
        out: list[dict] = []
        seen: set = set()

        def chain(value, parent, depth):
            while isinstance(value, Ref) and value not in seen and depth <= DEEP:
                seen.add(value)
                items = self.doc.dictionary(value)
                id_ = f"outline-{value.obj}-{value.gen}"
                action = self.doc.dictionary(items.get("A"))
                out.append({"id": id_, "parent_id": parent, "depth": depth, "ordinal": len(out), "title": text_of(self.get(items, "Title")), "page_number": self.destination(items.get("Dest", action.get("D")))[0]})
                chain(items.get("First"), id_, depth + 1)
                value = items.get("Next")

        chain(self.doc.dictionary(self.doc.catalog.get("Outlines")).get("First"), None, 0)
        return out

    def fields(self) -> list[dict]:
        out: list[dict] = []

        def visit(value, parent, prefix, inherited, depth, seen):
            if depth > DEEP or value in seen:
                return
            ref = value if isinstance(value, Ref) else None
            items = self.doc.dictionary(value)
            if not items:
                return
            own = inherited | {k: items[k] for k in ("FT", "V", "Ff") if k in items}
            part = text_of(self.get(items, "T"))
            name = ".".join(x for x in (prefix, part) if x)
            kids = self.doc.array(items.get("Kids"))
            named = [k for k in kids if "T" in self.doc.dictionary(k)]
            id_ = f"field-{key_of(ref, name)}"
            if part is not None or not parent:
                v = self.get(own, "V")
                shown = text_of(v) if not isinstance(v, list) else ", ".join(t for x in v if (t := text_of(self.doc.resolve(x))) is not None)
                shown = self.doc.decoded(v).decode("latin-1") if isinstance(v, Stream) else shown
                out.append({"id": id_, "parent_id": parent, "depth": depth, "ordinal": len(out), "name": name, "kind": FIELD.get(self.get(own, "FT"), "unknown"), "value": shown, "flags": self.get(own, "Ff") or 0, "page_number": self.number.get(items.get("P")), "obj": ref.obj if ref else None, "gen": ref.gen if ref else None})
            for k in named or []:
                visit(k, id_, name, own, depth + 1, seen | ({value} if ref else set()))

        for f in self.doc.array(self.doc.dictionary(self.doc.catalog.get("AcroForm")).get("Fields")):
            visit(f, None, "", {}, 0, frozenset())
        return out

    def attachments(self) -> list[dict]:
        pairs = self.name_tree(self.doc.dictionary(self.doc.catalog.get("Names")).get("EmbeddedFiles"))
        for p in self.pages:
            pairs += [(text_of(self.get(a, "Contents")) or "", a.get("FS")) for v in p.annotations if self.get(a := self.doc.dictionary(v), "Subtype") == "FileAttachment"]
        out, seen = [], set()
        for name, value in pairs:
            items = self.doc.dictionary(value)
            file = self.doc.dictionary(items.get("EF"))
            at = file.get("UF", file.get("F"))
            stream = self.doc.resolve(at)
            ref = value if isinstance(value, Ref) else at if isinstance(at, Ref) else None
            id_ = f"attachment-{key_of(ref, name)}"
            if not items or id_ in seen:
                continue
            seen.add(id_)
            parameters = self.doc.dictionary(stream.items.get("Params")) if isinstance(stream, Stream) else {}
            out.append({"id": id_, "name": text_of(self.get(items, "UF")) or text_of(self.get(items, "F")) or name, "description": text_of(self.get(items, "Desc")), "media_type": text_of(self.get(stream.items, "Subtype")) if isinstance(stream, Stream) else None, "size": parameters.get("Size") if isinstance(parameters.get("Size"), int) else None, "obj": at.obj if isinstance(at, Ref) else None, "gen": at.gen if isinstance(at, Ref) else None})
        return out

    def signatures(self) -> list[dict]:
        out = []
        for f in self.fields():
            if f["kind"] != "signature" or f["obj"] is None:
                continue
            items = self.doc.dictionary(Ref(f["obj"], f["gen"]))
            at = items.get("V")
            value = self.doc.dictionary(at)
            if value:
                ranges = self.doc.array(value.get("ByteRange"))
                out.append({"id": f"signature-{key_of(at if isinstance(at, Ref) else Ref(f['obj'], f['gen']))}", "field": f["name"], "filter": text_of(self.get(value, "Filter")), "sub_filter": text_of(self.get(value, "SubFilter")), "signed_at": text_of(self.get(value, "M")), "signer": text_of(self.get(value, "Name")), "byte_range": [r for r in ranges if isinstance(r, int)], "contents": bytes(c) if isinstance(c := self.get(value, "Contents"), bytes) else None})
        return out

    def layers(self) -> list[dict]:
        properties = self.doc.dictionary(self.doc.catalog.get("OCProperties"))
        from .content import Visible

        states = Visible(self.doc)
        return [{"id": f"optional-content-{r.obj}-{r.gen}", "name": text_of(self.get(self.doc.dictionary(r), "Name")), "visibility": states.of(r), "obj": r.obj, "gen": r.gen} for r in self.doc.array(properties.get("OCGs")) if isinstance(r, Ref)]

    def active(self) -> list[dict]:
        """Actions and media below the places where a document may hold them."""
        out: list[dict] = []
        seen: set = set()

        def walk(value, path, page, depth):
            if depth > DEEP:
                return
            ref = value if isinstance(value, Ref) else None
            if ref:
                if ref in seen:
                    return
                seen.add(ref)
            node = self.doc.resolve(value)
            node = node.items if isinstance(node, Stream) else node
            if isinstance(node, list):
                for k, v in enumerate(node):
                    walk(v, f"{path}.{k}" if path else str(k), page, depth + 1)
            elif isinstance(node, dict):
                kind = ACTIVE.get(node.get("S")) or MEDIA.get(node.get("Subtype"))
                if kind:
                    script = self.get(node, "JS")
                    payload = (self.doc.decoded(script) or b"").decode("latin-1") if isinstance(script, Stream) else text_of(script)
                    out.append({"id": f"active-{key_of(ref)}-{path or 'root'}", "kind": kind, "page_number": page, "payload": payload, "obj": ref.obj if ref else None, "gen": ref.gen if ref else None})
                for k, v in node.items():
                    if k not in SKIPPED:
                        walk(v, f"{path}.{k}" if path else k, page, depth + 1)

        catalog = self.doc.catalog
        for k in ("OpenAction", "AA", "Outlines", "AcroForm"):
            if k in catalog:
                walk(catalog[k], k, None, 0)
        scripts = self.doc.dictionary(catalog.get("Names")).get("JavaScript")
        for name, v in self.name_tree(scripts):
            walk(v, f"Names.JavaScript.{name}", None, 0)
        for p in self.pages:
            if "AA" in p.items:
                walk(p.items["AA"], f"page-{p.number}.AA", p.number, 0)
            for k, a in enumerate(p.annotations):
                walk(a, f"page-{p.number}.Annots.{k}", p.number, 0)
        return out

    def findings(self) -> list[dict]:
        """Kinds of content that a policy may care about, each once, with how often."""
        count: dict[str, int] = {}

        def note(kind, n=1):
            if n:
                count[kind] = count.get(kind, 0) + n

        for a in self.active():
            note(a["kind"])
        note("embedded-files", len(self.attachments()))
        note("forms", len(self.fields()))
        note("outlines", len(self.outlines()))
        note("annotations", len(self.annotations()))
        note("signatures", len(self.signatures()))
        note("optional-content", len(self.layers()))
        note("encryption", self.doc.security is not None)
        note("tagged", "StructTreeRoot" in self.doc.catalog)
        note("images", sum(self.get(self.doc.dictionary(v), "Subtype") == "Image" for p in self.pages for v in self.doc.dictionary(p.resources.get("XObject")).values()))
        note("fonts", len({k for p in self.pages for k in self.doc.dictionary(p.resources.get("Font")).values() if isinstance(k, Ref)}))
        return [{"kind": k, "n": n} for k, n in sorted(count.items())]

    def catalogs(self) -> dict[str, list[dict]]:
        return {"metadata": self.metadata(), "destination": self.destinations(), "page_label": self.page_labels(), "structure": self.structure(), "annotation": self.annotations(), "outline": self.outlines(), "field": self.fields(), "attachment": self.attachments(), "signature": self.signatures(), "layer": self.layers(), "active": self.active(), "finding": self.findings()}


# Images

SHORT = {"W": "Width", "H": "Height", "BPC": "BitsPerComponent", "CS": "ColorSpace", "F": "Filter", "DP": "DecodeParms", "IM": "ImageMask", "I": "Interpolate", "D": "Decode"}
MEDIA_TYPES = {"DCTDecode": "image/jpeg", "JPXDecode": "image/jp2", "JBIG2Decode": "image/jbig2", "CCITTFaxDecode": "image/fax"}


def image_row(doc: Document, id_: str, stream: Stream, inline: bool, include_bytes: bool = False) -> dict:
    from ..sources.filters import filter_names

    items = {SHORT.get(k, k): doc.resolve(v) for k, v in stream.items.items()}
    names = filter_names(items, doc.resolve)
    width, height = items.get("Width"), items.get("Height")
    space = items.get("ColorSpace")
    space = doc.resolve(space[0]) if isinstance(space, list) and space else space
    media = next((MEDIA_TYPES[n] for n in names if n in MEDIA_TYPES), None)
    raw = None
    if include_bytes:
        raw = stream.raw if media and names[-1] in MEDIA_TYPES else doc.decode(Stream(items, stream.raw))[1]
    return {"id": id_, "width": width if isinstance(width, int) else None, "height": height if isinstance(height, int) else None, "bits": items.get("BitsPerComponent") if isinstance(items.get("BitsPerComponent"), int) else None, "color_space": str(space) if isinstance(space, Name) else None, "mask": bool(items.get("ImageMask")), "filters": names, "media_type": media, "inline": inline, "bytes": raw}


def images(doc: Document, observed: Iterable[tuple[Page, Observer]], include_bytes: bool = False) -> tuple[list[dict], list[dict]]:
    """(resources, placements); each resource's pixels are counted once against the budget."""
    resources: dict[str, dict] = {}
    placements = []
    for page, seen in observed:
        inline = 0
        for m in seen.marks:
            if m["kind"] != "image":
                continue
            if m.get("inline") is not None:
                inline += 1
                id_ = f"image-inline-{page.number}-{m['stream'].obj}-{inline}"
                stream = m["inline"]
            elif m["resource"] is not None:
                id_ = f"image-{m['resource'].obj}-{m['resource'].gen}"
                stream = doc.resolve(m["resource"])
            else:
                continue
            if id_ not in resources:
                resources[id_] = image_row(doc, id_, stream, m.get("inline") is not None, include_bytes)
                doc.spent["image_pixels"] += (resources[id_]["width"] or 0) * (resources[id_]["height"] or 0)
                if doc.spent["image_pixels"] > doc.budget.image_pixels:
                    from ..sources.values import PdfError

                    raise PdfError("image pixels over the limit", "resource-limit")
            placements.append({"id": m["id"], "image_id": id_, "page_number": page.number, "bbox": m["bbox"]})
    return [resources[k] for k in sorted(resources)], sorted(placements, key=lambda p: (p["page_number"], p["id"]))
