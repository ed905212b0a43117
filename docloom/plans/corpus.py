"""A corpus of PDF documents as DataFrames.

Corpus(table) takes (doc_id, content[, password]); every product is a lazy DataFrame made by one pass of a
kernel over the documents' bytes, one document at a time. A document that cannot be read is a row with a
status in opened(), never an exception; the other products just have no rows of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import unswept
from ..sources.crypto import permissions
from ..sources.store import Document, Policy
from ..sources.values import PdfError, Ref, Stream, format_value

BOX = "struct<x:double,y:double,width:double,height:double>"
SCHEMAS = {
    "opened": "doc_id bigint, status string, code string, message string, pdf_version string, byte_length bigint, page_count int, object_count int, revision_count int, encrypted boolean, repaired boolean, credential string, p bigint, xref_kinds array<string>, finding_kinds array<string>",
    "xref": "doc_id bigint, revision int, section_offset bigint, section_kind string, seq int, kind string, obj int, gen int, offset bigint, objstm int, objstm_index int, next_free bigint",
    "latest": "doc_id bigint, obj int, gen int, revision int, versions bigint",
    "objects": "doc_id bigint, obj int, gen int, revision int, src_start bigint, src_end bigint, value_text string, type_name string, subtype string, has_stream boolean, filters array<string>, decode_state string, decoded binary, stream_role string",
    "pages": f"doc_id bigint, page_number int, obj int, gen int, media_box {BOX}, crop_box {BOX}, rotate int, content_count int, annotation_count int, fonts array<string>, xobjects array<string>",
    "content": "doc_id bigint, page_number int, op_index int, operator string, operands array<struct<kind:string,token:string>>, stream_obj int",
    "runs": "doc_id bigint, page_number int, id string, content_order int, text string, glyph_count int, encoding_kind string, writing_mode string, x double, y double, font_size double, starts_new_line boolean, font_obj int, stream_obj int, complete boolean, source_units int, mapped_units int, visibility string",
    "reachable": "doc_id bigint, obj int, gen int, revision int, src_start bigint, type_name string, has_stream boolean",
    "marks": f"doc_id bigint, page_number int, id string, content_order int, kind string, marked_content_id string, visibility string, bbox {BOX}, text string, tag string, content_kind string, actual_text string, paint string, rule string, point_count int, closed boolean, fill string, stroke string, line_width double, cap string, join string, alpha double, blend string, soft_mask boolean, resource_obj int",
    "metadata": "doc_id bigint, source string, key string, value string, custom boolean",
    "destination": "doc_id bigint, name string, page_number int, view string",
    "page_label": "doc_id bigint, page_number int, label string, style string, prefix string",
    "structure": "doc_id bigint, id string, parent_id string, depth int, ordinal int, role string, page_number int, mcid int, title string, alternate_text string, actual_text string, obj int, gen int",
    "annotation": f"doc_id bigint, id string, page_number int, subtype string, contents string, uri string, destination_page int, bbox {BOX}, obj int, gen int",
    "outline": "doc_id bigint, id string, parent_id string, depth int, ordinal int, title string, page_number int",
    "field": "doc_id bigint, id string, parent_id string, depth int, ordinal int, name string, kind string, value string, flags bigint, page_number int, obj int, gen int",
    "attachment": "doc_id bigint, id string, name string, description string, media_type string, size bigint, obj int, gen int",
    "signature": "doc_id bigint, id string, field string, filter string, sub_filter string, signed_at string, signer string, byte_range array<bigint>, contents binary",
    "layer": "doc_id bigint, id string, name string, visibility string, obj int, gen int",
    "active": "doc_id bigint, id string, kind string, page_number int, payload string, obj int, gen int",
    "finding": "doc_id bigint, kind string, n bigint",
    "images": "doc_id bigint, id string, width int, height int, bits int, color_space string, mask boolean, filters array<string>, media_type string, inline boolean, bytes binary",
    "placements": f"doc_id bigint, id string, image_id string, page_number int, bbox {BOX}",
}
CATALOGS = ("metadata", "destination", "page_label", "structure", "annotation", "outline", "field", "attachment", "signature", "layer", "active", "finding")


def _box(b):
    return None if b is None else dict(zip(("x", "y", "width", "height"), b))


def opened_row(content: bytes, passwords: tuple[str, ...], policy: Policy, doc: Document | None = None) -> dict:
    """What opening the document (doc, if it is open already) gives: completed, partial (repaired), blocked or failed."""
    from ..operators.features import Features

    row: dict = {"byte_length": len(content)}
    blocked = ("resource-limit", "policy-blocked", "password-required", "password-invalid", "encrypted-document-denied")
    try:
        doc = doc or Document(content, policy, passwords)
        pages = doc.pages()
        found = Features(doc, pages)
        kinds = [f["kind"] for f in found.findings()]
        row |= {"pdf_version": doc.version, "page_count": len(pages), "object_count": len(doc.refs()), "revision_count": len({e.revision for e in doc.entries}), "encrypted": doc.security is not None, "repaired": doc.repaired, "credential": doc.security.credential if doc.security else "none", "p": doc.security.p if doc.security else None, "xref_kinds": sorted({e.section_kind for e in doc.entries}), "finding_kinds": kinds}
        for kind, rule in (("javascript", policy.javascript), ("launch", policy.launch), ("embedded-files", policy.embedded_files)):
            if rule == "deny" and kind in kinds:
                return row | {"status": "blocked", "code": f"policy-{kind}-denied", "message": f"the document holds {kind}"}
        return row | {"status": "partial", "code": "structure-repaired"} if doc.repaired else row | {"status": "completed"}
    except PdfError as e:
        return row | {"status": "blocked" if e.code in blocked else "failed", "code": e.code, "message": str(e)}
    except (RecursionError, ValueError, TypeError, KeyError, IndexError, AttributeError) as e:
        return row | {"status": "failed", "code": "internal-failure", "message": str(e)}


def _objects(doc: Document, decode: bool):
    contents = {r for p in doc.pages() for r in p.contents}
    for ref in doc.refs():
        try:
            found = doc.object(ref)
        except PdfError:
            continue
        if found is None:
            continue
        value = found.value
        stream = value if isinstance(value, Stream) else None
        items = stream.items if stream else value if isinstance(value, dict) else {}
        state, raw, names = (None, None, [])
        if stream and items.get("Subtype") != "Image":
            state, raw, names = doc.decode(stream)
        elif stream:
            from ..sources.filters import filter_names

            state, names = "available", filter_names(items, doc.resolve)
        role = None if not stream else "content" if ref in contents else {"XRef": "xref", "ObjStm": "object-stream"}.get(items.get("Type"), "unknown")
        name = lambda k: str(v) if isinstance(v := doc.resolve(items.get(k)), str) else None
        yield {"obj": ref.obj, "gen": ref.gen, "revision": found.revision, "src_start": found.start, "src_end": found.end, "value_text": format_value(value), "type_name": name("Type"), "subtype": name("Subtype"), "has_stream": stream is not None, "filters": names, "decode_state": state, "decoded": raw if decode else None, "stream_role": role}


def _pages(doc: Document):
    for p in doc.pages():
        yield {"page_number": p.number, "obj": p.ref.obj, "gen": p.ref.gen, "media_box": _box(p.media_box), "crop_box": _box(p.crop_box), "rotate": p.rotate, "content_count": len(p.contents), "annotation_count": len(p.annotations), "fonts": sorted(map(str, doc.dictionary(p.resources.get("Font")))), "xobjects": sorted(map(str, doc.dictionary(p.resources.get("XObject"))))}


def _observed(doc: Document, listed: bool = False):
    """Each page and what is seen on it, one page at a time."""
    from ..operators.content import Observer, Visible

    visible = Visible(doc)
    return ((p, Observer(doc, p, visible, listed)) for p in doc.pages())


def _content(doc: Document):
    for p, seen in _observed(doc, listed=True):
        for o in seen.operators:
            yield {"page_number": p.number, "op_index": o["op_index"], "operator": o["operator"], "operands": [{"kind": k, "token": t} for k, t in o["operands"]], "stream_obj": o["stream"].obj}


def _runs(doc: Document):
    for p, seen in _observed(doc):
        shown = {m["run_id"]: m["visibility"] for m in seen.marks if m["kind"] == "text"}
        for r in seen.runs:
            yield {"page_number": p.number, "font_obj": r["font"].obj if r["font"] else None, "stream_obj": r["stream"].obj, "visibility": shown[r["id"]]} | {k: r[k] for k in ("id", "content_order", "text", "glyph_count", "encoding_kind", "writing_mode", "x", "y", "font_size", "starts_new_line", "complete", "source_units", "mapped_units")}


def _marks(doc: Document):
    from ..operators.content import color_text

    for p, seen in _observed(doc):
        for m in seen.marks:
            yield {"page_number": p.number, "bbox": _box(m.get("bbox")), "fill": color_text(m["fill"]) if "fill" in m else None, "stroke": color_text(m["stroke"]) if "stroke" in m else None, "line_width": m.get("width"), "resource_obj": m["resource"].obj if m.get("resource") else None} | {k: m.get(k) for k in ("id", "content_order", "kind", "marked_content_id", "visibility", "text", "tag", "content_kind", "actual_text", "paint", "rule", "point_count", "closed", "cap", "join", "alpha", "blend", "soft_mask")}


#: Catalogs that Features has under another name.
METHODS = {c: f"{c}s" for c in ("destination", "page_label", "annotation", "outline", "field", "attachment", "signature", "layer", "finding")}


def _fragments(doc: Document):
    """All channels in one pass; a catalog that can't be read is empty."""
    from ..operators.features import Features
    from ..operators.fragments import document_fragments

    found = Features(doc, doc.pages())

    def catalog(name: str) -> list[dict]:
        try:
            return list(getattr(found, METHODS.get(name, name))())
        except (PdfError, RecursionError, ValueError, TypeError, KeyError, IndexError, AttributeError):
            return []

    for page, channel, id_, text in document_fragments(_marks(doc), catalog):
        if text:
            yield {"page_number": page, "channel": channel, "id": id_, "text": text}


#: What a reference to a page's surroundings is called; closures don't follow it.
UPWARD = ("Parent", "P", "Kids")


def references(value):
    """The references a value holds, but for those upward."""
    pending = [value]
    while pending:
        v = pending.pop()
        if isinstance(v, Ref):
            yield v
        elif isinstance(v, list):
            pending += v
        elif isinstance(v, (dict, Stream)):
            pending += [w for k, w in (v.items if isinstance(v, Stream) else v).items() if k not in UPWARD]


def _reachable(doc: Document, pages: list[int] | None):
    """The objects that the chosen pages need: the catalog, contents, annotations, resources, layers, and all they refer to."""
    root = doc.trailer.get("Root")
    pending = [*references(doc.catalog.get("OCProperties"))]
    for p in doc.pages():
        if pages is None or p.number in pages:
            pending += [*p.contents, *references(p.annotations), *references(p.resources)]
    seen = {root} if isinstance(root, Ref) else set()
    shown = [root] if isinstance(root, Ref) else []
    while pending:
        ref = pending.pop()
        if ref not in seen:
            seen.add(ref)
            if (value := doc.get(ref)) is not None:
                shown.append(ref)
                pending += references(value)
    for ref in shown:
        found = doc.object(ref)
        value = found.value
        items = value.items if isinstance(value, Stream) else value if isinstance(value, dict) else {}
        name = doc.resolve(items.get("Type"))
        yield {"obj": ref.obj, "gen": ref.gen, "revision": found.revision, "src_start": found.start, "type_name": str(name) if isinstance(name, str) else None, "has_stream": isinstance(value, Stream)}


def pruned(rows: list[dict], pages: list[int]) -> list[dict]:
    """Structure elements (parents before children) on the pages, on none, or above one that is kept."""
    chosen, above, kept = set(pages), set(), []
    for r in reversed(rows):
        if r["page_number"] is None or r["page_number"] in chosen or r["id"] in above:
            kept.append(r)
            above.add(r["parent_id"])
    return kept[::-1]


def _catalog(name: str, pages: list[int] | None = None):
    def rows(doc: Document):
        from ..operators.features import Features

        method = METHODS.get(name, name)
        made = getattr(Features(doc, doc.pages()), method)()
        for row in pruned(list(made), pages) if name == "structure" and pages is not None else made:
            yield row | {"bbox": _box(row["bbox"])} if "bbox" in row else row

    return rows


def _images(which: int, include_bytes: bool):
    def rows(doc: Document):
        from ..operators.features import images

        for row in images(doc, _observed(doc), include_bytes)[which]:
            yield row | {"bbox": _box(row["bbox"])} if "bbox" in row else row

    return rows


#: Products that say a document's text.
TEXTS = ("runs", "marks", "content", "fragments")
#: Rows and bytes of sources after which a kernel hands on what it has made.
ROWS, BYTES = 4096, 4_000_000


def copies(doc: Document, channels: tuple[str, ...] = ()) -> bool:
    """Whether the policy lets text out: a user's credential needs leave to copy, or for the accessibility channel alone that one's."""
    if doc.policy.permissions != "enforce" or doc.security is None:
        return True
    allowed = permissions(doc.security.p, doc.security.credential)
    return allowed["copy"] or bool(channels) and set(channels) == {"accessibility"} and allowed["accessibility"]


def _fields(schema: str) -> list[str]:
    """The columns of a flat or nested schema."""
    from pyspark.sql.types import _parse_datatype_string

    return [f"{f.name} {f.dataType.simpleString()}" for f in _parse_datatype_string(schema)]


def _made(doc: Document, name: str):
    """A product's rows of an open document."""
    of = {"objects": lambda d: _objects(d, True), "pages": _pages, "latest": _latest, "content": _content, "runs": _runs, "marks": _marks, "images": _images(0, True), "placements": _images(1, False)}
    if name == "opened":
        return [opened_row(doc.data, (), doc.policy, doc)]
    return [e.__dict__ for e in doc.entries] if name == "xref" else of[name](doc) if name in of else _catalog(name)(doc)


def _latest(doc: Document):
    """Of each object's entries the last one, and how many there are."""
    last: dict[tuple[int, int], list] = {}
    for e in doc.entries:
        if e.kind != "free":
            found = last.setdefault((e.obj, e.gen), [e, 0])
            found[0], found[1] = max(found[0], e, key=lambda o: (o.revision, o.seq)), found[1] + 1
    for (obj, gen), (e, n) in sorted(last.items()):
        yield {"obj": obj, "gen": gen, "revision": e.revision, "versions": n}


class Corpus:
    """policy and budgets hold for each document; passwords come with the rows (password) or for all (passwords)."""

    def __init__(self, table: DataFrame, policy: Policy | None = None, passwords: tuple[str, ...] = (), partitions: int | None = None):
        self.policy, self.passwords = policy or Policy(javascript="report", launch="report"), passwords
        table = table.select("doc_id", "content", F.col("password") if "password" in table.columns else F.lit(None).cast("string").alias("password"))
        self.table = table.repartition(partitions) if partitions else table

    def _rows(self, schema: str, of: Callable, whole: bool = False) -> DataFrame:
        policy, passwords = self.policy, self.passwords
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        spark_schema = _parse_datatype_string(schema)
        # Longer sources are never read into a kernel: their length alone blocks them.
        limit = policy.budget.source_bytes
        table = self.table if whole else self.table.where(F.octet_length("content") <= limit)
        if whole:
            table = table.withColumn("content", F.when(F.octet_length("content") <= limit, F.col("content")))

        def run(batches):
            import pyarrow as pa

            arrow = to_arrow_schema(spark_schema)
            names, raw = arrow.names, [f.name for f in arrow if pa.types.is_binary(f.type)]

            def packed(rows):
                return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, arrow.types)], schema=arrow)

            # Rows of many small documents go on together, those of large ones in parts; memory follows one document.
            made, read = [], 0
            for batch in batches:
                for doc_id, content, password in zip(batch.column("doc_id").to_pylist(), batch.column("content"), batch.column("password").to_pylist()):
                    own, content = (password,) if password is not None else (), content.as_py()
                    try:
                        with unswept():
                            mine = [{"doc_id": doc_id, **r} for r in of(content, own + passwords, policy)]
                    except (PdfError, RecursionError, ValueError, TypeError, KeyError, IndexError, AttributeError):
                        if whole:
                            raise
                        continue
                    made += mine
                    read += len(content or b"") + sum(len(r.get(n) or b"") for r in mine for n in raw)
                    if len(made) >= ROWS or read >= BYTES:
                        for k in range(0, len(made), ROWS):
                            yield packed(made[k : k + ROWS])
                        made, read = [], 0
            if made:
                yield packed(made)

        return table.mapInArrow(run, spark_schema)

    def _product(self, name: str, of: Callable, schema: str | None = None) -> DataFrame:
        def rows(content, passwords, policy):
            doc = Document(content, policy, passwords)
            return of(doc) if name not in TEXTS or copies(doc) else ()

        return self._rows(schema or SCHEMAS[name], rows)

    def opened(self) -> DataFrame:
        def rows(content, passwords, policy):
            if content is None:
                return [{"status": "blocked", "code": "resource-limit", "message": "source over the limit"}]
            return [opened_row(content, passwords, policy)]

        return self._rows(SCHEMAS["opened"], rows, whole=True)

    def judged(self) -> DataFrame:
        """The corpus's rows, sources over the limit without content, with the status that opening each gives: one kernel and no shuffle."""
        policy, passwords, limit = self.policy, self.passwords, self.policy.budget.source_bytes

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                content, status = batch.column("content"), []
                for raw, password, fit in zip(content, batch.column("password").to_pylist(), batch.column("fit").to_pylist()):
                    own = (password,) if password is not None else ()
                    status.append(opened_row(raw.as_py(), own + passwords, policy)["status"] if fit else "blocked")
                step = max(1, BYTES * len(status) // max(BYTES, content.nbytes))
                for k in range(0, len(status), step):
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, step) for c in ("doc_id", "content", "password")), pa.array(status[k : k + step], pa.string())], names=["doc_id", "content", "password", "status"])

        fit = F.coalesce(F.octet_length("content") <= limit, F.lit(False))
        return self.table.select("doc_id", F.when(fit, F.col("content")).alias("content"), "password", fit.alias("fit")).mapInArrow(run, "doc_id bigint, content binary, password string, status string")

    def admitted(self) -> "Corpus":
        """The documents that open under the policy."""
        return Corpus(self.judged().where("status in ('completed', 'partial')"), self.policy, self.passwords)

    def pairs(self, left: str, right: str, columns: tuple[str, ...], on: dict[str, str] | None = None, lefts: Callable = lambda r: True, rights: Callable = lambda r: True) -> DataFrame:
        """Columns of two products of each document, joined within it: the left's rows that lefts lets pass to the right's that rights does, by equal keys (left's name to right's).

        Each document is made and parsed once, and nothing is shuffled. A column is left's or else right's; `product.name`
        says which, and is called product_name.
        """
        kinds = {name: {f.split()[0]: f.split()[1] for f in _fields(SCHEMAS[name])} for name in (left, right)}
        keys, taken, schema = list((on or {}).items()), [], "doc_id bigint"
        for c in columns:
            side, _, name = c.rpartition(".")
            side = side or (left if name in kinds[left] else right)
            taken.append((c.replace(".", "_"), side == left, name))
            schema += f", {taken[-1][0]} {kinds[side][name]}"

        def rows(content, passwords, policy):
            doc = Document(content, policy, passwords)
            if {left, right} & set(TEXTS) and not copies(doc):
                return
            of: dict[tuple, list[dict]] = {}
            for r in filter(rights, _made(doc, right)):
                of.setdefault(tuple(r[k] for _, k in keys), []).append(r)
            # Each product has the whole budget, as it has alone.
            doc.spent = dict.fromkeys(doc.spent, 0)
            for l in filter(lefts, _made(doc, left)):  # noqa: E741
                key = tuple(l[k] for k, _ in keys)
                for r in of.get(key, ()) if None not in key else ():
                    yield {c: (l if mine else r).get(name) for c, mine, name in taken}

        return self._rows(schema, rows)

    def xref(self) -> DataFrame:
        return self._product("xref", lambda doc: [e.__dict__ for e in doc.entries])

    def objects(self, decode: bool = False) -> DataFrame:
        return self._product("objects", lambda doc: _objects(doc, decode))

    def stream(self, obj: int, gen: int = 0, decode: bool = True) -> DataFrame:
        """(doc_id, state, filters, bytes) of one stream of each document that has it."""

        def rows(doc: Document):
            value = doc.get(Ref(obj, gen))
            if isinstance(value, Stream):
                state, raw, names = doc.decode(value)
                yield {"state": state, "filters": names, "bytes": raw if decode else value.raw}

        return self._product("stream", rows, "doc_id bigint, state string, filters array<string>, bytes binary")

    def pages(self) -> DataFrame:
        return self._product("pages", _pages)

    def content(self) -> DataFrame:
        return self._product("content", _content)

    def runs(self) -> DataFrame:
        return self._product("runs", _runs)

    def marks(self) -> DataFrame:
        return self._product("marks", _marks)

    def features(self, catalog: str, pages: list[int] | None = None) -> DataFrame:
        """One catalog; a choice of pages filters destinations, labels and annotations, and prunes the structure."""
        if catalog not in CATALOGS:
            raise TypeError(f"a catalog is one of {', '.join(CATALOGS)}")
        found = self._product(catalog, _catalog(catalog, pages))
        return found.where(F.col("page_number").isin(pages)) if pages is not None and catalog in ("destination", "page_label", "annotation") else found

    def images(self, include_bytes: bool = False) -> DataFrame:
        return self._product("images", _images(0, include_bytes))

    def placements(self) -> DataFrame:
        return self._product("placements", _images(1, False))

    def attachment(self, id_: str) -> DataFrame:
        """(doc_id, id, name, bytes) of the attachment, unless the policy denies embedded files."""
        if self.policy.embedded_files == "deny":
            raise PermissionError("embedded files are denied")

        def rows(doc: Document):
            from ..operators.features import Features

            for a in Features(doc, doc.pages()).attachments():
                value = doc.get(Ref(a["obj"], a["gen"])) if a["id"] == id_ and a["obj"] is not None else None
                if isinstance(value, Stream):
                    yield {"id": a["id"], "name": a["name"], "bytes": doc.decoded(value)}

        return self._product("attachment", rows, "doc_id bigint, id string, name string, bytes binary")

    def verify_signatures(self, trust=None) -> DataFrame:
        """(doc_id, id, status, code): whether each signature's byte range covers the file and its digest and key hold.

        trust (signatures.Trust): anchors, revocation lists and the time of a chain that must lead to the signer's
        certificate, else the signature is untrusted; without it the chain isn't looked at.
        """

        def rows(content, passwords, policy):
            from ..operators.features import Features
            from ..operators.signatures import verify

            doc = Document(content, policy, passwords)
            return [{"id": s["id"], **verify(content, s, trust)} for s in Features(doc, doc.pages()).signatures()]

        return self._rows("doc_id bigint, id string, status string, code string, signer string, digest string", rows)

    def fragments(self, channels: tuple[str, ...] = ()) -> DataFrame:
        """(doc_id, page_number or null, channel, id, text) of the channels (none named: all), each document parsed once."""

        def rows(content, passwords, policy):
            doc = Document(content, policy, passwords)
            return (f for f in _fragments(doc) if not channels or f["channel"] in channels) if copies(doc, channels) else ()

        return self._rows("doc_id bigint, page_number int, channel string, id string, text string", rows)

    def reachable(self, pages: list[int] | None = None) -> DataFrame:
        """(doc_id, obj, gen, revision, src_start, type_name, has_stream): the objects that the pages (none named: all) need."""
        return self._product("reachable", lambda doc: _reachable(doc, pages))

    def search(self, query: str, **options) -> DataFrame:
        from ..operators.fragments import search

        return search(self.fragments(tuple(options.get("channels") or ())), query, **options)

    def read(self, max_characters: int, **options) -> DataFrame:
        from ..operators.fragments import read

        return read(self.fragments(tuple(options.get("channels") or ())), max_characters, **options)

    def layout(self) -> DataFrame:
        from ..operators.layout import blocks

        return blocks(self.runs())

    def regions(self) -> DataFrame:
        from ..operators.regions import regions

        return regions(self.layout())

    def tables(self) -> DataFrame:
        """Tables and label forms of every page, those that only the order of runs tells included."""
        from ..operators.knowledge import tables

        return tables(self.layout(), self.runs())

    def known_limits(self, stage: str = "knowledge") -> DataFrame:
        from ..operators.layout import known_limits

        return known_limits(self.runs(), stage)

    def knowledge(self) -> DataFrame:
        from ..operators.knowledge import chunks

        return chunks(self.layout())
