"""Token-id files: canonical length-limited Huffman codes of ids, decoded by table in independent blocks.

The code comes from the ids' counts over the whole corpus (package-merge, at most LIMIT bits). A
document's code words start on a byte; every STEP ids the file notes the bit offset, and all noted
places of a block are decoded together, one table look-up a step for each.

One file, little-endian::

    magic 8 bytes | vocabulary size u32 | code length of each id, u8 each | blocks ...
    block: documents u32 | ids u32 | marks u32 | payload bytes u64
           doc_id i64 each | doc_id known u8 each | ids u32 each | first byte u64 each
           mark offset in bits u64 each | payload | 4 zero bytes

Files follow each other in ascending doc_id order (null first); rows of one doc_id may fill several files.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop, fresh_path, text_batches
from .tokens import encoder, vocabulary_path

MAGIC = b"DLHUFF01"
LIMIT = 20
STEP = 256
BLOCK_IDS = 1 << 17
TARGET_BYTES = 24_000_000
#: Beyond so many files they grow instead; a file's bounds come from PARTS measured ranges.
MOST_FILES, PARTS = 10_000, 8


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits for each id by package-merge; 0 where the count is 0."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(ids)
    if n <= 1:
        out[ids] = 1
        return out
    if n > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = ids[np.argsort(counts[ids], kind="stable")]
    weight = counts[order].astype(np.float64)
    # A level holds single ids and pairs of the level below, by weight; a pair is marked -1.
    kinds, level = [], weight
    kind = np.arange(n)
    for _ in range(limit):
        kinds.append(kind)
        m = len(level) // 2
        pairs = level[: 2 * m].reshape(m, 2).sum(axis=1)
        merged = np.concatenate([weight, pairs])
        by = np.argsort(merged, kind="stable")
        level, kind = merged[by], np.where(by < n, by, -1)
    bits, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for kind in reversed(kinds):
        chosen = kind[:take]
        singles = chosen[chosen >= 0]
        bits[singles] += 1
        take = 2 * int((chosen < 0).sum())
    out[order] = bits
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words: shorter first, then by id."""
    ids = np.flatnonzero(lengths)
    order = ids[np.lexsort((ids, lengths[ids]))]
    codes, code, last = np.zeros(len(lengths), dtype=np.uint64), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        mine = order[lengths[order] == n]
        code <<= n - last
        last = n
        codes[mine] = code + np.arange(len(mine), dtype=np.uint64)
        code += len(mine)
    return codes


def encode_ids(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The code words of one document, and the bit offsets of every STEP-th id."""
    if not len(ids):
        return b"", np.zeros(0, dtype=np.uint64)
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    at = ends - bits
    word = at >> 5
    both = codes[ids] << (64 - bits - (at & 31)).astype(np.uint64)
    n = int(ends[-1] + 31 >> 5) + 1
    total = np.bincount(word, (both >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (both & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
    return total.astype(np.uint64).astype(">u4").tobytes()[: int(ends[-1] + 7 >> 3)], at[::STEP].astype(np.uint64)


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of the next `top` bits: the id, and its code's length."""
    top = max(1, int(lengths.max(initial=0)))
    ids = np.flatnonzero(lengths)
    order = ids[np.lexsort((ids, lengths[ids]))]
    spread = 1 << (top - lengths[order].astype(np.int64))
    table, step = np.zeros(1 << top, dtype=np.uint32), np.ones(1 << top, dtype=np.uint8)
    filled = np.repeat(order, spread)
    table[: len(filled)], step[: len(filled)] = filled, np.repeat(lengths[order], spread)
    return table, step, top


def decode_block(payload: bytes, marks: np.ndarray, sizes: np.ndarray, table: np.ndarray, step: np.ndarray, top: int) -> np.ndarray:
    """sizes: ids from each mark to the next. All marks advance together."""
    raw = np.frombuffer(payload + bytes(8), dtype=np.uint8)
    out = np.empty(int(sizes.sum()), dtype=np.uint32)
    order = np.argsort(-sizes, kind="stable")
    at, left, to = marks[order].astype(np.int64), sizes[order], (np.cumsum(sizes) - sizes)[order]
    for k in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-left, -k, side="left"))
        p = at[:live] >> 3
        window = np.zeros(live, dtype=np.uint32)
        for b in range(4):
            window = window << np.uint32(8) | raw[p + b]
        window = window << (at[:live] & 7).astype(np.uint32) >> np.uint32(32 - top)
        out[to[:live] + k] = table[window]
        at[:live] += step[window]
    return out


def _places(counts: np.ndarray) -> np.ndarray:
    """Ids from each mark to the next, document by document."""
    n = (counts + STEP - 1) // STEP
    out = np.full(int(n.sum()), STEP, dtype=np.int64)
    some = np.flatnonzero(n)
    out[np.cumsum(n)[some] - 1] = counts[some] - (n[some] - 1) * STEP
    return out


def write_block(out, docs: list[tuple]) -> None:
    """docs: (doc_id or None, ids, payload, mark offsets)."""
    sizes = np.array([len(d[2]) for d in docs], dtype=np.uint64)
    first = np.cumsum(sizes) - sizes
    marks = [np.frombuffer(d[3], dtype="<u8") + f * np.uint64(8) for d, f in zip(docs, first)]
    marks = np.concatenate(marks) if marks else np.zeros(0, dtype="<u8")
    out.write(np.array([len(docs), sum(d[1] for d in docs), len(marks)], dtype="<u4").tobytes() + np.array([sizes.sum()], dtype="<u8").tobytes())
    out.write(np.array([d[0] or 0 for d in docs], dtype="<i8").tobytes() + np.array([d[0] is not None for d in docs], dtype="u1").tobytes())
    out.write(np.array([d[1] for d in docs], dtype="<u4").tobytes() + first.astype("<u8").tobytes() + marks.astype("<u8").tobytes())
    for d in docs:
        out.write(d[2])
    out.write(bytes(4))


def read_blocks(data):
    """data: a binary file. Yields (doc_ids, known, ids of each document, all ids) block by block."""
    if data.read(8) != MAGIC:
        raise ValueError("not a token file")
    size = int(np.frombuffer(data.read(4), dtype="<u4")[0])
    tables = decode_table(np.frombuffer(data.read(size), dtype=np.uint8))
    while head := data.read(20):
        n, _, m = np.frombuffer(head[:12], dtype="<u4").tolist()
        size = int(np.frombuffer(head[12:], dtype="<u8")[0])
        doc_ids, known = np.frombuffer(data.read(8 * n), dtype="<i8"), np.frombuffer(data.read(n), dtype="u1").astype(bool)
        counts = np.frombuffer(data.read(4 * n), dtype="<u4").astype(np.int64)
        data.read(8 * n)
        marks = np.frombuffer(data.read(8 * m), dtype="<u8")
        yield doc_ids, known, counts, decode_block(data.read(size + 4), marks, _places(counts), *tables)


def _open(path: str, mode: str):
    """A file in the shared folder, whichever file system that is."""
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if mode == "w":
        files.create_dir(at.rpartition("/")[0], recursive=True)
        return files.open_output_stream(at)
    return files.open_input_stream(at, buffer_size=1 << 20)


def token_ids(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, size, n, ids): the bytes of each text, its ids with the end id, as little-endian numbers of two bytes if all fit, else of four."""

    def encode(batches):
        import pyarrow as pa

        tool = encoder(vocabulary)
        kind = "<u2" if max(tool.size, end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for part in text_batches(batch):
                texts = part.column("text").to_pylist()
                flat, counts = tool.encode_flat(texts)
                flat = np.insert(flat, np.cumsum(counts), end_id).astype(kind)
                ends = np.cumsum(counts + 1) * flat.itemsize
                ids = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
                sizes = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array(counts + 1), ids], names=["doc_id", "size", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, size bigint, n bigint, ids binary")


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4")


def id_counts(coded: DataFrame) -> DataFrame:
    """(id, count) over all ids of token_ids()."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for raw, n in zip(batch.column("ids"), batch.column("n").to_pylist()):
                found = np.bincount(_numbers(raw.as_buffer(), n))
                if len(found) > len(total):
                    total = np.r_[total, np.zeros(len(found) - len(total), dtype=np.int64)]
                total[: len(found)] += found
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["id", "count"])

    return coded.select("ids", "n").mapInArrow(count, "id int, count bigint").groupBy("id").agg(F.sum("count").alias("count"))


def _ranges(coded: DataFrame, files: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Bounds of doc_id, and for each range between them (nulls first, range k holds ids up to bounds[k - 1]) its first file and its files.

    The ranges, PARTS a file and one for each common doc_id, are measured in bytes; a range of one doc_id that
    is over a file's share gets several files.
    """
    marks = [i / (PARTS * files) for i in range(1, PARTS * files)]
    found = coded.agg(F.percentile_approx("doc_id", marks, F.lit(min(10**6, 100 * PARTS * files)))).first()[0] or []
    again = {x for x, y in zip(found, found[1:]) if x == y}
    bounds = np.array(sorted({*found, *(x - 1 for x in again if x > -(1 << 63))}), dtype=np.int64)

    def measure(batches):
        import pyarrow as pa

        total = np.zeros(len(bounds) + 2, dtype=np.int64)
        for batch in batches:
            np.add.at(total, _range_of(batch.column("doc_id"), bounds), batch.column("size").to_numpy() + 8)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["range", "bytes"])

    sizes = np.zeros(len(bounds) + 2, dtype=np.int64)
    for r in coded.select("doc_id", "size").mapInArrow(measure, "range bigint, bytes bigint").groupBy("range").agg(F.sum("bytes").alias("bytes")).collect():
        sizes[r["range"]] = r["bytes"]
    single = np.r_[True, np.diff(bounds, prepend=bounds[:1] - 2) == 1, False]
    share, out, no, filled = max(1.0, sizes.sum() / files), [], 0, 0
    for size, one in zip(sizes.tolist(), single.tolist()):
        if filled and filled + size > share:
            no, filled = no + 1, 0
        parts = max(1, round(size / share)) if one else 1
        out.append((no, parts))
        no, filled = (no + parts, 0) if parts > 1 else (no, filled + size)
    return bounds, out


def _range_of(doc_ids, bounds: np.ndarray) -> np.ndarray:
    """The range of each doc_id: 0 for nulls."""
    known = doc_ids.is_valid().to_numpy(zero_copy_only=False)
    return np.where(known, np.searchsorted(bounds, doc_ids.fill_null(0).to_numpy(), side="left") + 1, 0)


def _own_tasks(spark, n: int) -> np.ndarray:
    """For each of n tasks a number that repartition(n, number) deals to it."""
    seen = spark.range(n * (n.bit_length() + 12)).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("task")).agg(F.min("id").alias("id")).collect()  # a row a task
    out = np.arange(n)
    for r in seen:
        out[r["task"]] = r["id"]
    return out


def write_token_files(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = 1, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Encode docs (doc_id, text) and write the files below path (default: a new place in the shared folder).

    Returns the manifest (file_no, path, docs, ids, start): a row for each file, start the ids in files before.
    Texts are encoded once; their ids are written, counted, and coded in a second pass. What reaches the driver:
    the ids' counts (at most the vocabulary), and PARTS measured ranges a file. A file takes about target_bytes
    of texts, more beyond MOST_FILES files, and is written by a task of its own, block by block.
    Null texts are empty and hold the end id alone; very long texts are whole documents of one file; repeated
    rows stay; an empty table writes no file; other columns are not looked at.
    """
    spark = docs.sparkSession
    vocabulary, path = vocabulary or vocabulary_path(), path or fresh_path(spark, "token-files")
    coded = cut(token_ids(docs, vocabulary, end_id), "ids")
    total = coded.agg(F.sum("size")).first()[0] or 0
    counts = id_counts(coded).collect()
    table = np.zeros(max([end_id, *(r["id"] for r in counts)]) + 1, dtype=np.int64)
    for r in counts:
        table[r["id"]] = r["count"]
    lengths = code_lengths(table)
    codes = canonical(lengths)
    bounds, of_range = _ranges(coded, min(MOST_FILES, max(1, math.ceil(total / target_bytes))))
    first, parts = (np.array(x, dtype=np.int64) for x in zip(*of_range))
    files = int((first + parts).max())
    tasks = _own_tasks(spark, files)

    def encode(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            raws, sizes = [x.as_buffer() for x in batch.column("ids")], batch.column("n").to_pylist()
            done = [encode_ids(_numbers(x, n), lengths, codes) for x, n in zip(raws, sizes)]
            at = _range_of(batch.column("doc_id"), bounds)
            where = first[at]
            for k in np.flatnonzero(parts[at] > 1).tolist():  # a range of several files: by doc_id, equal ones by their ids
                where[k] += xxh3_64_intdigest(raws[k]) % int(parts[at[k]])
            yield pa.RecordBatch.from_arrays([pa.array(tasks[where]), pa.array(where.astype(np.int32)), batch.column("doc_id"), batch.column("n"), pa.array([x for x, _ in done], pa.binary()), pa.array([y.tobytes() for _, y in done], pa.binary())], names=["task", "file_no", "doc_id", "n", "payload", "marks"])

    def write(batches):
        import pyarrow as pa

        now, out, held, rows, seen = None, None, [], 0, [0, 0]
        made = []

        def close():
            if out is not None:
                if held:
                    write_block(out, held)
                out.close()
                made.append((now, name, *seen))

        for batch in batches:
            for no, doc_id, n, payload, at in zip(*(batch.column(c).to_pylist() for c in ("file_no", "doc_id", "n", "payload", "marks"))):
                if no != now:
                    close()
                    now, held, rows, seen = no, [], 0, [0, 0]
                    name = f"{path}/{no:08d}-{uuid.uuid4().hex}.ids"
                    out = _open(name, "w")
                    out.write(MAGIC + np.array([len(lengths)], dtype="<u4").tobytes() + lengths.tobytes())
                held.append((doc_id, n, payload, at))
                rows, seen[0], seen[1] = rows + n, seen[0] + 1, seen[1] + n
                if rows >= BLOCK_IDS:
                    write_block(out, held)
                    held, rows = [], 0
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made]), pa.array([m[2] for m in made], pa.int64()), pa.array([m[3] for m in made], pa.int64())], names=["file_no", "path", "docs", "ids"])

    made = coded.mapInArrow(encode, "task bigint, file_no int, doc_id bigint, n bigint, payload binary, marks binary")
    made = made.repartition(files, "task").sortWithinPartitions("file_no", "doc_id", "n", "payload")
    made = cut(made.mapInArrow(write, "file_no int, path string, docs bigint, ids bigint"), "written")
    drop(coded)
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return cut(made.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("bigint"))), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files, ids as little-endian uint32 bytes."""
    return _read(manifest, "ids binary", lambda x: x)


def token_table(docs: DataFrame, **options) -> DataFrame:
    """Write the files, read them back: (doc_id, start, n_tokens, ids_crc32), start the ids of all documents before."""
    return _read(write_token_files(docs, **options), "ids_crc32 bigint", zlib.crc32)


def _read(manifest: DataFrame, column: str, of) -> DataFrame:
    schema = T._parse_datatype_string(f"doc_id bigint, start bigint, n_tokens bigint, {column}")

    def read(batches):
        import pyarrow as pa

        kind = pa.binary() if column.endswith("binary") else pa.int64()
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with _open(path, "r") as data:
                    for doc_ids, known, counts, ids in read_blocks(data):
                        ends = np.cumsum(counts)
                        raw = ids.astype("<u4").tobytes()
                        made = [of(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=~known), pa.array(start + ends - counts), pa.array(counts), pa.array(made, kind)], names=schema.names)
                        start += int(ends[-1]) if len(ends) else 0

    files = max(1, manifest.count())
    tasks = F.array(*[F.lit(int(t)) for t in _own_tasks(manifest.sparkSession, files)])
    place = F.row_number().over(Window.orderBy("file_no")) - 1  # a row a file
    dealt = manifest.select("path", "start", F.element_at(tasks, place + 1).cast("bigint").alias("task")).repartition(files, "task")
    return dealt.select("path", "start").mapInArrow(read, schema)
