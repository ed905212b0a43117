"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints that differ in at most `radius` bits agree in one of radius + 1 blocks of bits, so each
distinct fingerprint goes to a bucket for each block; a bucket that holds too many is dealt again by
blocks of its remaining bits, until it is small or all its members differ in a few bits only. Inside
a bucket fingerprints are sorted by Gray rank; runs of neighbours make leaves, runs of leaves make
upper nodes, and a node holds the bits its members share. Pairs of nodes are walked from the top:
differences in shared bits add up on the way down, and a pair of groups is dropped as a whole once
they pass the radius, or linked as a whole once nothing below can pass it.

keep_first() takes a wider radius than blocks can guarantee: a long fingerprint of five-word shingles, of
which each block deals the documents into buckets; inside a bucket the same order and tree find the pairs
within the radius, and their exact Jaccard similarity decides.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop, heavy_join, reached, text_batches

WIDTH = 4
RADIUS = 4
SEED = 42
FAN = 8
CROWD = 2048
ALL = (1 << 64) - 1
LONG = 4_000_000
#: What keep_first() takes for near copies: words a shingle and Jaccard similarity.
NEAR_WIDTH, NEAR = 5, 0.8
#: Its fingerprint: WORDS of 64 bits, of which a pair at NEAR differs in 0.15. In one of the 91 blocks of BLOCK bits it agrees with a chance of 0.9999, and in the first CHECKED words it differs in at most NEAR_RADIUS bits with one of over 0.9999.
WORDS, BLOCK, CHECKED, NEAR_RADIUS = 20, 14, 2, 40
#: Of all its bits a pair at NEAR differs in 194, standard deviation 13 (sets of 4 and 5 shingles: 240 and 14).
LONG_RADIUS = 300
#: So few words are counted bit by bit.
FEW = 24
#: A bucket with more pairs than DENSE a row (and DENSE_LEAST) first gives neighbours alone; what their verified links leave apart is joined up by the whole fingerprints in groups, to which the sets are sent. Of buckets over LARGE all rows count as met.
DENSE, DENSE_LEAST, LARGE = 4, 64, 4096
#: A group of more than 2 * TILE sets is dealt into at most TILES parts, each pair of parts a task's: no set is sent more than TILES - 1 times. A task compares AT_ONCE shingles at a time.
TILE, TILES = 512, 16
AT_ONCE = 2_000_000
#: keep_first() sends ids of documents to all tasks while they are no more than this; beyond, texts are shuffled to them.
SENT_IDS = 1_000_000


def _shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    last = len(words) - width + 1
    found = [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[:last].tolist(), ends[width - 1 :].tolist())]
    return np.array(found, dtype=np.uint64)


def _parts(raw: bytes, size: int):
    """A very long text in stretches that end at white space."""
    at = 0
    while len(raw) - at > size:
        cut_at = re.compile(rb"[\x20\x09-\x0d]").search(raw, at + size)
        if not cut_at:
            break
        yield raw[at : cut_at.start()]
        at = cut_at.start()
    yield raw[at:]


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit SimHash of a text's word shingles; a null text or one without words has 0."""
    from xxhash import xxh64_intdigest

    ones, n, carry = np.zeros(64, dtype=np.int64), 0, []
    for part in _parts((text or "").encode().lower(), LONG):  # bytes.lower() and split() know ASCII alone
        words = carry + part.split()
        if len(words) >= width:
            bits = np.unpackbits(_shingle_hashes(words, width).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones, n = ones + bits.sum(axis=0, dtype=np.int64), n + len(bits)
            carry = words[len(words) - width + 1 :]
        else:
            carry = words
    if not n:
        return xxh64_intdigest(b" ".join(carry), SEED) if carry else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): fp the fingerprint as a signed long."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_batches(batch):
                fp = np.array([fingerprint(t, width) for t in part.column("text").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _grouped(first: np.ndarray, last: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at most FAN neighbours within the same bucket: where they start and end. same: the bucket of each item."""
    new = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
    place = np.arange(len(same)) - np.repeat(new, np.diff(np.r_[new, len(same)]))
    starts = np.flatnonzero(place % FAN == 0)
    return starts, np.r_[starts[1:], len(same)]


def links(bucket: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row places, enough to connect all fingerprints of one bucket that are linked directly or in steps.

    bucket: a number for each row, fp: unsigned fingerprints, distinct within a bucket.
    """
    if len(fp) < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.lexsort((gray_rank(fp), bucket))
    bucket, fp = bucket[order], fp[order]
    # Levels from the rows up to one root a bucket: (first child, end of children, shared mask, pattern, bucket).
    mask, pattern, owner = np.full(len(fp), ALL, dtype=np.uint64), fp, bucket
    levels = [(np.arange(len(fp)), np.arange(len(fp)) + 1, mask, pattern, owner)]
    while True:
        starts, ends = _grouped(mask, pattern, owner)
        if len(starts) == len(owner):
            break
        ones, some = np.bitwise_and.reduceat(pattern, starts), np.bitwise_or.reduceat(pattern, starts)
        mask = np.bitwise_and.reduceat(mask, starts) & (ones | ~some)
        pattern, owner = ones & mask, owner[starts]
        levels.append((starts, ends, mask, pattern, owner))
    top = len(levels) - 1
    rows_from = [np.arange(len(fp))]
    rows_to = [np.arange(len(fp)) + 1]
    for starts, ends, *_ in levels[1:]:
        rows_from.append(rows_from[-1][starts])
        rows_to.append(rows_to[-1][ends - 1])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    roots = np.arange(len(levels[top][0]))
    stack = [(top, roots[k : k + 4096], roots[k : k + 4096], None) for k in range(0, len(roots), 4096)]
    while stack:
        level, a, b, passed = stack.pop()
        mask, pattern = levels[level][2:4]
        shared = mask[a] & mask[b]
        if passed is None:
            gone = np.bitwise_count((pattern[a] ^ pattern[b]) & shared).astype(np.int64)
        else:  # only the bits that this level adds to what the level above had compared
            gone = passed[1] + np.bitwise_count((pattern[a] ^ pattern[b]) & shared & ~passed[0])
        near = gone <= radius
        a, b, shared, gone = a[near], b[near], shared[near], gone[near]
        whole = gone + np.bitwise_count(~shared) <= radius  # no pair below can pass the radius
        if whole.any():
            lo, hi = rows_from[level], rows_to[level]
            for x, y in ((a[whole], a[whole]), (a[whole], b[whole])):
                n = hi[y] - lo[y]
                member = np.repeat(lo[y] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                out.append((np.repeat(lo[x], n), member))
        if level == 0:
            continue
        a, b, shared, gone = a[~whole], b[~whole], shared[~whole], gone[~whole]
        if not len(a):
            continue
        starts, ends = levels[level][:2]
        na, nb = ends[a] - starts[a], ends[b] - starts[b]
        n = na * nb
        pair = np.repeat(np.arange(len(a)), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        ca, cb = starts[a][pair] + k // nb[pair], starts[b][pair] + k % nb[pair]
        once = (ca <= cb) if level > 1 else (ca < cb)
        ca, cb, pair = ca[once], cb[once], pair[once]
        step = 65_536
        stack += [(level - 1, ca[s : s + step], cb[s : s + step], (shared[pair[s : s + step]], gone[pair[s : s + step]])) for s in range(0, len(ca), step)]
    a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, dtype=np.int64)
    b = np.concatenate([y for _, y in out]) if out else np.zeros(0, dtype=np.int64)
    root = reached(len(fp), a, b)
    far = np.flatnonzero(root != np.arange(len(fp)))
    return order[root[far]], order[far]


def _bits(count: int, blocks: int) -> list[tuple[int, int]]:
    """count bits as nearly equal blocks: (shift, width)."""
    edges = [round(i * count / blocks) for i in range(blocks + 1)]
    return [(s, e - s) for s, e in zip(edges, edges[1:])]


def _dealt(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, held, key): held the mask of the bits that the bucket's members share, key their values."""
    masks = [((1 << w) - 1) << s for s, w in _bits(64, radius + 1)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return fps.select("fp", F.explode(F.array(*[F.lit(m).cast("bigint") for m in signed])).alias("held")).withColumn("key", F.col("fp").bitwiseAND(F.col("held")))


def _redealt(rows: DataFrame, radius: int) -> DataFrame:
    """The rows of crowded buckets, by blocks of the bits not yet held."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp, held = batch.column("fp").to_numpy(), batch.column("held").to_numpy()
            for mask in np.unique(held).tolist():
                mine, free = fp[held == mask], [b for b in range(64) if not mask >> b & 1]
                for s, w in _bits(len(free), radius + 1):
                    more = mask & ALL | sum(1 << b for b in free[s : s + w])
                    more = more - (1 << 64) if more >> 63 else more
                    yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(np.full(len(mine), more, dtype=np.int64)), pa.array(mine & more)], names=["fp", "held", "key"])

    return rows.select("fp", "held").mapInArrow(run, "fp bigint, held bigint, key bigint")


def _bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        def found(held, key, fp):
            bucket = np.cumsum(np.r_[0, (held[1:] != held[:-1]) | (key[1:] != key[:-1])])
            a, b = links(bucket, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

        left: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * 3
        for batch in batches:
            now = [np.r_[x, batch.column(c).to_numpy()] for x, c in zip(left, ("held", "key", "fp"))]
            held, key, fp = now
            if len(fp) < 16_384:
                left = now
                continue
            same = (held == held[-1]) & (key == key[-1])
            end = len(fp) - int(np.argmin(same[::-1])) if not same.all() else 0
            if end:
                yield found(held[:end], key[:end], fp[:end])
            left = [x[end:] for x in now]
        if len(left[2]):
            yield found(*left)

    dealt = rows.select("held", "key", "fp").repartition("held", "key").sortWithinPartitions("held", "key")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def linked(fps: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(a, b): edges that connect distinct fingerprints (fp) at most radius bits apart, at most one a row and bucket."""
    rows, out = _dealt(fps, radius), None
    free = 64
    while True:
        rows = cut(rows, "buckets")
        hot = rows.groupBy("held", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("held", "key")
        free -= free // (radius + 1)
        last = free <= 12  # so few free bits hold no more fingerprints than a bucket may
        hot = None if last else cut(hot, "crowded")
        if last or hot.isEmpty():
            now = _bucket_links(rows, radius)
            return now if out is None else out.unionByName(now)
        now = _bucket_links(rows.join(hot, ["held", "key"], "left_anti"), radius)
        out = now if out is None else out.unionByName(now)
        rows = _redealt(rows.join(hot, ["held", "key"], "left_semi"), radius).distinct()


def simhash_groups(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most radius differing bits, its own
    included. Null and empty texts have fingerprint 0 and link like others; repeated rows stay; a null
    doc_id keeps its row and is never a component_id unless its component holds no other; other
    columns are not looked at.
    """
    marked = cut(fingerprints(docs, width), "fingerprints")
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(linked(classes.select("fp"), radius))
    # A class without links is its own component; the rest take their root's smallest doc_id.
    rooted = classes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return heavy_join(marked, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of a text's word shingles, ascending, each once; a shorter text is one shingle, a null text or one without words has none."""
    from xxhash import xxh64_intdigest

    found, carry = [np.zeros(0, dtype=np.uint64)], []
    for part in _parts((text or "").encode().lower(), LONG):
        words = carry + part.split()
        if len(words) >= width:
            found.append(_shingle_hashes(words, width))
            carry = words[len(words) - width + 1 :]
        else:
            carry = words
    if len(found) == 1 and carry:
        found.append(np.array([xxh64_intdigest(b" ".join(carry), SEED)], dtype=np.uint64))
    return np.unique(np.concatenate(found))


def _ones(words: np.ndarray) -> np.ndarray:
    """How many of n words have each bit, by adders over whole words; words: (m, n), result (m, 64)."""
    found, weight = np.zeros((len(words), 64), dtype=np.int64), 1
    while words.shape[1]:
        carries = [words[:, :0]]
        while words.shape[1] > FEW:
            n = words.shape[1] // 3
            x, y, z = words[:, :n], words[:, n : 2 * n], words[:, 2 * n : 3 * n]
            odd = x ^ y
            carries.append((x & y) | (odd & z))
            words = np.concatenate([odd ^ z, words[:, 3 * n :]], axis=1)
        bits = np.unpackbits(words.view(np.uint8).reshape(*words.shape, 8), axis=2, bitorder="little")
        found += weight * bits.sum(axis=1, dtype=np.int64)
        words, weight = np.concatenate(carries, axis=1), 2 * weight
    return found


def long_fingerprint(found: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The SimHash of a set of shingle hashes in `words` words of 64 bits: each bit as in over half the shingles, or if even as in the first; 0 for none."""
    ones = np.zeros((words, 64), dtype=np.int64)
    salt = (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for at in range(0, len(found), 4096):
        x = found[None, at : at + 4096] ^ salt
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += 2 * _ones(x)
        if not at:
            ones += _ones(x[:, :1])
    return np.packbits(ones > len(found), axis=1, bitorder="little").view(np.uint64)[:, 0]


def _set_key(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, d, s, fp) of rows (doc_id, d, text): s stands for the set of shingles, fp is its long fingerprint."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_batches(batch):
                s, fp = [], []
                for text in part.column("text").to_pylist():
                    found = shingles(text, width)
                    s.append(_set_key(found))
                    fp.append(long_fingerprint(found).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("d"), pa.array(s, pa.int64()), pa.array(fp, pa.binary())], names=["doc_id", "d", "s", "fp"])

    return docs.mapInArrow(run, "doc_id bigint, d bigint, s bigint, fp binary")


def _blocks(classes: DataFrame) -> DataFrame:
    """(key, s, w0, w1, ...): each row of classes (s, fp) once for each block of its fingerprint, with the first CHECKED words."""
    names = [f"w{k}" for k in range(CHECKED)]
    count = WORDS * 64 // BLOCK

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fp = np.frombuffer(b"".join(part.column("fp").to_pylist()), dtype=np.uint64).reshape(-1, WORDS)
                bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")[:, : count * BLOCK].reshape(-1, count, BLOCK)
                key = (bits @ (1 << np.arange(BLOCK))) | (np.arange(count) << BLOCK)
                rows = [key.ravel(), part.column("s").to_numpy().repeat(count), *(fp[:, k].view(np.int64).repeat(count) for k in range(CHECKED))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["key", "s", *names])

    return classes.select("s", "fp").mapInArrow(run, ", ".join(f"{x} bigint" for x in ("key", "s", *names)))


def near_pairs(bucket: np.ndarray, fp: np.ndarray, label: np.ndarray, radius: int, full: np.ndarray):
    """Yields all pairs of row places (a, b) of one bucket and different labels that differ in at most radius bits.

    bucket: ascending numbers from 0, fp: unsigned words (n, any number), in the Gray order of each bucket. Buckets
    that the caller marks in `full` meanwhile are not walked further.
    """
    top, low, high = bucket, label, label
    levels = [(np.arange(len(fp)), np.arange(len(fp)) + 1, np.full(fp.shape, ALL, dtype=np.uint64), fp, bucket, low, high)]
    while True:
        mask, pattern = levels[-1][2:4]
        starts, ends = _grouped(mask, pattern, top)
        if len(starts) == len(top):
            break
        ones, some = np.bitwise_and.reduceat(pattern, starts), np.bitwise_or.reduceat(pattern, starts)
        mask = np.bitwise_and.reduceat(mask, starts) & (ones | ~some)
        top, low, high = top[starts], np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
        levels.append((starts, ends, mask, ones & mask, top, low, high))
    step = 8192
    roots = np.arange(len(top))
    stack = [(len(levels) - 1, roots[k : k + step], roots[k : k + step]) for k in range(0, len(roots), step)]
    while stack:
        level, a, b = stack.pop()
        starts, ends, mask, pattern, owner, low, high = levels[level]
        apart = (pattern[a] ^ pattern[b]) & mask[a] & mask[b]
        near = np.bitwise_count(apart).sum(axis=1, dtype=np.int64) <= radius
        near &= ~full[owner[a]] & ((low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b]))
        a, b = a[near], b[near]
        if level <= 1:  # all rows of a leaf with all of another
            x, y = (starts[node][:, None] + np.arange(FAN if level else 1) for node in (a, b))
            gone = np.zeros((len(a), x.shape[1], x.shape[1]), dtype=np.uint8 if fp.shape[1] < 4 else np.int64)
            for word in fp.T:
                gone += np.bitwise_count(word.take(x, mode="clip")[:, :, None] ^ word.take(y, mode="clip")[:, None, :])
            node, i, j = np.nonzero(gone <= radius)
            x, y = x[node, i], y[node, j]
            some = (x < ends[a[node]]) & (y < ends[b[node]]) & (x < y)
            x, y = x[some], y[some]
            some = label[x] != label[y]
            if some.any():
                yield x[some], y[some]
            continue
        na, nb = ends[a] - starts[a], ends[b] - starts[b]
        n = na * nb
        pair = np.repeat(np.arange(len(a)), n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        ca, cb = starts[a][pair] + k // nb[pair], starts[b][pair] + k % nb[pair]
        once = ca <= cb
        ca, cb = ca[once], cb[once]
        stack += [(level - 1, ca[s : s + step], cb[s : s + step]) for s in range(0, len(ca), step)]


def _gray_order(bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
    ranks, odd = [], np.zeros(len(fp), dtype=np.uint64)
    for word in fp.T:  # a word after an odd one runs backwards
        ranks.append(gray_rank(word) ^ (np.uint64(0) - odd))
        odd = ranks[-1] & np.uint64(1)
    return np.lexsort((*ranks[::-1], bucket))


def _whole_keys(batches, names: list[str], most: int):
    """Batches of rows sorted by key as tables of at least `most` rows, all rows of a key in one."""
    import pyarrow as pa

    held = []
    for batch in batches:
        held.append(batch.select(names))
        if sum(b.num_rows for b in held) < most:
            continue
        now = pa.Table.from_batches(held).combine_chunks()
        key = now.column("key").to_numpy()
        end = int(np.searchsorted(key, key[-1]))
        if end:
            yield now.slice(0, end)
        held = now.slice(end).to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _placed(table) -> tuple:
    """(bucket, fp, order) of rows (key, w0, ... or fp) sorted by key: in Gray order, which is order of the rows."""
    key = table.column("key").to_numpy()
    bucket = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    if "fp" in table.column_names:
        fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), dtype=np.uint64).reshape(-1, WORDS)
    else:
        fp = np.stack([table.column(f"w{k}").to_numpy() for k in range(CHECKED)], axis=1).view(np.uint64)
    order = _gray_order(bucket, fp[:, :CHECKED])
    return bucket, fp[order], order


def _long_pairs(bucket: np.ndarray, fp: np.ndarray, label: np.ndarray, radius: int, long_radius: int):
    """The pairs of near_pairs() by the first CHECKED words of fp that differ in at most long_radius bits of all words."""
    for a, b in near_pairs(bucket, np.ascontiguousarray(fp[:, :CHECKED]), label, radius, np.zeros(bucket[-1] + 1, dtype=bool)):
        near = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1, dtype=np.int64) <= long_radius
        if near.any():
            yield a[near], b[near]


def _met(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b, key) of rows (key, s, w0, ...): pairs of s within the radius that share a bucket.

    A dense bucket gives rows (s, null, key) of those with a pair, and (a, b, key) of some next to each other.
    """
    names = ["key", "s", *(f"w{k}" for k in range(CHECKED))]

    def run(batches):
        import pyarrow as pa

        def sent(a, b, key):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, key)], names=["a", "b", "key"])

        for table in _whole_keys(batches, names, 65_536):
            bucket, fp, order = _placed(table)
            s = table.column("s").to_numpy()[order]
            size = np.bincount(bucket)
            count, over, full = np.zeros(len(size), dtype=np.int64), *np.zeros((2, len(size)), dtype=bool)
            met, held = np.zeros(len(s), dtype=bool), []
            for a, b in near_pairs(bucket, fp, s, radius, full):
                met[a] = met[b] = True
                some = ~over[bucket[a]]
                held.append((a[some], b[some]))
                count += np.bincount(bucket[a], minlength=len(size))
                over |= (count > DENSE * size) & (count > DENSE_LEAST)
                full |= over & (size > LARGE)
            for a, b in held:
                some = ~over[bucket[a]]
                yield sent(s[a[some]], s[b[some]], [None] * int(some.sum()))
            key = table.column("key").to_numpy()
            at = np.flatnonzero(over[bucket] & (met | full[bucket]))
            yield sent(s[at], [None] * len(at), key[at])
            a, b = at[:-1], at[1:]
            a, b = a[key[a] == key[b]], b[key[a] == key[b]]
            yield sent(s[a], s[b], key[a])

    dealt = rows.select(names).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a bigint, b bigint, key bigint")


def _shared(codes: np.ndarray, starts: np.ndarray, flag: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many elements the sets a and b share, pair by pair; a ascending, codes[starts[k] : starts[k + 1]] set k, flag all False."""
    lens = starts[b + 1] - starts[b]
    ends = np.cumsum(lens)
    theirs = codes[np.repeat(starts[b] - (ends - lens), lens) + np.arange(int(ends[-1]))]
    hit = np.zeros(len(theirs), dtype=np.int64)
    new = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    for x, y in zip(new, np.r_[new[1:], len(a)]):
        mine = codes[starts[a[x]] : starts[a[x] + 1]]
        flag[mine] = True
        at = slice(ends[x] - lens[x], ends[y - 1])
        hit[at] = flag[theirs[at]]
        flag[mine] = False
    return np.add.reduceat(hit, ends - lens)


def _groups(rows: DataFrame, radius: int, long_radius: int) -> DataFrame:
    """(a, b): edges that join up all s of rows (key, s, label, fp) that share a bucket, have different labels and are within both radii; fewer than rows."""
    names = ["key", "s", "label", "fp"]

    def run(batches):
        import pyarrow as pa

        for table in _whole_keys(batches, names, 16_384):
            bucket, fp, order = _placed(table)
            s, label = (table.column(c).to_numpy()[order] for c in ("s", "label"))
            place, root = np.arange(len(s)), np.arange(len(s))
            for a, b in _long_pairs(bucket, fp, label, radius, long_radius):
                some = root[a] != root[b]
                if some.any():
                    root = reached(len(s), np.r_[place, a[some]], np.r_[root, b[some]])
            far = np.flatnonzero(root != place)
            yield pa.RecordBatch.from_arrays([pa.array(s[far]), pa.array(s[root[far]])], names=["a", "b"])

    dealt = rows.select(names).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _tiled(rows: DataFrame, tile: int, tiles: int) -> DataFrame:
    """rows (s, root, ...) with their keys: one for all of a root, or of more than 2 * tile one for each two of at most `tiles` parts."""
    large = rows.groupBy("root").count().where(F.col("count") > 2 * tile).select("root", F.least(F.ceil(F.col("count") / tile).cast("int"), F.lit(tiles)).alias("parts"))
    rows = rows.join(_sent(large), "root", "left").withColumn("parts", F.coalesce("parts", F.lit(2)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("s"), "parts").cast("int"))
    others = F.array_except(F.sequence(F.lit(0), F.col("parts") - 1), F.array("part"))
    keys = F.transform(others, lambda k: F.xxhash64("root", F.least("part", k), F.greatest("part", k)))
    return rows.withColumn("keys", keys).drop("root", "parts", "part")


def _dense_links(rows: DataFrame, radius: int, long_radius: int, least: float) -> DataFrame:
    """(a, b): links between labels that a similarity of at least `least` joins up, of rows (key, label, fp, found).

    All pairs of a key within both radii are compared, but for those that earlier ones of the task have joined up.
    """
    names = ["key", "label", "fp", "found"]

    def run(batches):
        import pyarrow as pa

        for table in _whole_keys(batches, names, 1024):
            bucket, fp, order = _placed(table)
            sets = table.column("found").combine_chunks().take(pa.array(order))
            sets = pa.concat_arrays(sets.chunks) if isinstance(sets, pa.ChunkedArray) else sets
            starts = sets.offsets.to_numpy().astype(np.int64)
            starts, values = starts - starts[0], sets.flatten().to_numpy()
            words, codes = np.unique(values, return_inverse=True)
            flag, lens = np.zeros(len(words), dtype=bool), np.diff(starts)
            labels, mine = np.unique(table.column("label").to_numpy()[order], return_inverse=True)
            root = np.arange(len(labels))
            for a, b in _long_pairs(bucket, fp, mine, radius, long_radius):
                some = (root[mine[a]] != root[mine[b]]) & (np.minimum(lens[a], lens[b]) >= least * np.maximum(lens[a], lens[b]))
                a, b = a[some], b[some]
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                while len(a):
                    end = max(1, int(np.searchsorted(np.cumsum(lens[b[:16_384]]), AT_ONCE)))
                    x, y = a[:end], b[:end]
                    both = _shared(codes, starts, flag, x, y)
                    near = both >= least * (lens[x] + lens[y] - both)
                    a, b = a[end:], b[end:]
                    if near.any():
                        now = reached(len(labels), np.r_[np.arange(len(labels)), mine[x[near]]], np.r_[root, mine[y[near]]])
                        far = np.flatnonzero(now != root)
                        yield pa.RecordBatch.from_arrays([pa.array(labels[far]), pa.array(labels[now[far]])], names=["a", "b"])
                        root = now
                        some = root[mine[a]] != root[mine[b]]
                        a, b = a[some], b[some]

    dealt = rows.select(names).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(s, found) of rows (text), once for each s."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_batches(batch):
                found = [shingles(text, width) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(map(_set_key, found), pa.int64()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], names=["s", "found"])

    return docs.select("text").mapInArrow(run, "s bigint, found array<bigint>").groupBy("s").agg(F.first("found").alias("found"))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least `least`."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            near = np.zeros(batch.num_rows, dtype=bool)
            for k in range(batch.num_rows):
                p, q = x[k].values.to_numpy(), y[k].values.to_numpy()
                if min(len(p), len(q)) >= least * max(len(p), len(q)):
                    both = len(p) + len(q) - len(np.union1d(p, q))
                    near[k] = both >= least * (len(p) + len(q) - both)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    both = pairs.join(sets.select(F.col("s").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("s").alias("b"), F.col("found").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _sent(ids: DataFrame) -> DataFrame:
    """ids, to all tasks while they are few."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def similar(marked: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b): links that join up all sets with a similarity of at least `least`. marked: as of _sketched(), docs: (d, text).

    Sets whose fingerprints share a block meet, and of a bucket all pairs within the radius are compared. Where
    they are many - large groups of near copies -, verified neighbours are joined up first; the whole fingerprints
    tell which of the sets still apart may be similar, and each set is sent to the group of those. Joins meet a set
    once, so rows grow with the sets and not with the buckets of a set or the square of a group.
    """
    classes = cut(marked.groupBy("s").agg(F.min("d").alias("d"), F.first("fp").alias("fp")), "sets")
    met = cut(_met(_blocks(classes), NEAR_RADIUS), "met")

    def sets(needed: DataFrame) -> DataFrame:
        texts = cut(classes.join(needed.distinct(), "s", "left_semi").select("d").distinct(), "texts")
        return cut(_sets(docs.join(_sent(texts), "d", "left_semi"), width), "shingles")

    drawn = F.struct(F.xxhash64("a", "b").alias("o"), "b")
    few = met.where("key is not null and b is not null").groupBy("a").agg(F.min(drawn)["b"].alias("p"), F.max(drawn)["b"].alias("q"))
    few = few.select("a", F.explode(F.array("p", "q")).alias("b"))
    pairs = met.where("key is null").select("a", "b").unionByName(few)
    pairs = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    found = cut(_verified(pairs, sets(pairs.select(F.explode(F.array("a", "b")).alias("s"))), least), "similar")
    dense = met.where("b is null").groupBy(F.col("a").alias("s")).agg(F.collect_list("key").alias("keys"))
    dense = cut(dense.join(classes.select("s", "fp"), "s"), "dense")
    if dense.isEmpty():
        return found
    labels = components(found).select(F.col("node").alias("s"), F.col("root").alias("label"))
    dense = dense.join(labels, "s", "left").withColumn("label", F.coalesce("label", "s"))
    groups = components(_groups(dense.select(F.explode("keys").alias("key"), "s", "label", "fp"), NEAR_RADIUS, LONG_RADIUS))
    apart = cut(dense.drop("keys").join(groups.select(F.col("node").alias("s"), "root"), "s"), "apart")
    if apart.isEmpty():
        return found
    apart = _tiled(apart, TILE, TILES).join(sets(apart.select("s")), "s").withColumn("key", F.explode("keys"))
    return found.unionByName(cut(_dense_links(apart, NEAR_RADIUS, LONG_RADIUS, least), "similar"))


def keep_first(docs: DataFrame, width: int = NEAR_WIDTH, least: float = NEAR) -> DataFrame:
    """docs, all columns, with one row of each group of near copies: of those with the smallest doc_id; rows with a null doc_id stay.

    Near copies have a Jaccard similarity of at least `least` on shingles of `width` words, or are linked
    in steps of such; pairs come from the index over their SimHash fingerprints. Rows are told apart by doc_id and text, so different texts may share a doc_id.
    """
    rows = docs.withColumn("__d", F.xxhash64("text"))
    texts = rows.select("doc_id", F.col("__d").alias("d"), "text")
    marked = cut(_sketched(texts, width), "sketches")
    found = components(similar(marked, texts.select("d", "text"), width, least))
    mine = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "d"))
    firsts = marked.groupBy("s").agg(F.min(mine).alias("first")).join(found.select(F.col("node").alias("s"), "root"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    firsts = firsts.select("s", "root").join(firsts.groupBy("root").agg(F.min("first").alias("first")), "root").select("s", "first")
    ids = cut(marked.where("doc_id is not null").select("doc_id", "d", "s").join(firsts, "s").select("doc_id", F.col("d").alias("__d"), (F.struct("doc_id", "d") == F.col("first")).alias("kept")), "groups")
    gone = cut(ids.where("not kept").select("doc_id", "__d").distinct(), "gone")
    kept = rows.join(_sent(gone), ["doc_id", "__d"], "left_anti")
    if not ids.where("kept").groupBy("doc_id", "__d").count().where("count > 1").isEmpty():
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id", "__d"]).unionByName(kept.where("doc_id is null"))
    return kept.select(docs.columns)
