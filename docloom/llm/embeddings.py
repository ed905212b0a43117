"""Embedding near-duplicates by a forest of random-projection trees.

Equal vectors are one class with a count. Trees are grown on a bounded sample (SAMPLE classes,
smallest hash first): a node is split along a random direction near the middle of its sample, and
what lies close to the cut goes to both sides. Every class is routed through every tree; classes
that share a leaf are compared in double precision, and a pair counts in the first leaf it shares.
A leaf with more than CROWD classes is split again by planes between pairs of its own members, so
leaves stay bounded however many vectors there are, though the trees sent out never grow past the sample's.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop, heavy_join, reached

LEAST = 0.95
SAMPLE = 20_000
TREES = 8
LEAF = 256
SPILL = 0.08
CROWD = 4096
SEED = 20


def unit(column) -> np.ndarray:
    """An Arrow column of vectors - finite, of one length, none zero - as unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(axis=1, initial=0, keepdims=True)
    return x / np.linalg.norm(x, axis=1)[:, None]


def grow(sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> list[list[tuple]]:
    """Trees as lists of (direction or None, cut, left, right); a leaf has no direction and its number in `left`."""
    rng = np.random.default_rng(seed)
    scale, out, leaves = total / max(1, len(sample)), [], 0
    margin = SPILL / np.sqrt(max(1, sample.shape[1]))
    for _ in range(trees):
        nodes: list[tuple] = [()]
        todo = [(0, np.arange(len(sample)), 0)]
        while todo:
            at, rows, depth = todo.pop()
            if len(rows) * scale <= leaf or len(rows) < 32 or depth > 40:
                nodes[at] = (None, 0.0, leaves, 0)
                leaves += 1
                continue
            direction = rng.standard_normal(sample.shape[1])
            direction /= np.linalg.norm(direction)
            p = sample[rows] @ direction
            middle = float(np.quantile(p, rng.uniform(0.4, 0.6)))
            low, high = rows[p < middle + margin], rows[p >= middle - margin]
            if max(len(low), len(high)) >= 0.9 * len(rows):  # nothing gained: all lie near the cut
                low, high = rows[p < middle], rows[p >= middle]
                if not len(low) or not len(high):
                    nodes[at] = (None, 0.0, leaves, 0)
                    leaves += 1
                    continue
            nodes[at] = (direction, middle, len(nodes), len(nodes) + 1)
            nodes += [(), ()]
            todo += [(len(nodes) - 2, low, depth + 1), (len(nodes) - 1, high, depth + 1)]
        out.append(nodes)
    return out


def route(trees: list[list[tuple]], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that every row falls into."""
    margin = SPILL / np.sqrt(max(1, x.shape[1]))
    rows_out, leaves_out = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for nodes in trees:
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            direction, middle, left, right = nodes[at]
            if direction is None:
                rows_out.append(rows)
                leaves_out.append(np.full(len(rows), left))
                continue
            p = x[rows] @ direction
            todo += [(k, r) for k, r in ((left, rows[p < middle + margin]), (right, rows[p >= middle - margin])) if len(r)]
    return np.concatenate(rows_out), np.concatenate(leaves_out)


def compare(x: np.ndarray, weight: np.ndarray, member: np.ndarray, leaf: int, least: float, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """One leaf: links of each row (weights of its partners that this leaf is the first to hold), and the smallest row it is tied to.

    member: each row's leaves, padded with negative numbers. Whether two rows share an earlier leaf is told by
    the product of their rows in a table of 0 and 1, a column for each earlier leaf of two members or more.
    """
    n = len(x)
    row, column = np.nonzero((member >= 0) & (member < leaf))
    ids, place, count = np.unique(member[row, column], return_inverse=True, return_counts=True)
    common = count > 1
    held = np.zeros((n, int(common.sum())), dtype=np.uint8)
    some = common[place]
    held[row[some], (np.cumsum(common) - 1)[place[some]]] = 1
    links, root, weight = np.zeros(n), np.arange(n), weight.astype(np.float64)
    for s in range(0, n, step):
        near = x[s : s + step] @ x[s:].T >= least
        near &= np.arange(s, n) > np.arange(s, min(n, s + step))[:, None]
        if near.any():
            for c in range(0, held.shape[1], 2048):
                near &= held[s : s + step, c : c + 2048].astype(np.float32) @ held[s:, c : c + 2048].astype(np.float32).T < 0.5
        i, j = np.nonzero(near)
        if len(i):
            links[s : s + step] += near @ weight[s:]
            links[s:] += weight[s : s + step] @ near
            root = reached(n, np.r_[i + s, np.arange(n)], np.r_[j + s, root])
    return links.astype(np.int64), root


def _split_crowded(routed: DataFrame, classes: DataFrame, crowd: int) -> DataFrame:
    """Leaves of more than crowd classes split by planes between random members, as often as their size asks."""
    for turn in range(8):
        each = routed.select("h", F.explode("leaves").alias("leaf"))
        over = cut(each.groupBy("leaf").agg(F.count("*").alias("m")).where(F.col("m") > crowd), "crowded")
        if over.isEmpty():
            return routed
        inside = each.join(over, "leaf").join(classes.select("h", "embedding"), "h")
        # Ten pairs of members a leaf, picked by hash: a fixed number, aggregated with map-side combine.
        picks = [F.min_by("embedding", F.xxhash64("h", F.lit(100 * turn + i))).alias(f"p{i}") for i in range(20)]
        planes = inside.groupBy("leaf").agg(F.max("m").alias("m"), *picks).select("leaf", "m", F.array(*[f"p{i}" for i in range(20)]).alias("planes"))

        def deeper(batches):
            import pyarrow as pa

            for batch in batches:
                x, leaf, size = unit(batch.column("embedding")), batch.column("leaf").to_numpy(), batch.column("m").to_numpy()
                out_h, out_leaf = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
                h = batch.column("h").to_numpy()
                for one in np.unique(leaf).tolist():
                    mine = np.flatnonzero(leaf == one)
                    p = unit(batch.column("planes")[int(mine[0])].values)
                    normals = p[::2] - p[1::2]
                    levels = min(10, max(1, int(np.ceil(np.log2(size[mine[0]] / LEAF)))))
                    row, side = mine, np.zeros(len(mine), dtype=np.int64)
                    for normal in normals[:levels]:
                        d = x[row] @ normal
                        near = np.abs(d) < SPILL / np.sqrt(x.shape[1]) * np.linalg.norm(normal)
                        side = 2 * side + (d > 0)
                        row, side = np.r_[row, row[near]], np.r_[side, side[near] ^ 1]
                    out_h.append(h[row])
                    out_leaf.append(((one * 1_000_003 + (turn << 40) + (1 << 50)) % (1 << 62) + side * 7919) & (1 << 62) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_h)), pa.array(np.concatenate(out_leaf))], names=["h", "leaf"])

        more = inside.drop("m").join(planes, "leaf").select("h", "leaf", "m", "embedding", "planes").mapInArrow(deeper, "h bigint, leaf bigint")
        calm = each.join(over.select("leaf"), "leaf", "left_anti").select("h", "leaf")
        before, routed = routed, cut(calm.unionByName(more).groupBy("h").agg(F.collect_set("leaf").alias("leaves")), "routed")
        drop(before, over)
    return routed


def near_duplicates(vectors: DataFrame, least: float = LEAST, sample: int = SAMPLE, trees: int = TREES, crowd: int = CROWD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding).

    Links are pairs found with a cosine of at least `least`; equal vectors are always found. Vectors that
    are null, zero, of another length than most of the table's (the shorter of two as common), or hold null
    or non-finite components link with nothing and are their own component; so do rows with a null vec_id,
    whose component_id is null. Repeated rows count as others; of equal distances none is preferred. An empty
    table gives no rows; other columns are not looked at.
    """
    rows = vectors.select("vec_id", "embedding")
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    good = good & F.forall("embedding", fine) & F.exists("embedding", lambda v: v != 0)
    widths = rows.where(good).groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = widths["w"] if widths else 0
    good = good & (F.size("embedding") == width)
    # Equal vectors by a hash; a second one tells should two vectors ever share it, and another seed is taken.
    for seed in range(100):
        marked = rows.withColumn("h", F.when(good, F.xxhash64("embedding", F.lit(seed))))
        proof = F.xxhash64("embedding", F.lit(-1 - seed))
        classes = cut(marked.where("h is not null").groupBy("h").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"), (F.min(proof) != F.max(proof)).alias("mixed")), "classes")
        if classes.where("mixed").isEmpty():
            break
        drop(classes)
    marked, written, classes = marked.select("vec_id", "h"), classes, classes.drop("mixed")
    total = classes.count()
    picked = classes.select("embedding", F.xxhash64("h", F.lit(SEED)).alias("o")).orderBy("o").limit(sample).select("embedding").toArrow().column("embedding").combine_chunks()
    forest = grow(unit(picked), total, trees) if len(picked) else []

    def routing(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            at, leaf = route(forest, unit(batch.column("embedding")))
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(batch.num_rows + 1))
            leaves = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf[order], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("h"), leaves], names=["h", "leaves"])

    routed = cut(classes.select("h", "embedding").mapInArrow(routing, "h bigint, leaves array<bigint>"), "routed")
    routed = _split_crowded(routed, classes, crowd)

    def leaves_compared(batches):
        import pyarrow as pa

        def one(leaf, got):
            h, n, raw, leaves = (pa.concat_arrays([g[k] for g in got]) for k in range(4))
            if len(h) < 2:
                return None
            h, n, sizes = h.to_numpy(), n.to_numpy(), leaves.value_lengths().to_numpy()
            member = np.full((len(h), int(sizes.max())), -1, dtype=np.int64)
            member[np.arange(member.shape[1]) < sizes[:, None]] = leaves.flatten().to_numpy()
            links, root = compare(unit(raw), n, member, leaf, least)
            some = np.flatnonzero((links > 0) | (root != np.arange(len(h))))
            return pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(h[root[some]]), pa.array(links[some])], names=["a", "b", "links"]) if len(some) else None

        now, got = None, []
        for batch in batches:
            ids = batch.column("leaf").to_numpy()
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if ids[s] != now and got:
                    if (made := one(now, got)) is not None:
                        yield made
                    got = []
                now = int(ids[s])
                got.append([batch.column(c).slice(s, e - s) for c in ("h", "n", "embedding", "leaves")])
        if got and (made := one(now, got)) is not None:
            yield made

    dealt = classes.join(routed, "h").select(F.explode("leaves").alias("leaf"), "h", "n", "embedding", "leaves")
    found = cut(dealt.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(leaves_compared, "a bigint, b bigint, links bigint"), "links")
    links = found.groupBy(F.col("a").alias("h")).agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b")).select(F.col("node").alias("h"), "root")
    rooted = classes.select("h", "least", "n").join(roots, "h", "left").join(links, "h", "left")
    rooted = cut(rooted.select("h", F.coalesce("root", "h").alias("root"), "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "rooted")
    drop(written, routed, found)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = heavy_join(rooted, smallest, "root").select("h", "n_links", "component_id")
    ids = cut(marked, "ids")
    lone = ids.where("h is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = heavy_join(ids.where("h is not null"), named, "h").select("vec_id", F.col("n_links").cast("bigint").alias("n_links"), "component_id").unionByName(lone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
