"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text: hits and density of insult words, of words learnt from labelled texts, of
disguised insults (digits and signs for letters); how near a second-person word stands to a hit;
capitals, shouted words, exclamation marks, other punctuation, odd spellings, drawn-out letters, length.

The model is fitted on a bounded sample of labelled rows (TRAIN_ROWS, smallest hash of doc_id first), in the
same way whatever their number: words are learnt on either half for the features of the other, trees on three
quarters for the margins of the fourth, which the isotonic map is fitted on. Every text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, text_batches

TRAIN_ROWS = 20_000
LEXICON = 4_000
PREFIX = 5

# Plain insults and second-person words.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers pathetic worthless trash scum clown disgusting garbage imbecile jerk fool ugly creep filth vermin cretin idiota estúpido imbécil basura idioten dumm trottel arschloch abschaum connard crétin salaud ordure".split())
SECOND = frozenset("you your yours yourself u ur du dein deine dir dich ihr euch tu tes ton toi vous votre usted ustedes tú te ti".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "+": "t"})

EDGE = re.compile(r"^[^\w@$*!]+|[^\w@$*]+$")
ODD = re.compile(r"[^\W\d_][\d@$*!|+._-]+[^\W\d_]|[*@$]{2,}")
DRAWN = re.compile(r"(\w)\1\1")
INSULT, LEARNT, YOU, SHOUT, STRANGE, HIDDEN, LONG = (1 << i for i in range(7))
NAMES = ("insults", "insult_density", "learnt", "learnt_density", "hidden", "nearness", "second_person", "capitals", "shouted", "marks", "punctuation", "strange", "drawn", "length")


def grams(text: str) -> set[str]:
    """Words of three letters or more, and the beginnings of longer ones (marked *)."""
    words = {EDGE.sub("", w) for w in set(text.lower().split())}
    words = {w for w in words if len(w) >= 3}
    return words | {w[:n] + "*" for w in words for n in (PREFIX - 1, PREFIX) if len(w) > n}


class Features:
    """Dense features of texts; what single words say is remembered."""

    def __init__(self, lexicon: frozenset[str], limit: int = 300_000):
        self.lexicon, self.limit, self.known = lexicon, limit, {}

    def word(self, raw: str) -> int:
        bare = EDGE.sub("", raw)
        w = bare.lower()
        code = INSULT * (w in INSULTS) | LEARNT * (w in self.lexicon or any(len(w) > n and w[:n] + "*" in self.lexicon for n in (PREFIX - 1, PREFIX)))
        code |= YOU * (w in SECOND) | SHOUT * (len(bare) > 2 and bare.isupper()) | STRANGE * bool(ODD.search(w)) | LONG * bool(DRAWN.search(w))
        if not code & INSULT and not w.isalpha() and w:
            plain = re.sub(r"[^\w]|_", "", w.translate(LEET))
            code |= HIDDEN * (plain in INSULTS or plain in self.lexicon)
        return code

    def row(self, text: str | None) -> np.ndarray:
        text = text or ""
        words = text.split()
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.word(w)
        code = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        if len(known) > self.limit:
            known.clear()
        n = max(1, len(words))
        at = np.flatnonzero(code & (INSULT | LEARNT | HIDDEN))
        you = np.flatnonzero(code & YOU)
        near = 0.0
        if len(at) and len(you):
            right = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.minimum(right, len(you) - 1)]), np.abs(at - you[np.maximum(right - 1, 0)])).min()
            near = 1 / (1 + float(gap))
        of = lambda bit: int(np.count_nonzero(code & bit))
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=128)
        size = max(1, int(raw.sum()))
        letters = max(1, int(raw[65:91].sum() + raw[97:123].sum()))
        marks = int(raw[33] + raw[63])
        punctuation = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()) - marks
        return np.array([
            math.log1p(of(INSULT)), of(INSULT) / n, math.log1p(of(LEARNT)), of(LEARNT) / n, math.log1p(of(HIDDEN)), near, of(YOU) / n,
            raw[65:91].sum() / letters, of(SHOUT) / n, marks / size, punctuation / size, of(STRANGE) / n, of(LONG) / n, math.log1p(size),
        ])


class Boosted:
    """Binary log-loss boosting on quantile bins; a tree is kept as arrays (feature, cut, left, right, value)."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.trees: list[list[tuple]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        self.cuts = [np.unique(np.r_[c, (np.unique(col)[:-1] + np.unique(col)[1:]) / 2 if len(np.unique(col)) <= self.bins else c]) for c, col in zip(self.cuts, x.T)]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(self.cuts, x.T)], axis=1)
        p = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.base = math.log(p / (1 - p))
        f = np.full(len(y), self.base)
        for _ in range(self.n):
            q = 1 / (1 + np.exp(-f))
            tree: list[tuple] = []
            self._grow(tree, binned, y - q, np.maximum(q * (1 - q), 1e-9), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += self._walk(tree, x)
        return self

    def _grow(self, tree, binned, g, h, rows, depth) -> int:
        at, G, H = len(tree), g[rows].sum(), h[rows].sum()
        tree.append((-1, 0.0, 0, 0, self.rate * G / (H + 1.0)))
        best = (1e-6, -1, 0)
        if depth:
            for j, cuts in enumerate(self.cuts):
                b = binned[rows, j]
                gs, hs = np.cumsum(np.bincount(b, g[rows], len(cuts) + 1))[:-1], np.cumsum(np.bincount(b, h[rows], len(cuts) + 1))[:-1]
                gain = gs**2 / (hs + 1.0) + (G - gs) ** 2 / (H - hs + 1.0) - G**2 / (H + 1.0)
                gain[(hs < self.least) | (H - hs < self.least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
        if best[1] >= 0:
            low = binned[rows, best[1]] <= best[2]
            left = self._grow(tree, binned, g, h, rows[low], depth - 1)
            right = self._grow(tree, binned, g, h, rows[~low], depth - 1)
            tree[at] = (best[1], float(self.cuts[best[1]][best[2]]), left, right, 0.0)
        return at

    @staticmethod
    def _walk(tree, x) -> np.ndarray:
        feature, cut_at, left, right, value = (np.array(c) for c in zip(*tree))
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= cut_at[node], left[node], right[node])
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, probability), a little smoothed towards the mean."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of labels, sum of margins
    for m, t in zip(margin[order].tolist(), y[order].tolist()):
        blocks.append([1.0, t, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, s, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + s, blocks[-1][2] + k]
    at = np.array([k / w for w, _, k in blocks])
    value = np.array([(s + 0.5 * y.mean()) / (w + 0.5) for w, s, _ in blocks])
    return at, np.maximum.accumulate(value)


class Model:
    def __init__(self, lexicon: frozenset[str], boosted: Boosted | None, knots: tuple | None, base: float):
        self.lexicon, self.boosted, self.knots, self.base = lexicon, boosted, knots, base

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.boosted is None:  # no labels of both kinds: insults alone decide
            hit = np.expm1(x[:, 0]) + np.expm1(x[:, 4])
            return np.where(hit > 0, 1 - 0.4 / (1 + hit), 0.25)
        margin = self.boosted.margin(x)
        calibrated = np.interp(margin, *self.knots)
        return np.clip(0.99 * calibrated + 0.01 / (1 + np.exp(-margin)), 0, 1)


def _lexicons(train: DataFrame) -> list[frozenset[str]]:
    """Grams far commoner in toxic texts than chance allows, at most LEXICON: of fold 0, of fold 1, of both; equal texts count once."""

    def count(batches):
        import pyarrow as pa

        found = [Counter() for _ in range(4)]
        for batch in batches:
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
                found[2 * fold + toxic].update(grams(text or ""))
        some = list(set().union(*found))
        for k in range(0, len(some), 50_000):
            part = some[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([f[g] for g in part], pa.int64()) for f in found)], names=["gram", "q0", "p0", "q1", "p1"])

    once = train.groupBy("fold", F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    rows = train.join(F.broadcast(once), "doc_id", "left_semi").select("text", "toxic", "fold")  # at most TRAIN_ROWS ids
    each = {r["fold"]: (r["t"], r["n"]) for r in rows.groupBy("fold").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()}
    sums = [F.sum(c).alias(c) for c in ("q0", "p0", "q1", "p1")]
    both = cut(rows.mapInArrow(count, "gram string, q0 bigint, p0 bigint, q1 bigint, p1 bigint").groupBy("gram").agg(*sums).where("p0 + p1 >= 4"), "grams")
    out = []
    for folds in ((0,), (1,), (0, 1)):
        toxic, n = (sum(each.get(k, (0, 0))[i] for k in folds) for i in (0, 1))
        if not toxic or toxic == n:
            out.append(frozenset())
            continue
        rate = (toxic + 0.5) / (n + 1)
        p, q = (sum((F.col(f"{c}{k}") for k in folds[1:]), F.col(f"{c}{folds[0]}")) for c in "pq")
        share = p / (p + q)
        # Evidence in nats that the gram's texts are toxic more often than the rest, and nearly always.
        proof = p * F.log(share / F.lit(rate)) + F.when(q > 0, q * F.log((1 - share) / F.lit(1 - rate))).otherwise(0)
        kept = both.where((p >= 4) & (share >= 0.85)).withColumn("proof", proof).where("proof >= 11").orderBy(F.desc("proof"), "gram").limit(LEXICON)
        out.append(frozenset(r["gram"] for r in kept.select("gram").collect()))
    drop(both)
    return out


def _features(rows: DataFrame, lexicon: frozenset[str], keep: list[str]) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        tool = Features(lexicon)
        for batch in batches:
            x = [tool.row(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return rows.mapInArrow(run, ", ".join(f"{k} bigint" for k in keep) + ", x array<double>")


def held_out() -> F.Column:
    """Rows kept from all learning: crc32 of the doc_id as text (null: empty) is a multiple of 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """labels: (doc_id, toxic), rows with nulls ignored, the largest label of a doc_id counts."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("bigint").alias("toxic"))
    known = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "labels")
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most train_rows rows
    # One text for each doc_id, should it be repeated: the one of least hash.
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.max("toxic").alias("toxic"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))
    train = cut(texts.select("doc_id", F.col("t.text").alias("text"), "toxic", fold.alias("fold")), "training")
    drop(known)
    first, second, whole = _lexicons(train)
    rows = [r for k, lexicon in ((0, second), (1, first)) for r in _features(train.where(F.col("fold") == k), lexicon, ["doc_id", "toxic"]).collect()]
    drop(train)
    rows.sort(key=lambda r: r["doc_id"])
    x, y = np.array([r["x"] for r in rows]).reshape(-1, len(NAMES)), np.array([r["toxic"] for r in rows], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(whole, None, None, float(y.mean()) if len(y) else 0.0)
    # Quarters by turns in each class, so all have both as far as there are enough.
    quarter = np.zeros(len(y), dtype=np.int64)
    for kind in (0, 1):
        quarter[y == kind] = np.arange(int((y == kind).sum())) % 4
    margin = np.zeros(len(y))
    for k in range(4):
        mine = quarter == k
        if mine.any():
            margin[mine] = Boosted().fit(x[~mine], y[~mine]).margin(x[mine])
    return Model(whole, Boosted().fit(x, y), isotonic(margin, y), float(y.mean()))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null and empty texts are scored as empty, repeated rows alike."""

    def run(batches):
        import pyarrow as pa

        tool = Features(model.lexicon)
        for batch in batches:
            for part in text_batches(batch):
                x = np.array([tool.row(t) for t in part.column("text").to_pylist()]).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, by a model of the labelled rows that aren't held out.

    Null and empty texts are scored like any other, very long ones whole; repeated rows get the same score, rows
    that repeat a doc_id with another text their own, and one such text is learnt from; equal margins get equal
    scores; an empty table gives no rows; other columns are not looked at. Without labels of both kinds nothing
    can be learnt: then the insult words alone decide.
    """
    return scores(docs, fit(docs, labels, train_rows))


def keep_clean(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns, whatever their names.

    Null and empty texts are judged like any other, very long ones whole; repeated rows share their fate; an
    empty table stays empty.
    """
    model = fit(docs, labels, train_rows)

    def run(batches):
        import pyarrow as pa

        tool = Features(model.lexicon)
        for batch in batches:
            for part in text_batches(batch):
                x = np.array([tool.row(t) for t in part.column("text").to_pylist()]).reshape(-1, len(NAMES))
                yield part.filter(pa.array(model.score(x) < 0.5))

    return docs.mapInArrow(run, docs.schema)
