"""The pipeline against the same stages written plainly, on a small corpus."""

import collections
import importlib.util
import random
import re

import pytest

from docloom.llm import packing, simhash, toxicity

from .test_operators import corpus, crc, library, prose

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")


def write(spark, path):
    rows = [(d, t, "en", f"src{i % 3}", len(t or "")) for i, (d, t) in enumerate(corpus()) if d not in (400, 5, None)]
    rows += [(500 + i, f"{prose(30, 900 + i)} you idiot {prose(9, 950 + i)} moron", "en", "src9", 1) for i in range(20)]
    rows += [(600, prose(20, 77) + " " + prose(40, 5000) + " " + prose(20, 78), "en", "src0", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    marks = [(d, 1, int(d >= 500 and d < 600)) for d, *_ in rows if d % 2]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(40, 5000)), (2, prose(40, 5001))], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows


def shingles(text):
    """A text's five-word shingles; a shorter text is one, one without words has none."""
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    path = f"file://{tmp_path}"
    rows = write(spark, path)
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, labels).collect() if r["predicted"]}
    assert toxic >= {d for d in range(500, 520)} and not toxic & set(range(40))
    left = [(d, t) for d, t, *_ in rows if d not in toxic]
    sets = [shingles(t) for _, t in left]
    root = list(range(len(left)))
    for _ in left:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a == b or len(a & b) >= 0.8 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    least = collections.defaultdict(list)
    for (d, _), r in zip(left, root):
        least[r].append(d)
    left = [(d, t) for (d, t), r in zip(left, root) if d == min(least[r])]
    raws = [(t or "").encode() for _, t in left]
    words = [(t or "").lower().split() for _, t in left]
    seen = collections.Counter(b[i : i + 400] for b in raws for i in range(len(b) - 399))
    runs = collections.Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    after = []
    for (d, t), b, w in zip(left, raws, words):
        mask = [False] * len(b)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                mask[i : i + 400] = [True] * 400
        begins = [len(t[: m.start()].encode()) for m in re.finditer(r"\S+", t or "")][1:]
        bounds = [0, *begins, len(b)]
        for i in range(len(w) - 50):
            if runs[tuple(w[i : i + 51])] > 1:
                mask[bounds[i] : bounds[i + 51]] = [True] * (bounds[i + 51] - bounds[i])
        kept = bytes(x for x, m in zip(b, mask) if not m).decode("utf-8", "ignore") if any(mask) else t
        if not any(mask) or kept:
            after.append((d, kept))
    after = [(d, t) for d, t in after if d != 600]
    want = collections.Counter()
    for d, t in after:
        ids, start = [*library(t), 2], 0
        for n in packing.binary_lengths(len(ids)):
            want[(d, start, n, crc(ids[start : start + n]))] += 1
            start += n
    got = corpus_pipeline.run(spark, path).collect()
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


def test_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    path = f"file://{tmp_path}"
    write(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0


def test_short_words_are_cut(spark):
    """Passages of 51 short words, far under 400 bytes, in other case and white space; 50 words stay."""
    import corpus_pipeline

    run, other = (" ".join(f"{c}{i % 10}{'abcde'[i // 10 % 5]}" for i in range(51)) for c in "xy")
    fifty, single = other.rsplit(" ", 1)[0], " ".join("abcdefghij"[i * i % 7] + "klm"[i % 3] * (i % 2) for i in range(51))
    rows = [(1, f"Head one {run} one tail"), (2, "head two\n" + run.upper().replace(" ", "\u00a0\n") + " two tail"), (3, f"{fifty} three"), (4, f"four {fifty}"), (5, f"é {single}  five"), (6, f"six {single}"), (7, run), (8, None), (None, f"none {run}"), (9, "short"), (10, "日本 " * 60 + "end")]
    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows], "doc_id bigint, text string, n_chars int").repartition(3)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    want = dict(rows) | {1: "Head one one tail", 2: "head two\ntwo tail", 5: "é five", 6: "six ", None: "none ", 10: "end"}
    del want[7]
    assert got == {d: (t, len(t or "")) for d, t in want.items()}


def test_near_copies_of_five_words(spark):
    """One document of each pair with five-word Jaccard from 0.8 on, of which most differ in more than 4 bits of op1."""
    import corpus_pipeline

    rows, near = [], []
    for i in range(40):
        words = prose(300, 7000 + i).split()
        copy = list(words)
        for at in range(20, 300, 280 // (4 + i % 4)):
            copy[at] = f"new{at}"
        x, y = ({tuple(w[k : k + 5]) for k in range(296)} for w in (words, copy))
        rows += [(i, " ".join(words)), (1000 + i, " ".join(copy))]
        near.append(len(x & y) >= 0.8 * len(x | y))
    assert 10 < sum(near) < 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == {*range(40), *(1000 + i for i in range(40) if not near[i])}


def test_near_copies_among_unlike(spark, monkeypatch):
    """Many variants of a text that share passages but are no near copies of each other lose no link, in dense buckets either."""
    base, rows = prose(300, 7500).split(), []
    for i in range(120):
        words = list(base)
        places = random.Random(i).sample(range(300), 13)
        for at in places[:7]:
            words[at] = f"v{i}w{at}"
        copy = list(words)
        for at in places[7:]:
            copy[at] = f"c{i}w{at}"
        rows += [(i, " ".join(words)), (1000 + i, " ".join(copy))]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    groups = collections.Counter(map(find, range(len(rows))))
    assert 100 < len(groups) < 200
    least = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min(d, least.get(find(k), d))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == sorted(least.values())
    monkeypatch.setattr(simhash, "DENSE", 0, raising=False)
    monkeypatch.setattr(simhash, "DENSE_LEAST", 0, raising=False)
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == sorted(least.values())


def test_near_copies_by_fingerprint(spark, monkeypatch):
    """The pairs come from the index over fingerprints: with a radius of 0 near copies stay, copies go."""
    text = prose(300, 7600)
    rows = [(1, text), (2, text.replace(" ", "\n")), (3, text + " more words"), (4, prose(300, 7601))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == [1, 4]
    monkeypatch.setattr(simhash, "NEAR_RADIUS", 0, raising=False)
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == [1, 3, 4]


def test_dense_sets_are_sent_once(spark, monkeypatch):
    """Of a group of unlike variants each set is sent to one task, however many buckets it shares, or to few if the group is large."""
    rows = []
    for i in range(120):
        words = prose(300, 7700).split()
        places = random.Random(i).sample(range(300), 16)
        for at in places[:7]:
            words[at] = f"v{i}w{at}"
        copy = list(words)
        for at in places[7 : 7 + i % 4 * 3]:
            copy[at] = f"c{i}w{at}"
        rows += [(i, " ".join(words)), (1000 + i, " ".join(copy))]
    sets = [shingles(t) for _, t in rows]
    near = {(rows[i][0], rows[j][0]) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and len(a & b) >= 0.8 * len(a | b)}
    assert all(abs(a - b) == 1000 for a, b in near) and 60 < len(near) // 2 < 120
    want = [d for d, _ in rows if (d, d - 1000) not in near]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(simhash, "DENSE", 0)
    monkeypatch.setattr(simhash, "DENSE_LEAST", 0)
    dense_links, sent = simhash._dense_links, []

    def spy(found, *args):
        sent.extend(r["n"] for r in found.groupBy("found").count().withColumnRenamed("count", "n").collect())
        return dense_links(found, *args)

    monkeypatch.setattr(simhash, "_dense_links", spy)
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == sorted(want)
    assert len(sent) > 100 and set(sent) == {1}
    sent.clear()
    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "TILES", 4)
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == sorted(want)
    assert len(sent) > 100 and set(sent) == {3}
