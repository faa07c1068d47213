"""Deduplication by digest, window and fingerprint, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from maskwright.llm import near_copies as near_module
from maskwright.llm import simhash
from maskwright.llm.components import connected_components
from maskwright.llm.exact_dedup import DigestIndex, exact_dedup
from maskwright.llm.filters import drop_listed, only_listed
from maskwright.llm.near_copies import near_copies
from maskwright.llm.sorted_runs import SortedRuns
from maskwright.llm.storage import materialize, shared_folder
from maskwright.llm.substring_dedup import PassageIndex, remove_repeats
from maskwright.llm.wordstream import Words, blocks, sliding_min, utf8
from maskwright.llm.xxh64 import xxh64_slices
from maskwright.sources.manifest import Conflict

DOCS = "doc_id long, text string, n long, keep_id string, ranges string"


def _docs(spark, rows, parts=3):
    """Documents with extra columns whose names clash with those of operators."""
    return spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], DOCS).repartition(parts)


EDGE = [
    (100, None),
    (101, ""),
    (102, " \n"),
    (103, "same text"),
    (103, "same text"),
    (104, "same text"),
    (None, "same text"),
    (None, "alone"),
]


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, weak):
    rng = random.Random(1)
    rows = EDGE + [(i, rng.choice(["a", "b ", "b", "ç", "A"]) * rng.randrange(0, 3)) for i in range(80)]
    digest = {"digest": lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 2), 2, "0"))} if weak else {}
    got = Counter(tuple(r) for r in exact_dedup(_docs(spark, rows), **digest).collect())
    want = Counter()
    for d, t in rows:
        ids = [i for i, u in rows if (u or "") == (t or "")]
        keep = max((i for i in ids if i is not None), default=None)
        want[(d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    assert exact_dedup(_docs(spark, [])).isEmpty()


def test_runs_grow_by_batches(spark):
    merge = {"keep_id": F.min("keep_id"), "n": F.sum("n")}
    runs = SortedRuns(spark, "digest", merge, tier=2)
    batches = [[("a", 3, 1), ("b", 2, 1), ("a", 9, 1)], [("a", 1, 1), ("c", 5, 1)], [("d", 7, 1), ("c", 4, 1)], []]
    frames = [spark.createDataFrame(b, "digest string, keep_id long, n long") for b in batches]

    def hits(runs, frame):
        runs.add(frame)
        return {r["digest"] for r in runs.hits().collect()}

    repeated = [hits(runs, f) for f in frames[:2]]
    assert list(runs.levels.values()) == [1]
    runs = SortedRuns.open(spark.newSession(), "digest", merge, runs.path, tier=2)
    repeated += [hits(runs, f) for f in frames[2:]]
    assert repeated == [{"a"}, {"a"}, {"a", "c"}, {"a", "c"}]
    assert list(runs.levels.values()) == [2]
    want = [("a", 1, 3), ("b", 2, 1), ("c", 4, 2), ("d", 7, 1)]
    again = SortedRuns.open(spark, "digest", merge, runs.path)
    assert again.levels == runs.levels and sorted(map(tuple, again.rows().collect())) == want
    keys = spark.createDataFrame([("c",), ("x",)], "digest string")
    assert [tuple(r) for r in again.probe(keys).collect()] == [("c", 4, 2)]
    again.add(frames[0])
    again.compact(whole=True)
    assert len(again.levels) == 1 and again.rows().where("digest = 'a'").first()["n"] == 5


def test_index_over_sessions(spark):
    """Three batches in three sessions give what one run over all of them gives."""
    rng = random.Random(21)
    vocab = [f"x{i}" for i in range(30)]
    passages = [" ".join(rng.choice(vocab) for _ in range(20)) for _ in range(4)]
    rows = [
        (
            i,
            " ".join([rng.choice(passages), *(rng.choice(vocab) for _ in range(10))])
            if i % 3
            else rng.choice(["a", "b", ""]),
        )
        for i in range(45)
    ]
    paths = [f"{shared_folder(spark)}/three-{name}" for name in ("digests", "passages")]
    for k in range(3):
        session = spark.newSession()
        part = _docs(session, rows[15 * k : 15 * k + 15])
        DigestIndex.create(session, paths[0], again=k > 0).add(part)
        PassageIndex.create(session, paths[1], 7, 3, again=k > 0).add(part)
    session = spark.newSession()
    docs = _docs(session, rows)
    groups = DigestIndex.create(session, paths[0], again=True).groups(docs).collect()
    ids = {t: [d for d, u in rows if u == t] for _, t in rows}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in groups} == {
        d: (min(ids[t]), len(ids[t]), d == min(ids[t])) for d, t in rows
    }
    left = PassageIndex.create(session, paths[1], 7, 3, again=True).remove(docs)
    assert Counter(map(tuple, left.collect())) == _brute_windows(rows, 7)


@pytest.mark.parametrize("step", ["rows", "filter", "hits", "commit", "merge"])
def test_indexes_survive_a_lost_driver(spark, monkeypatch, step):
    """A driver that is lost at any step of adding a batch; a new one opens the index, adds the batch again, and all is
    as if nothing had happened.
    """
    rng = random.Random(step)
    words = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    shared = words(12)
    rows = [(i, f"{words(5)} {shared} {words(5)}" if i % 4 == 0 else words(15)) for i in range(12)] + [(90, "a"), (91, "b")]
    more = [(100, "a"), (101, words(20)), (102, f"{words(3)} {shared}"), (103, "")]
    paths = [f"{shared_folder(spark)}/lost-{step}-{name}" for name in ("digests", "passages")]
    parts = [rows[:7], rows[7:], more]

    def opened(again=True):
        d, p = DigestIndex.create(spark, paths[0], again=again), PassageIndex.create(spark, paths[1], 7, 3, again=again)
        d.runs.tier = p.runs.tier = 3
        return d, p

    def lose(index):
        writer = type(spark.range(0).write)
        real, failed = {n: getattr(o, n) for o, n in ((writer, "parquet"), (SortedRuns, "_commit"), (SortedRuns, "_replace"))}, []

        def parquet(self, path, *args, **kw):
            out = real["parquet"](self, path, *args, **kw)
            if step in ("rows", "filter", "hits") and path.startswith(index.runs.path) and path.endswith(f"/{step}"):
                failed.append(path)
                raise RuntimeError("lost")
            return out

        def other(name):
            def call(self, *args, **kw):
                failed.append(name)
                raise RuntimeError("lost")

            return call

        with monkeypatch.context() as m:
            m.setattr(writer, "parquet", parquet)
            if step in ("commit", "merge"):
                name = "_commit" if step == "commit" else "_replace"
                m.setattr(SortedRuns, name, other(name))
            with pytest.raises(RuntimeError, match="lost"):
                index.add(_docs(spark, more), name="2")
        assert failed

    for k in range(2):
        for index in opened(again=k > 0):
            index.add(_docs(spark, parts[k]), name=str(k))
    for index in opened():
        lose(index)
    for index in opened():
        index.add(_docs(spark, more), name="2")
        state = index.runs.manifest.read()
        index.add(_docs(spark, more), name="2")  # a call too many does no harm
        assert index.runs.manifest.read() == state
    digests, passages = opened()
    docs = rows + more
    same = lambda t: [d for d, u in docs if u == t]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in digests.groups(_docs(spark, docs)).collect()}
    assert got == {d: (min(same(t)), len(same(t)), d == min(same(t))) for d, t in docs}
    assert Counter(map(tuple, passages.remove(_docs(spark, docs)).collect())) == _brute_windows(docs, 7)
    assert digests.runs.rows().agg(F.sum("n")).first()[0] == len(docs)
    digests.runs.vacuum(), passages.runs.vacuum()
    assert Counter(map(tuple, passages.remove(_docs(spark, docs)).collect())) == _brute_windows(docs, 7)


def test_two_writers_of_an_index(spark):
    path = f"{shared_folder(spark)}/two-writers"
    one, two = (DigestIndex.create(spark, path) for _ in range(2))
    one.add(_docs(spark, [(1, "a")]))
    with pytest.raises(Conflict):
        two.add(_docs(spark, [(2, "a")]))
    assert DigestIndex.create(spark, path, again=True).runs.rows().count() == 1


def test_filters(spark):
    rows = spark.range(1000).withColumn("id", F.when(F.col("id") != 5, F.col("id")))
    listed = spark.range(0, 1000, 7)
    kept = only_listed(rows, listed, ["id"], buckets=1)
    assert kept.join(listed, "id").count() == listed.count() and kept.count() < 1000
    assert drop_listed(rows, listed, ["id"], buckets=1).count() == 1000 - listed.count()
    assert drop_listed(rows, listed.limit(0), ["id"]).count() == 1000


def _brute_windows(rows, width):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = Counter()
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out[(d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeats(spark, seed):
    rng = random.Random(seed)
    width, gram = rng.choice([(5, 2), (7, 3), (10, 4)])
    vocab = [["a", "bé", "cc", "ddd"], [f"x{i}" for i in range(30)], ["é", "zz", "q"]][seed]
    passages = [[rng.choice(vocab) for _ in range(rng.randrange(width - 1, 4 * width))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.5 else [
                rng.choice([*vocab, f"u{rng.randrange(10000)}"]) for _ in range(rng.randrange(1, 30))
            ]
        w += ["are"] * rng.randrange(width, 120) * (rng.random() < 0.1) + ["p", "q"] * rng.randrange(width, 60) * (
            rng.random() < 0.1
        )
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    rows += EDGE + [rows[3], rows[3], (200, rows[5][1])]
    got = Counter(tuple(r) for r in remove_repeats(_docs(spark, rows), width, gram).collect())
    assert got == _brute_windows(rows, width)


def test_repeats_of_production_width(spark):
    long = " ".join(f"w{i % 997}" for i in range(3000))
    rows = [
        (1, long),
        (2, "x " + " ".join(f"w{i}" for i in range(34)) + " y"),
        (3, " ".join(f"w{i}" for i in range(35))),
        (4, None),
    ]
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(_docs(spark, rows)).collect()}
    assert got == {d: n for (d, _, n, _), _ in _brute_windows(rows, 35).items()} and got[2] == 0 and got[3] == 35
    assert remove_repeats(_docs(spark, [])).isEmpty()


def _brute_fingerprint(text, k=4):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_hashes_and_words():
    raw = bytes(random.Random(2).randrange(256) for _ in range(400))
    data = np.frombuffer(raw, np.uint8)
    a = np.arange(0, 200)
    assert xxh64_slices(data, a, 2 * a).tolist() == [xxhash.xxh64_intdigest(raw[x : 2 * x], 42) for x in a]
    texts = ["", " a  bé\x0b", "x", "\x85  ", "last\n"]
    bytes_, off = utf8(pa.array([*texts, None]).slice(0, 6))
    w = Words(bytes_, off)
    assert [w.last[i] - w.first[i] for i in range(6)] == [len(re.findall("[^\x20\x09-\x0d]+", t)) for t in texts] + [0]
    assert list(blocks(np.array([0, 5, 5, 30, 31]), 6)) == [(0, 2), (2, 3), (3, 4)]
    x = np.random.default_rng(0).integers(0, 50, 40)
    assert all(sliding_min(x, n).tolist() == [min(x[i : i + n]) for i in range(40 - n + 1)] for n in range(1, 12))


def _brute_components(values, distance):
    label = {v: v for v in values}

    def find(v):
        while label[v] != v:
            label[v] = label[label[v]]
            v = label[v]
        return v

    for a in values:
        for b in values:
            if a < b and bin(a ^ b).count("1") <= distance:
                ra, rb = find(a), find(b)
                label[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in values}


@pytest.mark.parametrize(("dense", "distance"), [(512, 4), (2, 4), (2, 2)])
def test_links(spark, dense, distance):
    """The same connected parts as all pairs, whether buckets are compared within or through shared points."""
    rng = random.Random(dense + distance)
    values = {rng.getrandbits(64) for _ in range(40)}
    for base in list(values)[:5]:
        for _ in range(25):
            values.add(
                base ^ sum(
                    1 << b for b in rng.sample(rng.choice([range(64), range(10), range(28, 40)]), rng.randrange(1, 7))
                )
            )
    values |= {0, (1 << 64) - 1, 1 << 63, 15}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance, dense)
    parts = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    points = [v for v in signed if v not in parts]
    want = _brute_components(values, distance)
    groups: dict[int, set[int]] = {}
    for v, s in zip(values, signed, strict=True):
        groups.setdefault(parts.get(s, s), set()).add(want[v])
    assert len(points) == sum(1 for v in values if sum(w == want[v] for w in want.values()) == 1)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_simhash_groups(spark):
    rng = random.Random(9)
    base = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(300)]
    rows = EDGE + [(i, " ".join(base[:-1] + [f"t{i % 4}"])) for i in range(20, 40)] + [
        (i, " ".join(rng.sample(base, 30))) for i in range(50, 60)
    ] + [(61, "One"), (62, "one TWO three four five")]
    got = simhash.simhash_groups(_docs(spark, rows)).collect()
    prints = {v: _brute_fingerprint(v) for _, v in rows}
    assert all(len(r["fingerprint"]) == 16 for r in got)
    parts = _brute_components(set(prints.values()), 4)
    least: dict[int, int | None] = {}
    for d, t in rows:
        if d is not None:
            p = parts[prints[t]]
            least[p] = min(d, least.get(p, d))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter(
        (d, f"{prints[t]:016x}", least.get(parts[prints[t]])) for d, t in rows
    )
    assert simhash.simhash_groups(_docs(spark, [])).isEmpty()


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)]
    edges = spark.createDataFrame(path, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges, small).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert connected_components(edges.limit(0), small).isEmpty()
    node = F.struct(F.col("a").isNull().alias("none"), F.col("a").alias("id"), F.lit("x").alias("t"))
    ends = spark.createDataFrame([(3, 2), (None, 3), (5, None), (9, 8)], "a long, c long")
    other = F.struct(F.col("c").isNull().alias("none"), F.col("c").alias("id"), F.lit("x").alias("t"))
    got = {
        r["node"]["id"]: r["component"]["id"]
        for r in connected_components(ends.select(node.alias("a"), other.alias("b")), small).collect()
    }
    assert got == {2: 2, 3: 2, None: 2, 5: 2, 8: 8, 9: 8}


def _shingle_set(text, k=5):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


@pytest.mark.parametrize("stage", [True, False])
def test_near_copies(spark, stage):
    """The groups of all pairs at 0.8 or more, as brute force finds them, with few of them within four bits of a
    fingerprint.
    """
    import corpus_pipeline

    rng = random.Random(11)
    rows = [(1000, None), (1001, " "), (1002, "One two"), (1003, "one TWO"), (1004, "one two three")]
    for base in range(12):
        words = [f"w{base}x{rng.randrange(400)}" for _ in range(rng.choice([40, 120, 300]))]
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.randrange(0, len(words) // 25 + 1)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10000)}"
            rows.append((len(rows), " ".join(copy)))
    sets = {d: _shingle_set(t) for d, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = {d: d for d in sets}
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    prints = {d: _brute_fingerprint(t) for d, t in rows}
    assert sum(bin(prints[a] ^ prints[b]).count("1") > 4 for a, b in pairs) > len(pairs) / 3
    docs = _docs(spark, [*rows, (None, rows[9][1])])
    if stage:
        # The stage links fingerprints of five-word shingles within four bits too, and a row without an id like any
        # other.
        prints = {d: _brute_fingerprint(t, 5) for d, t in rows}
        pairs += [(a, b) for a in sets for b in sets if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
        for _ in sets:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        left = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
        assert left == set(label.values())
    else:
        got = {r["node"]: r["component"] for r in near_copies(docs.where("doc_id is not null"), rounds=1).collect()}
        assert {d: got.get(d, d) for d in label} == label


def test_near_copies_leave_texts_and_sets_where_they_lie(spark, monkeypatch):
    """Candidates' texts and open documents' sets are chosen by filters, not by joins that shuffle them whole, also when
    nothing is small enough to broadcast; the groups are those of brute force.
    """
    rng = random.Random(5)
    rows = []
    for base in range(4):
        words = [f"w{base}x{i}" for i in range(120)]
        for changed in (0, 1, 2, 8, 9):
            copy = list(words)
            for i in rng.sample(range(120), changed):
                copy[i] = f"n{rng.randrange(10000)}"
            rows.append((len(rows), " ".join(copy)))
    plans = {}

    def written(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return materialize(df, name)

    monkeypatch.setattr(near_module, "materialize", written)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["node"]: r["component"] for r in near_copies(_docs(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [name for name in ("shingles", "rare", "rare-shingles", "rare-counts") if "LeftSemi" in plans[name]]
    sets = {d: _shingle_set(t) for d, t in rows}
    label = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {d: got.get(d, d) for d in label} == label
