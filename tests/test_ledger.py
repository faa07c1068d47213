"""Seals over events against plain Python, and what verification says of each kind of tampering."""

from __future__ import annotations

import random
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from maskwright.operators import ledger as L

EVENTS = "stream string, seq bigint, id string, kind string, actor string, detail string, recorded_at string"
SIZE = {"width": 8, "fan": 3}


def _h(text):
    return sha256(text.encode()).hexdigest()


def _rows(stream, seqs):
    return [(stream, s, f"ev-{s}", "encode", None if s % 7 == 0 else "cli", f"dé {s}", "2024-01-01") for s in seqs]


def _leaf(row):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[1:]))


def _brute(batches):
    """(stream, nth, first, last, n, total, root, previous, head) by the batches that were sealed one after the other."""
    seals, done = [], {}
    for batch in batches:
        streams = defaultdict(dict)
        for r in batch:
            streams[r[0] or ""][r[1]] = _leaf(r)
        for name, events in streams.items():
            nth, known, previous, total = done.get(name, (-1, -1, "0" * 64, 0))
            new = {s: x for s, x in events.items() if s > known}
            if not new:
                continue
            nodes = {b: _h("".join(x for s, x in sorted(new.items()) if s // 8 == b)) for b in {s // 8 for s in new}}
            while len(nodes) > 1:
                nodes = {b: _h("".join(x for a, x in sorted(nodes.items()) if a // 3 == b)) for b in {a // 3 for a in nodes}}
            root, first, last = next(iter(nodes.values())), min(new), max(new)
            head = _h(":".join([previous, str(first), str(last), str(len(new)), root]))
            total += len(new)
            seals.append((name, nth + 1, first, last, len(new), total, root, previous, head))
            done[name] = (nth + 1, last, head, total)
    return sorted(seals)


@pytest.fixture(scope="module")
def sealed(spark):
    rng = random.Random(3)
    seqs = sorted(rng.sample(range(400), 150))
    one = _rows("a", seqs[:90]) + _rows(None, range(20)) + _rows("lone", [5])
    two = _rows("a", seqs[90:]) + _rows("b", range(1000, 1030))
    df = lambda rows: spark.createDataFrame(rows, EVENTS)
    seals, blocks = L.seal(df(one), **SIZE)
    more, more_blocks = L.seal(df(one + two), seals, **SIZE)
    seals, blocks = seals.unionByName(more), blocks.unionByName(more_blocks)
    assert sorted(map(tuple, seals.collect())) == _brute([one, one + two])
    return one + two, df, seals, blocks


def _found(made, rows, **kw):
    _, df, seals, blocks = made
    got = L.verify(df(rows), kw.pop("seals", seals), kw.pop("blocks", blocks), **SIZE, **kw)
    return sorted(((r["stream"], r["nth"], r["block"], r["reason"]) for r in got.collect()), key=repr)


def test_untouched(sealed):
    rows, _, seals, _ = sealed
    assert _found(sealed, rows[::-1] + _rows("a", [5000]), kept=L.heads(seals)) == []  # order and what comes later


def test_tampering_shows_with_its_block(spark):
    """Streams with the same events, each of them tampered with in its own way."""
    rng = random.Random(5)
    seqs = sorted(rng.sample([s for s in range(400) if s // 8 != 20], 150))
    block = lambda i: seqs[i] // 8
    free = next(s for s in range(8, 300) if s not in seqs and any(t // 8 == s // 8 for t in seqs))

    def changed(rows, i):
        return rows[:i] + [(*rows[i][:5], "other", rows[i][6])] + rows[i + 1 :]

    def swapped(rows, i, j):
        out = list(rows)
        out[i], out[j] = (*rows[i][:2], *rows[j][2:]), (*rows[j][:2], *rows[i][2:])
        return out

    ways = {f"changed-{i}": (lambda r, i=i: changed(r, i), [(block(i), "changed")]) for i in (0, 17, 89, 149)}
    ways |= {f"lost-{i}": (lambda r, i=i: r[:i] + r[i + 1 :], [(block(i), "lost")]) for i in (0, 17, 90)}
    ways |= {
        "repeated": (lambda r: r + [r[44]] * 5, [(block(44), "repeated")]),
        "swapped": (lambda r: swapped(r, 3, 120), [(block(3), "changed"), (block(120), "changed")]),
        "added": (lambda r: r + _rows(r[0][0], [free]), [(free // 8, "added")]),
        "added-block": (lambda r: r + _rows(r[0][0], [163]), [(20, "added")]),
        "cut": (lambda r: r[:140], [(b, "truncated") for b in sorted({s // 8 for s in seqs[140:]})]),
        "gone": (lambda r: [], [(b, "truncated") for b in sorted({s // 8 for s in seqs})]),
        "whole": (lambda r: r[::-1] + _rows(r[0][0], [5000]), []),
    }
    events = {name: _rows(name, seqs) for name in ways}
    df = lambda rows: spark.createDataFrame([r for x in rows.values() for r in x], EVENTS)
    seals, blocks = L.seal(df(events), **SIZE)
    left = {name: way(events[name]) for name, (way, _) in ways.items()}
    got = L.verify(df(left), seals, blocks, **SIZE).collect()
    assert {(r["stream"], r["block"], r["reason"]) for r in got} == {(n, *x) for n, (_, w) in ways.items() for x in w}
    assert len(got) == sum(len(w) for _, w in ways.values())
    assert {r["nth"] for r in got if r["stream"] == "added-block"} == {None}


def test_seals_guard_themselves(spark, sealed):
    rows, _, seals, blocks = sealed
    kept = L.heads(seals)
    # Whoever changes an event and its block, or the seal too, breaks the root, the link, or the kept head.
    other = blocks.withColumn("root", F.when(F.col("block") == 125, F.lit("0" * 64)).otherwise(F.col("root")))
    assert ("b", 0, None, "root") in _found(sealed, rows, blocks=other)
    forged = seals.withColumn("n", F.when(F.col("stream") == "b", 29).otherwise(F.col("n")))
    assert _found(sealed, rows, seals=forged) == [("b", 0, None, "link")]
    again = L.seal(sealed[1]([(*r[:5], "x", r[6]) if r[1] == 1003 else r for r in rows if r[0] == "b"]), **SIZE)
    all_anew = [x.where("stream <> 'b'").unionByName(y) for x, y in zip((seals, blocks), again, strict=True)]
    changed = [(*r[:5], "x", r[6]) if r[1] == 1003 else r for r in rows]
    assert _found(sealed, changed, seals=all_anew[0], blocks=all_anew[1]) == []
    assert _found(sealed, changed, seals=all_anew[0], blocks=all_anew[1], kept=kept) == [("b", 0, None, "head")]
    first = seals.where("stream <> 'a' OR nth = 1"), blocks.where("stream <> 'a' OR nth = 1")
    assert ("a", 1, None, "link") in _found(sealed, rows, seals=first[0], blocks=first[1])
    last = seals.where("stream <> 'a' OR nth = 0"), blocks.where("stream <> 'a' OR nth = 0")
    assert _found(sealed, rows, seals=last[0], blocks=last[1], kept=kept) == [("a", 1, None, "head")]


def test_events_that_cannot_be_sealed(spark, sealed):
    rows = sealed[0]
    odd = [("a", None, "x", "k", "y", "z", "t"), ("new", 4, "x", "k", "y", "z", "t")]
    assert _found(sealed, rows + odd) == [("a", None, None, "unsealed"), ("new", None, None, "unsealed")]
    seals, blocks = L.seal(sealed[1]([]), **SIZE)
    assert seals.isEmpty() and blocks.isEmpty() and L.verify(sealed[1]([]), seals, blocks).isEmpty()


def test_no_stream_is_one_task(spark):
    """A stream's blocks are spread: the digest of events is computed by block and not by stream."""
    events = spark.range(0, 20_000).selectExpr(
        "'hot' AS stream", "id AS seq", "string(id) AS id", "'k' AS kind", "'a' AS actor", "'d' AS detail", "'t' AS recorded_at"
    )
    seals, blocks = L.seal(events, width=64, fan=16)
    assert blocks.count() == -(-20_000 // 64) and seals.count() == 1
    assert L.verify(events, seals, blocks, width=64, fan=16).isEmpty()


def test_sealed_events_are_not_hashed_again(spark, monkeypatch):
    """Of a second batch only the new events are; all of them were hashed and sorted, and the old ones left out then."""
    events = spark.createDataFrame(_rows("a", range(40)), EVENTS)
    seals, _ = L.seal(events.where("seq < 20"), **SIZE)
    plans, write = [], L.written
    monkeypatch.setattr(
        L, "written",
        lambda df, name: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), write(df, name))[1],
    )
    more, _ = L.seal(events, seals, **SIZE)
    assert [r["n"] for r in more.collect()] == [20]
    plan = dict(plans)["blocks"]
    assert plan.index("octet_length") < plan.index("Join")
