"""The manifest tree, token counts and fill-in-the-middle against plain Python."""

from __future__ import annotations

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskwright.llm.fill_in_middle import SkipList, fill_in_middle, restored
from maskwright.llm.merkle import check, manifest, version_nodes
from maskwright.llm.token_counts import END, TokenCounter, token_counts, word_starts

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    fields = [row[0], row[3], row[2], row[4], text]
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def _climb(levels, i):
    sides = []
    for level in levels[:-1]:
        run = i // 16 * 16
        sides.append(("".join(level[run:i]), "".join(level[i + 1 : run + 16])))
        i //= 16
    return sides


def _brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of each row, and the levels of each source's tree."""
    least = (-1 << 70)
    order = lambda r: (least if r[0] is None else r[0], _leaf(r, r[1]))
    names = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((r for r in rows if r[3] == s), key=order) for s in names}
    trees = {s: _tree([_leaf(r, r[1]) for r in g]) for s, g in groups.items()}
    over = _tree([trees[s][-1][0] for s in names])
    out = []
    for nth, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            sides = _climb(trees[s], i) + _climb(over, nth)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            lower = None if r[1] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[1])
            node = _leaf(r, lower if changed else r[1])
            for left, right in sides:
                node = _h(left, node, right)
            out.append((r[0], trees[s][0][i], trees[s][-1][0], over[-1][0], _h(*[x for p in sides for x in p]), node))
    return out, trees, over


def _rows(n, source, first=0, text="Ab"):
    return [(first + i, f"{text} {i}", "en", source, 4) for i in range(n)]


def _manifest(df, **kw):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest(df, changed=lowered, when=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, **kw)


@pytest.mark.parametrize(
    "rows",
    [
        _rows(1, "a"),
        _rows(16, "a") + _rows(17, "b", 100) + _rows(1, None, 200),
        _rows(257, "a") + _rows(256, "B", 1000),
        [(7, "X", "en", "s", 1)] * 40 + [(None, None, None, None, None)] * 3 + [(None, "Q", "en", "s", 1), (9, "", "", "", 0)],
        [r for i in range(18) for r in _rows(2, f"s{i}é", 10 * i)],
        _rows(4100, "hot") + [(9999, "Long " * 400_000, "en", "t", 5)],
    ],
    ids=["one", "runs", "blocks", "repeats-and-nulls", "many-sources", "three-levels-and-a-long-text"],
)
def test_manifest(spark, rows):
    got = _manifest(spark.createDataFrame(rows, DOCS)).collect()
    want, trees, _ = _brute(rows)
    mine = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["copied"][-1]) for r in got]
    assert sorted(map(repr, mine)) == sorted(map(repr, want))
    assert all(r["height"] == len(trees[r["source"]]) - 1 for r in got)


def test_manifest_of_no_rows_and_of_clashing_names(spark):
    assert _manifest(spark.createDataFrame([], DOCS)).collect() == []
    rows = _rows(20, "a") + _rows(3, "b", 50)
    others = ["tree", "id", "leaf", "new", "row", "pos", "n", "block", "path", "cell", "root", "copied", "digest"]
    clash = spark.createDataFrame(rows, DOCS).select("*", *[F.lit("x").alias(c) for c in others])
    mine = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["copied"][-1]) for r in _manifest(clash).collect()]
    assert sorted(mine) == sorted(_brute(rows)[0])


def test_versions_share_all_but_their_path(spark):
    rows = _rows(300, "a", text="UP") + _rows(30, "b", 1000)
    made = _manifest(spark.createDataFrame(rows, DOCS), proofs=True)
    own, (_, trees, over) = version_nodes(made).collect(), _brute(rows)
    changed = {r["doc_id"]: r for r in made.where("changed_leaf is not null").collect()}
    assert {r["doc_id"] for r in own} == set(changed)
    for doc, row in changed.items():
        version = {s: [list(level) for level in t] for s, t in trees.items()}
        mine = sorted((x for x in own if x["doc_id"] == doc), key=lambda x: x["level"])
        assert len(mine) == row["height"] + len(over)  # a node for each level
        for x in mine:
            if x["index"] is not None:
                assert version[row["source"]][x["level"]][x["index"]] != x["digest"]
                version[row["source"]][x["level"]][x["index"]] = x["digest"]
        rebuilt = {s: _tree(v[0]) for s, v in version.items()}
        assert rebuilt == version  # base nodes and the copied ones are the changed tree
        assert row["copied"][-1] == _tree([rebuilt[s][-1][0] for s in ("a", "b")])[-1][0]
    root = next(iter(changed.values()))["root"]
    assert {(r["doc_id"] in changed, r["verified"]) for r in check(made, root).collect()} == {(True, False), (False, True)}


PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PIECES = ["a", "s", "t", "r", "re", "v", "ve", "l", "ll", "m", "d", "'", "'s", " ", "  ", "\n", "\t", "1", "½", "é", "漢", "-", "́", " ", "😀"]


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(BPE)


def test_words_begin_where_the_pattern_says(counter):
    rnd = random.Random(5)
    for n in [0, 1, 2, 3, 7, 40, 700, 9000]:
        for _ in range(60 if n < 1000 else 2):
            text = "".join(rnd.choice(PIECES) for _ in range(n))
            kinds = np.append(counter.kinds(np.array([ord(c) for c in text], np.uint32)), END).astype(np.uint8)
            assert word_starts(kinds).tolist() == [m.start() for m in PATTERN.finditer(text)]


def _mine(counter, texts):
    raw = [t.encode() for t in texts]
    return counter.count(b"".join(raw), np.concatenate(([0], np.cumsum([len(b) for b in raw])))).tolist()


def test_counts_are_the_librarys(counter):
    rnd, lib = random.Random(6), Tokenizer.from_file(BPE)
    pieces = [*PIECES, "the", " The", "ing", "<|endoftext|>", "<|endof", "==", "--------", "ab" * 9]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    texts += [c * n for c in ("-", " ", "a", "ha", "=", "\n", "é") for n in range(150)]
    texts += ["".join(chr(rnd.choice([rnd.randint(1, 0xD7FF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(30)) for _ in range(500)]
    assert _mine(counter, texts) == [len(e) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_counts_survive_new_tables(counter, monkeypatch):
    texts = ["".join(random.Random(i).choice("abcdefgh -") for _ in range(400)) for i in range(60)] + ["xy" * 50_000]
    want = _mine(counter, texts)
    monkeypatch.setattr("maskwright.llm.token_counts.STATES", 20)
    monkeypatch.setattr("maskwright.llm.token_counts.WORDS", 5)
    assert _mine(TokenCounter(BPE), texts) == want


def test_token_counts(spark):
    long = "Über 12 Wörter isn't it?\n\n " * 100_000
    rows = [(1, None), (2, ""), (None, "one"), (3, "a b"), (3, "a b"), (4, long), (5, "word " * 513)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n_tokens", "2 AS n_bytes", "3 AS over_limit")
    got = sorted(map(tuple, token_counts(df, BPE).collect()), key=repr)
    lib = Tokenizer.from_file(BPE)
    want = []
    for doc, text in rows:
        n = len(lib.encode(text or "", add_special_tokens=False))
        want.append((doc, len((text or "").encode()), n, n > 512))
    assert got == sorted(want, key=repr)
    assert token_counts(spark.createDataFrame([], "doc_id bigint, text string"), BPE).collect() == []
    with pytest.raises(ValueError):
        token_counts(df, public_tokenizers.path("word_bpe_49k.json"))


UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_skip_list_finds_every_rank():
    for n in (0, 1, 15, 16, 17, 256, 257, 5000):
        widths = np.array([random.Random(i).randint(1, 9) for i in range(n)], np.int64)
        units = SkipList(widths)
        assert len(units.lanes) == 1 or len(units.lanes[-1][0]) <= 16
        assert [units.seek(r) for r in range(n + 1)] == [0, *np.cumsum(widths).tolist()]


def _fim(doc, text):
    text = text or ""
    units, digest = UNITS.findall(text), sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h, n = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)], len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc, n, "plain", None, None, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    return doc, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rnd = random.Random(8)
    pieces = ["a", "bé", " ", "\n", "\t ", "漢字", "😀", "<", "S>", "<M", ">", " "]
    rows = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    rows += [(i, " \n ") for i in range(900, 930)] + [(i, "<P> x") for i in range(930, 950)]
    rows += [(None, "x y z"), (None, None), (5, None), (6, ""), (7, "q r"), (7, "q r")]
    rows += [(i, "wörd \t" * 200_000 + "end" * (i % 2)) for i in range(1000, 1004)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n", "2 AS form", "3 AS hash", "4 AS at", "5 AS output")
    made = fill_in_middle(df)
    got = made.withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((_fim(*r) for r in rows), key=repr)
    assert sorted(r["again"] for r in got) == sorted(t or "" for _, t in rows)
    assert {"plain", "spm", "psm"} == {r["form"] for r in got}
    assert fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
