"""Token counts by finite-state transducers that are compiled from a byte-level BPE tokenizer's file.

Two deterministic transducers count a text's tokens. The first one reads classes of characters and marks where words
begin, as the tokenizer's pattern splits a text. It has twelve states, so what a chunk of characters does is a map from
states to states; the maps of all chunks are made side by side, composed by a parallel prefix scan, and give the state
that each chunk starts in. The second one reads the bytes of a word; each transition carries by how much the byte
changes the number of tokens emitted so far, and their sum is the word's count. Its states are made when they are first
reached.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordstream import blocks, utf8

#: Characters of a chunk.
CHUNK = 512
#: States of words, and words whose counts are kept, before a worker starts anew.
STATES, WORDS = 250_000, 500_000

# Classes of characters: letters by their part in contractions, numbers, spaces, other white space, apostrophes, others;
# and the end of a piece.
LETTER, SINGLE, R, E, V, L, NUMBER, SPACE, WHITE, QUOTE, OTHER, END = range(12)
_LETTERS = (LETTER, SINGLE, R, E, V, L)
# States: at a boundary; in letters, numbers or others; after one space or other white space; after several, the last one
# a space or another; after an apostrophe that begins a word, alone or with r, v or l.
EDGE, IN_L, IN_N, IN_O, ONE_S, ONE_W, MANY_S, MANY_W, AFTER_Q, Q_R, Q_V, Q_L = range(12)
# What a transition says: a word begins at this character, at the one before it.
HERE, BACK = 1, 2


def _begin(kind: int) -> int:
    """The state after the first character of a word."""
    return {NUMBER: IN_N, SPACE: ONE_S, WHITE: ONE_W, QUOTE: AFTER_Q, OTHER: IN_O, END: EDGE}.get(kind, IN_L)


def _split_step(state: int, kind: int) -> tuple[int, int]:
    """The next state and the marks of a transition of the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    fresh = _begin(kind), (HERE if kind != END else 0)
    attached = {IN_L: IN_L, IN_N: IN_N, IN_O: IN_O, AFTER_Q: IN_O}.get(fresh[0])  # of what may follow a space
    blank = kind in (SPACE, WHITE)
    if state == IN_L:
        return (IN_L, 0) if kind in _LETTERS else fresh
    if state == IN_N:
        return (IN_N, 0) if kind == NUMBER else fresh
    if state == IN_O:
        return (IN_O, 0) if kind in (OTHER, QUOTE) else fresh
    if state in (ONE_S, ONE_W, MANY_S, MANY_W):
        if blank:
            return (MANY_S if kind == SPACE else MANY_W), 0
        if kind == END:
            return EDGE, 0
        # The last of several is a word of its own, or a space the beginning of the next one.
        back = BACK if state in (MANY_S, MANY_W) else 0
        return (attached, back) if state in (ONE_S, MANY_S) else (fresh[0], fresh[1] | back)
    if state == AFTER_Q:
        if kind in (R, V, L):
            return {R: Q_R, V: Q_V, L: Q_L}[kind], 0
        return (EDGE, 0) if kind == SINGLE else (IN_O, 0) if kind in (OTHER, QUOTE) else fresh
    if state in (Q_R, Q_V, Q_L):
        if kind == {Q_R: E, Q_V: E, Q_L: L}[state]:
            return EDGE, 0
        # No contraction: the letter before this one begins a word.
        after, marks = _split_step(IN_L, kind)
        return after, marks | BACK
    return fresh


_STEPS = [_split_step(s, k) for s in range(12) for k in range(12)]
#: By 12 times the state and the class: 12 times the next state, and the marks.
_NEXT, _MARKS = (bytes(x) + bytes(256 - len(x)) for x in ([12 * s for s, _ in _STEPS], [m for _, m in _STEPS]))


def _looked_up(table: bytes, at: np.ndarray) -> np.ndarray:
    return np.frombuffer(at.tobytes().translate(table), np.uint8).reshape(at.shape)


def chunk_maps(kinds: np.ndarray) -> np.ndarray:
    """For each chunk (a row of classes) and state before it the state after it."""
    maps = np.tile(12 * np.arange(12, dtype=np.uint8), (len(kinds), 1))
    for column in kinds.T:
        maps = _looked_up(_NEXT, maps + column[:, None])
    return (maps // 12).astype(np.intp)


def scanned(maps: np.ndarray) -> np.ndarray:
    """The composition of each map with all those before it, in a logarithmic number of rounds."""
    step = 1
    while step < len(maps):
        maps = np.concatenate((maps[:step], np.take_along_axis(maps[step:], maps[:-step], 1)))
        step *= 2
    return maps


def word_starts(kinds: np.ndarray) -> np.ndarray:
    """Where words begin in a stream of classes whose pieces end with ``END``."""
    width = min(CHUNK, max(int(len(kinds) ** 0.5), 1))
    n = -(-len(kinds) // width)
    rows = np.full(n * width, END, np.uint8)
    rows[: len(kinds)] = kinds
    rows = rows.reshape(n, width)
    state = 12 * np.concatenate(([EDGE], scanned(chunk_maps(rows))[:-1, EDGE])).astype(np.uint8)
    at = np.empty((width, n), np.uint8)
    for i, column in enumerate(rows.T):
        at[i] = state + column
        state = _looked_up(_NEXT, at[i])
    marks = _looked_up(_MARKS, at)
    marks = marks.T.ravel()
    begins = (marks & HERE) != 0
    begins[:-1] |= (marks[1:] & BACK) != 0
    return np.flatnonzero(begins)


def _alphabet() -> dict[str, int]:
    """The character that stands for each byte in the file: printable ones for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Counts(dict):
    """The token counts of words, made when they are first asked for."""

    def __init__(self, words: WordCounter):
        self.words = words

    def __missing__(self, word: bytes) -> int:
        n = self.words.run(word)
        if len(word) <= 64:
            if len(self) >= WORDS:
                self.clear()
            self[word] = n
        return n


class WordCounter:
    """The transducer from the bytes of a word to its number of tokens.

    A sequence of tokens is what BPE makes of their bytes just if that holds for every two neighbours. So the last token
    after a byte is the one that ends there and goes with the last token before its first byte, and a state is what
    tokens that can still be going on need: their bytes so far, and for each place in them the last token before it and
    how many tokens there were.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        alphabet = _alphabet()
        raw = {text: bytes(alphabet[c] for c in text) for text in vocab}
        self.tokens = {b: vocab[text] for text, b in raw.items()}
        self.bytes = {i: b for b, i in self.tokens.items()}
        self.ranks = {}
        for rank, (a, b) in enumerate(merges):
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.heads = {b[:i] for b in self.tokens for i in range(1, len(b) + 1)}
        # How each token is merged; and the ends of tokens on the way.
        self.parts = {token: (rank, *pair) for pair, (rank, token) in reversed(self.ranks.items())}
        self.spines: tuple[dict, dict] = {}, {}
        self.neighbours: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.table: dict[int, int] = {}
        self.neighbours.clear()
        start = (b"", (-1, 0))
        self.states, self.names = [start], {start: 0}

    def merged(self, word: bytes) -> list[int]:
        """The tokens of some bytes, pair by pair in the order of the merges."""
        parts = [self.tokens[word[i : i + 1]] for i in range(len(word))]
        while len(parts) > 1:
            best = min((self.ranks.get(p, (1 << 60, -1)) for p in zip(parts, parts[1:])), default=(1 << 60, -1))
            if best[1] < 0:
                break
            out, i = [], 0
            while i < len(parts):
                pair = self.ranks.get((parts[i], parts[i + 1])) if i + 1 < len(parts) else None
                out.append(best[1] if pair == best else parts[i])
                i += 2 if pair == best else 1
            parts = out
        return parts

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """What was at the left (0) or right (1) end of a token while it was merged, with the rank of the merge that
        ended it.
        """
        found = self.spines[side].get(token)
        if found is None:
            found, part, ends = [], token, 1 << 60
            while True:
                found.append((part, ends))
                if part not in self.parts:
                    break
                ends, *pair = self.parts[part]
                part = pair[side]
            self.spines[side][token] = found
        return found

    def together(self, one: int, two: int) -> bool:
        """Whether BPE leaves two tokens as they are; ``one`` is -1 at the beginning of a word.

        It does if no two parts that meet while both are merged make a pair that comes before what ends them. Of equal
        merges the left one goes first.
        """
        key = one << 20 | two
        found = self.neighbours.get(key)
        if found is None:
            if one < 0:
                found = self.merged(self.bytes[two]) == [two]
            else:
                ranks, none, left = self.ranks, (1 << 61, -1), self.spine(two, 0)
                found = not any(
                    (rank := ranks.get((x, y), none)[0]) < ends and rank <= other
                    for x, ends in self.spine(one, 1)
                    for y, other in left
                )
            self.neighbours[key] = found
        return found

    def compiled(self, state: int, byte: int) -> int:
        """The transition, as the next state and the change of the count."""
        tail, places = self.states[state]
        tail += bytes([byte])
        # Of the place before the last i bytes, places[-2 * i] is the token and the next entry the number of tokens.
        for i in range(len(tail), 0, -1):
            token = self.tokens.get(tail[-i:])
            if token is not None and self.together(places[-2 * i], token):
                break
        change = places[1 - 2 * i] + 1
        keep = next((k for k in range(len(tail), 0, -1) if tail[-k:] in self.heads), 0)  # only beginnings of tokens
        kept = [x - change if at & 1 else x for at, x in enumerate(places[len(places) - 2 * keep :])]
        name = (tail[len(tail) - keep :], (*kept, token, 0))
        number = self.names.setdefault(name, len(self.states))
        if number == len(self.states):
            self.states.append(name)
        step = number << 12 | (change + 2048)
        self.table[state << 8 | byte] = step
        return step

    def run(self, word: bytes) -> int:
        if len(self.states) > STATES:
            self.clear()
        state, n, table = 0, 0, self.table
        for byte in word:
            step = table.get(state << 8 | byte)
            if step is None:
                if len(self.states) > 2 * STATES:  # within a very long word
                    state, table = self._restart(state), self.table
                step = self.compiled(state, byte)
            state = step >> 12
            n += (step & 4095) - 2048
        return n

    def _restart(self, state: int) -> int:
        name = self.states[state]
        self.clear()
        self.table = {}
        if name in self.names:
            return self.names[name]
        self.names[name] = len(self.states)
        self.states.append(name)
        return self.names[name]


class TokenCounter:
    """The counts of texts, as the tokenizer in a file of the ``tokenizers`` library gives them without special tokens
    at the ends. Its added tokens are found in texts first, and count one each.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = {"dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"}
        if (
            spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space")
            or not before.get("use_regex", True) or model.get("type") != "BPE" or any(model.get(k) for k in plain)
            or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        ):
            raise ValueError("not a plain byte-level BPE tokenizer")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.words = _Counts(WordCounter(model["vocab"], pairs))
        added = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self._split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self._kinds = np.full(0x110000, 255, np.uint8)
        for chars, kind in (("stmd", SINGLE), ("r", R), ("e", E), ("v", V), ("l", L), (" ", SPACE), ("'", QUOTE)):
            self._kinds[[ord(c) for c in chars]] = kind

    def _kind(self, char: str) -> int:
        """A character is of the kind whose words it goes on, by the tokenizer's own pattern."""
        for one, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(self._split(one + char)) == 1:
                return kind
        return WHITE

    def kinds(self, points: np.ndarray) -> np.ndarray:
        found = self._kinds[points]
        for new in np.unique(points[found == 255]).tolist():
            self._kinds[new] = self._kind(chr(new))
        return self._kinds[points]

    def count(self, data: bytes, off: np.ndarray) -> np.ndarray:
        """The tokens of each text in a block; ``off`` has the offsets of the texts."""
        n, extra = len(off) - 1, 0
        pieces = np.arange(n)
        if self.added is not None and self.added.search(data):
            texts = [data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            parts = [self.added.split(t) for t in texts]
            sizes = np.array([len(p) for p in parts])
            pieces, extra = np.repeat(pieces, sizes), sizes - 1
            flat = [x for p in parts for x in p]
            data, off = b"".join(flat), np.concatenate(([0], np.cumsum([len(x) for x in flat])))
        points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # the first byte of each character
        ends = np.searchsorted(begins, off[1:])  # the characters up to the end of each piece
        stream = np.full(len(points) + len(ends), END, np.uint8)
        of_piece = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        stream[np.arange(len(points)) + of_piece] = self.kinds(points)
        starts = word_starts(stream)
        owner = np.searchsorted(ends + np.arange(len(ends)), starts)  # each piece has one END behind it
        at = begins[starts - owner]
        edges = np.append(at, len(data)).tolist()
        words = [data[a:b] for a, b in zip(edges, edges[1:])]
        counts = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        return np.bincount(pieces[owner], counts, n).astype(np.int64) + extra


@lru_cache(4)
def counter(path: str) -> TokenCounter:
    """One for each worker and file."""
    return TokenCounter(path)


def token_counts(
    docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``path`` names a tokenizer's file that the driver and all executors have. A null text is empty and has no tokens;
    ids may be null or repeated; empty tables give no rows, other columns are ignored. Texts are read whole, each in one
    pass; one of n bytes takes some 60 n bytes of a Python worker.
    """
    counter(path)  # the driver says what is wrong with a file

    @F.arrow_udf("bigint")
    def counted(text: pa.Array) -> pa.Array:
        data, off = utf8(text)
        parts = [
            counter(path).count(data[off[a] : off[b]].tobytes(), off[a : b + 1] - off[a]) for a, b in blocks(off)
        ]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    counts = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), counted("text").alias("n_tokens"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
