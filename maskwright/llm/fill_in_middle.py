"""Fill-in-the-middle: texts cut in two places between units, and put together with the middle last.

A unit is a word with the white space before it, or the white space at the end. The units of a text are an indexable
skip list: the lowest lane has a node for each unit, each lane above it a node for every 16 below, and a node carries
its width in units and in code points. A cut is found by going down from the top lane, along each as far as the widths in
units allow; the widths in code points that were passed add up to its place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordstream import Words, blocks, utf8

#: Nodes of a lane under one node of the next.
STRIDE = 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_FOUND = "struct<n:bigint,first:bigint,second:bigint>"


class SkipList:
    """The units of one text, by their widths in code points."""

    def __init__(self, points: np.ndarray):
        units = np.ones(len(points), np.int64)
        self.lanes = [(units, points)]
        while len(units) > STRIDE:
            at = np.arange(0, len(units), STRIDE)
            units, points = np.add.reduceat(units, at), np.add.reduceat(points, at)
            self.lanes.append((units, points))

    def __len__(self) -> int:
        return len(self.lanes[0][0])

    def seek(self, rank: int) -> int:
        """The number of code points in the first ``rank`` units, 0 to all of them."""
        node = point = 0
        for units, points in reversed(self.lanes):
            while node < len(units) and units[node] <= rank:
                rank -= int(units[node])
                point += int(points[node])
                node += 1
            node *= STRIDE
        return point


def unit_widths(words: Words, ends: np.ndarray) -> list[np.ndarray]:
    """The code points of each unit of each text of a block; ``ends`` has the byte that each text ends before."""
    starts = (words.data & 0xC0) != 0x80
    before = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(starts, out=before[1:])
    lists, begin = [], 0
    for first, last, end in zip(words.first.tolist(), words.last.tolist(), ends.tolist(), strict=True):
        cuts = words.end[first:last]
        tail = end > (cuts[-1] if len(cuts) else begin)  # white space at the end
        places = np.concatenate(([begin], cuts, [end] if tail else [])).astype(np.int64)
        lists.append(np.diff(before[places]))
        begin = end
    return lists


def _cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    data, off = utf8(text)
    one, two = one.to_pylist(), two.to_pylist()
    n, first, second = [], [], []
    for a, b in blocks(off):
        ends = off[a + 1 : b + 1] - off[a]
        widths = unit_widths(Words(data, off[a : b + 1]), ends)
        for i, points in enumerate(widths, a):
            units = SkipList(points)
            low, high = sorted((one[i] % (len(units) + 1), two[i] % (len(units) + 1)))
            n.append(len(units))
            first.append(units.seek(low))
            second.append(units.seek(high))
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, first, second)], ["n", "first", "second"])


def fill_in_middle(
    docs: DataFrame, seed: str = "42", rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form, prefix_chars, middle_chars, output.

    The cuts and the form come from the SHA-256 of ``seed``, a colon and the id: four numbers, of eight digits each.
    The smaller of the first two, modulo n + 1, is where the prefix ends, the larger one where the middle ends. ``form``
    is plain, and the output the text, if the text is empty or has one of the marks, or unless the third number modulo
    100 is below ``rate``; else spm (suffix first) if the fourth one is below ``spm``, else psm. Widths are in code
    points, and null for plain texts.

    A null text is empty, a null id counts as an empty one. Each row is judged by itself, so repeated rows give repeated
    results; empty tables give no rows, other columns are ignored. Texts are read whole; a text of n bytes takes some
    30 n bytes of a Python worker.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), name), 256).alias("hash")
    )
    h = [F.conv(F.substring("hash", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    cuts = F.arrow_udf(_cuts, _FOUND)
    cut = rows.select("doc_id", "text", "hash", cuts("text", h[0], h[1]).alias("at"))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    one, two, whole = F.col("at.first").cast("int"), F.col("at.second").cast("int"), F.col("text")
    prefix, middle = whole.substr(F.lit(1), one), whole.substr(one + 1, two - one)
    suffix = whole.substr(two + 1, F.length(whole))
    mixed = {
        "psm": F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle),
        "spm": F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle),
    }
    output = F.when(F.col("form") == "plain", whole)
    for kind, parts in mixed.items():
        output = output.when(F.col("form") == kind, parts)
    widths = [F.when(F.col("form") != "plain", x.cast("long")) for x in (one, two - one)]
    return cut.withColumn("form", form).select(
        "doc_id", F.col("at.n").alias("n"), "form", widths[0].alias("prefix_chars"), widths[1].alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    body = F.substring(output, len(PREFIX) + 1, (1 << 31) - 1)

    def three(second: str) -> list[Column]:
        rest = F.substring_index(body, second, -1)
        return [F.substring_index(body, second, 1), *(F.substring_index(rest, MIDDLE, i) for i in (1, -1))]

    (p, s, m), (s2, p2, m2) = three(SUFFIX), three(PREFIX)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)
