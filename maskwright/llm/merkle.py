"""A manifest of a table as a persistent Merkle tree: every changed row makes a version that copies the nodes above its
leaf and shares all others.

A leaf is the digest of a row. The rows of a group (``source``), in the order of their ids, are the leaves of its tree:
each 16 consecutive nodes have one node above them, until one is left, the subroot. The subroots, in the order of the
groups, are the leaves of one more tree, whose top is the root. Digests are lower-case hexadecimal SHA-256, of inputs
that are concatenated.

Leaves are kept in aligned blocks of 16 * 16, each one task's small group: a version copies its two lower levels there
and then goes on along the block's path, the nodes beside it on each level above, which all versions of the block share.
All levels are tables; none is held by one task or by the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

#: Nodes under one node.
FAN = 16
#: Levels and leaves of an aligned block.
DEPTH = 2
BLOCK = FAN**DEPTH
_PATH = "array<struct<left:string,right:string>>"
_NODE = pa.schema(
    [("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("height", pa.int32())]
)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """How a leaf's digest takes a value: its number of UTF-8 bytes, a colon and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _placed(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in its tree by ``order``, from 0, and ``n``, the number of the tree's rows.

    Rows are put in ranges of (tree, order) and written; the sizes of a tree's ranges tell where each range begins, so a
    tree is never one task's work, and neither are rows that are alike, as ``order`` ends in a number of the row.
    """
    ranged = rows.repartitionByRange(tree, *order).withColumn("cell", F.spark_partition_id())
    cells = materialize(ranged, "ranges")
    # A row for each range, and one more for each tree.
    sizes = cells.groupBy(tree, "cell").agg(F.count("*").alias("size"))
    one = Window.partitionBy(tree)
    before = one.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        tree,
        "cell",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"),
        F.sum("size").over(one).alias("n"),
    )
    within = F.row_number().over(Window.partitionBy(tree, "cell").orderBy(*order)) - 1
    placed = cells.withColumn("within", within).join(offsets, [tree, "cell"])
    return placed.withColumn("pos", F.col("offset") + F.col("within")).drop("cell", "offset", "within")


def _runs(nodes: DataFrame) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, pos, n, digest; n nodes of that level in the tree), from below: (tree, pos, n,
    children, digest) each. A tree of one node has none. A level has a sixteenth of the rows of that below.
    """
    levels: list[DataFrame] = []
    while True:
        under = nodes.where("n > 1")
        if under.isEmpty():
            return levels
        children = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        runs = under.groupBy("tree", F.floor(F.col("pos") / FAN).alias("up"), "n").agg(children.alias("children"))
        levels.append(
            materialize(
                runs.select(
                    "tree",
                    F.col("up").alias("pos"),
                    F.ceil(F.col("n") / FAN).alias("n"),
                    "children",
                    F.sha2(F.array_join("children", ""), 256).alias("digest"),
                ),
                "runs",
            )
        )
        nodes = levels[-1]


def _tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, digest, height): the last node of each tree, and its level over ``nodes``."""
    tops = [x.where("n = 1").select("tree", "digest", F.lit(h).alias("height")) for h, x in enumerate([nodes, *levels])]
    return reduce(DataFrame.unionByName, tops)


def _paths(nodes: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """``nodes`` (tree, pos) with ``path``: the digests before and after each one of the nodes above, level by level,
    and then the ``path`` of the tree itself in ``above`` (tree, and what else it has).
    """
    rest = [c for c in above.columns if c not in ("tree", "path")]
    done = nodes.where("n = 1").select("tree", "pos").join(above, "tree")
    upper = None
    for level in reversed(levels):
        tops = level.where("n = 1").select("tree", "pos", "children").join(above, "tree")
        if upper is not None:
            tops = tops.unionByName(level.where("n > 1").select("tree", "pos", "children").join(upper, ["tree", "pos"]))
        children = F.col("children")
        beside = F.struct(
            F.array_join(F.slice(children, F.lit(1), F.col("nth")), "").alias("left"),
            F.array_join(F.slice(children, F.col("nth") + 2, F.size(children)), "").alias("right"),
        )
        each = tops.select("*", F.posexplode("children").alias("nth", "child"))
        upper = each.select(
            "tree",
            (F.col("pos") * FAN + F.col("nth")).alias("pos"),
            F.concat(F.array(beside), F.col("path")).alias("path"),
            *rest,
        )
    return done if upper is None else done.unionByName(upper)


def raised(leaves: list[str], whole: bool) -> list[list[str]]:
    """The levels of a block, from its leaves to its top; those of a ``whole`` tree end where one node is left."""
    levels = [leaves]
    for _ in range(DEPTH):
        below = levels[-1]
        if whole and len(below) == 1:
            break
        levels.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return levels


def beside(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """The digests before and after the leaf ``at``, and each node above it within the block."""
    out = []
    for level in levels[:-1]:
        first = at // FAN * FAN
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + FAN])))
        at //= FAN
    return out


def copied(leaf: str, path: Sequence[tuple[str, str]]) -> list[str]:
    """The nodes that a version with this leaf copies, from the leaf to the root."""
    nodes = [leaf]
    for left, right in path:
        nodes.append(digest(left + nodes[-1] + right))
    return nodes


def _top_of_block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("pos")
    n = rows.column("n")[0].as_py()
    levels = raised(rows.column("leaf").to_pylist(), n <= BLOCK)
    row = {"tree": key[0].as_py(), "pos": key[1].as_py(), "n": -(-n // BLOCK), "digest": levels[-1][0]}
    return pa.Table.from_pylist([row | {"height": len(levels) - 1}], _NODE)


def manifest(
    docs: DataFrame, changed: Column | None = None, group: str = "source", order: str = "doc_id",
    fields: Sequence[str] = FIELDS, text: str = "text", when: Column | None = None, proofs: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``order`` and ``group``, pos, leaf, changed_leaf (null where nothing is changed),
    height (levels from the leaf to the subroot), subroot, root, proof_sha256, copied; and proof with ``proofs``.

    ``changed`` is the ``text`` of the rows for which ``when`` holds after a change. Such a row is a version of the tree:
    ``copied`` has its own nodes, from the changed leaf to the version's root, and all others are those of the first
    tree (``version_nodes``). For other rows they are that tree's own, computed from the leaf. ``proof`` has the digests
    before and after each of these nodes, proof_sha256 is the digest of all of them, level by level.

    Null fields count as null and not as empty; a null group is a tree of its own, the first; null ids come first.
    Repeated rows have a leaf each; rows that share group and id are in the order of their leaves. Empty tables give no
    rows; other columns are ignored; texts are read whole, once.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    new = F.lit(None).cast("string")
    if changed is not None:
        new = F.when(F.lit(True) if when is None else when, leaf_digest(*[changed if f == text else F.col(f) for f in fields]))
    rows = docs.select(
        tree.alias("tree"),
        F.col(order).alias("id"),
        F.unhex(leaf_digest(*map(F.col, fields))).alias("leaf"),
        F.unhex(new).alias("new"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = materialize(
        _placed(materialize(rows, "leaves"), "tree", ["id", "leaf", "row"]).select(
            "tree", "id", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("new")).alias("new"), "pos", "n",
            F.floor(F.col("pos") / BLOCK).alias("block"),
        ),
        "placed",
    )
    blocks = materialize(
        leaves.select("tree", "block", "pos", "n", "leaf").groupBy("tree", "block").applyInArrow(
            _top_of_block, "tree string, pos bigint, n bigint, digest string, height int"
        ),
        "blocks",
    )
    levels = _runs(blocks)
    inner = blocks.where("pos = 0").select("tree", F.col("height").alias("inner"))
    tops = _tops(blocks, levels).join(inner, "tree").withColumn("height", F.col("height") + F.col("inner"))
    subroots = materialize(tops.drop("inner").withColumn("all", F.lit(0)), "subroots")
    # The trees' own places; there is a row for each group.
    tier = _placed(subroots, "all", ["tree"]).select(
        F.lit("").alias("tree"), "pos", "n", "digest", F.col("tree").alias("name"), "height"
    )
    tier = materialize(tier, "tier")
    over = _runs(tier)
    root = _tops(tier, over).select("tree", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    named = tier.select("pos", F.col("name").alias("tree"), F.col("digest").alias("subroot"), "height")
    above = _paths(tier, over, root).join(named, "pos").select(named["tree"], "path", "height", "subroot", "root")
    paths = materialize(_paths(blocks, levels, materialize(above, "trees")), "paths")
    paths = paths.withColumnRenamed("pos", "block")
    kind = docs.schema[order].dataType.simpleString()
    schema = (
        f"tree string, id {kind}, pos bigint, leaf string, new string, height int, subroot string, root string, "
        f"proof_sha256 string, copied array<string>, proof {_PATH}"
    )

    def versions(block: pa.Table, path: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        nodes = raised(block.column("leaf").to_pylist(), block.column("n")[0].as_py() <= BLOCK)
        upper = [(x["left"], x["right"]) for x in path.column("path")[0].as_py()]
        shared = "".join(left + right for left, right in upper)
        hashes, own, whole = [], [], []
        for at, new in enumerate(block.column("new").to_pylist()):
            lower = beside(nodes, at)
            hashes.append(digest("".join(left + right for left, right in lower) + shared))
            own.append(copied(nodes[0][at] if new is None else new, lower + upper))
            whole.append([{"left": a, "right": b} for a, b in lower + upper] if proofs else None)
        sides = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        columns = {name: block.column(name) for name in ("tree", "id", "pos", "leaf", "new")}
        columns |= {name: pa.repeat(path.column(name)[0], len(block)) for name in ("height", "subroot", "root")}
        columns |= {"proof_sha256": pa.array(hashes, pa.string()), "copied": pa.array(own, pa.list_(pa.string()))}
        return pa.table(columns | {"proof": pa.array(whole, sides)})

    made = leaves.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(versions, schema)
    shown = made.select(
        F.col("id").alias(order),
        F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias(group),
        "pos", "leaf", F.col("new").alias("changed_leaf"), "height", "subroot", "root", "proof_sha256", "copied", "proof",
    )
    return shown if proofs else shown.drop("proof")


def version_nodes(versions: DataFrame, group: str = "source", order: str = "doc_id") -> DataFrame:
    """(id, group, level, index, digest): the nodes that each changed row's version has for its own. ``level`` 0 is the
    leaf and ``index`` the node's place on its level; the levels over the subroot have no index, as a node of theirs is
    the only one that the version has there. All other nodes of the version are those of the first tree.
    """
    each = versions.where("changed_leaf IS NOT NULL").select(
        order, group, "pos", "height", F.posexplode("copied").alias("level", "digest")
    )
    index = F.floor(F.col("pos") / F.pow(F.lit(FAN), "level")).cast("long")
    return each.select(order, group, "level", F.when(F.col("level") <= F.col("height"), index).alias("index"), "digest")


def check(rows: DataFrame, root: str) -> DataFrame:
    """``rows`` of ``manifest(..., proofs=True)`` with ``verified``: whether leaf, or changed leaf, and proof give the
    root. Every row is checked by itself, without the tree.
    """
    start = F.coalesce("changed_leaf", "leaf")
    end = F.aggregate("proof", start, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))
    return rows.withColumn("verified", end == F.lit(root))


__all__ = ["BLOCK", "DEPTH", "FAN", "check", "leaf_digest", "manifest", "version_nodes"]
