"""Tables: column kinds, cells, policies, candidates, encoding of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import field_path, is_blank
from .vault import token

#: Policy tables have a row for each column of a table at most; more rows than this are joined without a broadcast.
BROADCAST_POLICIES = 10_000
# Confidence of a table candidate, and the decision that each action leads to.
CONFIDENCE = 100
DECISIONS = {"encode": "approved", "review": "needs_review"}
ACTIONS = ["encode", "review", "ignore"]


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Numbers the rows from 0 in the order of the scan: the sizes of the partitions before, plus the place within the
    partition. ``df`` has to be a plain scan, which gives the same partitions twice.
    """
    marked = df.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = marked.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(
        name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ).drop("_part", "_start", "_at")


def infer_kinds(df: DataFrame) -> DataFrame:
    """(index, name, inferred_kind) of each column in one pass: ``integer`` if some value is not blank and all such
    values are 64-bit integers, else ``string``.
    """
    aggs = []
    for i, name in enumerate(df.columns):
        value = F.col(f"`{name}`").cast("string")
        filled = ~is_blank(value)
        number = value.rlike(
            r"(?U)^\s*[+-]?[0-9]+\s*$"
        ) & F.regexp_replace(value, r"(?U)\s", "").try_cast("bigint").isNotNull()
        aggs += [F.count_if(filled).alias(f"f{i}"), F.count_if(filled & ~number).alias(f"s{i}")]
    rows = [
        F.struct(
            F.lit(i).alias("index"),
            F.lit(n).alias("name"),
            F.when((F.col(f"f{i}") > 0) & (F.col(f"s{i}") == 0), "integer").otherwise("string").alias("inferred_kind"),
        )
        for i, n in enumerate(df.columns)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def to_cells(df: DataFrame, row: str = "row_index", columns: Sequence[str] | None = None) -> DataFrame:
    """(row_index, column_index, header, value) of each cell that is not blank. Only ``columns`` are read, if given;
    indexes count all columns but ``row``.
    """
    headers = [c for c in df.columns if c != row]
    cells = [
        F.struct(
            F.lit(i).alias("column_index"), F.lit(h).alias("header"), F.col(f"`{h}`").cast("string").alias("value")
        )
        for i, h in enumerate(headers) if columns is None or h in columns
    ]
    exploded = df.select(
        F.col(row).alias("row_index"), F.explode(F.filter(F.array(*cells), lambda c: ~is_blank(c["value"]))).alias("c")
    )
    return exploded.select("row_index", "c.column_index", "c.header", "c.value")


def first_policies(policies: DataFrame) -> DataFrame:
    """The first policy of each header, by policy_ord."""
    return policies.groupBy("header").agg(F.min_by(F.struct("phi_type", "action"), "policy_ord").alias("p")).select(
        "header", "p.phi_type", "p.action"
    )


def apply_policies(cells: DataFrame, policies: DataFrame) -> DataFrame:
    """Candidates: cells whose header's first policy says encode or review, with phi_type, decision, confidence and
    field_path.
    """
    first = first_policies(policies).where(F.col("action").isin(*DECISIONS))
    small = policies.limit(BROADCAST_POLICIES + 1).count() <= BROADCAST_POLICIES
    joined = cells.join(F.broadcast(first) if small else first, "header")
    return joined.select(
        "row_index", "column_index", "header", "phi_type", "value",
        F.create_map(*[F.lit(x) for pair in DECISIONS.items() for x in pair])[F.col("action")].alias("decision"),
        F.lit(CONFIDENCE).alias("confidence"),
        field_path(F.col("row_index"), F.col("column_index"), F.col("header")).alias("field_path"),
    )


def validate_policies(df: DataFrame, json_col: str, id_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(policies, rejected) from JSON arrays of objects. Rejected rows have the index of the bad entry, null if the
    whole is no array, and a reason.
    """
    raw = df.select(*id_cols, F.from_json(json_col, "array<string>").alias("entries"))
    whole = raw.where(F.col("entries").isNull()).select(
        *id_cols, F.lit(None).cast("int").alias("index"), F.lit("not_an_array").alias("reason")
    )
    entry = raw.select(*id_cols, F.posexplode("entries").alias("index", "e"))
    field = lambda n: F.get_json_object("e", f"$.{n}")
    text = lambda n: F.col("e").rlike(rf'"{n}"\s*:\s*"')
    reason = F.coalesce(
        F.when(F.coalesce(~F.col("e").rlike(r"^\s*\{"), F.lit(True)), "not_an_object"),
        *[F.when(~text(n) | field(n).isNull(), f"bad_{n}") for n in ("header", "phi_type", "action")],
        F.when(~field("action").isin(*ACTIONS), "bad_action"),
    )
    judged = entry.withColumn("reason", reason)
    good = judged.where("reason is null").select(
        *id_cols,
        F.col("index").alias("policy_ord"),
        field("header").alias("header"),
        field("phi_type").alias("phi_type"),
        field("action").alias("action"),
    )
    return good, whole.unionByName(judged.where("reason is not null").select(*id_cols, "index", "reason"))


def allows_encode(decision: Column) -> Column:
    return decision == "approved"


def requires_human_review(decision: Column) -> Column:
    return decision == "needs_review"


def is_high_risk(kind: Column) -> Column:
    return kind.isin("decode", "export", "import")


def is_terminal(state: Column) -> Column:
    return state.isin("completed", "partially_failed", "failed", "cancelled")


def is_open(state: Column) -> Column:
    return state.isin("open", "claimed")


def is_partial_failure(failed_rows: Column) -> Column:
    return failed_rows > 0


def run_rollup(runs: DataFrame, state: str = "state") -> DataFrame:
    """(state, terminal, n)."""
    return runs.groupBy(state).agg(F.count("*").alias("n")).select(
        state, is_terminal(F.col(state)).alias("terminal"), "n"
    )


def route(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to encode, to review); candidates with any other decision are dropped."""
    return candidates.where(allows_encode(F.col("decision"))), candidates.where(
        requires_human_review(F.col("decision"))
    )


def failed_rows(candidates: DataFrame, n_rows: Column | int, width: int) -> DataFrame:
    """The row_index of each row with an approved candidate for a column that the table lacks; candidates past the last
    row are ignored.
    """
    bad = allows_encode(F.col("decision")) & (F.col("row_index") < n_rows) & (
        (F.col("column_index") >= width) | (F.col("column_index") < 0)
    )
    return candidates.where(bad).select("row_index").distinct()


def encode_table(
    df: DataFrame, policies: DataFrame, key: str, failed: DataFrame | None = None, row: str = "row_index"
) -> DataFrame:
    """The table with approved cells replaced by keyed tokens, in one narrow pass; blank, review and ignored cells and
    rows in ``failed`` (row_index) stay as they are.
    """
    chosen = {
        r["header"]: r["phi_type"]
        for r in first_policies(policies).where("action = 'encode'").limit(len(df.columns) + 1).collect()
    }
    if failed is not None:
        df = df.join(failed.select(F.col("row_index").alias(row), F.lit(True).alias("_failed")), row, "left")
    keep = F.coalesce(F.col("_failed"), F.lit(False)) if failed is not None else F.lit(False)
    cells = []
    for name in (c for c in df.columns if c != "_failed"):
        value = F.col(f"`{name}`")
        text = value.cast("string")
        cells.append(
            F.when(keep | is_blank(text), text).otherwise(token(key, F.lit(chosen[name]), text)).alias(name)
            if name in chosen and name != row
            else value
        )
    return df.select(*cells)


def encode_table_with(df: DataFrame, policies: DataFrame, mapping: DataFrame) -> DataFrame:
    """As encode_table, with tokens from ``mapping`` (phi_type, original_value, token); values without one stay. Each
    policy column joins the distinct values of its type.
    """
    chosen = {
        r["header"]: r["phi_type"]
        for r in first_policies(policies).where("action = 'encode'").limit(len(df.columns) + 1).collect()
    }
    known = mapping.groupBy("phi_type", "original_value").agg(F.min("token").alias("_token"))
    for name in [c for c in df.columns if c in chosen]:
        of = known.where(F.col("phi_type") == chosen[name]).select(F.col("original_value").alias("_value"), "_token")
        df = df.join(of, F.col(f"`{name}`").cast("string") == F.col("_value"), "left").withColumn(
            name, F.coalesce("_token", F.col(f"`{name}`").cast("string"))
        ).drop("_value", "_token")
    return df


def batch_summary(n_rows: DataFrame, candidates: DataFrame, width: int) -> DataFrame:
    """One row: total_rows, encoded_cells, review_required_cells, failed_rows. ``n_rows`` is the table, or any frame
    with its rows.
    """
    total = n_rows.agg(F.count("*").alias("total_rows"))
    seen = candidates.crossJoin(F.broadcast(total))
    inside = F.col("row_index") < F.col("total_rows")
    bad = allows_encode(F.col("decision")) & inside & (F.col("column_index") >= width)
    by_row = seen.groupBy("row_index").agg(
        F.count_if(bad).alias("bad"),
        F.count_if(allows_encode(F.col("decision")) & inside & (F.col("column_index") < width)).alias("ok"),
        F.count_if(requires_human_review(F.col("decision"))).alias("review")
    )
    sums = by_row.agg(
        F.coalesce(F.sum(F.when(F.col("bad") == 0, F.col("ok"))), F.lit(0)).alias("encoded_cells"),
        F.coalesce(F.sum("review"), F.lit(0)).alias("review_required_cells"),
        F.count_if(F.col("bad") > 0).alias("failed_rows"),
    )
    return total.crossJoin(F.broadcast(sums))
