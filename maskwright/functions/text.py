"""Text, path and name helpers as native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TEXT_BYTES = 1 << 20


def is_blank(c: Column) -> Column:
    """Null, or nothing but white space of any script."""
    return c.isNull() | c.rlike(r"(?U)^\s*$")


def squash_ws(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_labels(c: Column) -> Column:
    """``Patient:`` as ``Patient``, then squashed."""
    return squash_ws(F.replace(c, F.lit("Patient:"), F.lit("Patient ")))


def text_metrics(c: Column) -> Column:
    """(line_count, char_count): lines that are not blank, and characters after squashing."""
    lines = F.filter(F.split(c, r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]"), lambda x: ~is_blank(x))
    return F.struct(
        F.size(lines).cast("long").alias("line_count"), F.length(squash_ws(c)).cast("long").alias("char_count")
    )


def guard_text(df: DataFrame, text_col: str, max_bytes: int = MAX_TEXT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones without the text but with a reason: ``blank`` or ``too_large``."""
    text = F.col(text_col)
    reason = F.when(F.octet_length(text) > max_bytes, "too_large").when(is_blank(text), "blank")
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").drop(text_col)


def count_literal(text: Column, phrase: Column) -> Column:
    """How often a phrase occurs, not overlapping."""
    return F.when(
        F.length(phrase) > 0,
        ((F.length(text) - F.length(F.replace(text, phrase, F.lit("")))) / F.length(phrase)).cast("long"),
    ).otherwise(F.lit(0).cast("long"))


def count_literals(
    df: DataFrame, text_col: str, id_cols: Sequence[str], dictionary: dict[str, Sequence[str]]
) -> DataFrame:
    """(ids, category, n) for each category of fixed phrases that occurs in a text. The dictionary is part of the
    expression, so nothing is joined.
    """
    totals = [
        F.struct(
            F.lit(k).alias("category"),
            sum((count_literal(F.col(text_col), F.lit(p)) for p in phrases), F.lit(0).cast("long")).alias("n"),
        )
        for k, phrases in sorted(dictionary.items())
    ]
    return df.select(
        *id_cols, F.explode(F.filter(F.array(*totals), lambda x: x["n"] > 0)).alias("x")
    ).select(*id_cols, "x.category", "x.n")


def excel_column_name(index: Column) -> Column:
    """0 to A, 25 to Z, 26 to AA and so on: as many letters as the index needs, fourteen for the largest."""

    def letter(state: Column, _: Column) -> Column:
        rest = state["rest"]
        more = F.when(rest >= 26, F.call_function("div", rest, F.lit(26)) - 1).otherwise(F.lit(-1).cast("long"))
        name = F.when(rest >= 0, F.concat(F.char(F.lit(65) + rest % 26), state["name"])).otherwise(state["name"])
        return F.struct(name.alias("name"), more.cast("long").alias("rest"))

    start = F.struct(F.lit("").alias("name"), index.cast("long").alias("rest"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, letter, lambda s: s["name"])


def field_path(row: Column, column: Column, header: Column) -> Column:
    return F.concat(
        F.lit("rows/"),
        row.cast("string"),
        F.lit("/columns/"),
        column.cast("string"),
        F.lit("/"),
        F.replace(header, F.lit("/"), F.lit("_")),
    )


def media_path(label: Column, key: Column) -> Column:
    clean = lambda c: F.translate(c, "/\\", "__")
    return F.concat(F.lit("media:"), clean(label), F.lit(":"), clean(key))


def dicom_path(group: Column, element: Column, keyword: Column) -> Column:
    four = lambda n: F.lpad(F.lower(F.hex(n)), 4, "0")
    return F.concat(F.lit("dicom/"), four(group), F.lit(","), four(element), F.lit("/"), keyword)


def page_path(page: Column, label: Column) -> Column:
    return F.concat(F.lit("pdf/pages/"), page.cast("string"), F.lit("/"), F.replace(label, F.lit("/"), F.lit("_")))


def scope_key(job: Column, artifact: Column, path: Column) -> Column:
    return F.concat_ws("/", job, artifact, path)


def dicom_output_name(source: Column) -> Column:
    """``dicom-output`` with the source's extension only if that is ``.dcm`` in any case."""
    base = F.regexp_extract(source, r"([^/\\]*)$", 1)
    return F.when(
        base.rlike(r"(?i)[^.]\.dcm$"), F.concat(F.lit("dicom-output"), F.lower(F.substring(base, -4, 4)))
    ).otherwise("dicom-output")


def safe_stem(
    path: Column,
    lower: bool = True,
    sep: str = "-",
    keep: str = "",
    suffixes: Sequence[str] = (),
    default: str | None = "output",
    max_chars: int = 64,
) -> Column:
    """A file stem of ASCII letters and digits (and ``keep``): the last path segment without a suffix or extension,
    other runs as ``sep``, cut to ``max_chars``, no ``sep`` at the ends; ``default`` if nothing is left.
    """
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    for suffix in suffixes:
        stem = F.when(
            F.endswith(F.lower(base), F.lit(suffix)), F.substring(base, F.lit(1), F.length(base) - len(suffix))
        ).otherwise(stem)
    stem = F.lower(stem) if lower else stem
    escaped = "".join("\\" + c for c in keep)
    stem = F.regexp_replace(stem, rf"[^A-Za-z0-9{escaped}]+", sep)
    stem = F.rtrim(F.substring(F.ltrim(stem, F.lit(sep)), 1, max_chars), F.lit(sep))
    return F.coalesce(F.when(stem != "", stem), F.lit(default))
