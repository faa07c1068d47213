"""Identifier spans in text as native expressions.

A span is a struct (label, start, end, ord): offsets in code points, the end exclusive; ``ord`` is the place of its
detector, which orders spans with equal offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .arrays import CHUNK, let, scan
from .names import fresh

SPAN = "array<struct<label:string,start:int,end:int,ord:int>>"
_FOUND = "array<struct<start:int,end:int,value:string>>"


@dataclass(frozen=True)
class Detector:
    """A label, its pattern and the group that is the identifier. ``needs`` is a cheap pattern that a text with a match
    has; ``valid`` checks the identifier, a column of text; ``blocked_by`` and ``blocks`` name sets of ranges in
    which a match may not start.
    """

    label: str
    pattern: str
    group: int = 0
    needs: str | None = None
    valid: Callable[[Column], Column] | None = None
    blocks: str | None = None
    blocked_by: str | None = None


#: Marks that a match is put between; texts that have one get another control character in its place, which no pattern
#: tells apart from it.
_OPEN, _SHUT, _END = "\x01", "\x02", "\x03"


def unmarked(text: Column) -> Column:
    """The text without the marks that ``spans`` uses, of the same length."""
    return F.when(text.rlike("[\x01-\x03]"), F.translate(text, "\x01\x02\x03", "\x04\x04\x04")).otherwise(text)


def _pieces(text: Column, pattern: str, group: int) -> Column:
    """A text without marks, cut where matches begin: each piece but the first is the whole match, its group, and the
    text up to the next match, with marks between.
    """
    folded = pattern.startswith("(?i)")
    regex = "(?Ui)" + pattern[4:] if folded else "(?U)" + pattern
    return F.split(F.regexp_replace(text, regex, f"{_OPEN}$0{_SHUT}${group}{_END}"), _OPEN, -1)


#: The spans of pieces, in time proportional to them: offsets are running sums of the pieces' lengths, and as appending
#: copies an array, those of a chunk are gathered before they are appended. As text, as there are many detectors.
_SPANS = f"""coalesce(aggregate(
  CASE WHEN size({{0}}) > 1 THEN sequence(0, cast(floor((size({{0}}) - 2) / {CHUNK}) AS int)) ELSE array() END,
  named_struct('at', length({{0}}[0]), 'out', cast(array() AS {_FOUND})),
  (whole, i) -> aggregate(
    transform(slice({{0}}, i * {CHUNK} + 2, {CHUNK}), p -> named_struct(
      'all', length(substring_index(p, '{_SHUT}', 1)),
      'value', substring_index(substring_index(p, '{_END}', 1), '{_SHUT}', -1),
      'gap', length(substring_index(p, '{_END}', -1)))),
    named_struct('at', whole.at, 'out', cast(array() AS {_FOUND})),
    (own, p) -> named_struct('at', own.at + p.all + p.gap, 'out', concat(own.out, array(named_struct(
      'start', own.at + p.all - length(p.value), 'end', own.at + p.all, 'value', p.value)))),
    own -> named_struct('at', own.at, 'out', concat(whole.out, own.out))),
  whole -> whole.out), cast(array() AS {_FOUND}))"""


def spans(text: Column, pattern: str, group: int = 0, needs: str | None = None) -> Column:
    """(start, end, value) of each match of ``pattern``, or of its ``group``, which has to end the match; leftmost, not
    overlapping.

    No match, or null text: an empty array. ``needs`` is a cheap pattern that each text with a match has.
    """
    def offsets(p: Column) -> tuple[Column, Column, Column]:
        whole, value = F.substring_index(p, _SHUT, 1), F.substring_index(F.substring_index(p, _END, 1), _SHUT, -1)
        return F.length(whole), value, F.length(F.substring_index(p, _END, -1))

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        whole, value, gap = offsets(p)
        end = at + whole
        span = F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))
        return end + gap, F.array(span)

    def all_of(ps: Column) -> Column:
        return F.when(F.size(ps) > 1, scan(F.slice(ps, 2, F.size(ps)), F.length(F.get(ps, F.lit(0))), step, _FOUND))

    clean, none = unmarked(text), F.array().cast(_FOUND)
    found = F.coalesce(let(_pieces(clean, pattern, group), all_of), none)
    return found if needs is None else F.when(clean.rlike(needs), found).otherwise(none)


def valid_dea(value: Column) -> Column:
    """The last digit is the last one of the odd places' sum and twice the even places' sum."""
    d = [F.substring(value, i, 1).cast("int") for i in range(3, 10)]
    return F.coalesce((d[0] + d[2] + d[4] + 2 * (d[1] + d[3] + d[5])) % 10 == d[6], F.lit(False))


def valid_npi(value: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", F.concat(F.lit("80840"), value)), F.lit(False))


def valid_age(value: Column) -> Column:
    return F.coalesce(value.try_cast("int").between(0, 120), F.lit(False))


DEFAULT: tuple[Detector, ...] = (
    Detector("NAME", P.NAME, 1, "Patient"),
    Detector("EMAIL", P.EMAIL, 0, "@"),
    Detector("FAX", P.FAX, 1, "(?i)fax|facsimile", blocks="phone"),
    Detector("PHONE", P.PHONE_OVERLONG, 0, r"(?U)\d{3}[-.]\d{4}\s+[xXeE]", blocks="phone", blocked_by="phone"),
    Detector("PHONE", P.PHONE_EXTENSION, 0, r"(?U)\d{3}[-.]\d{4}\s+[xXeE]", blocks="phone", blocked_by="phone"),
    Detector("PHONE", P.PHONE, 0, r"(?U)\d{3}[-.]\d{4}", blocked_by="phone"),
    Detector("DATE", P.DATE, 0, r"(?U)\d[-/]\d"),
    Detector("SSN", P.SSN, 0, r"(?U)\d-\d\d-\d"),
    Detector("PASSPORT", P.PASSPORT, 0, r"(?U)[A-Z]\d{8}"),
    Detector("PASSPORT", P.PASSPORT_NUMERIC, 1, "(?i)passport"),
    Detector("INSURANCE_ID", P.INSURANCE_ID, 1, "(?i)insurance|member|policy"),
    Detector("DEA_NUMBER", P.DEA_NUMBER, 1, "DEA", valid_dea),
    Detector("AGE", P.AGE, 1, "(?i)age", valid_age),
    Detector("FACILITY", P.FACILITY, 1, "facility|hospital|clinic|site|location"),
    Detector("NPI", P.NPI, 1, "(?i)npi", valid_npi),
    Detector("LICENSE_PLATE", P.LICENSE_PLATE, 1, "(?i)plate"),
    Detector("VIN", P.VIN, 1, "(?i)vin|vehicle"),
    Detector("DRIVER_LICENSE", P.DRIVER_LICENSE, 1, "(?i)driver|dl"),
    Detector("IP_ADDRESS", P.IP_ADDRESS, 0, r"(?U)\d\.\d"),
    Detector("URL", P.URL, 0, "https?://"),
    Detector("ZIP", P.ZIP, 0, r"(?U)\d{5}"),
    Detector("ADDRESS", P.ADDRESS, 0, r"(?U)\d\s+[A-Z]"),
    Detector("MRN", P.MRN, 0, "(?i)mrn"),
    Detector("ID", P.ID, 0, "(?i)id"),
)


class Registry:
    """The default detectors and a user's own, which come after them. A validator is a function from a column to a
    column, so no Python runs on rows.
    """

    def __init__(self, detectors: Sequence[Detector] = DEFAULT):
        self.detectors = tuple(detectors)

    def add(
        self, label: str, pattern: str, group: int = 0, valid: Callable[[Column], Column] | None = None
    ) -> Registry:
        return Registry((*self.detectors, Detector(label, pattern, group, valid=valid)))

    def only(self, *labels: str) -> Registry:
        return Registry([d for d in self.detectors if d.label in labels])


def with_spans(
    df: DataFrame, text_col: str, detectors: Sequence[Detector] | Registry = DEFAULT, out: str = "spans"
) -> DataFrame:
    """Adds the ordered spans of all detectors. Each detector's matches are a column of their own in a first step, and
    are merged in a second one, so that no expression is computed twice.
    """
    detectors = detectors.detectors if isinstance(detectors, Registry) else tuple(detectors)
    taken_names = [*df.columns, out]
    clear, start = fresh(taken_names, "unmarked"), fresh(taken_names, "detected")
    cut, names = ([fresh(taken_names, f"{start}_{kind}_{i}") for i in range(len(detectors))] for kind in ("cut", "own"))
    text, found = F.col(clear), df.withColumn(clear, unmarked(F.col(text_col)))
    cuts = {}
    for name, d in zip(cut, detectors, strict=True):
        pieces = _pieces(text, d.pattern, d.group)
        cuts[name] = pieces if d.needs is None else F.when(text.rlike(d.needs), pieces)
    found = found.withColumns(cuts).withColumns(
        {name: F.expr(_SPANS.format(f"`{pieces}`")) for name, pieces in zip(names, cut, strict=True)}
    )
    # Detectors that depend on others come one after the other, each as a column.
    taken: dict[str, list[str]] = {}
    for name, d in zip(names, detectors, strict=True):
        if d.valid is not None:
            found = found.withColumn(name, _kept(F.col(name), d.valid))
        for other in taken.get(d.blocked_by or "", []):
            found = found.withColumn(name, _outside(F.col(name), F.col(other)))
        if d.blocks:
            taken.setdefault(d.blocks, []).append(name)
    parts = [_labelled(F.col(name), d.label, i) for i, (name, d) in enumerate(zip(names, detectors, strict=True))]
    merged = found.withColumn(out, order_spans(F.concat(*parts)) if parts else F.array().cast(SPAN))
    return merged.drop(clear, *cut, *names)


def _kept(own: Column, valid: Callable[[Column], Column]) -> Column:
    return F.filter(own, lambda s: valid(s["value"]))


def _outside(own: Column, other: Column) -> Column:
    """Those of the spans that don't begin in one of the other ones: both in one order, with how far the others reach."""
    marked = [
        F.transform(
            spans_,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(mine).alias("mine"), s["end"].alias("end"), s["value"].alias("value")
            ),
        )
        for spans_, mine in ((other, 0), (own, 1))
    ]

    def step(reach: Column, x: Column) -> tuple[Column, Column]:
        mine, none = x["mine"] == 1, F.array().cast(_FOUND)
        span = F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
        free = mine & (x["start"] >= reach)
        return F.when(mine, reach).otherwise(F.greatest(reach, x["end"])), F.when(free, span).otherwise(none)

    both = scan(F.array_sort(F.concat(*marked)), F.lit(0), step, _FOUND)
    return F.when((F.size(own) == 0) | (F.size(other) == 0), own).otherwise(both)


def _labelled(own: Column, label: str, nth: int) -> Column:
    return F.transform(
        own,
        lambda s: F.struct(
            F.lit(label).alias("label"), s["start"].alias("start"), s["end"].alias("end"), F.lit(nth).alias("ord")
        ),
    )


def order_spans(found: Column) -> Column:
    """By start, end and detector."""
    keyed = F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["ord"].alias("ord"), s["label"].alias("label")
        ),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda s: F.struct(
            s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["ord"].alias("ord")
        ),
    )


def category_counts(found: Column) -> Column:
    """Label to number of spans, overlapping ones too, sorted by label."""
    labels = F.array_sort(F.array_distinct(F.transform(found, lambda s: s["label"])))
    return F.map_from_entries(
        F.transform(
            labels,
            lambda x: F.struct(
                x.alias("key"), F.size(F.filter(found, lambda s: s["label"] == x)).cast("long").alias("value")
            ),
        )
    )


def mask(text: Column, found: Column) -> Column:
    """Replaces spans by ``[LABEL]`` from left to right; a span that starts before the end of the last one replaced is
    left out.
    """
    none = F.array().cast("array<string>")

    def stretch(at: Column, xs: Column) -> Column:
        """Where a chunk's text begins, and that text: finding a place in a text takes as long as what is before it."""
        end = F.greatest(F.array_max(F.transform(xs, lambda x: x["end"])), at)
        return F.struct(at.alias("from"), text.substr(at + 1, end - at).alias("text"))

    def step(at: Column, x: Column, here: Column) -> tuple[Column, Column]:
        before = here["text"].substr(at - here["from"] + 1, x["start"] - at)
        skip = x["start"] < at
        shown = F.array(before, F.concat(F.lit("["), x["label"], F.lit("]")))
        return F.when(skip, at).otherwise(x["end"]), F.when(skip, none).otherwise(shown)

    def ends(at: Column, x: Column) -> Column:
        return F.when(x["start"] < at, at).otherwise(x["end"])

    last = F.aggregate(found, F.lit(0), ends)
    masked = F.array_join(scan(found, F.lit(0), step, "array<string>", stretch), "")
    whole = F.concat(masked, text.substr(last + 1, F.length(text)))
    return F.when(found.isNotNull(), F.when(F.size(found) == 0, text).otherwise(whole))


def text_report(
    df: DataFrame, text_col: str, id_cols: Sequence[str], detectors: Sequence[Detector] | Registry = DEFAULT
) -> DataFrame:
    """One report per row: ids, summary (input_char_count, detected_span_count, category_counts), masked_text, spans
    with a redacted preview, metadata.
    """
    found = with_spans(df.select(*id_cols, text_col), text_col, detectors, "_spans")
    counted = found.withColumn("_masked", mask(F.col(text_col), F.col("_spans")))
    preview = F.transform(
        "_spans",
        lambda s: F.struct(
            s["label"].alias("label"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit("<redacted>").alias("preview"),
        ),
    )
    return counted.select(
        *id_cols,
        F.struct(
            F.length(text_col).cast("long").alias("input_char_count"),
            F.size("_spans").cast("long").alias("detected_span_count"),
            category_counts(F.col("_spans")).alias("category_counts"),
        ).alias("summary"),
        F.col("_masked").alias("masked_text"), preview.alias("spans"),
        F.struct(
            F.lit("fallback_synthetic_patterns").alias("engine"),
            F.lit(False).alias("network_api_called"),
            F.lit("redacted_placeholders_only").alias("preview_policy"),
        ).alias("metadata"),
    )


def each_span(found: DataFrame, others: Sequence[str], spans_col: str = "spans", name: str = "s") -> DataFrame:
    """A row for each span. An outer explode: of an inner one the optimiser makes a filter on the array's size, which it
    moves below the detectors, so that they run twice.
    """
    return found.select(*others, F.explode_outer(spans_col).alias(name)).where(F.col(name).isNotNull())


def label_counts(
    df: DataFrame, text_col: str, by: Sequence[str], detectors: Sequence[Detector] | Registry = DEFAULT
) -> DataFrame:
    """(by, label, n): spans by the given columns and label."""
    found = with_spans(df.select(*by, text_col), text_col, detectors, "_spans")
    return each_span(found, by, "_spans.label", "label").groupBy(*by, "label").agg(
        F.count("*").alias("n")
    )


__all__ = [
    "DEFAULT",
    "Detector",
    "Registry",
    "category_counts",
    "each_span",
    "label_counts",
    "mask",
    "order_spans",
    "spans",
    "text_report",
    "valid_age",
    "valid_dea",
    "valid_npi",
    "with_spans",
]
