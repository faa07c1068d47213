"""The mapping vault: tokens, upsert, decode, export, import and the audit trail.

``vault`` has seq, id, job_id, artifact_id, field_path, phi_type, token, original_value, created_at; ``audit`` has seq,
id, kind, actor, detail, recorded_at. ``seq`` is the order of insertion. A record is identified by its scope (job,
artifact, field path), type and value; a token by type and value.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..functions.text import is_blank, scope_key
from ..sources.keys import Key
from ..sources.scratch import written
from .components import chain_ends, components
from .ledger import field

SCOPE = ["job_id", "artifact_id", "field_path"]
IDENTITY = ["phi_type", "original_value"]
RECORD = [*SCOPE, *IDENTITY]
# The phrase that stands for an event's detail, by kind.
SAFE_DETAIL = {
    "encode": "encoded mapping",
    "decode": "decode event",
    "export": "portable export event",
    "import": "portable import event",
}
MAX_PAGE = 100


def _keyed(key: str | Column | Key, *parts: Column) -> Column:
    """A digest of some texts that only holders of the key can make. A ``Key`` is the way to give one: the digest is an
    HMAC over the parts with their lengths, and no plan shows the key. A text or column is for tests and for tokens of
    earlier versions: it is hashed before the parts, and is part of the plan.
    """
    if isinstance(key, Key):
        return key.hmac(F.concat(*map(field, parts)))
    return F.sha2(F.concat_ws("\x1f", F.lit(key) if isinstance(key, str) else key, *parts), 256)


def token(key: str | Column | Key, phi_type: Column, value: Column) -> Column:
    """``tok-`` and 32 hexadecimal digits of a keyed digest: the same for a type and value wherever it is computed."""
    return F.concat(F.lit("tok-"), F.substring(_keyed(key, phi_type, value), 1, 32))


def record_id(key: str | Key, *scope: Column) -> Column:
    """A UUID-shaped name of a record, from its identity."""
    h = _keyed(key, F.lit("record"), *scope) if isinstance(key, Key) else _keyed(f"{key}:record", *scope)
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.substring(h, 13, 4),
        F.substring(h, 17, 4),
        F.substring(h, 21, 12),
    )


def _first(vault: DataFrame) -> DataFrame:
    """The token that each type and value got first."""
    return vault.groupBy(*IDENTITY).agg(F.min_by("token", "seq").alias("known"))


def ensure_mappings(candidates: DataFrame, vault: DataFrame, key: str | Key) -> DataFrame:
    """The records to append for ``candidates`` (scope, type, value): none for a record that is there, the known token
    for a known value, a keyed one otherwise.

    Candidates are reduced to distinct records before anything is joined, so a value that fills a third of a table is
    one row.
    """
    wanted = candidates.select(*RECORD).distinct()
    new = wanted.join(vault.select(*RECORD), RECORD, "left_anti")
    named = new.join(_first(vault), IDENTITY, "left")
    tokens = F.coalesce("known", token(key, F.col("phi_type"), F.col("original_value")))
    return named.select(record_id(key, *[F.col(c) for c in RECORD]).alias("id"), *RECORD, tokens.alias("token"))


def audit_encode(new: DataFrame, actor: str) -> DataFrame:
    """One event for each new record."""
    return new.select(
        F.lit("encode").alias("kind"),
        F.lit(actor).alias("actor"),
        F.concat(F.lit("encoded mapping "), scope_key(*[F.col(c) for c in SCOPE])).alias("detail"),
    )


def duplicate_ids(ids: DataFrame, request: str = "request_id", record: str = "record_id") -> DataFrame:
    """(request, record) that a request names more than once."""
    return ids.groupBy(request, record).count().where("count > 1").select(request, record)


def validate_decode(requests: DataFrame, ids: DataFrame) -> DataFrame:
    """(request_id, reason): null for a good request. ``requests`` has request_id, output_target, justification; ``ids``
    request_id, ordinal, record_id. Reasons in order of precedence.
    """
    counts = ids.groupBy("request_id", "record_id").agg(F.count("*").alias("n")).groupBy("request_id").agg(
        F.count("*").alias("ids"), F.max("n").alias("most")
    )
    reason = (
        F.when(F.coalesce(F.col("ids"), F.lit(0)) == 0, "empty_scope").when(F.col("most") > 1, "duplicate_record_id").when(
            is_blank(F.col("output_target")), "missing_output_target"
        ).when(is_blank(F.col("justification")), "missing_justification")
    )
    return requests.join(counts, "request_id", "left").select("request_id", reason.alias("reason"))


def decode(vault: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values, failed): request_id, ordinal, record_id, token, original_value of requests all of whose ids are known;
    request_id and the number of unknown ids of the others.
    """
    known = vault.select(F.col("id").alias("record_id"), "token", "original_value", "phi_type", *SCOPE)
    found = ids.join(known, "record_id", "left")
    failed = found.where(F.col("token").isNull()).groupBy("request_id").agg(F.count("*").alias("unknown_ids"))
    return found.join(failed, "request_id", "left_anti").select(
        "request_id", "ordinal", "record_id", "token", "original_value"
    ), failed


def audit_decode(requests: DataFrame, values: DataFrame) -> DataFrame:
    """One event for each decoded request, with target, reason, count and ids in their order. The list is as long as the
    request.
    """
    ids = values.groupBy("request_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "record_id"))), lambda x: x["record_id"]), ","
        ).alias("ids"),
        F.count("*").alias("n"),
    )
    detail = F.concat(
        F.lit("decode to "),
        F.col("output_target"),
        F.lit(" because "),
        F.col("justification"),
        F.lit("; records "),
        F.col("n").cast("string"),
        F.lit(": "),
        F.col("ids"),
    )
    return requests.join(ids, "request_id").select(
        "request_id", F.lit("decode").alias("kind"), "actor", detail.alias("detail")
    )


def export_subset(vault: DataFrame, ids: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of portable exports; ``contexts`` has request_id and context. Rejected have a reason:
    blank_context, empty, duplicate_record_id or unknown_record_id.
    """
    known = ids.join(vault.withColumnRenamed("id", "record_id"), "record_id", "left")
    per = known.groupBy("request_id", "record_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("token").isNull()).alias("missing")
    ).groupBy("request_id").agg(F.max("n").alias("most"), F.sum("missing").alias("missing"))
    reason = F.when(is_blank(F.col("context")), "blank_context").when(F.col("most").isNull(), "empty").when(
        F.col("most") > 1, "duplicate_record_id"
    ).when(F.col("missing") > 0, "unknown_record_id")
    rejected = contexts.join(per, "request_id", "left").select("request_id", reason.alias("reason")).where(
        "reason is not null"
    )
    good = contexts.select("request_id").join(rejected, "request_id", "left_anti")
    return known.join(good, "request_id", "left_semi").select(
        "request_id", "ordinal", "record_id", *RECORD, "token"
    ), rejected


#: Rows of a component of conflicts that one task goes through in order; larger ones are settled in rounds.
IN_ORDER = 1_000_000


def _round(undecided: DataFrame, write: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(kept, undecided): rows that are first both for their id and their record are kept, those that share either with
    a kept row are dropped.
    """
    firsts = [
        F.when(F.col(c).isNull(), F.col("ord")).otherwise(F.min("ord").over(Window.partitionBy(c))).alias(f"by_{c}")
        for c in ("id", "record")
    ]
    ranked = write(undecided.select("ord", "id", "record", *firsts))
    kept = ranked.where("ord = by_id AND ord = by_record").select("ord", "id", "record")
    return kept, _without(undecided, kept, write)


def _without(undecided: DataFrame, kept: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that share neither id nor record with a kept row."""
    rest = undecided.join(kept.select("id"), "id", "left_anti")
    return write(rest.join(kept.select("record"), "record", "left_anti").select("ord", "id", "record"))


def _chain_round(undecided: DataFrame, write: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``_round``, which also settles the chains that begin at the rows it keeps, however long they are.

    A row with one earlier row that shares its id or record is kept if that one is not, so along such links each second
    row is; a row with more of them is left.
    """
    earlier = {}
    for c in ("id", "record"):
        order = Window.partitionBy(c, F.when(F.col(c).isNull(), F.col("ord"))).orderBy("ord")
        earlier |= {f"{c}_{n}": F.lag("ord", n).over(order) for n in (1, 2)}
    seen = write(undecided.select("ord", "id", "record", *[of.alias(name) for name, of in earlier.items()]))
    number = sum((F.col(name).isNotNull().cast("int") for name in earlier), F.lit(0))
    links = chain_ends(seen.where(number == 1).select("ord", F.coalesce("id_1", "record_1").alias("to")), "ord", "to")
    firsts = seen.where(number == 0).select("ord", "id", "record")
    even = links.where("NOT odd").join(firsts.select(F.col("ord").alias("end")), "end", "left_semi").select("ord")
    kept = write(firsts.unionByName(seen.join(even, "ord", "left_semi").select("ord", "id", "record")))
    return kept, _without(undecided, kept, write)


def _in_order(key: tuple, rows: pa.Table) -> pa.Table:
    """The rows of one component that a scan in order keeps."""
    rows = rows.sort_by("ord")
    ids, records, kept = set(), set(), []
    for at, (i, r) in enumerate(zip(rows.column("id").to_pylist(), rows.column("record").to_pylist(), strict=True)):
        if i not in ids and r not in records:
            ids |= {i} - {None}
            records.add(r)
            kept.append(at)
    return rows.take(kept).select(["ord"])


def _first_wins(
    rows: DataFrame, write: Callable[[DataFrame], DataFrame], rounds: int = 2, in_order: int = IN_ORDER
) -> DataFrame:
    """Of rows with ``ord`` (a bigint), ``id`` and ``record``, those that a scan in order would keep, if it drops a row
    whose id or record a kept row has.

    Null ids are no conflict. Of rows that agree in both only the first can be kept. ``rounds`` rounds settle all rows whose conflicts are few,
    however often an id or a record is named, and another one chains of any length (``_chain_round``). In what is left
    rows are edges between ids and records, whose connected components, found in a logarithmic number of rounds, don't
    touch each other, so each is scanned in order, side by side, as 64-bit digests of ids and records. A component of
    more than ``in_order`` rows is not one task's work: rounds go on until it is smaller. ``write`` materialises a frame.
    """
    undecided = write(rows.groupBy("id", "record").agg(F.min("ord").alias("ord")).select("ord", "id", "record"))
    kept = None
    while True:
        for turn in [*[_round] * rounds, _chain_round]:
            first, undecided = turn(undecided, write)
            kept = first.select("ord") if kept is None else kept.unionByName(first.select("ord"))
            if undecided.isEmpty():
                return kept
        # Digests may join two components, which does no harm.
        ends = undecided.select(
            "ord", "id", "record", F.xxhash64(F.lit("id"), "id").alias("a"), F.xxhash64(F.lit("record"), "record").alias("b")
        )
        found = components(ends.select("a", "b")).withColumnRenamed("node", "a")
        named = write(ends.join(found, "a").select("ord", "id", "record", "component"))
        sizes = named.groupBy("component").agg((F.count("*") <= in_order).alias("small"))
        sized = write(named.join(sizes, "component"))
        scanned = write(sized.where("small").drop("small").groupBy("component").applyInArrow(_in_order, "ord bigint"))
        kept = kept.unionByName(scanned)
        undecided = sized.where("NOT small").select("ord", "id", "record")
        if undecided.isEmpty():
            return kept


def import_snapshot(
    vault: DataFrame, snapshot: DataFrame, write: Callable[[DataFrame], DataFrame] = written
) -> DataFrame:
    """The rows of ``snapshot`` (ord, id, scope, type, value, token) with ``outcome`` imported or duplicate and the
    ``token`` they get.

    A row is a duplicate if its id or record is in the vault or in a kept row before it; an imported value that is known
    takes the known token, else that of the first kept row. ``ord`` is an integer without repeats. ``write``
    materialises each step, by default as a table in the shared folder, so that none is computed twice.
    """
    record = F.to_json(F.struct(*RECORD), {"ignoreNullFields": "false"})
    seen = snapshot.select(F.col("ord").cast("bigint").alias("ord"), "id", record.alias("record"))
    fresh = seen.join(vault.select("id"), "id", "left_anti").join(
        vault.select(record.alias("record")), "record", "left_anti"
    ).select("ord", "id", "record")
    kept = _first_wins(fresh, write).select(F.col("ord").alias("first"))
    marked = snapshot.join(kept, F.col("ord") == F.col("first"), "left").withColumn(
        "outcome", F.when(F.col("first").isNotNull(), "imported").otherwise("duplicate")
    ).drop("first")
    first_here = marked.where("outcome = 'imported'").groupBy(*IDENTITY).agg(F.min_by("token", "ord").alias("own"))
    return marked.join(_first(vault), IDENTITY, "left").join(first_here, IDENTITY, "left").withColumn(
        "token", F.coalesce("known", "own", "token")
    ).drop("known", "own")


def import_counts(imported: DataFrame) -> DataFrame:
    """One row: imported_records, duplicate_records."""
    return imported.agg(
        F.count_if(F.col("outcome") == "imported").alias("imported_records"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicate_records"),
    )


def inspect_snapshot(snapshot: DataFrame, preview: bool = False) -> DataFrame:
    """The number of records; with ``preview`` their ids, scopes and types, without values or tokens."""
    return snapshot.select("id", *SCOPE, "phi_type") if preview else snapshot.agg(F.count("*").alias("record_count"))


def audit_page(
    events: DataFrame, kind: str | None = None, actor: str | None = None, limit: int = MAX_PAGE, offset: int = 0
) -> DataFrame:
    """A page of events, newest first, each with total_matching_events, has_more and next_offset. ``limit`` is at most
    100; 0 is refused.
    """
    if limit <= 0 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    limit = min(limit, MAX_PAGE)
    chosen = events
    for name, value in (("kind", kind), ("actor", actor)):
        chosen = chosen.where(F.col(name) == value) if value is not None else chosen
    total = chosen.agg(F.count("*").alias("total_matching_events"))
    page = chosen.orderBy(F.col("seq").desc()).offset(offset).limit(limit)
    more = F.col("total_matching_events") > offset + limit
    return page.crossJoin(F.broadcast(total)).withColumns(
        {"has_more": more, "next_offset": F.when(more, F.lit(offset + limit).cast("long"))}
    )


#: Sequence numbers of a stretch of the audit index.
STRETCH = 65_536


def audit_index(events: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(at, kind, actor, n): the events of each stretch of sequence numbers, by kind and actor. Counts of appended events
    can be appended; ``audit_page_at`` adds them up.
    """
    at = F.floor(F.col("seq") / stretch).cast("bigint").alias("at")
    return events.groupBy(at, "kind", "actor").agg(F.count("*").alias("n"))


def audit_page_at(
    events: DataFrame, index: DataFrame, kind: str | None = None, actor: str | None = None, limit: int = MAX_PAGE,
    offset: int = 0, stretch: int = STRETCH,
) -> DataFrame:
    """``audit_page`` by way of an ``audit_index`` with its ``stretch``: the index tells the total, and the stretches
    that the page is in, so that only events of these are read and sorted, however deep the page is.
    """
    if limit <= 0 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    limit = min(limit, MAX_PAGE)

    def chosen(rows: DataFrame) -> DataFrame:
        for name, value in (("kind", kind), ("actor", actor)):
            rows = rows.where(F.col(name) == value) if value is not None else rows
        return rows

    newest = Window.orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)  # a row for each stretch
    counts = chosen(index).groupBy("at").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(newest))
    held = (F.col("upto") > offset) & (F.col("upto") - F.col("n") < offset + limit)
    total, low, high, before = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)),
        F.min(F.when(held, F.col("at"))),
        F.max(F.when(held, F.col("at"))),
        F.min(F.when(held, F.col("upto") - F.col("n"))),
    ).first()
    inside = F.col("seq").between(low * stretch, high * stretch + stretch - 1) if low is not None else F.lit(False)
    rows = chosen(events.where(inside)).orderBy(F.col("seq").desc())
    more = total > offset + limit
    return rows.offset(offset - (before or 0)).limit(limit).withColumns(
        {
            "total_matching_events": F.lit(total).cast("long"),
            "has_more": F.lit(more),
            "next_offset": F.lit(offset + limit if more else None).cast("long"),
        }
    )


def sanitize_audit(events: DataFrame) -> DataFrame:
    """Events with a fixed phrase for each kind in place of the detail."""
    phrase = F.create_map(*[F.lit(x) for pair in SAFE_DETAIL.items() for x in pair])
    return events.withColumn("detail", phrase[F.col("kind")])


def audit_caption(total: Column, offset: Column, returned: Column) -> Column:
    empty = (returned == 0) | (total == 0) | (offset >= total)
    return F.when(empty, F.format_string("Audit events page: showing 0 of %d from offset %d", total, offset)).otherwise(
        F.format_string("Audit events page: showing %d-%d of %d", offset + 1, F.least(offset + returned, total), total)
    )


def decode_summary(values: DataFrame) -> DataFrame:
    """(request_id, decoded_value_count): what may be shown beside the protected values."""
    return values.groupBy("request_id").agg(F.count("*").alias("decoded_value_count"))


def chain(events: DataFrame, by: str = "stream") -> DataFrame:
    """Events with ``hash``, a digest of the event's fields and of those of the event before it, by stream and seq.

    A change, a loss or a swap shows at the place where it was made, and each event is checked with its neighbour alone.
    What must bind the whole history, its end included, is sealed (``ledger.seal``).
    """
    own = F.sha2(
        F.concat_ws(
            "\x1f", F.col("seq").cast("string"), "id", "kind", "actor", "detail", F.col("recorded_at").cast("string")
        ),
        256,
    )
    order = Window.partitionBy(by).orderBy("seq")
    name = fresh(events.columns, "own")
    return events.withColumn(name, own).withColumn(
        "hash", F.sha2(F.concat_ws("\x1f", F.lag(name, 1, "").over(order), F.col(name)), 256)
    ).drop(name)


def verify_chain(events: DataFrame, by: str = "stream") -> DataFrame:
    """The events whose stored ``hash`` is not the one that their fields and the event before them give."""
    stored = fresh(events.columns, "stored")
    again = chain(events.withColumnRenamed("hash", stored), by)
    return again.where(~F.col("hash").eqNullSafe(F.col(stored))).drop("hash").withColumnRenamed(stored, "hash")
