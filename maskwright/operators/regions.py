"""Image regions: ``images`` has image_id, width, height; ``regions`` image_id, x, y, w, h; pixel runs image_id, y, x0,
x1 (exclusive) and a colour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh

MAX_REGIONS = 4096
MAX_PIXELS = 16_000_000


def parse_regions(df: DataFrame, json_col: str, id_col: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """(regions, rejected) from JSON arrays of {x, y, width, height}. Rejected have the index of the bad entry, null for
    the whole, and a reason.
    """
    raw = df.select(
        id_col, F.from_json(json_col, "array<struct<x:string,y:string,width:string,height:string>>").alias("r")
    )
    whole = raw.where(F.col("r").isNull() | (F.size("r") == 0)).select(
        id_col, F.lit(None).cast("int").alias("index"), F.lit("not_a_filled_array").alias("reason")
    )
    entry = raw.select(id_col, F.posexplode("r").alias("index", "e"))
    number = lambda n: F.when(F.col(f"e.{n}").rlike("^-?[0-9]+$"), F.col(f"e.{n}").try_cast("bigint"))
    rows = entry.select(
        id_col,
        "index",
        number("x").alias("x"),
        number("y").alias("y"),
        number("width").alias("w"),
        number("height").alias("h"),
    )
    good = F.coalesce((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("w") > 0) & (F.col("h") > 0), F.lit(False))
    return rows.where(good).drop("index"), whole.unionByName(
        rows.where(~good).select(id_col, "index", F.lit("bad_region").alias("reason"))
    )


def validate_regions(
    images: DataFrame, regions: DataFrame, max_regions: int = MAX_REGIONS, max_pixels: int = MAX_PIXELS
) -> DataFrame:
    """(image_id, reason) for each image: null if its regions can be redacted."""
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("w") <= F.col("width")) & (
        F.col("y") + F.col("h") <= F.col("height")
    )
    filled = (F.col("w") > 0) & (F.col("h") > 0)
    joined = images.join(regions, "image_id", "left")
    seen = joined.groupBy("image_id", "width", "height").agg(
        F.count("x").alias("n"),
        F.count_if(F.col("x").isNotNull() & ~filled).alias("hollow"),
        F.count_if(F.col("x").isNotNull() & ~inside).alias("out"),
    )
    reason = F.when(
        F.col("width") * F.col("height") > max_pixels, "too_many_pixels"
    ).when(F.col("n") == 0, "no_regions").when(F.col("n") > max_regions, "too_many_regions").when(F.col("hollow") > 0, "empty_region").when(F.col("out") > 0, "out_of_bounds")
    return seen.select("image_id", reason.alias("reason"))


#: Rows of a part that images are dealt in. Parts hold few bytes for their rows, so by size alone too many would meet.
PART = 250_000


def _parts(rows: DataFrame, times: int = 1) -> int:
    """The number of parts that ``times`` as many rows are dealt in by image: a task has no more rows if there are more
    in all.
    """
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * times // PART))


def covered_slabs(regions: DataFrame) -> DataFrame:
    """(image_id, y0, y1, x0, x1): disjoint rectangles that regions cover. The lines of an image are cut at the upper and
    lower edges of its regions; between two such edges, in a slab, all lines are alike, so a region gives a row for each
    slab that it crosses, however high the slabs are.
    """
    # Repeated regions are one. They are dealt by image once, and what follows stays where they are.
    filled = regions.where((F.col("w") > 0) & (F.col("h") > 0)).select(
        "image_id", "y", (F.col("y") + F.col("h")).alias("below"), F.col("x").alias("x0"),
        (F.col("x") + F.col("w")).alias("x1"),
    ).repartition(_parts(regions), "image_id").distinct()
    edges = filled.select("image_id", F.explode(F.array("y", "below")).alias("y0")).distinct()
    slabs = edges.withColumn("y1", F.lead("y0").over(Window.partitionBy("image_id").orderBy("y0")))
    inside = (F.col("y0") >= F.col("y")) & (F.col("y0") < F.col("below"))
    crossed = filled.join(slabs, "image_id").where(inside).select("image_id", "y0", "y1", "x0", "x1").distinct()
    slab = Window.partitionBy("image_id", "y0", "y1").orderBy("x0", "x1")
    reach = F.max("x1").over(slab.rowsBetween(Window.unboundedPreceding, -1))
    marked = crossed.withColumn("fresh", F.coalesce(F.col("x0") > reach, F.lit(True)).cast("int"))
    grouped = marked.withColumn("run", F.sum("fresh").over(slab.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("image_id", "y0", "y1", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("run")


def covered_runs(regions: DataFrame) -> DataFrame:
    """(image_id, y, x0, x1): for each line of an image the disjoint runs that regions cover, for what is known by line.
    """
    lines = F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y")
    return covered_slabs(regions).select("image_id", lines, "x0", "x1")


def covered_pixels(regions: DataFrame) -> DataFrame:
    """(image_id, covered): pixels that at least one region covers."""
    area = (F.col("x1") - F.col("x0")).cast("long") * (F.col("y1") - F.col("y0"))
    return covered_slabs(regions).groupBy("image_id").agg(F.sum(area).alias("covered"))


def redaction_summary(images: DataFrame, regions: DataFrame) -> DataFrame:
    """(image_id, redacted_regions, redacted_pixels, unchanged_pixels)."""
    n = regions.groupBy("image_id").agg(F.count("*").alias("redacted_regions"))
    dealt = images.repartition(max(_parts(regions), _parts(images)), "image_id")
    counted = dealt.join(n, "image_id", "left").join(covered_pixels(regions), "image_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return counted.select(
        "image_id",
        zero("redacted_regions").alias("redacted_regions"),
        zero("covered").alias("redacted_pixels"),
        (F.col("width").cast("long") * F.col("height") - zero("covered")).alias("unchanged_pixels"),
    )


def verify_redaction(before: DataFrame, after: DataFrame, regions: DataFrame, fill: int) -> DataFrame:
    """(image_id, verified): every covered pixel has the fill colour and every other one its colour from before.

    ``before`` and ``after`` are runs (image_id, y, x0, x1, colour) that tile each line. Runs of a line are cut at each
    other's ends, and at those of the covered runs, by one window over all boundaries of that line; a piece where either
    side is missing fails. Runs are dealt by image once, and their boundaries, the sums by place, the windows by line
    and the verdicts stay where they are.
    """
    none = F.lit(None).cast("long")
    sides = [
        frame.select("image_id", "y", "x0", "x1", F.lit(side).alias("side"), colour.alias("colour"))
        for frame, side, colour in (
            (before, "before", F.col("colour").cast("long")),
            (after, "after", F.col("colour").cast("long")),
            (covered_runs(regions), "cover", none),
        )
    ]
    runs = sides[0].unionByName(sides[1]).unionByName(sides[2]).repartition(_parts(before, 2), "image_id")
    opens = F.struct(F.col("x0").alias("x"), F.col("colour").alias("colour"), F.lit(1).alias("open"))
    shuts = F.struct(F.col("x1").alias("x"), F.col("colour").alias("colour"), F.lit(-1).alias("open"))
    ends = runs.select("image_id", "y", "side", F.explode(F.array(opens, shuts)).alias("e")).select(
        "image_id", "y", "side", "e.*"
    )
    names = ["before", "after", "cover"]
    is_open = F.col("open") == 1
    events = ends.groupBy("image_id", "y", "x").agg(
        *[F.sum(F.when(F.col("side") == s, F.col("open")).otherwise(0)).alias(s) for s in names],
        *[F.max(F.when((F.col("side") == s) & is_open, F.col("colour"))).alias(f"{s}_colour") for s in names[:2]],
    )
    line = Window.partitionBy("image_id", "y").orderBy("x")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    pieces = events.select(
        "image_id",
        *[F.sum(s).over(so_far).alias(s) for s in names],
        *[F.last(f"{s}_colour", ignorenulls=True).over(so_far).alias(f"{s}_colour") for s in names[:2]],
        F.lead("x").over(line).alias("next"),
    ).where("next is not null")
    same = F.when(F.col("cover") > 0, F.col("after_colour") == fill).otherwise(
        F.col("after_colour") == F.col("before_colour")
    )
    right = same & (F.col("before") == 1) & (F.col("after") == 1)
    return pieces.groupBy("image_id").agg(F.bool_and(F.coalesce(right, F.lit(False))).alias("verified"))


def redaction_batch(manifest: DataFrame, images: DataFrame, regions: DataFrame) -> DataFrame:
    """Per manifest row (item_index, image_id, input_path, output_path): status redacted or failed, a code, and the
    redacted pixels. One failure does not stop the others.
    """
    mark = fresh([*manifest.columns, "reason", "covered"], "known")
    known = images.select("image_id", F.lit(True).alias(mark))
    checked = manifest.join(validate_regions(images, regions), "image_id", "left").join(known, "image_id", "left")
    checked = checked.join(covered_pixels(regions), "image_id", "left")
    same = F.col("input_path") == F.col("output_path")
    code = F.when(F.col(mark).isNull(), "missing_image").when(same, "output_is_input").otherwise(F.col("reason"))
    status = F.when(code.isNull(), "redacted").otherwise("failed")
    pixels = F.when(code.isNull(), F.col("covered")).otherwise(0).cast("long")
    return checked.select(
        "item_index", "image_id", status.alias("status"), code.alias("code"), pixels.alias("redacted_pixels")
    )


def batch_totals(items: DataFrame) -> DataFrame:
    """One row over a batch's items (status): total_item_count, succeeded_item_count, failed_item_count."""
    return items.agg(
        F.count("*").alias("total_item_count"),
        F.count_if(F.col("status") == "redacted").alias("succeeded_item_count"),
        F.count_if(F.col("status") == "failed").alias("failed_item_count"),
    )
