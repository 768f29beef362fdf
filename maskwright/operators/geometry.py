"""Joins of boxes to boxes: frames to their elements, labels to values, vision results to images; merging frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import scalars as S


def match_frames(rasters: DataFrame, frames: DataFrame, tolerance: int = 2) -> DataFrame:
    """snapshot_id, frame_id, vid of each frame and iframe of one origin and size that have no other candidate.

    rasters: snapshot_id, vid, kind, src, inner (box); frames: snapshot_id, frame_id, url, w, h. Snapshot and origin
    are equi-keys, so sizes are compared only within them.
    """
    r = rasters.where((F.col("kind") == "iframe") & F.col("inner").isNotNull()).withColumn("origin", S.origin_of(F.col("src")))
    f = frames.withColumn("origin", S.origin_of(F.col("url")))
    fits = r.join(f, ["snapshot_id", "origin"]).where((F.abs(F.col("inner.x1") - F.col("inner.x0") - F.col("w")) <= tolerance) & (F.abs(F.col("inner.y1") - F.col("inner.y0") - F.col("h")) <= tolerance))
    alone = lambda *key: F.count(F.lit(1)).over(Window.partitionBy("snapshot_id", *key))
    return fits.withColumn("nf", alone("frame_id")).withColumn("nr", alone("vid")).where("nf = 1 and nr = 1").select("snapshot_id", "frame_id", "vid", "origin", "inner")


def merge_frames(items: DataFrame, matched: DataFrame, child_items: DataFrame) -> DataFrame:
    """Items of snapshots with those of their matched child frames at page coordinates.

    items: snapshot_id, vid, kind (element, raster, text), bbox, ord; child_items: snapshot_id, frame_id and the same.
    Matched iframes go; children get ids after the greatest of their snapshot, frame by frame, elements, texts, then
    rasters, and the route (frame_id, child_vid, origin) that leads back to them.
    """
    top = items.groupBy("snapshot_id").agg(F.max("vid").alias("top"))
    gone = matched.select("snapshot_id", "vid", F.lit("raster").alias("kind"))
    own = items.join(gone, ["snapshot_id", "vid", "kind"], "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    own = own.select("snapshot_id", "vid", "kind", "bbox", none("int").alias("frame_id"), none("int").alias("child_vid"), none("string").alias("origin"))
    rank = F.when(F.col("kind") == "element", 0).when(F.col("kind") == "text", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("frame_id", rank, "ord", "vid"))
    kids = child_items.join(matched.select("snapshot_id", "frame_id", "origin", "inner"), ["snapshot_id", "frame_id"]).withColumn("place", place).join(top, "snapshot_id")
    routed = lambda c: F.when(F.col("kind") == "element", F.col(c))
    kids = kids.select(
        "snapshot_id", (F.col("top") + F.col("place")).cast("int").alias("vid"), "kind", S.shifted(F.col("bbox"), F.col("inner.x0"), F.col("inner.y0")).alias("bbox"),
        routed("frame_id").alias("frame_id"), routed("vid").alias("child_vid"), routed("origin").alias("origin"),
    )
    return own.unionByName(kids)


def routed(actions: DataFrame, merged: DataFrame) -> DataFrame:
    """actions (snapshot_id, target) with frame_id, child_vid and origin of the frame that the target's element came from;
    null where it is an element of the page itself, or there is no target."""
    routes = merged.where((F.col("kind") == "element") & F.col("frame_id").isNotNull()).select("snapshot_id", F.col("vid").alias("target"), "frame_id", "child_vid", "origin")
    return actions.join(routes, ["snapshot_id", "target"], "left")


def left_labels(lines: DataFrame) -> DataFrame:
    """lines (image_id, line, text, bbox) with `label`: the text of the nearest line to the left in the same row.

    The label ends at most two pixels into the line, and their middles differ by less than half the line's height; the
    one that ends furthest right counts, the first in reading order among equals. Rows of an image are banded by half
    of its tallest line, so lines meet only those of near bands.
    """
    mid = (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    tall = lines.groupBy("image_id").agg(F.greatest(F.max(F.col("bbox.y1") - F.col("bbox.y0")) / 2, F.lit(1.0)).alias("band_h"))
    banded = lines.withColumn("mid", mid).join(tall, "image_id").withColumn("band", F.floor(F.col("mid") / F.col("band_h")))
    value = banded.select("image_id", "line", "bbox", "mid", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    label = banded.select("image_id", "band", F.col("line").alias("l"), F.col("text").alias("label"), F.col("bbox").alias("lb"), F.col("mid").alias("lmid"))
    near = value.join(label, ["image_id", "band"]).where((F.col("line") != F.col("l")) & (F.col("lb.x1") <= F.col("bbox.x0") + 2) & (F.abs(F.col("lmid") - F.col("mid")) < (F.col("bbox.y1") - F.col("bbox.y0")) / 2))
    best = near.groupBy("image_id", "line").agg(F.max_by("label", F.struct(F.col("lb.x1").alias("x"), (-F.col("l")).alias("o"))).alias("label"))
    return lines.join(best, ["image_id", "line"], "left")


def left_label_class(label: Column) -> Column:
    """Class of a value by the label to its left, which has 40 characters at most."""
    return F.when(F.length(label) <= 40, S.class_from_ocr_label(label))


def previous_label_class(blocks: DataFrame, parent: list[str], order: str) -> DataFrame:
    """Text blocks with the class that the block before them under the same parent tells, as `context_class`."""
    before = F.lag("text").over(Window.partitionBy(*parent).orderBy(order))
    shown = S.collapse(before)
    fine = (F.length(shown) <= 40) & (F.length(S.strip(F.col("text"))) <= 120)
    if "is_label" in blocks.columns:
        fine = fine & ~F.coalesce("is_label", F.lit(False))
    return blocks.withColumn("context_class", F.when(fine, S.class_from_context(shown)))


def raster_key(b: Column) -> Column:
    part = lambda v: F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))
    return F.concat_ws(",", *[part(b[n]) for n in ("x0", "y0", "x1", "y1")])


def raster_vision(rasters: DataFrame, vision: DataFrame) -> DataFrame:
    """rasters (snapshot_id, vid, kind, alt, bbox) with what vision (snapshot_id, key, ok, faces, codes, lines) saw.

    `whole`: the image is masked as a whole, since its result is missing or failed, or it says what it shows.
    """
    seen = rasters.withColumn("key", raster_key(F.col("bbox"))).join(vision, ["snapshot_id", "key"], "left")
    hint = S.image_hint(F.coalesce("alt", F.lit("")))
    return seen.withColumn("hint", hint).withColumn("whole", ~F.coalesce("ok", F.lit(False)) | hint.isNotNull())


def vision_candidates(rasters: DataFrame, most: int = X.MAX_RASTERS) -> DataFrame:
    """The largest rasters of each snapshot, first in page order among equals; the others fail closed."""
    place = F.row_number().over(Window.partitionBy("snapshot_id").orderBy(S.box_area(F.col("bbox")).desc(), "vid"))
    return rasters.withColumn("place", place).withColumn("analysed", F.col("place") <= most).drop("place")


def vision_summary(vision: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.when(F.col("ok"), F.size(c)).otherwise(0)).cast("long")
    return vision.groupBy("snapshot_id").agg(
        F.count_if("ok").alias("images"), n("faces").alias("faces"), n("codes").alias("codes"), n("lines").alias("lines"),
        F.count_if(~F.coalesce("ok", F.lit(False))).alias("whole"), F.min_by(F.col("error"), F.when(~F.coalesce("ok", F.lit(False)), F.col("key"))).alias("error"),
    )


def suppressed(boxes: Column, threshold: float = 0.3) -> Column:
    """Greedy non-maximum suppression of array<struct(box, score)>: best first, without those that overlap a kept one."""
    ordered = F.array_sort(boxes, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0))
    empty = F.slice(ordered, 1, 0)
    return F.aggregate(ordered, empty, lambda acc, x: F.when(F.exists(acc, lambda k: S.iou(k["box"], x["box"]) >= threshold), acc).otherwise(F.concat(acc, F.array(x))))
