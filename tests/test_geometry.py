from pyspark.sql import functions as F

from maskwright.functions import scalars as S
from maskwright.operators import geometry as G

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_frames_match_only_without_rivals(spark):
    rasters = spark.createDataFrame([(1, 7, "iframe", "https://p.example/a", (100.0, 300.0, 500.0, 500.0)), (1, 8, "iframe", "https://q.example", (0.0, 0.0, 50.0, 50.0)), (1, 9, "iframe", "https://q.example", (0.0, 60.0, 50.0, 110.0)), (1, 10, "img", "https://p.example", (0.0, 0.0, 400.0, 200.0))], f"snapshot_id int, vid int, kind string, src string, inner {BOX}")
    frames = spark.createDataFrame([(1, 21, "https://P.example:443/b", 401, 199), (1, 22, "https://q.example/x", 50, 50), (1, 23, "about:blank", 50, 50)], "snapshot_id int, frame_id int, url string, w int, h int")
    matched = G.match_frames(rasters, frames)
    assert [(r.frame_id, r.vid) for r in matched.collect()] == [(21, 7)]
    items = spark.createDataFrame([(1, 1, "element", (0.0, 0.0, 1.0, 1.0), 1), (1, 7, "raster", (100.0, 300.0, 500.0, 500.0), 2)], f"snapshot_id int, vid int, kind string, bbox {BOX}, ord int")
    kids = spark.createDataFrame([(1, 21, 1, "element", (12.0, 12.0, 212.0, 42.0), 1), (1, 21, 2, "text", (0.0, 0.0, 5.0, 5.0), 1)], f"snapshot_id int, frame_id int, vid int, kind string, bbox {BOX}, ord int")
    got = {r.vid: (tuple(r.bbox), r.frame_id, r.child_vid, r.origin) for r in G.merge_frames(items, matched, kids).collect()}
    assert got == {1: ((0, 0, 1, 1), None, None, None), 8: ((112, 312, 312, 342), 21, 1, "https://p.example"), 9: ((100, 300, 105, 305), None, None, None)}


def test_left_label_is_the_nearest(spark):
    rows = [("i", 0, "Name", (0.0, 0.0, 40.0, 20.0)), ("i", 1, "Dateof birth", (50.0, 2.0, 90.0, 22.0)), ("i", 2, "12-08-1999", (91.0, 1.0, 200.0, 21.0)), ("i", 3, "below", (0.0, 100.0, 50.0, 300.0)), ("j", 0, "alone", (500.0, 0.0, 600.0, 20.0))]
    got = G.left_labels(spark.createDataFrame(rows, f"image_id string, line int, text string, bbox {BOX}")).select("image_id", "line", "label", G.left_label_class(F.col("label")).alias("c"))
    assert {(r.image_id, r.line): (r.label, r.c) for r in got.collect()} == {("i", 0): (None, None), ("i", 1): ("Name", "NAME"), ("i", 2): ("Dateof birth", "DOB"), ("i", 3): (None, None), ("j", 0): (None, None)}


def test_missing_or_failed_vision_fails_closed(spark):
    rasters = spark.createDataFrame([(1, v, "img", alt, (0.0, 0.0, float(v), 1.5)) for v, alt in ((1, "x"), (2, "x"), (3, "x"), (4, "My avatar"), (5, None))], f"snapshot_id int, vid int, kind string, alt string, bbox {BOX}")
    vision = spark.createDataFrame([(1, "0,0,1,1.5", True), (1, "0,0,2,1.5", False), (1, "0,0,4,1.5", True), (1, "0,0,5,1.5", None)], "snapshot_id int, key string, ok boolean")
    assert {r.vid: (r.whole, r.hint) for r in G.raster_vision(rasters, vision).collect()} == {1: (False, None), 2: (True, None), 3: (True, None), 4: (True, "FACE"), 5: (True, None)}


def test_largest_rasters_are_analysed(spark):
    rasters = spark.createDataFrame([(1, v, (0.0, 0.0, float(v), 1.0)) for v in range(1, 9)], f"snapshot_id int, vid int, bbox {BOX}")
    assert sorted(r.vid for r in G.vision_candidates(rasters).where("analysed").collect()) == [3, 4, 5, 6, 7, 8]


def test_suppression_and_boxes(spark):
    boxes = F.array(*[F.struct(S.box(*b).alias("box"), F.lit(s).alias("score")) for b, s in (((0, 0, 10, 10), 0.7), ((1, 1, 11, 11), 0.9), ((50, 50, 60, 60), 0.8))])
    got = spark.range(1).select(G.suppressed(boxes).alias("v")).first().v
    assert [x.score for x in got] == [0.9, 0.8]
    m = spark.range(1).select(S.mask_box(S.box(10, 10, 80, 24), F.lit("⟦NAME_1⟧"), F.lit(False), F.lit(2.0)).alias("m")).first().m
    assert (m.x, m.y, m.w, m.h, m.label) == (14, 14, 160, 40, "NAME_1")


def test_previous_label(spark):
    rows = spark.createDataFrame([(1, 1, "Full name"), (1, 2, "Ananya Rao"), (1, 3, "x" * 130), (2, 1, "Ravi")], "parent int, ord int, text string")
    assert {(r.parent, r.ord): r.context_class for r in G.previous_label_class(rows, ["parent"], "ord").collect()} == {(1, 1): None, (1, 2): "NAME", (1, 3): None, (2, 1): None}


def test_actions_are_routed_to_their_frames(spark):
    merged = spark.createDataFrame([(1, 1, "element", None, None, None), (1, 8, "element", 21, 1, "https://p.example"), (1, 9, "text", 21, 2, "https://p.example")], "snapshot_id int, vid int, kind string, frame_id int, child_vid int, origin string")
    actions = spark.createDataFrame([(1, 8, "click"), (1, 1, "click"), (1, None, "done"), (2, 8, "click")], "snapshot_id int, target int, type string")
    got = {(r.snapshot_id, r.target): (r.frame_id, r.child_vid, r.origin) for r in G.routed(actions, merged).collect()}
    assert got == {(1, 8): (21, 1, "https://p.example"), (1, 1): (None,) * 3, (1, None): (None,) * 3, (2, 8): (None,) * 3}


def test_vision_totals_name_the_first_failure(spark):
    rows = spark.createDataFrame([("s", "a", True, 2, None), ("s", "c", False, 1, "late"), ("s", "b", None, 1, "early")], "snapshot_id string, key string, ok boolean, n int, error string")
    v = rows.select("snapshot_id", "key", "ok", *[F.array_repeat(F.lit(1), F.col("n")).alias(c) for c in ("faces", "codes", "lines")], "error")
    r = G.vision_summary(v).first()
    assert (r.images, r.faces, r.whole, r.error) == (1, 2, 2, "early")
