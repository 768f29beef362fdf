"""Queries whose rows are few bytes and long work: in many tasks, and their kernels against plain ones."""

import numpy as np
import pytest

import __spark_entry__ as entry
from maskwright import screen_queries
from maskwright.operators import names, vision
from maskwright.sources import dom


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """A table of one file with one group of rows, which is read by one task."""
    at = str(tmp_path_factory.mktemp("customers"))
    spark.range(0, 40, 1, 1).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "'MACHINERY' AS c_mktsegment").write.parquet(f"{at}/customer.parquet")
    return at


def tasks_with_rows(df) -> int:
    return sum(n > 0 for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


def plain_parts(mask):
    """Components by filling from each pixel, in reading order."""
    out, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if not out[y, x]:
            n, left = n + 1, [(y, x)]
            while left:
                a, b = left.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                    out[a, b] = n
                    left += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return out


def test_text_regions(spark, customers):
    assert tasks_with_rows(entry.queries()["text_regions"](spark, customers)) > 1
    r = np.random.default_rng(1)
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        mask = r.random((19, 23)) < share
        assert (vision.labelled(mask) == plain_parts(mask)).all()


def plain_runs(dark):
    out = []
    for y, row in enumerate(dark.tolist()):
        cut = [0, *[i for i in range(1, len(row)) if row[i] != row[i - 1]], len(row)]
        for at in range(len(cut) - 5):
            five = [b - a for a, b in zip(cut[at : at + 5], cut[at + 1 : at + 6], strict=True)]
            m = sum(five) / 7
            if row[cut[at]] and sum(five) >= 7 and all(abs(f - k * m) < k * m * 0.6 for f, k in zip(five, (1, 1, 3, 1, 1), strict=True)):
                out.append((y, cut[at + 2] + five[2] / 2, m))
    return out


def test_code_regions(spark, customers):
    assert tasks_with_rows(entry.queries()["code_regions"](spark, customers)) > 1
    r = np.random.default_rng(2)
    dark = np.kron((r.random((30, 60)) < 0.5).astype(np.int8), np.ones((2, 2), np.int8))
    assert plain_runs(dark) == vision.finder_runs(dark) != []
    assert vision.finder_runs(np.zeros((1, 3), np.int8)) == []


def test_found_names(spark, customers):
    assert tasks_with_rows(entry.queries()["found_names"](spark, customers)) > 1
    seen = {}
    assert names.pieces("Asha Asha x.", {"[UNK]": 0, "As": 1, "##ha": 2, ".": 3}, seen) == names.pieces("Asha Asha x.", {"[UNK]": 0, "As": 1, "##ha": 2, ".": 3})
    assert set(seen) == {"Asha", "x", "."}


def test_analysed_images(spark, customers):
    images = entry.queries()["analysed_images"](spark, customers)
    assert tasks_with_rows(images) > 1 and "RoundRobin" not in images._jdf.queryExecution().toString()
    r = np.random.default_rng(3)
    img = r.integers(0, 256, (40, 70, 4)).astype(np.uint8)
    x, _ = vision.face_input(img)
    again, _ = vision.face_input(img[:, :30], vision.face_input(np.full((9, 9, 4), 200, np.uint8))[0])  # written over
    assert (again == vision.face_input(img[:, :30].copy())[0]).all() and not (again == x).all()
    assert (vision.resize(np.full((3, 5, 4), 77, np.uint8), 11, 9) == 77).all()


def test_screens(spark, customers):
    assert tasks_with_rows(screen_queries._screens(spark, customers)[0]) > 1


def test_scan_texts(spark, customers):
    assert tasks_with_rows(entry.queries()["scan_texts"](spark, customers)) > 1
    page = "<p>Mobile</p><p>9876543210</p><p>x</p><p>9876543210</p><p>Full name</p><p>Asha</p><p>Plan</p><p>Asha</p><title>a&lt</title><P >b</P ><script><p>c</p></script>"
    row = dom.scan_pages(spark.createDataFrame([(1, page)], "page_id int, html string")).first()
    assert row.asDict().keys() == {"page_id", "title", "elements", "texts", "rasters"} and row.title == "a<"
    assert [(t.vid, t.text, [(s.cls, s.value) for s in t.spans]) for t in row.texts] == [
        (1, "Mobile", []), (2, "9876543210", [("PHONE", "9876543210")]), (3, "x", []), (4, "9876543210", [("PHONE", "9876543210")]), (5, "Full name", []), (6, "Asha", [("NAME", "Asha")]), (7, "Plan", []), (8, "Asha", []), (9, "b", []),
    ]
