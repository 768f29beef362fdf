"""Queries over pages, screens, boxes, images and names, made from the rows of the supplied tables; with SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import fixed as X
from .functions import scalars as S
from .operators import detect as D
from .operators import geometry, names, timing, vision
from .operators.ranking import durable, shared_folder, spread
from .operators.sanitize import sanitize
from .queries import _read, _sql_rules, query
from .sources import dom, images, synth, wire
from .sources.png import encode_png


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _padded(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


# --- scanning ---


@query("""WITH c AS (SELECT *, CAST(c_custkey AS VARCHAR) AS k FROM customer)
SELECT c_custkey, vid, role, label, value, has_value, cls FROM c, LATERAL (VALUES
 (1, 'textbox', 'Full name', c_name, true, 'NAME'), (2, 'textbox', 'Card number', k, true, 'CARD'), (3, 'password', 'PIN', '', true, 'SECRET'), (4, 'combobox', 'Segment', c_mktsegment, true, NULL),
 (5, 'textbox', 'Notes', left(repeat(k || ' ', 300), 500), true, NULL), (6, 'button', 'Go on ' || c_mktsegment, '', false, NULL), (7, 'link', 'Home', '', false, NULL), (8, 'checkbox', 'agree', '', false, NULL),
 (9, 'textbox', '', c_name, true, NULL)) t(vid, role, label, value, has_value, cls) WHERE vid < 9 OR c_custkey % 3 > 0""")
def scan_elements(spark, sf_dir):
    """Elements of a form for each customer, some of them hidden."""
    k, name, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    html = _text(
        '<form><label for="n">Full name</label><input id="n" value="', name, '"><div><span>Card \n number</span><input name="c" value="', k, '"></div><input type="password" aria-label="PIN" value="p', k,
        '"><div hidden><button>No</button></div><input style="display: none" value="x"><input type=hidden name=h value=y><select title="Segment"><option>none</option><option selected>', seg, '</option></select><textarea placeholder="Notes">',
        F.repeat(_text(k, " "), F.lit(300)), "</textarea><button>Go <b>on ", seg, '</b></button><a href="/x"><img alt="Home"></a><input type="checkbox" name="agree" checked><div role="textbox" contenteditable',
        F.when(k % 3 == 0, F.lit(' style="visibility:hidden"')).otherwise(F.lit("")), ">", name, "</div></form>",
    )
    e = dom.scan_pages(_read(spark, sf_dir, "customer").select("c_custkey", html.alias("html")), "c_custkey").select("c_custkey", F.explode("elements").alias("e"))
    cls = S.field_class(*[F.col(f"e.{c}") for c in ("type", "autocomplete", "label", "name", "idAttr", "placeholder")])
    return e.select("c_custkey", "e.vid", "e.role", "e.label", "e.value", F.col("e.hasValue").alias("has_value"), cls.alias("cls"))


@query("""SELECT c_custkey, least(400, 5 + c_custkey % 3 * 210) AS n_texts, 'NAME ' || c_name || ',EMAIL user' || c_custkey || '@mail.example,PHONE +91 98' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ' 12345' AS spans FROM customer""")
def scan_texts(spark, sf_dir):
    """Text blocks of a page for each customer: those of scripts are none, 400 at most; with their spans."""
    k = F.col("c_custkey")
    html = _text(
        "<div>Name</div><div>", F.col("c_name"), "</div><p>Write to <b>now</b> user", k, "@mail.example or call +91 98", _padded(k % 1000, 3), " 12345</p><script>4111 1111 1111 1111</script><style>x</style><h2>Total 5</h2>",
        F.repeat(F.lit("<li>item</li>"), (k % 3 * 210).cast("int")),
    )
    s = dom.scan_pages(spread(_read(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", html.alias("html")), "c_custkey")
    spans = F.flatten(F.transform("texts", lambda t: F.transform(t["spans"], lambda x: F.concat_ws(" ", x["cls"], x["value"]))))
    return s.select("c_custkey", F.size("texts").alias("n_texts"), F.array_join(spans, ",").alias("spans"))


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY o) AS vid, kind, alt, src, w FROM (SELECT p_partkey, 1 AS o, 'img' AS kind, 'Picture ' || p_name AS alt, NULL AS src, CAST(p_size * 4 AS DOUBLE) AS w FROM part WHERE p_size * 4 >= 48
 UNION ALL SELECT p_partkey, 2, 'svg', 'Chart', NULL, 120.0 FROM part UNION ALL SELECT p_partkey, 3, 'iframe', 'Pay', 'https://a.example/' || p_partkey, NULL FROM part)""")
def scan_rasters(spark, sf_dir):
    """Images of a page for each part: large enough ones that are shown, no drawing within a drawing."""
    html = _text(
        '<img width="', F.col("p_size") * 4, '" height="60" alt="Picture ', F.col("p_name"), '"><svg width="90" height="200"></svg><svg width="120" height="120" aria-label="Chart"><svg width="200" height="200"></svg></svg><iframe title="Pay" src="https://a.example/',
        F.col("p_partkey"), '"></iframe><div style="opacity:0"><video></video></div><canvas width="47" height="300"></canvas>',
    )
    s = dom.scan_pages(_read(spark, sf_dir, "part").select("p_partkey", html.alias("html")), "p_partkey").select("p_partkey", F.explode("rasters").alias("r"))
    return s.select("p_partkey", F.col("r.vid").cast("long").alias("vid"), "r.kind", "r.alt", "r.src", F.get("r.bbox", F.lit(2)).alias("w"))


_BLOCKS = ["Full name", "Mobile", "Notes", "Date of birth", "x" * 130, "PAN"]


@query(f"""WITH b AS (SELECT l_orderkey, l_linenumber, [{", ".join(f"'{x}'" for x in _BLOCKS)}][CAST(min(l_partkey) % 6 + 1 AS BIGINT)] AS text FROM lineitem GROUP BY ALL),
p AS (SELECT *, lag(text) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN length(before) <= 40 AND length(text) <= 120 THEN {_sql_rules("lower(before)", X.CONTEXT_RULES)} END AS context_class FROM p""")
def previous_labels(spark, sf_dir):
    """What the text block before tells of a text block, in blocks of an order's lines."""
    text = F.element_at(F.array(*map(F.lit, _BLOCKS)), (F.min("l_partkey") % 6 + 1).cast("int"))
    blocks = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(text.alias("text"))
    return geometry.previous_label_class(blocks, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "context_class")


# --- sanitizing ---


def _screens(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A snapshot for each customer, and no result of vision."""
    k, name = F.col("c_custkey"), F.col("c_name")
    kinds = {"vid": "int", "hasValue": "boolean", "required": "boolean", "disabled": "boolean", "checked": "boolean", "options": "array<string>", "bbox": "array<double>", "valueBox": "array<double>"}
    columns = ["vid", "role", "tag", "type", "label", "value", "hasValue", "placeholder", "name", "idAttr", "autocomplete", "required", "disabled", "checked", "options", "bbox", "valueBox"]

    def element(**given) -> Column:
        empty = {c: F.lit("") for c in ("tag", "type", "value", "placeholder", "name", "idAttr", "autocomplete")}
        box = F.array(F.lit(10.0), (F.lit(10.0) * given["vid"]), F.lit(90.0), F.lit(10.0) * given["vid"] + 8)
        all_ = empty | {"hasValue": F.lit("value" in given), "required": F.lit(False), "disabled": F.lit(False), "bbox": box, "valueBox": box} | {n: v if isinstance(v, Column) else F.lit(v) for n, v in given.items()}
        return F.struct(*[all_.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in columns])

    elements = F.array(
        element(vid=1, role="textbox", label="Full name", value=name), element(vid=2, role="textbox", label="Email", value=_text("u", k, "@mail.example")), element(vid=3, role="password", type="password", label="PIN", hasValue=True),
        element(vid=4, role="textbox", label="Notes", value=_text("call +91 98", _padded(k % 1000, 3), " 12345 after 5")), element(vid=5, role="combobox", label="Segment", options=F.array(name, F.col("c_mktsegment"))), element(vid=6, role="button", label="Continue"),
    )
    text = lambda vid, t: F.struct(F.lit(vid).alias("vid"), t.alias("text"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("bbox"), D.block_spans(t, F.lit(None).cast("string")).alias("spans"))
    raster = F.struct(F.lit(9).alias("vid"), F.lit("img").alias("kind"), _text("Photo of ", name).alias("alt"), F.array(F.lit(200.0), F.lit(5.0), F.lit(300.0), F.lit(105.0)).alias("bbox"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("array<double>").alias("inner"))
    made = spread(_read(spark, sf_dir, "customer"), "c_custkey").select(
        _padded(k, 9).alias("snapshot_id"), _text("s", k).alias("source"), _text("https://bank.example/accounts/", k, "/profile?x=1").alias("url"), _text("Open account for ", name).alias("title"), F.array(F.lit(1280), F.lit(720)).alias("viewport"),
        F.lit(1.0).alias("dpr"), F.lit(1).alias("ms"), elements.alias("elements"), F.array(text(7, F.lit("Aadhaar: 4821 6630 1979")), text(8, _text("Welcome back, ", name))).alias("texts"), F.array(raster).alias("rasters"),
    )
    return durable(made), spark.createDataFrame([], wire.VISION)


_RANKS = """WITH p AS (SELECT c_custkey % 1000 AS m, row_number() OVER (ORDER BY min(c_custkey)) AS pn FROM customer GROUP BY 1),
c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS snapshot_id FROM customer JOIN p ON p.m = c_custkey % 1000)"""


@query(_RANKS + """SELECT snapshot_id, id, role, label, value, masked, options, field_class FROM c, LATERAL (VALUES
 (1, 'textbox', 'Full name', '⟦NAME_' || n || '⟧', NULL::BOOLEAN, NULL, 'NAME'), (2, 'textbox', 'Email', '⟦EMAIL_' || n || '⟧', NULL, NULL, 'EMAIL'), (3, 'password', 'PIN', '⟦SECRET_' || n || '⟧', NULL, NULL, 'SECRET'),
 (4, 'textbox', 'Notes', 'call ⟦PHONE_' || pn || '⟧ after 5', NULL, NULL, NULL), (5, 'combobox', 'Segment', '', NULL, '⟦NAME_' || n || '⟧,' || c_mktsegment, NULL), (6, 'button', 'Continue', NULL, NULL, NULL, NULL),
 (9, 'image', 'Photo of ⟦NAME_' || n || '⟧', NULL, true, NULL, NULL)) t(id, role, label, value, masked, options, field_class)""")
def sanitized_elements(spark, sf_dir):
    """What is shown of the elements of each customer's screen."""
    screens, _ = sanitize(*_screens(spark, sf_dir))
    e = screens.select("snapshot_id", F.explode("elements").alias("e"))
    return e.select("snapshot_id", "e.id", "e.role", "e.label", "e.value", "e.masked", F.array_join("e.options", ",").alias("options"), "e.field_class")


@query(_RANKS + """SELECT snapshot_id, 'https://bank.example' AS origin, '/accounts/{id}/profile' AS path_template, 'Open account for ⟦NAME_' || n || '⟧' AS title, 'form' AS state,
 'Aadhaar: ⟦AADHAAR_1⟧|Welcome back, ⟦NAME_' || n || '⟧' AS texts, true AS late, '⟦NAME_' || n || '⟧ 10 18,⟦EMAIL_' || n || '⟧ 20 28,⟦SECRET_' || n || '⟧ 30 38,REDACTED 40 48,⟦FACE_' || n || '⟧ 5 105' AS masks, 6 AS n_marks FROM c""")
def sanitized_screens(spark, sf_dir):
    """Title, path, state, texts and masks of each customer's screen."""
    screens, _ = sanitize(*_screens(spark, sf_dir))
    at = lambda m, i: F.get(m["bbox"], F.lit(i)).cast("long").cast("string")
    masks = F.transform(F.array_sort(F.transform("masks", lambda m: F.struct((~m["field"]).alias("f"), F.get(m["bbox"], F.lit(1)).alias("y"), m.alias("m")))), lambda x: F.concat_ws(" ", x["m"]["label"], at(x["m"], 1), at(x["m"], 3)))
    return screens.select("snapshot_id", "origin", "path_template", "title", F.col("state.class").alias("state"), F.array_join(F.transform("texts", lambda t: t["text"]), "|").alias("texts"), "late", F.array_join(masks, ",").alias("masks"), F.size("marks").alias("n_marks"))


# --- sanitizing with what vision saw ---

_SEEN_LINES = """l AS (SELECT l_suppkey, l_linenumber AS n, lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS snapshot_id, l_orderkey % 2 = 0 AS known, l_quantity, l_partkey % 100000 AS phone, l_partkey, CAST(l_quantity AS BIGINT) % 3 AS kind, l_orderkey,
  CASE CAST(l_quantity AS BIGINT) % 3 WHEN 0 THEN 'Order ' || l_orderkey WHEN 1 THEN 'ring +91 98450 ' || lpad(CAST(l_partkey % 100000 AS VARCHAR), 5, '0') ELSE 'mail p' || l_partkey || '@mail.example' END AS text, (l_suppkey + l_linenumber) % 4 <> 0 AND (l_suppkey + l_linenumber) % 5 <> 4 AS ok FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, n ORDER BY l_orderkey, text) - 1 AS i FROM l),
p AS (SELECT phone, row_number() OVER (ORDER BY min(struct_pack(s := snapshot_id, n := n, i := i))) AS t FROM k WHERE ok AND kind = 1 GROUP BY phone),
m AS (SELECT l_partkey, row_number() OVER (ORDER BY min(struct_pack(s := snapshot_id, n := n, i := i))) AS t FROM k WHERE ok AND kind = 2 GROUP BY l_partkey),
t AS (SELECT k.*, CASE kind WHEN 1 THEN '⟦PHONE_' || p.t || '⟧' WHEN 2 THEN '⟦EMAIL_' || m.t || '⟧' END AS token FROM k LEFT JOIN p ON p.phone = k.phone AND kind = 1 LEFT JOIN m ON m.l_partkey = k.l_partkey AND kind = 2 WHERE ok)"""


def _seen_screens(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A screen for each supplier, with an image for each line number, and what vision saw in these: lines of text, faces
    and codes that follow from the items; some results failed, some are missing."""
    n, qty = F.col("l_linenumber"), F.col("l_quantity")
    kind = qty.cast("long") % 3
    line = F.when(kind == 0, _text("Order ", F.col("l_orderkey"))).when(kind == 1, _text("ring +91 98450 ", F.lpad((F.col("l_partkey") % 100000).cast("string"), 5, "0"))).otherwise(_text("mail p", F.col("l_partkey"), "@mail.example"))
    images = _read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", line.alias("text")))).alias("rows"), F.min("l_quantity").cast("double").alias("least"), F.max("l_quantity").cast("double").alias("most"))
    y = n * 100.0
    box = F.array(F.lit(0.0), y, F.lit(500.0), y + 90)
    edge = lambda i: i * 2.0 + 10
    read = lambda r, i: F.struct(r["text"].alias("text"), F.array(F.lit(10.0), y + i, edge(F.length(r["text"])), y + i + 0.8).alias("bbox"), F.when(r["l_orderkey"] % 2 == 0, F.transform(F.sequence(F.lit(0), F.length(r["text"]) - 1), lambda c: F.array(edge(c), edge(c + 1)))).otherwise(F.array().cast("array<array<double>>")).alias("chars"))
    snapshot, mix = _padded(F.col("l_suppkey"), 9), F.col("l_suppkey") + n
    some = lambda when, b: F.when(when, F.array(b)).otherwise(F.array().cast("array<array<double>>"))
    images = durable(images.select("l_suppkey", n, snapshot.alias("snapshot_id"), (mix % 4 != 0).alias("ok"), (mix % 5 == 4).alias("missing"), box.alias("box"), F.transform("rows", read).alias("lines"), some(n % 2 == 0, F.array("least", y, F.col("most") + 1, y + 20)).alias("faces"), some(n % 3 == 0, F.array("most", y, F.col("most") + 30, y + 30)).alias("codes")))
    vision = images.where("not missing").select("snapshot_id", geometry.raster_key(S.box_from(F.col("box"))).alias("key"), "ok", "faces", "codes", "lines", F.when(~F.col("ok"), F.lit("failed")).alias("error"))
    raster = F.struct((n + 1).cast("int").alias("vid"), F.lit("img").alias("kind"), _text("scan ", n).alias("alt"), F.col("box").alias("bbox"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("array<double>").alias("inner"))
    by = images.groupBy("l_suppkey", "snapshot_id").agg(F.array_sort(F.collect_list(raster)).alias("rasters"))
    none = {c: "" for c in ("tag", "type", "value", "placeholder", "name", "idAttr", "autocomplete")}
    choice = F.from_json(F.lit(json.dumps([none | {"vid": 1, "role": "combobox", "label": "Part", "hasValue": False, "required": False, "disabled": False}])), dom.ELEMENTS)
    choice = F.transform(choice, lambda e: e.withField("options", F.transform(F.sequence(F.lit(1), (F.col("l_suppkey") % 45 + 1).cast("int")), lambda i: _text("part ", i))))
    texts = F.array(F.struct(F.lit(9).alias("vid"), _text("Supplier ", F.col("l_suppkey")).alias("text"), F.lit(None).cast("array<double>").alias("bbox"), D.no_spans().alias("spans")))
    return durable(by.select("snapshot_id", F.col("snapshot_id").alias("source"), F.lit("https://a.example/s").alias("url"), F.lit("").alias("title"), F.array(F.lit(800), F.lit(600)).alias("viewport"), F.lit(1.0).alias("dpr"), F.lit(1).alias("ms"), choice.alias("elements"), texts.alias("texts"), "rasters")), vision


@query(f"""WITH {_SEEN_LINES}, g AS (SELECT snapshot_id, n, ok, min(l_quantity) AS least, max(l_quantity) AS most FROM l GROUP BY ALL),
f AS (SELECT *, row_number() OVER (ORDER BY snapshot_id, n) AS t FROM g WHERE ok AND n % 2 = 0), c AS (SELECT *, row_number() OVER (ORDER BY snapshot_id, n) AS t FROM g WHERE ok AND n % 3 = 0)
SELECT snapshot_id, token AS label, CASE WHEN known THEN 20 ELSE 10 END::DOUBLE AS x0, (100 * n + i)::DOUBLE AS y0, (10 + 2 * length(text))::DOUBLE AS x1, (100 * n + i + 1)::DOUBLE AS y1 FROM t WHERE token IS NOT NULL
UNION ALL SELECT snapshot_id, 'IMAGE', 0, 100 * n, 500, 100 * n + 90 FROM g WHERE NOT ok
UNION ALL SELECT snapshot_id, '⟦FACE_' || t || '⟧', least, 100 * n, most + 1, 100 * n + 20 FROM f UNION ALL SELECT snapshot_id, '⟦QR_' || t || '⟧', most, 100 * n, most + 30, 100 * n + 30 FROM c""")
def vision_masks(spark, sf_dir):
    """Masks over what vision saw on each supplier's screen: characters that are values, faces, codes, and whole images
    whose result failed or is missing."""
    screens, _ = sanitize(*_seen_screens(spark, sf_dir))
    at = lambda i: F.get("m.bbox", F.lit(i))
    return screens.select("snapshot_id", F.explode("masks").alias("m")).select("snapshot_id", "m.label", at(0).alias("x0"), at(1).alias("y0"), at(2).alias("x1"), at(3).alias("y1"))


@query(f"""WITH {_SEEN_LINES}, s AS (SELECT snapshot_id, l_suppkey, 9 + row_number() OVER (PARTITION BY snapshot_id ORDER BY n, i) AS id, CASE kind WHEN 1 THEN 'ring ' || token WHEN 2 THEN 'mail ' || token ELSE text END AS text FROM t),
a AS (SELECT snapshot_id, id, text FROM s WHERE id <= 159 UNION ALL SELECT snapshot_id, 9, 'Supplier ' || l_suppkey FROM (SELECT l.snapshot_id, l.l_suppkey, count(*) FILTER (l.ok) AS n FROM l GROUP BY ALL) WHERE n < 150)
SELECT a.snapshot_id, a.id::INTEGER AS id, a.text, least(30, CAST(a.snapshot_id AS BIGINT) % 45 + 1)::INTEGER AS n_options FROM a""")
def vision_texts(spark, sf_dir):
    """The texts of each supplier's screen, those that vision read before those of the page, 150 at most; and how many
    options are told, 30 at most."""
    screens, _ = sanitize(*_seen_screens(spark, sf_dir))
    return screens.select("snapshot_id", F.explode("texts").alias("t"), F.size(F.get("elements", F.lit(0))["options"]).alias("n_options")).select("snapshot_id", "t.id", "t.text", "n_options")


@query("""WITH n AS (SELECT count(*) AS n, CAST(sum(CASE c_custkey % 3 WHEN 0 THEN 7 ELSE 11 END) AS BIGINT) AS texts FROM customer),
v AS (SELECT l_suppkey, l_linenumber AS n, (l_suppkey + l_linenumber) % 4 <> 0 AS ok, count(*) AS lines FROM lineitem WHERE (l_suppkey + l_linenumber) % 5 <> 4 GROUP BY ALL)
SELECT 'made' AS stage, 0 AS place, n AS n_rows, NULL::BIGINT AS texts, NULL::BIGINT AS faces, NULL::BIGINT AS codes, NULL::BIGINT AS lines, NULL::BIGINT AS whole, true AS timed FROM n UNION ALL SELECT 'scanned', 1, n, texts, NULL, NULL, NULL, NULL, true FROM n
UNION ALL SELECT 'seen', 2, count(*), NULL, count(*) FILTER (ok AND n % 2 = 0), count(*) FILTER (ok AND n % 3 = 0), CAST(sum(lines) FILTER (ok) AS BIGINT), count(*) FILTER (NOT ok), true FROM v""")
def stage_timings(spark, sf_dir):
    """Stages of scanning made-up pages and of reading vision results, timed and counted while they run."""
    t = timing.Timings(spark)
    made = t.stage("made", synth.pages(synth.people(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")))))
    t.stage("scanned", dom.scan_pages(made.select("page", "html"), "page", "html"), texts=F.sum(F.size("texts")))
    t.stage("seen", _seen_screens(spark, sf_dir)[1], **timing.vision_metrics())
    of = lambda c: F.try_element_at("metrics", F.lit(c)).alias(c)
    return t.table().select("stage", "place", "n_rows", *map(of, ("texts", "faces", "codes", "lines", "whole")), (F.col("ms") > 0).alias("timed"))


@query("""SELECT n_name AS name, strlen(string_agg(c_name, chr(10) ORDER BY c_custkey)) + 1 AS n_bytes, sha256(string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10)) AS sha256 FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def image_folder(spark, sf_dir):
    """A folder of files read as rows of path and bytes: one file for each nation, of what its customers are called."""
    path = f"{shared_folder(spark)}/maskwright-queries/{uuid.uuid4().hex}"
    c = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c.repartition("n_name").sortWithinPartitions("n_name", "c_custkey").select("c_name", F.concat(F.col("n_name"), F.lit(".png")).alias("file")).write.partitionBy("file").text(path)
    found = images.read_images(spark, path, "part-*")
    return found.select(F.regexp_extract("path", "file=([^/]+)[.]png/", 1).alias("name"), F.octet_length("png").cast("long").alias("n_bytes"), F.sha2("png", 256).alias("sha256")).withColumn("name", F.url_decode("name"))


# --- names in prose ---

_FIRST, _LAST = ["Asha", "Ravi", "Meera", "Kiran"], ["Patel", "Singh", "Menon", "Bose"]
_WEAK = "Kiran"
_PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *_FIRST, *[x[:3] for x in _LAST], *["##" + x[3:] for x in _LAST], "Today", "paid", "order", "for", "us", "."]


def _classifier():
    """First names begin a name, last names go on; of one first name it is unsure."""
    said = np.zeros((len(_PIECES), len(names.LABELS)))
    for i, piece in enumerate(_PIECES):
        weak = piece in (_WEAK, _LAST[_FIRST.index(_WEAK)][:3])
        said[i, 1 if piece in _FIRST else 2 if piece in [x[:3] for x in _LAST] else 0] = 2.0 if weak else 9.0
    return lambda ids, mask: said[ids]

    return classify


def _prose(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % 4 + 1).cast("int"))
    return _read(spark, sf_dir, "customer").select("c_custkey", _padded(k, 9).alias("snapshot_id"), _text("Today ", pick(_FIRST), " ", pick(_LAST), " paid order ", k, " for us. ").alias("sentence"))


_SQL_PROSE = f"p AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS snapshot_id, [{', '.join(repr(a + ' ' + b) for a, b in zip(_FIRST, _LAST))}][CAST(c_custkey % 4 + 1 AS BIGINT)] AS who FROM customer)"


@query(f"""WITH {_SQL_PROSE}, t AS (SELECT *, 'Today ' || who || ' paid order ' || c_custkey || ' for us. ' AS s FROM p)
SELECT snapshot_id, CAST(6 + i * length(s) AS INTEGER) AS "start", CAST(6 + i * length(s) + length(who) AS INTEGER) AS "end", who AS value FROM (SELECT *, unnest(range(0, 1 + c_custkey % 3 * 20)) AS i FROM t) WHERE who NOT LIKE '{_WEAK}%'""")
def found_names(spark, sf_dir):
    """Names that a classifier tells in texts of up to 41 sentences, in segments of at most 128 pieces."""
    texts = spread(_prose(spark, sf_dir), "snapshot_id").select("snapshot_id", F.lit(1).cast("long").alias("ord"), F.repeat("sentence", (1 + F.col("c_custkey") % 3 * 20).cast("int")).alias("text"))
    return names.find_names(texts, names.read_vocabulary("\n".join(_PIECES)), _classifier).select("snapshot_id", "start", "end", "value")


@query(f"""WITH {_SQL_PROSE}, r AS (SELECT who, row_number() OVER (ORDER BY min(c_custkey)) AS n FROM p WHERE who NOT LIKE '{_WEAK}%' GROUP BY who)
SELECT snapshot_id, 'Today ' || coalesce('⟦NAME_' || n || '⟧', who) || ' paid order ' || c_custkey || ' for us.' AS text FROM p LEFT JOIN r USING (who)""")
def learned_names(spark, sf_dir):
    """Names in prose from candidate texts over the budget and the classifier to the vault and the masked screens."""
    text = F.struct(F.lit(1).alias("vid"), F.col("sentence").alias("text"), F.lit(None).cast("array<double>").alias("bbox"), D.no_spans().alias("spans"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    shots = _prose(spark, sf_dir).select(
        "snapshot_id", F.col("snapshot_id").alias("source"), F.lit("https://a.example/").alias("url"), F.lit("News").alias("title"), F.array(F.lit(1280), F.lit(720)).alias("viewport"), F.lit(1.0).alias("dpr"), F.lit(1).alias("ms"),
        none(wire.RAW_ELEMENT).alias("elements"), F.array(text).alias("texts"), none(wire.RAW_RASTER).alias("rasters"),
    )
    no_vision = spark.createDataFrame([], wire.VISION)
    empty = spark.createDataFrame([], "key string, token string, cls string, value string, source string, valid boolean, n long, first_ord string")
    new = names.learned(shots, no_vision, names.read_vocabulary("\n".join(_PIECES)), _classifier, empty)
    screens, _ = sanitize(shots, no_vision, names=new)
    return screens.select("snapshot_id", F.explode("texts").alias("t")).select("snapshot_id", "t.text")


@query(r"""WITH t AS (SELECT lang || '/' || CAST(doc_id % 50 AS VARCHAR) AS snapshot_id, doc_id, text FROM documents WHERE regexp_matches(text, '\p{Lu}\p{Ll}+') AND len(regexp_extract_all(text, '\p{L}{2,}')) >= 4),
b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY snapshot_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) SELECT snapshot_id, doc_id FROM b WHERE before < 8000""")
def name_budget(spark, sf_dir):
    """Texts that may hold names, up to the budget of characters of each group of documents."""
    docs = _read(spark, sf_dir, "documents").select(_text(F.col("lang"), "/", F.col("doc_id") % 50).alias("snapshot_id"), "doc_id", F.col("doc_id").alias("ord"), "text")
    return names.budgeted(docs).select("snapshot_id", "doc_id")


@query("""SELECT c_custkey, value FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' Al ' WHEN 1 THEN 'Nominee' ELSE c_name END AS value FROM customer) WHERE length(trim(value)) >= 3 AND value <> 'Nominee' AND c_custkey % 2 = 1""")
def new_names(spark, sf_dir):
    """Names that aren't too short, no label, and not in the vault, which holds those of even keys."""
    k = F.col("c_custkey")
    c = _read(spark, sf_dir, "customer")
    vault = c.where(k % 2 == 0).select(F.lit("NAME").alias("cls"), F.upper("c_name").alias("value"), _text("⟦NAME_", k, "⟧").alias("token"))
    found = c.select("c_custkey", F.when(k % 5 == 0, F.lit(" Al ")).when(k % 5 == 1, F.lit("Nominee")).otherwise(F.col("c_name")).alias("value"))
    return names.fresh_names(found, vault).select("c_custkey", "value")


# --- frames and boxes ---


@query("""SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS snapshot_id, vid, kind, x0, frame_id, child_vid FROM customer, LATERAL (VALUES
 (1, 'element', 1.0, NULL, NULL, 2), (2, 'raster', 10.0, NULL, NULL, 0), (3, 'text', 1.0, NULL, NULL, 2), (4, 'element', 13.0 + c_custkey % 50, 7, 1, 1), (5, 'text', 17.0 + c_custkey % 50, NULL, NULL, 1), (6, 'raster', 21.0 + c_custkey % 50, NULL, NULL, 1)) t(vid, kind, x0, frame_id, child_vid, w)
WHERE w = 2 OR (c_custkey % 4 = 0) = (w = 0)""")
def merged_frames(spark, sf_dir):
    """Items of each customer's screen with those of its frame, where the frame's size fits."""
    return _merged(spark, sf_dir).select("snapshot_id", "vid", "kind", F.col("bbox.x0").alias("x0"), "frame_id", "child_vid")


def _merged(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    c = _read(spark, sf_dir, "customer").select("c_custkey", _padded(k, 9).alias("snapshot_id"))
    item = lambda vid, kind, x: F.struct(F.lit(vid).alias("vid"), F.lit(kind).alias("kind"), S.box(x, 1, 99, 9).alias("bbox"), F.lit(vid).alias("ord"))
    flat = lambda df, *more: df.select("snapshot_id", *more, F.explode("items").alias("i")).select("snapshot_id", *more, "i.*")
    items = flat(c.withColumn("items", F.array(item(1, "element", 1), item(2, "raster", 10), item(3, "text", 1))))
    kids = flat(c.withColumn("frame_id", F.lit(7)).withColumn("items", F.array(item(1, "element", 3), item(2, "text", 7), item(5, "raster", 11))), "frame_id")
    rasters = c.select("snapshot_id", F.lit(2).alias("vid"), F.lit("iframe").alias("kind"), F.lit("https://pay.example/f").alias("src"), S.box(10 + k % 50, F.lit(20), 310 + k % 50, F.lit(220)).alias("inner"))
    frames = c.select("snapshot_id", F.lit(7).alias("frame_id"), F.lit("https://PAY.example:443/f?q=1").alias("url"), F.when(k % 4 == 0, 305).otherwise(301).alias("w"), F.lit(199).alias("h"))
    return geometry.merge_frames(items, geometry.match_frames(rasters, frames), kids)


@query("""SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS snapshot_id, target, CASE WHEN target = 4 AND c_custkey % 4 > 0 THEN 7 END AS frame_id, CASE WHEN target = 4 AND c_custkey % 4 > 0 THEN 1 END AS child_vid,
 CASE WHEN target = 4 AND c_custkey % 4 > 0 THEN 'https://pay.example' END AS origin FROM customer, (VALUES (1), (4), (NULL)) t(target)""")
def routed_actions(spark, sf_dir):
    """Where actions on merged screens go: to the frame that an element came from, or to the page."""
    actions = _read(spark, sf_dir, "customer").select(_padded(F.col("c_custkey"), 9).alias("snapshot_id"), F.explode(F.array(F.lit(1), F.lit(4), F.lit(None))).alias("target"))
    return geometry.routed(actions, _merged(spark, sf_dir)).select("snapshot_id", "target", "frame_id", "child_vid", "origin")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 10.0 ELSE p_size % 3 * 5.0 END AS x0, CASE WHEN p_partkey % 5 = 0 THEN 91.0 ELSE (p_size % 3 + 2 + p_partkey % 3) * 5.0 END AS x1 FROM part""")
def char_rects(spark, sf_dir):
    """Rectangles of runs of characters in lines, of the whole line where its characters aren't known."""
    n = F.length("p_name")
    chars = F.transform(F.sequence(F.lit(1), F.when(F.col("p_partkey") % 5 == 0, n - 1).otherwise(n)), lambda i: F.array(((i - 1) * 5).cast("double"), (i * 5).cast("double")))
    start = F.col("p_size") % 3
    rect = S.char_rect(S.box(10, 2.5, 90.5, 9), chars, F.col("p_name"), start, (start + 2 + F.col("p_partkey") % 3).cast("int"))
    return _read(spark, sf_dir, "part").select("p_partkey", rect["x0"].alias("x0"), rect["x1"].alias("x1"))


_LI = "li AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price, max(l_quantity) AS qty, max(l_suppkey) AS supp FROM lineitem GROUP BY ALL)"


def _lines(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"), F.max("l_quantity").alias("qty"), F.max("l_suppkey").alias("supp"))


@query(f"""WITH {_LI}, b AS (SELECT l_orderkey, l_linenumber, supp * 13 % 700 - 20 AS x, floor((supp * 13 % 700 - 20 - 3) * 1.5) AS bx, ceil((qty + 6) * 1.5) AS w FROM li)
SELECT l_orderkey, l_linenumber, CAST(bx AS BIGINT) AS x, CAST(w AS BIGINT) AS w, 'EMAIL_1' AS label, bx < 900 AND bx + w > 0 AS inside FROM b""")
def mask_boxes(spark, sf_dir):
    """Masks of fields in the pixels of an image of 900 by 600, and whether they lie in it."""
    x = (F.col("supp") * 13 % 700 - 20).cast("double")
    m = S.mask_box(S.box(x, F.lit(10), x + F.col("qty"), F.lit(30)), F.lit("⟦EMAIL_1⟧"), F.lit(True), F.lit(1.5))
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", m.alias("m"))
    return rows.select("l_orderkey", "l_linenumber", "m.x", "m.w", "m.label", S.in_frame(F.col("m"), F.lit(900), F.lit(600)).alias("inside"))


@query(f"""WITH {_LI} SELECT l_orderkey, l_linenumber, qty - 20 > 1 AND supp % 900 - 50 + qty - 20 > 0 AND supp % 900 - 50 < 800 AS shown FROM li""")
def visible_boxes(spark, sf_dir):
    """Which boxes are more than a pixel wide and within a viewport of 800 by 600."""
    x = F.col("supp") % 900 - 50
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", S.visible(S.box(x, F.lit(5), x + F.col("qty") - 20, F.lit(25)), F.lit(800), F.lit(600)).alias("shown"))


@query(f"""WITH {_LI}, c AS (SELECT l_orderkey, l_linenumber, greatest(0, floor((supp % 90 - 10.5) * 2)) AS x0, least(160, ceil((supp % 90 - 10.5 + qty) * 2)) AS x1 FROM li)
SELECT l_orderkey, l_linenumber, CAST(x0 AS DOUBLE) AS x0, CAST(x1 AS DOUBLE) AS x1, (4 + x0) / 2.0 AS back FROM c""")
def crop_views(spark, sf_dir):
    """Boxes in the pixels of a frame, clamped to it, and a point of the crop back on the page."""
    x = F.col("supp") % 90 - 10.5
    c = S.crop_box(S.box(x, F.lit(1), x + F.col("qty"), F.lit(9)), F.lit(2.0), F.lit(160), F.lit(90))
    back = S.to_view(S.box(4, 0, 8, 8), c, F.lit(2.0))["x0"]
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", c["x0"].alias("x0"), c["x1"].alias("x1"), back.alias("back"))


@query(f"""WITH {_LI}, o AS (SELECT l_orderkey, l_linenumber, qty, least(10 + qty, 40) - 20 AS w FROM li)
SELECT l_orderkey, l_linenumber, CASE WHEN w > 0 THEN w * 5 / (qty * 10 + 20 * 10 - w * 5) ELSE 0 END AS iou, qty * 10 AS area FROM o""")
def box_overlaps(spark, sf_dir):
    """Area of a box, and its overlap with another over their union."""
    a, b = S.box(F.lit(10), F.lit(0), 10 + F.col("qty"), F.lit(10)), S.box(20, 5, 40, 15)
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", S.iou(a, b).alias("iou"), S.box_area(a).alias("area"))


@query(f"WITH {_LI} SELECT l_orderkey, CAST(supp % 3 * 100 AS DOUBLE) AS x, max(price) AS score FROM li GROUP BY l_orderkey, supp % 3")
def suppressed_boxes(spark, sf_dir):
    """Of boxes that overlap, the one of the highest score."""
    x = F.col("supp") % 3 * 100
    boxes = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.struct(S.box(x, F.lit(0), x + 80 + F.col("l_linenumber"), F.lit(50)).alias("box"), F.col("price").alias("score"))).alias("boxes"))
    return boxes.select("l_orderkey", F.explode(geometry.suppressed(F.col("boxes"))).alias("k")).select("l_orderkey", F.col("k.box.x0").alias("x"), "k.score")


@query(f"WITH {_LI} SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY qty * 10 DESC, l_linenumber) <= 3 AS analysed FROM li")
def ranked_rasters(spark, sf_dir):
    """The three largest images of each screen."""
    r = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_linenumber").alias("vid"), S.box(F.lit(0), F.lit(0), F.col("qty"), F.lit(10)).alias("bbox"))
    return geometry.vision_candidates(r, 3).select(F.col("snapshot_id").alias("l_orderkey"), F.col("vid").alias("l_linenumber"), "analysed")


@query(f"""WITH {_LI}, v AS (SELECT *, supp % 3 > 0 AS ok, qty % 4 AS n FROM li) SELECT l_orderkey, count(*) FILTER (ok) AS images, CAST(sum(CASE WHEN ok THEN n ELSE 0 END) AS BIGINT) AS faces, CAST(0 AS BIGINT) AS codes,
 CAST(sum(CASE WHEN ok THEN n ELSE 0 END) AS BIGINT) AS lines, count(*) FILTER (NOT ok) AS whole, arg_min('failed ' || l_linenumber, l_linenumber) FILTER (NOT ok) AS error FROM v GROUP BY l_orderkey""")
def vision_totals(spark, sf_dir):
    """What vision saw on each screen, and its first error."""
    ok, n = F.col("supp") % 3 > 0, (F.col("qty") % 4).cast("int")
    many = lambda x: F.array_repeat(x, n)
    v = _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("snapshot_id"), F.col("l_linenumber").cast("string").alias("key"), ok.alias("ok"), many(F.array(F.lit(1.0))).alias("faces"), F.array().cast("array<array<double>>").alias("codes"), many(F.lit("x")).alias("lines"),
        F.when(~ok, _text("failed ", F.col("l_linenumber"))).alias("error"),
    )
    return geometry.vision_summary(v).withColumnRenamed("snapshot_id", "l_orderkey")


@query(f"WITH {_LI} SELECT l_orderkey, bool_and(supp % 40 <= 16) AS integrity, CAST(sum(supp % 40 + 5) AS BIGINT) AS total FROM li GROUP BY l_orderkey")
def mask_integrity(spark, sf_dir):
    """Whether all masks of an image cover, by a pixel under each; and the sum of the times of its stages."""
    pixel = F.array(F.lit(0), (F.col("supp") % 40).cast("int"), F.lit(16))
    rows = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(pixel).alias("pixels"), F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("string"), (F.col("supp") % 40 + 5).cast("int")))).alias("ms"))
    return rows.select("l_orderkey", S.masks_opaque(F.col("pixels")).alias("integrity"), S.total_ms(F.col("ms")).alias("total"))


# --- images ---


def _drawn(spark, sf_dir, columns: str, draw) -> DataFrame:
    """Rows that draw(c_custkey) gives for each customer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names_of = [c.split()[0] for c in columns.split(", ")]
        for b in batches:
            yield pd.DataFrame([r for k in b["c_custkey"] for r in draw(int(k))], columns=names_of)

    return spread(_read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").mapInPandas(run, columns)


def _plain_png(k: int) -> bytes:
    return encode_png(np.tile(np.array([k % 251, 7, 9, 255], np.uint8), (6, 8 + k % 3, 1)))


@query("SELECT c_custkey, 8 + c_custkey % 3 AS width, 6 AS height, repeat(printf('%02X0709FF', c_custkey % 251), CAST(6 * (8 + c_custkey % 3) AS BIGINT)) AS pixels, 'data:image/png;base64,iVBORw0KGgo' AS url FROM customer")
def decoded_images(spark, sf_dir):
    """PNG images, written and read."""
    made = _drawn(spark, sf_dir, "path string, png binary", lambda k: [(str(k), _plain_png(k))])
    url = images.decoded(made).join(made.select("path", F.left(images.data_url(F.col("png")), F.lit(33)).alias("url")), "path")
    return url.select(F.col("path").cast("long").alias("c_custkey"), F.col("width").cast("long").alias("width"), "height", F.hex("rgba").alias("pixels"), "url")


@query("SELECT c_custkey, [4 * (c_custkey % 20), 4 * (c_custkey % 20) + 10, 4 * (c_custkey % 20) + 30, 4 * (c_custkey % 20) + 40] AS reds FROM customer")
def resized_images(spark, sf_dir):
    """A row of two pixels, drawn twice as wide."""

    def draw(k: int):
        img = np.full((1, 2, 4), 255, np.uint8)
        img[0, :, 0] = [4 * (k % 20), 4 * (k % 20) + 40]
        return [(k, [int(x) for x in vision.resize(img, 4, 1)[0, :, 0]])]

    return _drawn(spark, sf_dir, "c_custkey long, reds array<long>", draw)


@query("""WITH b AS (SELECT c_custkey, x, y, w, h, w * h * 1.5 / (2 * (w + h)) AS d FROM customer, LATERAL (VALUES (5 + c_custkey % 7, 12, 20 + c_custkey % 5, 8), (40, 12 + c_custkey % 3 * 25, 10, 6)) t(x, y, w, h))
SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY greatest(0, floor((y - d) / 0.5)), x) AS place, CAST(greatest(0, floor((x - d) / 0.5)) AS BIGINT) AS x0, CAST(greatest(0, floor((y - d) / 0.5)) AS BIGINT) AS y0, CAST(least(200, ceil((x + w + d) / 0.5)) AS BIGINT) AS x1, CAST(least(180, ceil((y + h + d) / 0.5)) AS BIGINT) AS y1 FROM b""")
def text_regions(spark, sf_dir):
    """Boxes of two areas of text in a map of probabilities at half the image's size; a faint third one is none."""

    def draw(k: int):
        prob = np.zeros((90, 100))
        for x, y, w, h, p in ((5 + k % 7, 12, 20 + k % 5, 8, 0.9), (40, 12 + k % 3 * 25, 10, 6, 0.8), (70, 60, 9, 9, 0.5), (1, 1, 2, 9, 0.9)):
            prob[y : y + h, x : x + w] = p
        return [(k, i, *map(int, b)) for i, b in enumerate(vision.text_boxes(prob, 0.5, 200, 180), 1)]

    return _drawn(spark, sf_dir, "c_custkey long, place long, x0 long, y0 long, x1 long, y1 long", draw)


@query("""WITH t AS (SELECT c_custkey, CAST(c_custkey + 1000000 AS VARCHAR) AS s FROM customer) SELECT c_custkey, s AS text, 10.0 AS x0, 10 + (2 * length(s) - 1) * 3.0 AS mid, 10 + 6.0 * length(s) * 1.0 AS x1 FROM t""")
def line_texts(spark, sf_dir):
    """Digits read from probabilities over time, with the extents of the first and the last character."""
    keys = list("0123456789")

    def draw(k: int):
        text = str(k + 1_000_000)
        prob = np.zeros((3 * len(text), 11))
        for i, c in enumerate(text):
            prob[3 * i + 1, int(c) + 1] = 1.0  # before and after it blank
            prob[[3 * i, 3 * i + 2], 0] = 1.0
        line = vision.line_text(prob, keys, [10, 0, 10 + 6 * len(text), 9])
        return [(k, line["text"], line["chars"][0][0], line["chars"][0][1] + (len(text) - 1) * 6 - 3, line["chars"][-1][1])]

    return _drawn(spark, sf_dir, "c_custkey long, text string, x0 double, mid double, x1 double", draw)


@query("""WITH f AS (SELECT c_custkey, (5 + c_custkey % 60) * 8 + 4.0 AS cx, 10 * 8 + 4.0 AS cy FROM customer) SELECT c_custkey, CAST(greatest(0, floor(cx - 4 - 1.6)) AS BIGINT) AS x0, CAST(floor(cy - 4 - 1.6) AS BIGINT) AS y0, CAST(least(640, ceil(cx + 4 + 1.6)) AS BIGINT) AS x1 FROM f""")
def face_regions(spark, sf_dir):
    """A face decoded from the heads of a model, of two that overlap the surer one, widened by a fifth."""

    def draw(k: int):
        out = {f"{name}_{s}": np.zeros(((640 // s) ** 2, n), np.float32) for s in vision.FACE_STRIDES for name, n in (("cls", 1), ("obj", 1), ("bbox", 4))}
        at = 10 * 80 + 5 + k % 60
        for i, score in ((at, 0.9), (at + 1, 0.8), (at + 80 * 20, 0.5)):
            out["cls_8"][i] = out["obj_8"][i] = score
            out["bbox_8"][i] = [0.5, 0.5, 0, 0]
        out["bbox_8"][at + 1, 0] = -0.3
        return [(k, int(b[0]), int(b[1]), int(b[2])) for b in vision.face_boxes(out, 1.0, 640, 640)]

    return _drawn(spark, sf_dir, "c_custkey long, x0 long, y0 long, x1 long", draw)


@query("""WITH q AS (SELECT c_custkey, 3 + c_custkey % 3 AS m, 20 + c_custkey % 11 AS x FROM customer) SELECT c_custkey, CAST(x + 3.5 * m - 4.5 * m AS BIGINT) AS x0, CAST(x + 3.5 * m + 14 * m + 4.5 * m AS BIGINT) AS x1 FROM q""")
def code_regions(spark, sf_dir):
    """Boxes of QR codes, from three finder patterns of modules of three to five pixels."""

    def draw(k: int):
        m, x, img = 3 + k % 3, 20 + k % 11, np.full((170, 170, 4), 255, np.uint8)
        for fx, fy in ((x, 20), (x + 14 * m, 20), (x, 20 + 14 * m)):
            for inset, shade in ((0, 0), (1, 255), (2, 0)):
                img[fy + inset * m : fy + (7 - inset) * m, fx + inset * m : fx + (7 - inset) * m, :3] = shade
        return [(k, round(b[0] / 1), round(b[2] / 1)) for b in vision.find_codes(img)]

    return _drawn(spark, sf_dir, "c_custkey long, x0 long, x1 long", draw)


@query("SELECT c_custkey, [c_name, c_mktsegment, ' '] AS keys FROM customer")
def model_keys(spark, sf_dir):
    """The list of characters in a model's metadata."""
    entry = lambda *kv: b"".join(bytes([n << 3 | 2, len(v)]) + v for n, v in kv)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, name, seg in zip(b["c_custkey"], b["c_name"], b["c_mktsegment"], strict=True):
                lines = f"{name}\n{seg}\n ".encode()
                raw = b"\x08\x07" + entry((2, b"torch")) + entry((14, entry((1, b"other"), (2, b"x")))) + entry((14, entry((1, b"character"), (2, lines))))
                out.append((k, vision.protobuf_strings(raw)))
            yield pd.DataFrame(out, columns=["c_custkey", "keys"])

    return _read(spark, sf_dir, "customer").mapInPandas(run, "c_custkey long, keys array<string>")


def _reader() -> dict:
    """Finds one line where the image is bright, and reads a number in it; no faces."""

    def detect(x: np.ndarray) -> np.ndarray:
        prob = np.zeros(x.shape[2:])
        if x[0, 0, 0, 0] > 0:
            prob[2:6, 2:6] = 0.9
        return prob[None, None]

    def recognise(x: np.ndarray) -> np.ndarray:
        return np.eye(11)[[1 + int(c) if c != " " else 0 for c in " 9 8 7 "]][None]

    def faces(x: np.ndarray) -> dict:
        return {f"{name}_{s}": np.zeros(((640 // s) ** 2, n), np.float32) for s in vision.FACE_STRIDES for name, n in (("cls", 1), ("obj", 1), ("bbox", 4))}

    return {"detect": detect, "recognise": recognise, "faces": faces, "keys": list("0123456789")}


def _shaded_png(k: int) -> bytes:
    return encode_png(np.full((8, 8, 4), 250 if k % 2 else 0, np.uint8)) if k % 5 else b"no image"


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN CASE c_custkey % 2 WHEN 1 THEN '987' ELSE '' END END AS lines FROM customer")
def read_back_lines(spark, sf_dir):
    """Lines that can be read in outgoing images; null where one can't be read."""
    made = _drawn(spark, sf_dir, "id long, png binary", lambda k: [(k, _shaded_png(k))])
    return vision.read_back(made, _reader).select(F.col("id").alias("c_custkey"), F.array_join("audit", ",").alias("lines"))


@query("""SELECT c_custkey, c_custkey % 5 > 0 AND c_custkey % 7 > 0 AS ok, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 7 > 0 AND c_custkey % 2 = 1 THEN '987' ELSE '' END AS lines,
 CASE WHEN c_custkey % 7 = 0 THEN 'too many images on screen' WHEN c_custkey % 5 = 0 THEN 'not a PNG file' END AS error FROM customer""")
def analysed_images(spark, sf_dir):
    """What models see in images; those that fail, or are over the limit, aren't ok."""
    made = _drawn(spark, sf_dir, "snapshot_id string, key string, png binary, analysed boolean", lambda k: [(str(k), "0", _shaded_png(k), k % 7 > 0)])
    v = vision.analyse(made, _reader, seconds=3600.0)
    return v.select(F.col("snapshot_id").cast("long").alias("c_custkey"), "ok", F.array_join(F.transform("lines", lambda x: x["text"]), ",").alias("lines"), "error")
