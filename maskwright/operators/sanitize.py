"""Sanitizing page snapshots in two passes: learn all values into the vault, then apply it to every string.

Since the vault is complete before it is applied, a name that a page shows late is masked in its early labels too; what
is masked covers what a single pass in page order would mask. Placeholders are numbered in the order of a single pass:
lines of images left to right, elements in order (label, value, placeholder, options; right to left within a string),
images, texts, title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import scalars as S
from . import detect as D
from .geometry import left_label_class, left_labels, raster_vision
from .ranking import durable
from .vault import build_vault, dictionary, secret_slot, vault_key


def spans_seen(items: DataFrame) -> DataFrame:
    """Sightings of the spans of items (item, source, ord, spans), right to left in a string unless `forward`."""
    forward = F.col("forward") if "forward" in items.columns else F.lit(False)
    s = items.select("source", "ord", forward.alias("f"), F.explode("spans").alias("s"))
    return s.select("source", F.struct("ord", F.when(F.col("f"), F.col("s.start")).otherwise(-F.col("s.start")).alias("at")).alias("ord"), F.col("s.cls").alias("cls"), F.col("s.value").alias("value"), F.col("s.valid").alias("valid"))


def apply_vault(items: DataFrame, vault: DataFrame) -> DataFrame:
    """items (item, text, spans) with `clean`, `shown` (spans with placeholders) and `hit`.

    Spans get their placeholder by an equi-join on the vault's key. Terms of the dictionary that lie apart from them
    are masked too.
    """
    one = items.select("item", F.posexplode("spans").alias("i", "s")).withColumn("key", vault_key(F.col("s.cls"), F.col("s.value")))
    held = one.join(vault.select("key", F.col("token").alias("t")), "key", "left")
    told = held.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("i", "s", "t"))).alias("ts"))
    s = lambda x: D.span(x["s"]["cls"], x["s"]["start"], x["s"]["end"], x["s"]["value"], x["s"]["valid"], F.coalesce(x["t"], x["s"]["token"]), x["s"]["layer"])
    rows = items.join(told.select("item", F.transform("ts", s).alias("own")), "item", "left")
    rows = D.dictionary_spans(rows, dictionary(vault), key="item")
    rows = rows.withColumn("shown", D.merged(F.coalesce("own", D.no_spans()), F.col("dict_spans")))
    return rows.withColumn("clean", D.replaced(F.col("text"), F.col("shown"), lambda x: x["token"])).withColumn("hit", F.size("shown") > 0).drop("own", "dict_spans")


def screen_state(has_password: Column, textboxes: Column, rasters: Column, texts: Column) -> Column:
    """struct(class, confidence, src) of a screen by what it holds."""
    state = lambda c, p: F.struct(F.lit(c).alias("class"), F.lit(p).alias("confidence"), F.lit("heuristic").alias("src"))
    return F.when(has_password & (textboxes <= 2), state("login", 0.6)).when(textboxes >= 3, state("form", 0.6)).when((rasters > 0) & (texts < 40), state("document", 0.4)).otherwise(state("generic", 0.4))


def snapshot_state(snapshots: DataFrame) -> DataFrame:
    boxes = F.size(F.filter("elements", lambda e: e["role"] == "textbox"))
    return snapshots.withColumn("state", screen_state(F.exists("elements", lambda e: e["role"] == "password"), boxes, F.size("rasters"), F.size("texts")))


def sanitized_url(url: Column) -> Column:
    """struct(origin, path_template); (unknown, /) for what isn't a URL."""
    parts = S.url_parts(url)
    shown = S.path_template(parts["path"], lambda s: F.size(D.detect_patterns(s)) > 0)
    return F.struct(F.coalesce(parts["origin"], F.lit("unknown")).alias("origin"), F.when(parts.isNull(), F.lit("/")).otherwise(shown).alias("path_template"))


def image_lines(rasters: DataFrame) -> DataFrame:
    """Lines read from images that aren't masked whole, with their spans: what patterns and pairs find, else the class
    that the label to the left tells."""
    lines = rasters.where(~F.col("whole")).select("snapshot_id", "source", "vid", F.posexplode("lines").alias("line", "l"))
    lines = lines.select(F.concat_ws("/", "snapshot_id", "vid").alias("image_id"), "snapshot_id", "source", "vid", "line", F.col("l.text").alias("text"), S.box_from(F.col("l.bbox")).alias("bbox"), F.col("l.chars").alias("chars"))
    found = D.merged(D.detect_patterns(F.col("text")), D.label_values(F.col("text")))
    lines = left_labels(lines.withColumn("found", found))
    return lines.withColumn("spans", F.when(F.size("found") > 0, F.col("found")).otherwise(D.context_span(F.col("text"), left_label_class(F.col("label"))))).drop("found", "label")


def sanitize(snapshots: DataFrame, vision: DataFrame, known: DataFrame | None = None, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(screens, vault). snapshots: snapshot_id, source, url, title, viewport, elements, texts, rasters as scanned;
    vision: snapshot_id, key, ok, faces, codes, lines.

    A screen has origin, path_template, title, state, viewport, elements, texts, masks, marks and late (whether the
    dictionary found values in texts that had no span of their own); no value of a field leaves but as its placeholder.
    Images whose result failed or is missing are masked whole. names: snapshot_id, source, ord, start, value of names in
    prose, which join the vault before all else of their snapshot.
    """
    base = snapshots.select("snapshot_id", "source")
    el = snapshots.select("snapshot_id", "source", F.explode("elements").alias("e"))
    is_field = F.col("e.role").isin(X.FIELD_ROLES)
    fc = F.when(is_field, S.field_class(*[F.col(f"e.{c}") for c in ("type", "autocomplete", "label", "name", "idAttr", "placeholder")]))
    el = el.withColumn("fc", fc)
    secret = F.col("e.role").eqNullSafe("password") | F.col("fc").eqNullSafe("SECRET")
    el = el.withColumn("kind", F.when(secret & F.col("e.hasValue"), "secret").when(~secret & (F.coalesce("e.value", F.lit("")) != "") & F.col("fc").isNotNull(), "field").when(~secret & (F.coalesce("e.value", F.lit("")) != ""), "inline"))
    slot = secret_slot(F.col("source"), F.col("e.label"), F.col("e.name"), F.col("e.idAttr"))
    el = el.withColumn("whole_cls", F.when(F.col("kind") == "secret", "SECRET").when(F.col("kind") == "field", F.col("fc")))
    el = el.withColumn("whole_value", F.when(F.col("kind") == "secret", slot).when(F.col("kind") == "field", F.col("e.value")))
    # what several later steps read is written once
    el = durable(el)

    rasters = raster_vision(snapshots.select("snapshot_id", "source", F.explode("rasters").alias("r")).select("snapshot_id", "source", "r.vid", "r.kind", "r.alt", S.box_from(F.col("r.bbox")).alias("bbox")), vision)
    rasters = durable(rasters)
    lines = durable(image_lines(rasters))
    tx = snapshots.select("snapshot_id", "source", F.explode("texts").alias("t"))

    # strings: snapshot_id, source, part, vid, sub, text, spans, ord
    def strings(df: DataFrame, part: str, order: int, vid: Column, text: Column, spans: Column | None = None, sub: Column | None = None) -> DataFrame:
        sub = F.lit(0) if sub is None else sub
        step = {"label": 0, "value": 1, "placeholder": 2, "option": 3}.get(part, 0)
        at = F.struct(F.col("snapshot_id").alias("s"), F.lit(order).alias("p"), vid.cast("int").alias("v"), F.lit(step).alias("k"), sub.cast("int").alias("i"))
        spans = F.lit(None).cast(D.NO_SPANS) if spans is None else spans  # found below, for all parts at once
        return df.select("snapshot_id", "source", F.lit(part).alias("part"), vid.cast("int").alias("vid"), sub.cast("int").alias("sub"), text.alias("text"), spans.alias("spans"), at.alias("ord"), F.lit(part == "line").alias("forward"))

    e = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit(""))
    options = el.select("snapshot_id", "source", "e.vid", F.posexplode(F.slice("e.options", 1, X.MAX_OPTIONS)).alias("i", "o"))
    parts = [
        strings(lines, "line", 0, F.col("vid"), F.col("text"), F.col("spans"), F.col("line")),
        strings(el, "label", 1, F.col("e.vid"), e("label")),
        strings(el.where("kind = 'inline'"), "value", 1, F.col("e.vid"), e("value")),
        strings(el, "placeholder", 1, F.col("e.vid"), e("placeholder")),
        strings(options, "option", 1, F.col("vid"), F.col("o"), None, F.col("i")),
        strings(rasters.withColumn("alt", F.coalesce("alt", F.lit(""))), "alt", 2, F.col("vid"), F.col("alt")),
        strings(tx, "text", 3, F.col("t.vid"), F.col("t.text"), F.coalesce("t.spans", D.no_spans())),
        strings(snapshots, "title", 4, F.lit(0), F.coalesce("title", F.lit(""))),
    ]
    items = parts[0]
    for p in parts[1:]:
        items = items.unionByName(p)
    items = items.withColumn("item", F.concat_ws("/", "snapshot_id", "part", "vid", "sub"))
    items = durable(items.withColumn("spans", F.coalesce("spans", D.detect_patterns(F.col("text")))))

    order = lambda p, k: F.struct(F.struct(F.col("snapshot_id").alias("s"), F.lit(p).alias("p"), F.col("vid").cast("int").alias("v"), F.lit(k).alias("k"), F.col("i").cast("int").alias("i")).alias("ord"), F.lit(0).alias("at"))
    wholes = el.where("whole_cls is not null").withColumn("vid", F.col("e.vid")).withColumn("i", F.lit(0)).select("source", order(1, 1).alias("ord"), F.col("whole_cls").alias("cls"), F.col("whole_value").alias("value"), F.lit(None).cast("boolean").alias("valid"))
    spot = lambda name, cls: rasters.where(~F.col("whole")).select("snapshot_id", "source", "vid", "alt", F.posexplode(name + "s" if name != "code" else "codes").alias("i", "b")).withColumn("cls", F.lit(cls)).withColumn("value", F.concat("source", F.lit("|"), F.coalesce("alt", F.lit("")), F.lit(f"|{name}"), F.col("i").cast("string")))
    spots = spot("face", "FACE").unionByName(spot("code", "QR"))
    hinted = rasters.where(F.col("whole") & F.col("hint").isNotNull()).withColumn("i", F.lit(0)).withColumn("cls", F.col("hint")).withColumn("value", F.concat("source", F.lit("|"), "alt"))
    none = F.lit(None).cast("boolean").alias("valid")
    sightings = spans_seen(items).unionByName(wholes)
    sightings = sightings.unionByName(spots.select("source", order(2, 1).alias("ord"), "cls", "value", none)).unionByName(hinted.select("source", order(2, 1).alias("ord"), "cls", "value", none))
    if names is not None:
        first = F.struct(F.struct(F.col("snapshot_id").alias("s"), F.lit(-1).alias("p"), F.col("ord").cast("int").alias("v"), F.lit(0).alias("k"), F.lit(0).alias("i")).alias("ord"), F.col("start").cast("int").alias("at"))
        sightings = sightings.unionByName(names.select("source", first.alias("ord"), F.lit("NAME").alias("cls"), "value", none))
    vault = build_vault(sightings, known)

    vault = durable(vault)
    clean = durable(apply_vault(items, vault).select("snapshot_id", "part", "vid", "sub", "clean", "hit", "shown", (F.col("hit") & (F.size("spans") == 0)).alias("late")))
    token_of = lambda df: df.withColumn("key", vault_key(F.col("cls"), F.col("value"))).join(vault.select("key", "token"), "key", "left")
    of = lambda part, name: clean.where(F.col("part") == part).select("snapshot_id", "vid", F.col("clean").alias(name), F.col("hit").alias(f"{name}_hit"))
    opts = clean.where("part = 'option'").groupBy("snapshot_id", "vid").agg(F.transform(F.array_sort(F.collect_list(F.struct("sub", "clean"))), lambda x: x["clean"]).alias("options"))
    el = token_of(el.withColumn("vid", F.col("e.vid")).withColumn("cls", F.col("whole_cls")).withColumn("value", F.col("whole_value")))
    el = el.join(of("label", "label"), ["snapshot_id", "vid"], "left").join(of("value", "inline"), ["snapshot_id", "vid"], "left").join(of("placeholder", "hint"), ["snapshot_id", "vid"], "left").join(opts, ["snapshot_id", "vid"], "left")
    shown = F.coalesce("token", "inline", F.lit(""))
    keep = lambda c: F.when(F.col(f"e.{c}"), F.lit(True))
    element = lambda **k: F.struct(*[k.get(n, F.lit(None)).cast(t).alias(n) for n, t in ELEMENT])
    elements = el.select("snapshot_id", "vid", F.lit(0).alias("o"), element(
        id=F.col("vid"), role=F.col("e.role"), label=F.col("label"), value=F.when(F.col("e.role").isin(X.FIELD_ROLES), shown), placeholder=F.when(F.col("hint") != "", F.col("hint")),
        field_class=F.col("fc"), required=keep("required"), disabled=keep("disabled"), checked=F.col("e.checked"), options=F.when(F.col("e.options").isNotNull(), F.coalesce("options", F.array().cast("array<string>"))),
        masked=F.lit(None), bbox=F.col("e.bbox"), src=F.lit("dom")).alias("element"))
    ra = rasters.join(of("alt", "label"), ["snapshot_id", "vid"], "left")
    box_list = F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")
    images = ra.select("snapshot_id", "vid", F.lit(1).alias("o"), element(
        id=F.col("vid"), role=F.lit("image"), label=F.when(S.collapse(F.col("label")) != "", S.collapse(F.col("label"))).otherwise(F.col("kind")), masked=F.when(F.col("whole"), F.lit(True)), bbox=box_list, src=F.lit("dom")).alias("element"))
    all_elements = elements.unionByName(images).groupBy("snapshot_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "vid", "element"))), lambda x: x["element"]).alias("elements"))

    short = lambda c: F.substring(S.collapse(c), 1, X.MAX_TEXT_CHARS)
    line_text = clean.where("part = 'line'").join(lines.select("snapshot_id", "vid", F.col("line").alias("sub"), "bbox", "chars", F.col("text").alias("raw")), ["snapshot_id", "vid", "sub"])
    rounded = F.array(*[S.round_half_up(F.col(f"bbox.{c}")).cast("double") for c in ("x0", "y0", "x1", "y1")])
    top = snapshots.select("snapshot_id", F.array_max(F.concat(F.array(F.lit(0)), *[F.transform(c, lambda x: x["vid"].cast("int")) for c in ("elements", "texts", "rasters")])).alias("top"))
    place = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("vid", "sub"))
    from_images = line_text.join(top, "snapshot_id").select("snapshot_id", F.lit(0).alias("o"), (F.col("top") + place).cast("int").alias("id"), short(F.col("clean")).alias("text"), rounded.alias("bbox"))
    from_page = clean.where("part = 'text'").join(tx.select("snapshot_id", F.col("t.vid").alias("vid"), F.col("t.bbox").alias("bbox")), ["snapshot_id", "vid"]).select("snapshot_id", F.lit(1).alias("o"), F.col("vid").alias("id"), short(F.col("clean")).alias("text"), F.col("bbox").cast("array<double>").alias("bbox"))
    texts = from_images.unionByName(from_page)
    texts = texts.withColumn("n", F.row_number().over(Window.partitionBy("snapshot_id").orderBy("o", "id"))).where(F.col("n") <= X.MAX_TEXTS)
    all_texts = texts.groupBy("snapshot_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id", "text", "bbox"))), lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), x["bbox"].alias("bbox"))).alias("texts"))

    mask = lambda b, label, field: F.struct(b.cast("array<double>").alias("bbox"), label.cast("string").alias("label"), F.lit(field).alias("field"))
    of_fields = el.where("kind in ('secret', 'field') or (kind = 'inline' and inline_hit)").select("snapshot_id", mask(F.col("e.valueBox"), F.coalesce("token", F.lit("REDACTED")), True).alias("m"))
    of_spots = token_of(spots).select("snapshot_id", mask(F.col("b"), F.col("token"), False).alias("m"))
    of_wholes = token_of(ra.where("whole").withColumn("cls", F.col("hint")).withColumn("value", F.concat("source", F.lit("|"), "alt"))).select("snapshot_id", mask(box_list, F.coalesce("token", F.lit("IMAGE")), False).alias("m"))
    rect = lambda s: S.char_rect(F.col("bbox"), F.col("chars"), F.col("raw"), s["start"], s["end"])
    of_lines = line_text.select("snapshot_id", F.explode(F.transform("shown", lambda s: F.struct(rect(s).alias("r"), s["token"].alias("t")))).alias("x")).select("snapshot_id", mask(F.array("x.r.x0", "x.r.y0", "x.r.x1", "x.r.y1"), F.col("x.t"), False).alias("m"))
    masks = of_fields.unionByName(of_spots).unionByName(of_wholes).unionByName(of_lines).groupBy("snapshot_id").agg(F.array_sort(F.collect_list("m")).alias("masks"))

    url = snapshots.select("snapshot_id", sanitized_url(F.col("url")).alias("u"))
    titles = clean.where("part = 'title'").select("snapshot_id", F.col("clean").alias("title"))
    out = base.select("snapshot_id").join(url, "snapshot_id").join(titles, "snapshot_id").join(snapshot_state(snapshots).select("snapshot_id", "state", "viewport"), "snapshot_id")
    out = out.join(all_elements, "snapshot_id", "left").join(all_texts, "snapshot_id", "left").join(masks, "snapshot_id", "left")
    late = clean.where("part = 'text'").groupBy("snapshot_id").agg(F.bool_or("late").alias("late"))
    out = out.join(late, "snapshot_id", "left").withColumn("late", F.coalesce("late", F.lit(False)))
    marks = F.transform(F.filter("elements", lambda x: x["role"].isin(X.MARK_ROLES)), lambda x: F.struct(x["id"].alias("id"), x["bbox"].alias("bbox")))
    return out.select("snapshot_id", "u.origin", "u.path_template", "title", "state", "viewport", "elements", "texts", "masks", marks.alias("marks"), "late"), vault


ELEMENT = [
    ("id", "int"), ("role", "string"), ("label", "string"), ("value", "string"), ("placeholder", "string"), ("field_class", "string"), ("required", "boolean"),
    ("disabled", "boolean"), ("checked", "boolean"), ("options", "array<string>"), ("masked", "boolean"), ("bbox", "array<double>"), ("src", "string"),
]
