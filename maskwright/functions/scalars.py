"""Check digits, normal forms, classes by context, placeholders, URLs, boxes and masks, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X

JAVA_BORDER = X.BORDER


def java(pattern: str) -> str:
    """A fixed pattern for Java's regular expressions: \\b becomes a border of ASCII words."""
    return pattern.replace(r"\b", JAVA_BORDER)


def _table(rows: list[list[int]]) -> Column:
    """One literal, which the optimizer folds to an array: a literal for each value takes seconds to send to the JVM."""
    return F.split(F.lit(",".join(str(v) for r in rows for v in r)), ",").cast("array<int>")


# --- check digits ---


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _reversed_digits(s: Column) -> Column:
    return F.transform(F.filter(F.split(F.reverse(digits(s)), ""), lambda c: c != ""), lambda c: c.cast("int"))


def _verhoeff_state(reversed_digits: Column) -> Column:
    moved = F.transform(reversed_digits, lambda d, i: F.element_at(_table(X.VERHOEFF_P), ((i % 8) * 10 + d + 1).cast("int")))
    return F.aggregate(moved, F.lit(0), lambda c, d: F.element_at(_table(X.VERHOEFF_D), c * 10 + d + 1))


def verhoeff(s: Column) -> Column:
    """Whether the digits end in their Verhoeff check digit; false without digits."""
    d = _reversed_digits(s)
    return (F.size(d) > 0) & (_verhoeff_state(d) == 0)


def verhoeff_check_digit(s: Column) -> Column:
    return F.element_at(_table([X.VERHOEFF_INV]), _verhoeff_state(F.concat(F.array(F.lit(0)), _reversed_digits(s))) + 1)


def _luhn_sum(reversed_digits: Column) -> Column:
    return F.aggregate(F.transform(reversed_digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))), F.lit(0), lambda a, x: a + x)


def luhn(s: Column) -> Column:
    """Whether at least 12 digits have a Luhn sum that ten divides."""
    d = _reversed_digits(s)
    return (F.size(d) >= 12) & (_luhn_sum(d) % 10 == 0)


def luhn_check_digit(s: Column) -> Column:
    return (10 - _luhn_sum(F.concat(F.array(F.lit(0)), _reversed_digits(s))) % 10) % 10


# --- strings ---


def strip(s: Column) -> Column:
    """Without white space of the web platform at both ends."""
    return F.regexp_replace(s, rf"^{X.SPACE}+|{X.SPACE}+\z", "")


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, f"{X.SPACE}+", " "))


def escaped(s: Column) -> Column:
    """Regular expression that matches a literal."""
    return F.regexp_replace(s, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def first_visible(s: Column) -> Column:
    """Offset of the first character that isn't white space, -1 if there is none."""
    return F.when(s.rlike(X.NOT_SPACE), F.length(s) - F.length(F.regexp_replace(s, rf"^{X.SPACE}+", ""))).otherwise(-1)


def trimmed_length(s: Column) -> Column:
    return F.length(F.regexp_replace(s, rf"{X.SPACE}+\z", ""))


def normalize_value(cls: Column, v: Column) -> Column:
    """The form under which equal values of a class meet."""
    packed = F.regexp_replace(v, f"{X.SPACE}+", "")
    return (
        F.when(cls == "PHONE", F.right(digits(v), F.lit(10)))
        .when(cls.isin(X.DIGIT_CLASSES), digits(v))
        .when(cls.isin(X.UPPER_CLASSES), F.upper(packed))
        .when(cls.isin(X.LOWER_CLASSES), F.lower(strip(v)))
        .otherwise(F.lower(collapse(v)))
    )


def format_hint(cls: Column, v: Column) -> Column:
    """Shape of a value of a fixed format: # for digits, A for ASCII letters; null for other classes."""
    shown = F.when(cls == "PHONE", F.right(digits(v), F.lit(10))).otherwise(strip(v))
    return F.when(cls.isin(X.SHAPE_CLASSES), F.regexp_replace(F.regexp_replace(shown, "[A-Za-z]", "A"), "[0-9]", "#"))


def group_of(cls: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in X.GROUPS.items() for x in kv]), cls)


# --- classes by context ---


def bound(value: Column, f) -> Column:
    """f(value), with the value worked out once however often f names it, and no generated code for each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _first_rule(told: Column, rules: Sequence[tuple[str, str]]) -> Column:
    def chain(s: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for pattern, cls in rules:
            out = out.when(s.rlike(java(pattern)), F.lit(cls))
        return out

    return bound(told, chain)


def class_from_context(*parts: Column) -> Column:
    """Class that a field's label and names suggest, null if none."""
    told = F.concat_ws(" ", *[F.when(p != "", p) for p in parts])
    return _first_rule(F.regexp_replace(F.lower(told), "[_-]+", " "), X.CONTEXT_RULES)


def class_from_ocr_label(label: Column) -> Column:
    """The same for a label read from pixels, where any space may be missing."""
    loose = [(re.sub(r" \??", " ?", p), c) for p, c in X.CONTEXT_RULES]
    return _first_rule(F.regexp_replace(F.lower(label), "[_-]+", " "), loose)


def class_from_autocomplete(attribute: Column) -> Column:
    return _first_rule(F.lower(attribute), X.AUTOCOMPLETE_RULES)


def field_class(type_: Column, autocomplete: Column, label: Column, name: Column, id_attr: Column, placeholder: Column) -> Column:
    return F.when(type_ == "password", F.lit("SECRET")).otherwise(F.coalesce(class_from_autocomplete(autocomplete), class_from_context(label, name, id_attr, placeholder)))


def image_hint(alt: Column) -> Column:
    return _first_rule(alt, X.IMAGE_HINTS)


def irreversible(label: Column, side: str) -> Column:
    """side: `client` (acting) or `server` (planning); their lists differ."""
    return F.coalesce(label.rlike(java({"client": X.CLIENT_IRREVERSIBLE, "server": X.SERVER_IRREVERSIBLE}[side])), F.lit(False))


def compatible(field: Column, cls: Column) -> Column:
    """Whether a value of a class may go into a field of another."""
    same = field.eqNullSafe(cls)
    for f, others in X.COMPATIBLE.items():
        same = same | ((field == f) & cls.isin(others))
    return F.coalesce(same, F.lit(False))


# --- placeholders ---


def make_token(cls: Column, n: Column) -> Column:
    return F.concat(F.lit("⟦"), cls, F.lit("_"), n.cast("string"), F.lit("⟧"))


def tokens_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(X.TOKEN), F.lit(0))


def without_tokens(text: Column) -> Column:
    return F.regexp_replace(text, X.TOKEN, " ")


def blanked_tokens(text: Column) -> Column:
    """Placeholders replaced by as many spaces, so that offsets stay."""
    gaps, tokens = F.split(text, X.LATE_TOKEN, -1), F.regexp_extract_all(text, F.lit(X.LATE_TOKEN), F.lit(0))
    return F.concat_ws("", F.transform(gaps, lambda g, i: F.concat(g, F.repeat(F.lit(" "), F.coalesce(F.length(F.get(tokens, i)), F.lit(0))))))


# --- URLs ---

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*):/*(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:\[\]\s]+)(?::([0-9]*))?([/?#].*)?\z"


def url_parts(raw: Column) -> Column:
    """struct(origin, scheme, host, path) of an absolute web URL, null if it isn't one."""
    s = strip(raw)
    part = lambda k: F.regexp_extract(s, _URL, k)
    scheme, host, port = F.lower(part(1)), F.lower(part(2)), part(3)
    default = F.try_element_at(F.create_map(*[F.lit(x) for kv in X.DEFAULT_PORTS.items() for x in kv]), scheme)
    shown = F.when((port == "") | port.eqNullSafe(default), F.lit("")).otherwise(F.concat(F.lit(":"), F.regexp_replace(port, "^0+(?=[0-9])", "")))
    path = F.regexp_replace(part(4), r"[?#].*\z", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    fine = s.rlike(_URL) & scheme.isin(list(X.DEFAULT_PORTS))
    return F.when(fine, F.struct(F.concat(scheme, F.lit("://"), host, shown).alias("origin"), scheme.alias("scheme"), host.alias("host"), path.alias("path")))


def origin_of(raw: Column) -> Column:
    return url_parts(raw)["origin"]


def decoded(segment: Column) -> Column:
    """Percent-decoded; as it is if that fails. A plus sign stays."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(segment, r"\+", "%2B")), segment)


def path_template(path: Column, names_a_value) -> Column:
    """Segments that name a thing become {id}. names_a_value: tells of a decoded segment whether a detector finds a value in it."""

    def shown(seg: Column) -> Column:
        s = decoded(seg)
        told = F.length(s) > X.LONGEST_SEGMENT
        for p in X.ID_SEGMENTS:
            told = told | s.rlike(p)
        return F.when((seg != "") & (told | names_a_value(s)), F.lit("{id}")).otherwise(seg)

    return F.concat_ws("/", F.transform(F.split(path, "/", -1), shown))


def destination_allowed(dest: Column, server: Column) -> Column:
    """Same origin as the server, and https or this machine; false for what isn't a URL."""
    d, s = url_parts(dest), url_parts(server)
    return F.coalesce((d["origin"] == s["origin"]) & ((d["scheme"] == "https") | d["host"].isin(X.LOCAL_HOSTS)), F.lit(False))


# --- boxes and masks ---


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


def box_from(a: Column) -> Column:
    return box(*[F.get(a, F.lit(k)) for k in range(4)])


def box_area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def shifted(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["x0"] + dx, b["y0"] + dy, b["x1"] + dx, b["y1"] + dy)


def iou(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h / (box_area(a) + box_area(b) - w * h)).otherwise(0.0)


def to_view(b: Column, crop: Column, k: Column) -> Column:
    """From the pixels of a crop to the page: k pixels of the frame make one of the page."""
    return box((b["x0"] + crop["x0"]) / k, (b["y0"] + crop["y0"]) / k, (b["x1"] + crop["x0"]) / k, (b["y1"] + crop["y0"]) / k)


def crop_box(b: Column, k: Column, width: Column, height: Column) -> Column:
    """The box in the pixels of a frame, clamped to it."""
    return box(F.greatest(F.lit(0), F.floor(b["x0"] * k)), F.greatest(F.lit(0), F.floor(b["y0"] * k)), F.least(width, F.ceil(b["x1"] * k)), F.least(height, F.ceil(b["y1"] * k)))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def char_rect(line_box: Column, chars: Column, text: Column, start: Column, end: Column) -> Column:
    """Rectangle of characters [start, end) of a line; of the whole line if it doesn't know them all."""
    known = F.size(chars) == F.length(text)
    x0 = F.when(known, F.get(F.get(chars, start), F.lit(0))).otherwise(line_box["x0"])
    x1 = F.when(known, F.get(F.get(chars, end - 1), F.lit(1))).otherwise(line_box["x1"])
    return box(*map(round_half_up, (x0, line_box["y0"], x1, line_box["y1"])))


def mask_width(label: Column, w: Column, h: Column) -> Column:
    """Width that a mask is drawn with: the next of its class's steps, which are multiples of its height."""
    cls = F.when(label.rlike(rf"^{X.TOKEN}\z"), F.regexp_extract(label, X.TOKEN, 1)).otherwise(label)
    lists = [F.array(*map(F.lit, s)) for s in (X.MASK_SECRET, X.MASK_FIXED, X.MASK_VARIABLE)]
    steps = F.when(cls == "SECRET", lists[0]).when(cls.isin(X.MASK_FIXED_CLASSES), lists[1]).otherwise(lists[2])
    ratio, top = w / h, F.array_max(steps)
    snapped = F.coalesce(F.get(F.filter(steps, lambda s: s >= ratio), F.lit(0)), F.ceil(ratio / top) * top)
    return F.when(cls.isin(X.MASK_REGIONS) | (h <= 0), w.cast("double")).otherwise(snapped * h)


def mask_box(b: Column, label: Column, is_field: Column, k: Column) -> Column:
    """struct(x, y, w, h, label) in image pixels; k pixels make one of the page."""
    w, h = b["x1"] - b["x0"] + 2 * X.MASK_PAD, b["y1"] - b["y0"] + 2 * X.MASK_PAD
    wide = F.when(is_field, w).otherwise(mask_width(label, w, h))
    return F.struct(
        F.floor((b["x0"] - X.MASK_PAD) * k).alias("x"), F.floor((b["y0"] - X.MASK_PAD) * k).alias("y"), F.ceil(wide * k).alias("w"), F.ceil(h * k).alias("h"),
        F.regexp_replace(label, "[⟦⟧]", "").alias("label"),
    )


def in_frame(m: Column, width: Column, height: Column) -> Column:
    return (m["w"] > 0) & (m["h"] > 0) & (m["x"] < width) & (m["y"] < height) & (m["x"] + m["w"] > 0) & (m["y"] + m["h"] > 0)


def visible(b: Column, width: Column, height: Column) -> Column:
    """More than one pixel each way, and within the viewport."""
    return (b["x1"] - b["x0"] > 1) & (b["y1"] - b["y0"] > 1) & (b["y1"] > 0) & (b["x1"] > 0) & (b["y0"] < height) & (b["x0"] < width)


def masks_opaque(pixels: Column) -> Column:
    """Whether all masks cover: pixels is array<array<int>>, an RGB sample under each mask. False for a null sample."""
    dark = lambda p: F.coalesce((F.get(p, F.lit(0)) <= 16) & (F.get(p, F.lit(1)) <= 16) & (F.get(p, F.lit(2)) <= 16), F.lit(False))
    return F.coalesce(F.forall(pixels, dark), F.lit(False))


def total_ms(timings: Column) -> Column:
    """Sum of a map of stage timings."""
    return F.aggregate(F.map_values(timings), F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v, F.lit(0)).cast("long"))
