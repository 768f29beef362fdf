import pytest
from pyspark.sql import functions as F

from maskwright.functions import scalars as S
from maskwright.operators import detect as D


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(*xs):
    return [F.lit(x) for x in xs]


@pytest.mark.parametrize("number, good", [("4821 6630 1979", True), ("4821 6630 1978", False), ("", False), ("none", False)])
def test_verhoeff(spark, number, good):
    assert one(spark, S.verhoeff(F.lit(number))) is good


def test_check_digits(spark):
    assert one(spark, S.verhoeff_check_digit(F.lit("48216630197"))) == 9
    assert one(spark, S.luhn(F.lit("4111 1111 1111 1111"))) is True
    assert one(spark, S.luhn(F.lit("4111 1111 1111 1112"))) is False
    assert one(spark, S.luhn(F.lit("00000000000"))) is False  # fewer than 12 digits
    assert one(spark, S.luhn_check_digit(F.lit("411111111111111"))) == 1


@pytest.mark.parametrize(
    "cls, value, want",
    [("PHONE", "+91 98450-12345", "9845012345"), ("AADHAAR", "4821-6630-1979", "482166301979"), ("EMAIL", " Ananya.Rao@Mail.IN ", "ananya.rao@mail.in"), ("PAN", "abc pr 1234k", "ABCPR1234K"), ("NAME", "  Ananya   Rao ", "ananya rao")],
)
def test_normalize(spark, cls, value, want):
    assert one(spark, S.normalize_value(*lit(cls, value))) == want


def test_format_hint(spark):
    assert one(spark, S.format_hint(*lit("AADHAAR", "4821 6630 1979"))) == "#### #### ####"
    assert one(spark, S.format_hint(*lit("PAN", "ABCPR1234K"))) == "AAAAA####A"
    assert one(spark, S.format_hint(*lit("EMAIL", "a@b.in"))) is None


@pytest.mark.parametrize(
    "label, cls",
    [("Full name", "NAME"), ("Username", "USERNAME"), ("Pin code", "ADDRESS"), ("UPI PIN", "SECRET"), ("Enter OTP", "SECRET"), ("Aadhaar number", "AADHAAR"), ("Date of birth", "DOB"), ("Plan type", None), ("Expiry", "CARD"), ("Valid thru", "CARD"), ("E-mail", None), ("", None)],
)
def test_context(spark, label, cls):
    assert one(spark, S.class_from_context(F.lit(label))) == cls


def test_ocr_label_may_lack_spaces(spark):
    assert one(spark, S.class_from_ocr_label(F.lit("Dateof birth"))) == "DOB"
    assert one(spark, S.class_from_context(F.lit("Dateof birth"))) is None


@pytest.mark.parametrize("attribute, cls", [("current-password", "SECRET"), ("cc-number", "CARD"), ("cc-exp", "CARD"), ("given-name", "NAME"), ("off", None), (None, None)])
def test_autocomplete(spark, attribute, cls):
    assert one(spark, S.class_from_autocomplete(F.lit(attribute).cast("string"))) == cls


@pytest.mark.parametrize("path, want", [("/users/48213/profile", "/users/{id}/profile"), ("/u/ananya.rao@mail.in", "/u/{id}"), ("/u/ananya.rao%40mail.in", "/u/{id}"), ("/accounts/new", "/accounts/new"), ("/a//b/", "/a//b/"), ("/x/%zz", "/x/%zz"), ("/t/ABCPR1234K", "/t/{id}"), ("/h/deadbeef01", "/h/{id}"), ("/a+b", "/a+b")])
def test_path_template(spark, path, want):
    assert one(spark, S.path_template(F.lit(path), lambda s: F.size(D.detect_patterns(s)) > 0)) == want


@pytest.mark.parametrize("url, want", [("HTTPS://Ex.com:443/a", "https://ex.com"), ("http://ex.com:8080", "http://ex.com:8080"), ("http://u:p@Ex.com/", "http://ex.com"), ("nonsense", None), ("", None), (None, None)])
def test_origin(spark, url, want):
    assert one(spark, S.origin_of(F.lit(url).cast("string"))) == want


@pytest.mark.parametrize("dest, server, ok", [("https://p.example/v1", "https://p.example", True), ("https://q.example/v1", "https://p.example", False), ("http://p.example/v1", "http://p.example", False), ("http://localhost:8000/v1", "http://localhost:8000", True), ("x", "y", False)])
def test_destination(spark, dest, server, ok):
    assert one(spark, S.destination_allowed(*lit(dest, server))) is ok


@pytest.mark.parametrize("label, w, want", [("⟦NAME_1⟧", 70, 80), ("⟦NAME_1⟧", 150, 150), ("⟦NAME_1⟧", 158, 200), ("⟦SECRET_1⟧", 40, 120), ("⟦SECRET_1⟧", 90, 120), ("⟦AADHAAR_1⟧", 130, 160), ("⟦ADDRESS_1⟧", 900, 1400), ("REDACTED", 50, 60), ("IMAGE", 400, 400), ("⟦FACE_2⟧", 123, 123)])
def test_mask_width(spark, label, w, want):
    assert one(spark, S.mask_width(F.lit(label), F.lit(float(w)), F.lit(20.0))) == want


def test_blanked_tokens_keep_offsets(spark):
    assert one(spark, S.blanked_tokens(F.lit("a ⟦NAME_12⟧ b"))) == "a " + " " * 9 + " b"
    assert one(spark, S.tokens_in(F.lit("⟦NAME_12⟧ and ⟦VOTER_ID_1⟧ ⟦x_1⟧"))) == ["⟦NAME_12⟧", "⟦VOTER_ID_1⟧"]


def test_irreversible_lists_differ(spark):
    assert one(spark, S.irreversible(F.lit("Make payment"), "client")) and not one(spark, S.irreversible(F.lit("Make payment"), "server"))
    assert one(spark, S.irreversible(F.lit("Apply"), "server")) and not one(spark, S.irreversible(F.lit("Apply"), "client"))


def test_masks_and_timings(spark):
    assert one(spark, S.masks_opaque(F.array(F.array(F.lit(0), F.lit(16), F.lit(3))))) is True
    assert one(spark, S.masks_opaque(F.array(F.array(F.lit(0), F.lit(17), F.lit(3))))) is False
    assert one(spark, S.masks_opaque(F.lit(None).cast("array<array<int>>"))) is False
    assert one(spark, S.total_ms(F.create_map(F.lit("a"), F.lit(3), F.lit("b"), F.lit(4)))) == 7
