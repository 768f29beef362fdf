import numpy as np
from pyspark.sql import functions as F

from maskwright import queries
from maskwright.functions import fixed as X
from maskwright.operators import names, vision
from maskwright.operators.sanitize import sanitize
from maskwright.sources import dom, png, synth, wire

PAGE = """<title> My  page </title><body><h1>Profile</h1><label for=n>Full name</label><input id=n value="Ananya Rao" required><div>Email <input type=hidden value=x></div>
<input type=password value=secret aria-label="PIN"><select name=c><option>A<option selected>B c</select><button>Go <b>on</b></button><a href=/x><img alt="Home"></a>
<dl><dt>Date of birth<dd>12-08-1999</dl><p hidden>gone</p><script>var x="<p>no</p>"</script><p>Card 4111 1111 1111 1111</p><img width=100 height=100 alt="Photo of me"><svg width=20></svg></body>"""


def test_scan():
    got = dom.scan(PAGE)
    assert got["title"] == "My page"
    assert [(e["vid"], e["role"], e["label"], e["value"], e["hasValue"]) for e in got["elements"]] == [(1, "textbox", "Full name", "Ananya Rao", True), (2, "password", "PIN", "", True), (3, "combobox", "My page", "B c", True), (4, "button", "Go on", "", False), (5, "link", "Home", "", False)]
    assert [(r["vid"], r["kind"], r["alt"]) for r in got["rasters"]] == [(6, "img", "Home"), (7, "img", "Photo of me")]
    assert ("12-08-1999", "Date of birth") in [(t["text"].strip(), t["prev_label"]) for t in got["texts"]]
    assert not any("gone" in t["text"] or "no" == t["text"] for t in got["texts"])
    assert dom.scan("") == dom.scan(None) == {"title": "", "elements": [], "texts": [], "rasters": []}


def test_scan_finds_spans(spark):
    row = dom.scan_pages(spark.createDataFrame([(1, PAGE), (2, None)], "page_id int, html string")).where("page_id = 1").first()
    assert {(s.cls, s.value) for t in row.texts for s in t.spans} == {("DOB", "12-08-1999"), ("CARD", "4111 1111 1111 1111")}


def snapshot(spark):
    el = lambda vid, role, label, value="", has=False, **k: (vid, role, "input", k.get("type", "text"), label, value, has, k.get("placeholder", ""), "", "", k.get("autocomplete", ""), False, False, None, None, [0.0, 0.0, 10.0, 10.0], [1.0, 1.0, 9.0, 9.0])
    elements = [
        el(1, "textbox", "Full name", "Ananya Rao", True), el(2, "textbox", "Mail", "ananya.rao@mail.in", True, autocomplete="email"), el(3, "password", "Password", "", True, type="password"), el(4, "textbox", "Notes", "call +91 98450 12345 after 5", True),
        el(5, "button", "Continue as Ananya Rao"), el(6, "textbox", "Aadhaar", "", False, placeholder="#### #### ####"),
    ]
    texts = [(8, "Aadhaar: 4821 6630 1979", [0.0, 0.0, 5.0, 5.0], [("AADHAAR", 9, 23, "4821 6630 1979", True, None, "L1")])]
    rasters = [(7, "img", "Photo of Ananya Rao", [0.0, 0.0, 100.0, 100.0], None, None), (9, "img", "card", [0.0, 100.0, 200.0, 200.0], None, None)]
    return spark.createDataFrame([("p", "http://x", "http://x.example/accounts/new/48213?q=1", "Open account for Ananya Rao", [800, 600], 1.0, 1, elements, texts, rasters)], wire.SNAPSHOT)


def test_sanitize(spark):
    none = spark.createDataFrame([], wire.VISION)
    screens, vault = sanitize(snapshot(spark), none)
    s = screens.first()
    by = {e.id: e for e in s.elements}
    assert [by[i].value for i in (1, 2, 3, 4)] == ["⟦NAME_1⟧", "⟦EMAIL_1⟧", "⟦SECRET_1⟧", "call ⟦PHONE_1⟧ after 5"]
    assert by[5].label == "Continue as ⟦NAME_1⟧" and by[5].value is None and by[6].field_class == "AADHAAR"
    assert (s.origin, s.path_template, s.title) == ("http://x.example", "/accounts/new/{id}", "Open account for ⟦NAME_1⟧")
    assert s.texts[0].text == "Aadhaar: ⟦AADHAAR_1⟧" and s.state["class"] == "form"
    assert by[7].label == "Photo of ⟦NAME_1⟧" and by[7].masked and by[9].masked
    assert {m.label for m in s.masks} >= {"⟦NAME_1⟧", "⟦EMAIL_1⟧", "⟦SECRET_1⟧", "REDACTED", "⟦FACE_1⟧", "IMAGE"}
    assert "secret" not in str(vault.collect()) and {r.value for r in vault.where("cls = 'SECRET'").collect()} == {""}
    assert [m.id for m in s.marks] == [1, 2, 3, 4, 5, 6]
    again, more = sanitize(snapshot(spark), none, vault)
    assert {e.value for e in again.first().elements} == {e.value for e in s.elements} and more.count() == vault.count()


def test_sanitize_reads_image_lines(spark):
    line = lambda t, b: (t, b, [[b[0] + i, b[0] + i + 1.0] for i in range(len(t))])
    lines = [line("Dateof birth", [0.0, 100.0, 60.0, 110.0]), line("12-08-1999", [70.0, 100.0, 120.0, 110.0]), line("4821 6630 1979", [0.0, 150.0, 100.0, 160.0]), line("9845012345", [0.0, 170.0, 100.0, 180.0])]
    vision_rows = spark.createDataFrame([("p", "0,100,200,200", True, [[1.0, 101.0, 20.0, 120.0]], [[150.0, 150.0, 190.0, 190.0]], lines, None)], wire.VISION)
    screens, vault = sanitize(snapshot(spark), vision_rows)
    s = screens.first()
    assert [t.text for t in s.texts] == ["Dateof birth", "⟦DOB_1⟧", "⟦AADHAAR_1⟧", "⟦PHONE_1⟧", "Aadhaar: ⟦AADHAAR_1⟧"]
    assert {m.label for m in s.masks} >= {"⟦FACE_1⟧", "⟦QR_1⟧", "⟦DOB_1⟧", "⟦AADHAAR_1⟧", "⟦PHONE_1⟧"}
    assert {e.id: e.masked for e in s.elements}[9] is None


def test_made_up_pages_are_found(spark):
    keys = spark.range(60).select(F.col("id").alias("key"))
    made = synth.pages(synth.people(keys))
    scanned = dom.scan_pages(made.select("page", "html"), "page", "html")
    spans = scanned.select("page", F.explode("texts").alias("t")).select("page", F.explode("t.spans").alias("s")).select("page", F.col("s.cls").alias("class"), F.col("s.value").alias("value"))
    truth = made.select("page", F.explode("truth").alias("t")).where("t.field is null").select("page", "t.class", "t.value")
    got = {r["class"]: (r.labelled, r.recall, r.precision) for r in synth.score(truth, spans).collect()}
    assert got == {c: (20, 1, 1) for c in ("ADDRESS", "PHONE", "EMAIL", "NAME", "DOB", "AADHAAR", "CARD", "PAN")}
    fields = {(r.page, r.name): r.value for r in scanned.select("page", F.explode("elements").alias("e")).select("page", "e.name", "e.value").collect()}
    assert all(fields[r.page, r.t.field] == r.t.value for r in made.select("page", F.explode("truth").alias("t")).where("t.field is not null").collect())
    assert not spans.join(made.select("page", F.regexp_extract("html", r"\b1[0-9]{11}\b", 0).alias("nobody")), "page").where(F.instr(F.col("nobody"), F.regexp_replace("value", r"\D", "")) > 0).where("length(regexp_replace(value, '[^0-9]', '')) > 5").count()
    assert made.count() == 60 and made.select("template").distinct().count() == 3


def test_every_value_of_a_person_is_labelled_and_scored(spark, tmp_path):
    n = 300
    keys = spark.range(n).select(F.col("id").alias("key"))
    keys.select(F.col("key").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["class"]: r for r in queries.synth_score(spark, str(tmp_path)).collect()}
    once = n // 3  # on one of the pages that take turns
    labelled = {c: n + once for c in ("ADDRESS", "EMAIL", "DOB", "AADHAAR", "ACCOUNT", "IFSC", "CARD", "PAN")} | {"PHONE": 2 * n + once, "UPI": 2 * n + once, "NAME": 3 * n + once}
    assert {c: r.labelled for c, r in got.items()} == labelled
    assert {c: r.hit for c, r in got.items()} == labelled | {"NAME": 2 * n + once}  # no rule tells a first name alone
    assert got["NAME"].recall == 0.7 and all(r.recall == 1 for c, r in got.items() if c != "NAME") and all(r.precision == 1 for r in got.values())
    looks = {"ACCOUNT": 0, "PHONE": 0, "AADHAAR": 0, "CARD": 0}
    for a in [r.account for r in synth.people(keys).select("account").collect()]:
        check = 0
        for i, d in enumerate(reversed(a)):
            check = X.VERHOEFF_D[check][X.VERHOEFF_P[i % 8][int(d)]]
        doubled = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(a)))
        phone = len(a) == 11 and a[0] == "0" and a[1] > "5" or len(a) == 12 and a[:2] == "91" and a[2] > "5"
        looks["CARD" if len(a) == 14 and doubled % 10 == 0 else "AADHAAR" if len(a) == 12 and a[0] > "1" and check == 0 else "PHONE" if phone else "ACCOUNT"] += 1
    assert min(looks.values()) > 0
    assert {c: r.found for c, r in got.items()} == {c: m + looks.get(c, 0) - n * (c in ("ACCOUNT", "NAME")) for c, m in labelled.items()}


def test_claims_are_scanned_as_they_are_labelled(spark):
    made = synth.claims(synth.people(spark.range(30).select(F.col("id").alias("key"))))
    scanned = dom.scan_pages(made.select("page", "html"), "page", "html")
    fields = {(r.page, r.name): r.value for r in scanned.select("page", F.explode("elements").alias("e")).select("page", "e.name", "e.value").collect() if r.name}
    texts = {(r.page, r.text.strip()) for r in scanned.select("page", F.explode("texts").alias("t")).select("page", "t.text").collect()}
    facts = made.select("page", F.explode("truth").alias("t")).select("page", "t.*").collect()
    assert len(facts) == 30 * 15 and {(r.page, r.field): r.value for r in facts if r.field} == fields
    assert all((r.page, r.value) in texts or (r.page, f"Applicant: {r.value}") in texts for r in facts if not r.field)


def test_png_round_trip():
    img = np.random.default_rng(1).integers(0, 256, (7, 5, 4), dtype=np.uint8)
    assert (png.decode_png(png.encode_png(img)) == img).all()
    assert (png.decode_png(png.encode_png(img[..., :3]))[..., :3] == img[..., :3]).all()


def finder(img, x, y, m):
    for size, shade in ((7, 0), (5, 255), (3, 0)):
        a = (7 - size) * m // 2
        img[y + a : y + a + size * m, x + a : x + a + size * m, :3] = shade


def test_qr_codes():
    img = np.full((200, 220, 4), 255, np.uint8)
    for x, y in ((40, 40), (120, 40), (40, 120)):
        finder(img, x, y, 4)
    (box,) = vision.find_codes(img)
    assert box[0] <= 40 and box[1] <= 40 and box[2] >= 148 and box[3] >= 148
    img[40:68, 120:148, :3] = 255
    assert vision.find_codes(img) == []


def test_text_boxes_and_lines():
    prob = np.zeros((32, 64))
    prob[10:14, 5:25] = 0.9
    prob[20:22, 40:60] = 0.9  # too flat
    prob[4:9, 40:50] = 0.4  # too faint
    assert vision.text_boxes(prob, 1.0, 64, 32) == [[2, 7, 28, 17]]
    parts = vision.labelled(np.array([[1, 0, 1], [1, 1, 1], [0, 0, 0], [1, 0, 1]], bool))
    assert parts.tolist() == [[1, 0, 1], [1, 1, 1], [0, 0, 0], [2, 0, 3]]
    p = np.eye(4)[[0, 1, 1, 0, 1, 3]]
    line = vision.line_text(p, ["a", "b"], [0, 0, 60, 10])
    assert line["text"] == "aa " and line["chars"][0][0] == 0 and line["chars"][-1][1] == 60 and line["chars"][0][1] == line["chars"][1][0] == 30


def test_faces_are_suppressed_and_widened():
    out = {}
    for s in vision.FACE_STRIDES:
        n = (vision.FACE_SIDE // s) ** 2
        out |= {f"cls_{s}": np.zeros(n), f"obj_{s}": np.zeros(n), f"bbox_{s}": np.zeros((n, 4))}
    for i, score in ((10 * 20 + 10, 1.0), (10 * 20 + 11, 0.8)):
        out["cls_32"][i] = out["obj_32"][i] = score
        out["bbox_32"][i] = [0.5, 0.5, np.log(4), np.log(4)]
    (box,) = vision.face_boxes(out, 1.0, 640, 640)
    assert box == [246, 246, 426, 426]


def test_resize_keeps_constant_images():
    img = np.full((9, 7, 4), 77, np.uint8)
    assert (vision.resize(img, 20, 3) == 77).all() and vision.resize(img, 7, 9) is img


def test_character_list():
    entry = lambda k, v: bytes([10, len(k)]) + k + bytes([18, len(v)]) + v
    raw = b"\x08\x01" + b"".join(bytes([14 << 3 | 2, len(e)]) + e for e in (entry(b"other", b"x"), entry(b"character", b"a\nb")))
    assert vision.protobuf_strings(raw) == ["a", "b"]


VOCAB = names.read_vocabulary("[PAD]\n[UNK]\n[CLS]\n[SEP]\nann\n##a\nrao\n.\nmet\nx")


def test_pieces_and_segments():
    got = names.pieces("anna rao. zz x", VOCAB)
    assert [(p.id, p.start, p.end, p.word, p.stop) for p in got] == [(4, 0, 3, 0, False), (5, 3, 4, 0, False), (6, 5, 8, 1, False), (7, 8, 9, 2, True), (1, 10, 12, 3, False), (9, 13, 14, 4, False)]
    assert [len(s) for s in names.segments(got, 5)] == [4, 2]
    assert [len(s) for s in names.segments(names.pieces("anna anna anna", VOCAB), 3)] == [2, 2, 2]
    assert names.pieces("x" * 101, VOCAB)[0].id == 1


def test_names(spark):
    def model():
        def classify(ids, mask):
            out = np.zeros((*ids.shape, 9))
            out[..., 0] = 3
            out[ids == 4] = [0, 9, 0, 0, 0, 0, 0, 0, 0]
            out[ids == 6] = [0, 0, 9, 0, 0, 0, 0, 0, 0]
            return out

        return classify

    texts = spark.createDataFrame([("p", 0, "met anna rao. x rao"), ("p", 1, "x")], "snapshot_id string, ord long, text string")
    got = names.find_names(texts, VOCAB, model).collect()
    assert [(r.ord, r.value, r.start) for r in got] == [(0, "anna rao", 4), (0, "rao", 16)]
    rows = spark.createDataFrame([("p", i, t) for i, t in enumerate(["Ananya met Ravi in Pune " + "x" * 8000, "Asha met Ravi in Pune", "no names in here at all", "Too short"])], "snapshot_id string, ord long, text string")
    assert [r.ord for r in names.budgeted(rows).collect()] == [0]


def test_strict_schema(spark):
    raw = spark.createDataFrame([('{"session_id":"s","screen":{"x":1,"elements":[{"id":1,"q":2}]}}',), ("not json",), (None,)], "json string")
    got = wire.parsed_requests(raw).select("unknown", "missing", "schema_ok").collect()
    assert got[0].unknown == ["screen.x", "screen.elements[0].q"] and "goal" in got[0].missing and not any(r.schema_ok for r in got)


def test_settings():
    assert wire.read_settings({"paranoid": True}, {"terms": ["a"]}) == {"serverUrl": "http://localhost:8000", "terms": ["a"], "paranoid": True}


def test_images_as_rows(spark, tmp_path):
    from maskwright.sources import images

    img = np.random.default_rng(1).integers(0, 256, (4, 6, 4), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png.encode_png(img))
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = images.read_images(spark, str(tmp_path))
    got = {r.path[-5:]: (r.width, r.height, r.rgba) for r in images.decoded(rows).collect()}
    assert got == {"a.png": (6, 4, bytearray(img.tobytes())), "b.png": (None, None, None)}
    assert all(r.u.startswith("data:image/png;base64,") for r in rows.select(images.data_url(F.col("png")).alias("u")).collect())


def test_failed_vision_rows(spark):
    rows = spark.createDataFrame([("p", "k", bytearray(png.encode_png(np.full((9, 9, 4), 255, np.uint8))), True), ("p", "l", bytearray(b"x"), False)], "snapshot_id string, key string, png binary, analysed boolean")
    assert {r.key: (r.ok, r.error) for r in vision.analyse(rows).collect()} == {"k": (False, "models unavailable"), "l": (False, "too many images on screen")}

    def models():
        heads = {f"{n}_{s}": np.zeros((vision.FACE_SIDE // s) ** 2 * (4 if n == "bbox" else 1)) for s in vision.FACE_STRIDES for n in ("cls", "obj", "bbox")}
        return {"faces": lambda x: heads, "detect": lambda x: np.zeros((1, 1, *x.shape[2:])), "recognise": None, "keys": []}

    assert [(r.ok, r.faces, r.lines) for r in vision.analyse(rows.where("key = 'k'"), models).collect()] == [(True, [], [])]


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 5000 + "x user@mail.example" + "</div>" * 5000
    wide = "<ul>" + "".join(f"<li>{i}</li><input name=n{i}>" for i in range(3000)) + "</ul>"
    rows = spark.createDataFrame([(1, deep), (2, wide), (3, None), (4, "<div hidden><p>no</p></div><p>yes</p><svg width=100 height=100><svg width=100 height=100></svg></svg>")], "page_id int, html string")
    got = {r.page_id: r for r in dom.scan_pages(rows).collect()}
    assert [s.value for s in got[1].texts[0].spans] == ["user@mail.example"]
    assert len(got[2].texts) == 400 and len(got[2].elements) == 3000 and got[2].elements[1].label == "1"
    assert got[3].texts == [] and [t.text for t in got[4].texts] == ["yes"] and len(got[4].rasters) == 1


def test_time_budget_and_reading_back(spark):
    image = bytearray(png.encode_png(np.full((9, 9, 4), 255, np.uint8)))
    rows = spark.createDataFrame([("p", "a", image, True), ("p", "b", image, True), ("q", "a", image, True)], "snapshot_id string, key string, png binary, analysed boolean")

    def models():
        heads = {f"{n}_{s}": np.zeros((vision.FACE_SIDE // s) ** 2 * (4 if n == "bbox" else 1)) for s in vision.FACE_STRIDES for n in ("cls", "obj", "bbox")}
        return {"faces": lambda x: heads, "detect": lambda x: np.zeros((1, 1, *x.shape[2:])), "recognise": None, "keys": []}

    assert {(r.snapshot_id, r.key): r.error for r in vision.analyse(rows, models, seconds=0.0).collect()} == {("p", "a"): None, ("p", "b"): "time budget exceeded", ("q", "a"): None}
    assert [r.audit for r in vision.read_back(rows.selectExpr("1 AS id", "png").limit(1), models).collect()] == [[]]
    assert [r.audit for r in vision.read_back(rows.selectExpr("1 AS id", "png").limit(1)).collect()] == [None]


def test_only_passed_screens_are_written(spark, tmp_path):
    screens = spark.createDataFrame([("a",), ("b",), ("c",)], "snapshot_id string")
    wire.sanitized_only(screens, spark.createDataFrame([("a", True), ("b", False), ("c", None)], "id string, ok boolean"), str(tmp_path / "out"))
    assert [r.snapshot_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]


def test_names_come_before_all_else(spark):
    shot, none = snapshot(spark), spark.createDataFrame([], wire.VISION)
    new = spark.createDataFrame([("p", "http://x", 1, 5, "Rao")], "snapshot_id string, source string, ord long, start int, value string")
    screens, vault = sanitize(shot, none, names=new)
    s = screens.first()
    # a name found in prose is number one, the longer name of a field is another
    assert s.title == "Open account for ⟦NAME_2⟧" and {(r.token, r.value) for r in vault.where("cls = 'NAME'").collect()} == {("⟦NAME_1⟧", "Rao"), ("⟦NAME_2⟧", "Ananya Rao")}
    assert s.late is False
    vision_rows = spark.createDataFrame([("p", "k", True, [], [], [("line one", [0.0] * 4, [])], None)], wire.VISION)
    got = [(r.ord, r.text) for r in names.name_texts(shot, vision_rows).orderBy("ord").collect()]
    assert got == [(1, "Aadhaar: 4821 6630 1979"), (2, "Ananya Rao"), (3, "ananya.rao@mail.in"), (4, "call +91 98450 12345 after 5"), (5, "line one")]


def test_dictionary_hits_without_spans_are_told(spark):
    el = "Ananya Rao"
    shot = snapshot(spark).withColumn("texts", F.expr("transform(array('Hello Ananya Rao', 'x'), (t, i) -> named_struct('vid', 8 + i, 'text', t, 'bbox', array(0D, 0D, 5D, 5D), 'spans', array()))").cast(f"array<{wire.RAW_TEXT}>"))
    s = sanitize(shot, spark.createDataFrame([], wire.VISION))[0].first()
    assert s.late is True and el not in str(s)
