import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import boosting, bpe, pages, toxicity
from maskwright.llm.language import spectra
from maskwright.llm.textkernel import Words, arrow_bytes

TEXTS = st.lists(st.text(alphabet=st.sampled_from(list("ab é\n\t\x0b😀-")), max_size=30), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_and_windows(texts):
    import re

    data, offsets = arrow_bytes(pa.array(texts, pa.string()))
    w = Words(data, offsets, fold=False)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    got = [[bytes(data[a:b]).decode() for a, b in zip(w.starts[x:y], w.ends[x:y])] for x, y in zip(w.first, w.first[1:])]
    assert got == want
    flat = [x for ws in want for x in ws]
    assert len(set(flat)) == len(set(w.hashes.tolist()))
    h, ok = w.windows(3)
    windows = [tuple(ws[i : i + 3]) if i + 3 <= len(ws) else None for ws in want for i in range(len(ws))]
    assert [x is not None for x in windows] == ok.tolist()
    kept = [(x, int(y)) for x, y, o in zip(windows, h, ok) if o]
    assert len({x for x, _ in kept}) == len({y for _, y in kept}) == len(set(kept))
    same = {}
    for ws, s in zip(want, w.sequences().tolist()):
        assert same.setdefault(tuple(ws), s) == s
    assert len(set(same.values())) == len(same)


def test_nulls_and_slices_of_arrow_columns():
    col = pa.array(["ab", None, "", "c d"])[1:]
    data, offsets = arrow_bytes(col)
    assert bytes(data) == b"c d" and offsets.tolist() == [0, 0, 0, 3]
    assert Words(data, offsets, True).counts().tolist() == [0, 0, 2]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.vocabulary_path())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=st.sampled_from(list("ab '\n  1éñ😀<|endoftext|>")), max_size=80))
def test_bpe_equals_the_library(codec, text):
    from tokenizers import Tokenizer

    lib = codec.__dict__.setdefault("_lib", None) or codec.__dict__.__setitem__("_lib", Tokenizer.from_file(bpe.vocabulary_path())) or codec.__dict__["_lib"]
    ids = lib.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids
    assert codec.decode(ids) == lib.decode(ids, skip_special_tokens=False) == text
    assert codec.round_trip(text) == (",".join(map(str, ids)), len(ids), text)


def test_long_words_merge_alike(codec):
    rng = random.Random(1)
    for n in (250, 256, 257, 900):
        word = "".join(rng.choice("abcdet") for _ in range(n)).encode()
        long = [codec.ids[p] for p in codec._merged_long(word)]
        kept, bpe.SHORT = bpe.SHORT, 10_000
        short = codec.word_ids(word)
        bpe.SHORT = kept
        assert long == short


def test_spectra_hold_every_ngram():
    texts = ["Abc déf", "", "x" * 5000 + "yz", None]
    rows = np.concatenate([x for _, _, x in spectra(pa.array(texts, pa.string()))])
    alone = [np.concatenate([x for _, _, x in spectra(pa.array([t], pa.string()))])[0] for t in texts]
    assert all((a == b).all() for a, b in zip(rows, alone)) and rows[1].sum() == rows[3].sum() == 0 and rows[2].sum() == 12


def restorer():
    counts = np.zeros((toxicity.LETTERS,) * 3)
    for word in ["idiot", "moron", "stupid", "hello", "world", "moon"] * 50:
        x = [0, 0, *map(toxicity.letter, word), 0]
        for a, b, c in zip(x, x[1:], x[2:]):
            counts[a, b, c] += 1
    return toxicity.Restorer(toxicity.letter_costs(counts))


@pytest.mark.parametrize("token, word", [("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("s.t.u.p.i.d", "stupid"), ("id!ot", "idiot"), ("moon", "moon"), ("$tup1d", "stupid"), ("hello,", "hello"), ("world!!", "world")])
def test_restored_words(token, word):
    assert restorer().word(token)[0] == word


def test_spaced_letters_are_joined_and_plain_text_stays():
    r = restorer()
    assert "moron" in r.words("you m o r o n there")
    assert r.words("Hello, world") == {"hello", "world"}
    assert r.words("") == set() and "1234" in r.words("1234")


def sentences():
    r = restorer()
    counts = np.zeros((toxicity.LETTERS,) * 3)
    for text in ["idiot", "asshole", "scumbag", "ass", "hello", "you are a scumbag", "a stupid idiot", "you are a moron"] * 50:
        x = [0, 0, *map(toxicity.letter, text), 0]
        for a, b, c in zip(x, x[1:], x[2:]):
            counts[a, b, c] += 1
    return type(r)(toxicity.letter_costs(counts))


@pytest.mark.parametrize("text, words", [("you are a s c u m b a g", "scumbag"), ("a s t u p i d i d i o t", "stupid idiot"), (" ".join("youareascumbag"), "you are scumbag"), ("y o u  a r e  a  m o r o n", "you are moron"), (" ".join("youareastupididiot" * 9), "you are stupid idiot")])
def test_spaced_words_and_sentences_are_cut(text, words):
    assert set(words.split()) <= sentences().words(text)


@pytest.mark.parametrize("token, word", [("!diot", "idiot"), ("*sshole", "asshole"), ("(scumbag!)", "scumbag"), ("4$$", "ass"), ("@$$", "ass"), ("iiddiioott", "idiot"), ("s" + "t" * 60 + "upid", "stupid"), (".".join("youareastupididiot" * 3), "idiot"), ("stu" + "u" * 50 + "pid!", "stupid"), ("11dd110000tt", "idiot")])
def test_disguises_at_the_ends_without_letters_doubled_and_long(token, word):
    assert word in sentences().word(token)


def brute_viterbi(r, lattice):
    import itertools

    best = []
    for path in itertools.product(*lattice):
        text = "".join(p for p, _ in path)
        x = [0, 0, *map(toxicity.letter, text), 0]
        best.append((sum(c for _, c in path) + sum(r.flat[(a * toxicity.LETTERS + b) * toxicity.LETTERS + c] for a, b, c in zip(x, x[1:], x[2:])), text))
    return min(best)[1]


def test_viterbi_equals_brute_force():
    r = restorer()
    for token in ("1d10t", "m00n", "s+upid", "w0r1d", "h3ll0", "1!|1"):
        lattice = r.readings(token)
        assert r.best(lattice)[0] == brute_viterbi(r, lattice)


def test_boosting_learns_an_interaction():
    x = np.random.default_rng(0).random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fitted(x, y)
    assert ((model.raw(x) > 0) == y).mean() > 0.97


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>
<article><h1>Title &amp;&nbsp;more</h1><p><b>First  line,\n with words in it.<br>And a second one.<p>Another paragraph, of some length, with several words. It goes on.</p></article><div class="comments"><h3>Comments</h3><p>First!</p></div><footer>&copy; x &middot; y</footer>"""


def test_end_tags_of_head_and_option_may_be_left_out():
    body = PAGE[PAGE.index("<nav>") :]
    want = pages.main_texts([PAGE], pages.trained())[0]
    heads = ["<html><head><title>t</title><body>", "<head><meta charset=x><title>t</title><template><p>no</p></template><link rel=y>", "<head><title>t</title></head><body>", "<head><script>var a;</script>\n<body class=a>"]
    assert pages.main_texts([h + body for h in heads], pages.trained()) == [want] * len(heads)
    lists = ["<datalist><option value=a><option value=b></datalist>", "<datalist><option>one<b>two</b><option>three</datalist>", "<datalist><option>one</option></datalist>", "<div><option>one<div>two</div>three</div>", "<select><option>one<option>two</select>"]
    assert pages.main_texts(["<body>" + x + body for x in lists], pages.trained()) == [want] * len(lists)
    assert "one" not in str([pages.Page("<body>" + x + "<p>z").blocks for x in lists]) and pages.Page("<head><title>t</title>Text").blocks == [(0, "Text")]


def test_main_text():
    assert pages.main_texts([PAGE, "", "plain text only"], pages.trained()) == ["Title & more\n\nFirst line, with words in it. And a second one.\n\nAnother paragraph, of some length, with several words. It goes on.", "", "plain text only"]


PROSE = "The river rose in the night, and by morning the lower fields were under water. Nobody had expected it so early in the year."


def test_tables_and_lists_of_an_article_stay():
    inside = [
        ("<table><tr><th>Place</th><td>Depth</td></tr><tr><th>Mill</th><td>2 m</td></tr></table>", ["Place", "Depth", "Mill", "2 m"]), ("<table><thead><tr><th>Day</th></tr></thead><tbody><tr><td>Monday</td></tr></tbody></table>", ["Day", "Monday"]),
        ("<dl><dt>Weir</dt><dd>A low dam over a river.</dd></dl>", ["Weir", "A low dam over a river."]), ("<ol><li>Leave the house.</li><li>Go up the hill.</li></ol>", ["Leave the house.", "Go up the hill."]), ("<pre>gauge one  two</pre>", ["gauge one two"]),
        ("<figure><img src=a><figcaption>The mill in the flood.</figcaption></figure>", ["The mill in the flood."]),
    ]
    sources = [f"<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>The flood</h1><p>{PROSE}</p>{x}<p>{PROSE}</p></article><footer>&copy; us</footer></body>" for x, _ in inside]
    assert pages.main_texts(sources, pages.trained()) == ["\n\n".join(["The flood", PROSE, *blocks, PROSE]) for _, blocks in inside]


def test_pages_of_plain_text_stay():
    sources = [PROSE, f"{PROSE}<br>{PROSE}", "one", "  a  b\n c ", f"<html><body>{PROSE}</body></html>"]
    assert pages.main_texts(sources, pages.trained()) == [PROSE, f"{PROSE} {PROSE}", "one", "a b c", PROSE]


def test_what_is_nested_in_a_picture_is_no_text():
    sources = [f"<article><p>{PROSE}</p>{x}<p>{PROSE}</p></article>" for x in ("<svg><g><svg><text>in</text></svg><text>out</text></g></svg>", "<svg><svg/><text>x</text></svg>", "<template><p>a<template><p>b</template><p>c</template>", "<math><mi>x</mi></math>")]
    assert pages.main_texts(sources, pages.trained()) == [f"{PROSE}\n\n{PROSE}"] * 4


@pytest.mark.parametrize("piece", ['<p "', "<p '", '<p a="', "<p a='\"", "<p x='>", "<![CDATA[", "<!", "<?x", "<!--", "<a", "<svg>", "<option>", "<div a=", "</", "<p =\t "])
def test_pages_are_read_in_linear_time(piece):
    import time

    began = time.process_time()
    pages.Page(piece * ((1 << 20) // len(piece)))
    assert time.process_time() - began < 6


def test_quotes_hide_what_ends_a_tag_only_in_values():
    of = lambda s: [b for _, b in pages.Page(s).blocks]
    assert of('<p title="a > b">x</p>') == ["x"] and of("<p title = 'a > b'>x</p>") == ["x"] and of('<p it"s>x</p>') == ["x"]
    assert of('<p title="a>x</p><p>y</p>') == ["x", "y"] and of("<![CDATA[a<b]]>c") == ["a<bc"] and of("a <p") == ["a <p"]


def test_held_out_sample_pages():
    rng, right = random.Random(12345), 0
    for _ in range(150):
        source = pages.sample_page(rng)
        page = pages.Page(source)
        want = "\n\n".join(t for node, t in page.blocks if page.truth[node] == 1)
        right += pages.main_texts([source], pages.trained()) == [want]
    assert right >= 120


def test_decoding_is_the_likeliest_consistent_labelling():
    import itertools
    import math

    rng = np.random.default_rng(3)
    page = pages.Page("<div>a<p>b</p><div><p>c</p></div></div><p>d</p>")
    for _ in range(30):
        odds = rng.normal(0, 2, len(page.tag))
        got = page.main_nodes(odds)

        def value(labels):
            total = 0.0
            for i, x in enumerate(labels):
                up = labels[page.parent[i]] if i else "o"
                if up == "s" and x != "s" or up == "m" and x == "o":
                    return -math.inf
                yes = -math.log1p(math.exp(-odds[i]))
                side = yes - odds[i]
                total += yes if x == "m" else side if x == "s" else (-0.8 if i else 0.0) + (side if page.chars[i] else 0.0)
            return total

        best = max(itertools.product("oms", repeat=len(page.tag)), key=value)
        assert got == [x == "m" for x in best]


def test_digest_of_ids(codec):
    ids, n, text = codec.round_trip("hello")
    assert hashlib.sha256(ids.encode()).hexdigest() == hashlib.sha256(b"31373").hexdigest() and n == 1 and text == "hello"


@pytest.mark.parametrize(
    "html",
    [
        "<body><div><button>Menu</div><article><p>{}</p></article></body>",
        "<body><button>Menu<article><p>{}</p></article></body>",
        "<body><div><select><option>a<option>b</div><article><p>{}</p></article></body>",
        "<body><select><option>a<article><p>{}</p></article></body>",
        "<body><!-- note --!><article><p>{}</p></article></body>",
        "<body><!--><article><p>{}</p></article><!-- x --></body>",
        "<body><div><video><source src=a>no video</div><article><p>{}</p></article></body>",
        "<body><button><div>a</div><span>b</button><article><p>{}</p></article></body>",
        "<head><title>x</title><article><p>{}</p></article>",
    ],
)
def test_pages_whose_elements_are_not_ended(html):
    text = "The river rose in the night, and by morning the lower fields were under water. Nobody had expected it so early in the year."
    page = pages.Page(html.format(text))
    assert [b for _, b in page.blocks if "river" in b] == [text] and not any("Menu" in b or b in ("a", "b", "no video", "ab") for _, b in page.blocks)


def test_deeply_nested_pages():
    page = pages.Page("<div>" * 3000 + "<p>The end of it all, at last.</p>" + "</div>" * 3000)
    assert [b for _, b in page.blocks] == ["The end of it all, at last."]
    assert len(page.features()) == len(page.tag)


def test_letters_that_look_alike():
    made = toxicity.Restorer(np.ones((toxicity.LETTERS,) * 3))
    assert "idiot" in made.word("\u0456di\u043et") and "moron" in made.word("m\u03bfr\u043en")
    assert made.word("\u0445\u043e\u0440") == ("\u0445\u043e\u0440",)  # a word of one script stays
