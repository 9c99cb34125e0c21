"""Text functions, HTML, sections and windows."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import windows as w
from corpusloom.functions.html import visible, visible_text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_tokens_match_python(spark):
    text = "Net 1,234.5% rose; naïve Q3 3.x İ 10.% a.b.c"
    assert one(spark, text, tx.tokens) == re.findall(r"[a-z0-9]+(?:[.,][a-z0-9]+)*%?", text.lower())
    assert one(spark, None, tx.tokens) == []


@pytest.mark.parametrize("raw", ["  a  b\t", "\x1cx\x1d y\x1f", "　", "", "plain", "a\n\nb "])
def test_white_space_is_unicode(spark, raw):
    assert one(spark, raw, tx.strip) == raw.strip()
    assert one(spark, raw, tx.collapse) == re.sub(r"\s+", " ", raw).strip()


@pytest.mark.parametrize("raw,wanted", [("418207", "0000418207"), (" cik0000418207 ", "0000418207"), ("CIK-9041", "0000009041"), ("123456789012", "123456789012")])
def test_cik(spark, raw, wanted):
    assert one(spark, raw, tx.cik10) == wanted


@pytest.mark.parametrize("bad", ["abc", "", "12x"])
def test_bad_cik_is_an_error(spark, bad):
    with pytest.raises(Exception, match="not a CIK"):
        one(spark, bad, tx.cik10)


def test_accession_and_urls(spark):
    assert one(spark, "000041820721000056", tx.accession_dashed) == "0000418207-21-000056"
    assert one(spark, "0000418207-21-000056", tx.accession_bare) == "000041820721000056"
    with pytest.raises(Exception, match="18-digit"):
        one(spark, "123", tx.accession_dashed)
    url = one(spark, "0000418207-21-000056", lambda a: tx.document_url("https://x/A/", F.lit("0000418207"), a, F.lit("/d.htm")))
    assert url == "https://x/A/edgar/data/418207/000041820721000056/d.htm"
    assert one(spark, "0000418207-21-000056", lambda a: tx.index_headers_url("https://x", F.lit("1"), a)).endswith("/0000418207-21-000056-index-headers.html")


@pytest.mark.parametrize("document,wanted", [("a b/../c d.htm", "A-c_d.html"), ("..\\..\\evil.txt", "A-evil.html"), ("???", "A-exhibit.html"), (None, "A-exhibit.html"), (".htm", "A-htm.html"), ("x.tar.gz", "A-x.tar.html")])
def test_stored_names_stay_in_their_folder(spark, document, wanted):
    assert one(spark, document, lambda d: tx.stored_name(F.lit("A"), F.lit("exhibit"), d, F.lit(".html"))) == wanted
    assert one(spark, document, lambda d: tx.stored_name(F.lit("A"), F.lit("primary"), d, F.lit(".html"))) == "A.html"


def test_small_predicates(spark):
    assert one(spark, "ex-99.1", lambda c: tx.is_exhibit_type(c, ["EX-99", " "])) and not one(spark, "EX-101.INS", lambda c: tx.is_exhibit_type(c, ["EX-99"]))
    assert one(spark, None, lambda c: tx.is_exhibit_type(c, ["EX-99"])) is False
    assert one(spark, "text/html; charset=x", lambda c: tx.allowed_type(c, ["text/html"])) and one(spark, None, lambda c: tx.allowed_type(c, ["text/html"]))
    assert not one(spark, "application/pdf", lambda c: tx.allowed_type(c, ["text/html"]))
    present = F.array(F.lit("99.1"), F.lit("10.2"))
    for label, wanted in (("99", True), ("99.1", True), ("9", False), ("10.1", False), ("10", True)):
        assert one(spark, label, lambda c: tx.label_present(c, present)) is wanted
    assert one(spark, "2024-1-5", tx.iso_date) is None and str(one(spark, "2024-01-05", tx.iso_date)) == "2024-01-05" and one(spark, "2024-13-05", tx.iso_date) is None
    assert one(spark, "EX-99.1", tx.exhibit_label) == "99.1"
    assert one(spark, "  query: x", lambda c: tx.starts_with_foreign(c, ["query:"]))


@pytest.mark.parametrize(
    "html,wanted",
    [
        ("<span>Part</span><span>IV</span>", "Part IV"),
        ("<i>wa</i>ter<u>fall</u>", "waterfall"),
        ("Row&#160;7</em></td><td>Cell", "Row 7 Cell"),
        ("a<td/>b<br>c", "a b c"),
        ("x<div style='color:red; DISPLAY : none'>hid<p>den</p></div>y", "x y"),
        ("x<script>var a='</p>';</script><style>p{}</style>y", "x y"),
        ("<div><p>one<p>two</div>three", "one two three"),
        ("a<ix:header>z<ix:hidden>q</ix:header>b", "a b"),
        ("</p>stray", "stray"),
        ("", ""),
        ("<head><title>t</title></head>body", "body"),
    ],
)
def test_visible_text(html, wanted):
    assert visible_text(html) == wanted
    assert visible_text(html.encode()) == wanted


def test_visible_bytes_and_column(spark):
    assert visible_text(b"caf\xe9 &amp; x") == "caf� & x" and visible_text(None) == ""
    assert visible_text("<b>x</b>y", frozenset()) == "x y"
    assert one(spark, "<p>a</p><p>b", visible) == "a b"


@given(st.text("ab. !?\n", max_size=80), st.integers(1, 20), st.integers(0, 19), st.booleans())
@settings(max_examples=150, deadline=None)
def test_char_windows_cover_and_end(text, size, overlap, snapped):
    if overlap >= size:
        with pytest.raises(ValueError):
            w.CharWindows(size, overlap)
        return
    cut = w.CharWindows(size, overlap, snapped).cut(text)
    if not text:
        assert cut == []
        return
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    for (a, b, n), (c, *_) in zip(cut, cut[1:], strict=False):
        assert n == b - a <= size and a < c <= b
    if snapped:
        for a, b, _ in cut[:-1]:
            assert b - a <= size


@given(st.text("ab. ,\n", max_size=80), st.integers(2, 12), st.integers(0, 11))
@settings(max_examples=100, deadline=None)
def test_token_windows_keep_their_overlap(text, size, overlap):
    if overlap >= size:
        return
    marks = w.word_offsets(text)
    cut = w.TokenWindows(size, overlap).cut(text)
    starts = {a: i for i, (a, _) in enumerate(marks)}
    at = [(starts[a], starts[a] + n) for a, _, n in cut]
    for (i, j), (k, _) in zip(at, at[1:], strict=False):
        assert k == max(i + 1, j - overlap)
    assert not marks or at[-1][1] == len(marks)


@pytest.mark.parametrize("size,overlap", [(0, 1), (-3, 0), (8, 8), (8, 21), (8, -2)])
def test_bad_windows(size, overlap):
    for make in (w.CharWindows, w.TokenWindows):
        with pytest.raises(ValueError):
            make(size, overlap)
    with pytest.raises(ValueError):
        w.windower("lines", 10, 1)


def test_plain_windows_are_the_unsnapped_ones(spark):
    rows = spark.createDataFrame([(n, "x" * n) for n in (0, 1, 9, 10, 11, 16, 17, 50)], "n int, t string")
    for r in rows.select("n", w.plain_windows(F.length("t"), 10, 4).alias("p"), w.cut_windows(F.col("t"), w.CharWindows(10, 4, False)).alias("c")).collect():
        assert [tuple(x) for x in r["p"]] == [tuple(x) for x in r["c"]], r["n"]


def twin(text, anchors, least, preamble, flags=re.I):
    """Sections by the definition, in plain Python."""
    hits = []
    for k, a in enumerate(anchors):
        for m in re.finditer(a["pattern"], text, flags):
            label = a["label"]
            if "{0}" in label:
                if not m.groups() or not m.group(1):
                    continue
                label = label.format(m.group(1).strip())
            hits.append((m.start(), k, label))
    hits.sort(key=lambda h: h[:2])
    edge = [h[0] for h in hits] + [len(text)]
    kept = [(p, lab) for i, (p, _, lab) in enumerate(hits) if edge[i + 1] - p >= least and (i == 0 or p - edge[i - 1] >= least)]
    if not text:
        return []
    if not kept:
        return [(preamble, 0, len(text))]
    out = [(preamble, 0, kept[0][0])] if kept[0][0] else []
    return out + [(lab, p, kept[i + 1][0] if i + 1 < len(kept) else len(text)) for i, (p, lab) in enumerate(kept)]


ITEMS = [{"label": "item_{0}", "pattern": r"item\s*(\d(?:\.\d\d)?)?"}, {"label": "end", "pattern": r"signatures?\s*$"}]


def test_sections_match_their_definition(spark):
    toc = "Item 1 a Item 2 b Item 3 c " + "x" * 300 + " ITEM 1 " + "y" * 250 + " item 2.02 " + "z" * 260 + " signatures"
    texts = ["", "nothing", toc, "Item 1" + "q" * 300, "\U0001f600 item 4 " + "r" * 220 + " item  " + "s" * 400, "item 1 " * 50]
    rows = spark.createDataFrame([(i, t, "8-K", "primary") for i, t in enumerate(texts)], "i int, text string, form string, doc_type string")
    for preamble in (None, "front"):
        for r in w.with_spans(rows, {"_default": ITEMS, "8-K": []}, 200, preamble).collect():
            assert [tuple(s) for s in r["spans"]] == twin(r["text"], ITEMS, 200, preamble), r["i"]


def test_anchor_lists_and_flags():
    lists = {"10-Q/primary": [], "10-Q": [{"label": "q", "pattern": "q"}], "_default": [{"label": "d", "pattern": "d"}]}
    assert w.anchors_for(lists, "10-Q", "primary")[0]["label"] == "q"
    assert w.anchors_for(lists, "8-K", None)[0]["label"] == "d" and w.anchors_for({}, "x", "y") == []
    assert w.flags_of(["ignorecase", "MULTILINE"]) == int(re.I | re.M)
    with pytest.raises(ValueError):
        w.flags_of(["LOUD"])
