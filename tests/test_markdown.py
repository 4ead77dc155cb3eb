"""Markdown to text: goldens (white space squeezed before comparing), chunks, long documents."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusterms.functions import commonmark
from corpusterms.operators import markdown

from .test_markup import unended

MD = [
    ("# Kepala\n\nTeks **tebal** akhir.", "Kepala Teks tebal akhir."),
    ("a*b*c", "a b c"),
    ('Lihat [pautan](http://a.b "t") ini', "Lihat pautan ini"),
    ('![alt](i.png "tajuk")', "tajuk"),
    ('[lab]: http://x "def"', "lab def"),
    ("```\nkod\n```\n", ""),
    ("teks `kod` akhir", "teks akhir"),
    ("---\ntitle: x\n---\nbadan", "badan"),
    ("+++\ntitle = 1\n+++\nbadan", "badan"),
    ("para <b>html</b> akhir", "para html akhir"),
    ("> petikan\n> lagi", "petikan lagi"),
    ("- satu\n- dua\n1. tiga", "satu dua tiga"),
    ("Tajuk\n=====\n\n***\n", "Tajuk"),
    ("AT&amp;T &lt;x&gt;", "AT&T <x>"),
    ("<!-- komen --> teks", ""),  # an HTML block: the whole line
    ("ini <!-- komen --> teks", "ini teks"),
    ("lihat [teks][r] lagi", "lihat [teks][r] lagi"),
    ("lihat [teks][r] lagi\n\n[r]: x", "lihat teks lagi r"),
    ("di <https://a.b/c> sana", "di https://a.b/c sana"),
    ("a\n<script>var x = 1;</script>\nb", "a b"),
    # inside a paragraph only the tags are raw HTML; at a line's start it is a block
    ("a <pre>kod\nblok</pre> b", "a kod blok b"),
    ("a\n<pre>kod\nblok</pre>\nb", "a b"),
    ("satu _dua tiga_ empat", "satu dua tiga empat"),
    ("nama_fail kekal", "nama_fail kekal"),
    ("<div class='x'>\nteks dalam\n</div>\n\nluar", "luar"),
    ("para <div>x</div> akhir", "para x akhir"),
    ("a \\*b\\* c", "a *b* c"),
    ("\\# bukan tajuk", "# bukan tajuk"),
    ("x \\. y \\[a\\](b)", "x . y [a](b)"),
    ("2 * 3", "2 * 3"),
    ("a__b", "a__b"),
    ("foo*** bar", "foo*** bar"),
    ("***bold it*** x", "bold it x"),
    ("**a *b* c**", "a b c"),
    ("tahun itu\n1998. lalu", "tahun itu 1998. lalu"),
    ("tahun itu\n1. lalu", "tahun itu lalu"),
    ("10) x\n11) y", "x y"),
    (" x", " x"),
    ("```\nkod\nlagi", ""),
    ("para\n\n    kod\n\nlagi", "para lagi"),
    ("para\n    bukan kod", "para bukan kod"),
    ("&copy; &#65; &#x42; &eacute; &bogus;", "© A B é &bogus;"),
    ("- a\n\n      kod\n\n  b\n- c", "a b c"),
    ("> > a\n> > b\n> c", "a b c"),
    ("* * *\nx", "x"),
    ("# x ##", "x"),
    ("``a ` b`` c", "c"),
    ("![a [b](c)](d) e", "e"),
    ("[a](<b c> 'd') e", "a e"),
]



def squeeze(s):
    return re.sub(r"\s+", " ", s).strip()


def read(spark, texts, chunk=markdown.CHUNK):
    df = spark.createDataFrame(list(enumerate(texts)), "document int, text string").repartition(3)
    got = {r.document: r.text for r in markdown.markdown_text(df, chunk).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("chunk", [markdown.CHUNK, 5])
def test_goldens(spark, chunk):
    for (source, want), got in zip(MD, read(spark, [m[0] for m in MD], chunk), strict=True):
        assert squeeze(got) == want, source


# What a document leaves open at a cut: the text between must not be read as text.
CARRIED = [
    ("```\n# a\n\nb\n- c\n\nd\n```\n# e", "e"),
    ("````\n# a\n```\n# b\n`````\n# c", "c"),
    ("~~~\n# a\n```\n# b\n~~~\n# c\n```\n# d", "c"),
    ("<!-- x\n# a\n\nb -->\n# c", "c"),
    ("<script>\n# a\n\nb\n</script>\n# c", "c"),
    ("<div>\n# a\n- b\n\n# c", "c"),
    ("<?\n# a\n<!--\n# b\n?>\n# c\n-->\n# d", "c --> d"),
    ("- a\n\n  ```\n  x\n# b\n```\n# c", "a b"),
    ("> ```\n> x\n\ny [l]\n\n- z [L][]\n\n[l]: u 'T'\n", "y l z L l T"),
    ("see [one two]\n\n# x\n\n[One\nTwo]: u\n", "see one two x One Two"),
    ("see [one]\n\n```\n\n[one]: u\n```\n# y", "see [one] y"),
]


@pytest.mark.parametrize("chunk", [markdown.CHUNK, 1, 12])
def test_what_is_open_at_a_cut_is_carried(spark, chunk):
    for (source, want), got in zip(CARRIED, read(spark, [c[0] for c in CARRIED], chunk), strict=True):
        assert squeeze(got) == want, source


def test_chunks_of_any_size_give_the_same(spark):
    rnd = random.Random(8)
    bits = ["a", "b c", "# h", "> ", "- ", "1. ", "    code", "\t", "\n", "\n", "\n\n", "\n\n", "```\n", "~~~\n", "<div>\n"]
    bits += ["<!-- ", "-->", "</script>", "<script>", "***", "---", "[l]: x 'T'\n", "[l]", "*e*", "`g`", "  ", "\r\n", "\x00"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(60))) for _ in range(300)]
    whole = read(spark, texts)
    for chunk in (1, 17):
        assert read(spark, texts, chunk) == whole


def test_a_long_document_is_read_by_many_tasks(spark):
    part = "# Title {i}\n\nSome *words* of [link {i}] and `code`.\n\n```\n# not text {i}\n\n- nor this\n```\n\n- item {i}\n\n"
    text = "".join(part.format(i=i) for i in range(3000)) + "[link 7]: http://x 'seven'\n"
    df = spark.createDataFrame([(1, text), (2, "short [link 7]"), (3, None), (4, "")], "document int, text string")
    got = {r.document: r.text for r in markdown.markdown_text(df, 2000).collect()}
    want = []
    for i in range(3000):
        link = "link 7" if i == 7 else f"[link {i}]"
        want += [f"Title {i}", f"Some words of {link} and .", f"item {i}"]
    assert got == {1: "\n".join([*want, "link 7 seven"]), 2: "short [link 7]", 3: "", 4: ""}


def test_the_chunks_of_one_document_are_dealt_over_tasks(spark, monkeypatch):
    df = spark.createDataFrame([(1, "# a\n\nsome *words*\n\n" * 3000)], "document int, text string")
    dealt = []
    real = markdown.stored
    monkeypatch.setattr(markdown, "stored", lambda x: dealt.append(x) or real(x))
    parts = markdown.markdown_chunks(df, 500).where("document = 1")
    sizes = [r[0] for r in dealt[0].groupBy(F.spark_partition_id()).agg(F.sum(F.length("source"))).select("sum(length(source))").collect()]
    assert len(sizes) == 8 and max(sizes) < 0.3 * sum(sizes)
    # What a Python call gets is a chunk's blocks, never the document's.
    assert parts.agg(F.max(F.length("text"))).first()[0] < 1000


def test_rows_of_one_name_stay_apart(spark):
    long = "# a\n\nb\n\n" * 100
    df = spark.createDataFrame([(1, long), (1, long + "# c"), (1, "x"), (1, "x")], "document int, text string")
    got = sorted(r.text for r in markdown.markdown_text(df, 50).collect())
    assert got == sorted(["a\nb\n" * 99 + "a\nb", "a\nb\n" * 100 + "c", "x", "x"])


def test_openers_without_an_end_neither_crash_nor_stall(spark):
    texts = unended()
    began = time.monotonic()
    assert len(read(spark, texts)) == len(texts)
    assert time.monotonic() - began < 120


@pytest.mark.parametrize("unit", ["*a_b**c__ ", "**a_", "*a **b _c __d ", "_a*", "a**b*", "*_"])
def test_interleaved_emphasis_is_matched_in_linear_time(unit):
    took = []
    for size in (50_000, 200_000):
        began = time.process_time()
        commonmark.inline_text(unit * (size // len(unit)), set())
        took.append(time.process_time() - began)
    assert took[1] < 3 and took[1] < 12 * took[0] + 0.2


def test_containers_beyond_the_bound_are_text(spark):
    got = read(spark, ["> " * 100 + "a", "> " * 150 + "a", "- " * 100 + "b"])
    assert squeeze(got[0]) == "a" and squeeze(got[1]).count(">") == 50 and squeeze(got[2]) == "b"
