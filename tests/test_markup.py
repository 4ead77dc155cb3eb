"""Markup to text: goldens (white space squeezed before comparing)."""

import re
import time

import pytest
from pyspark.sql import functions as F

from corpusterms.functions import markup

def squeeze(s):
    return re.sub(r"\s+", " ", s).strip()


def run(spark, fn, cases):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "id int, raw string")
    got = {r.id: r.t for r in df.select("id", fn(F.col("raw")).alias("t")).collect()}
    return {i: squeeze(got[i]) for i in got}


WIKI = [
    ("== Sejarah ==\nTeks", "## Sejarah\nTeks"),
    ("'''Saluang''' ialah ''alat''", "Saluang ialah alat"),
    ("[[Muzik|muzik]] dan [[Sumatra]]", "muzik dan Sumatra"),
    ("a {{cite|x={{inner}}}} b", "a b"),
    ("a<ref>nota</ref> b<ref name=x/> c", "a b c"),
    ("[[Fail:x.png|thumb|[[a]] cap]] teks", "teks"),
    ("[http://x.y luar] dan [http://z.w]", "luar dan"),
    ("* satu\n# dua", "- satu\n- dua"),
    ('{| class="wikitable"\n|-\n| a\n|}\nlepas', "lepas"),
    ("__NOTOC__ teks <math>x^2</math> akhir", "teks akhir"),
    ("a <gallery>\nFail:x.jpg|kapsyen\n</gallery> b", "a b"),
    ("teks [[en:Saluang]] [[ms-arab:x]]", "teks"),
    ("{{a{{b{{c{{d{{e{{f{{g}}}}}}}}}}}}}} teks", "teks"),
    ("{{" * 50 + "x" + "}}" * 50 + " teks", "teks"),
    ("{| a {| b {| c |} |} |} teks", "teks"),
    ("a {{tak tutup b", "a {{tak tutup b"),
    ("a<ref>tak tutup", "a tak tutup"),
    ("[[Imej:x.png|" + "[[a|b]] " * 50 + "]] teks", "teks"),
]

OPENERS = [
    "[", "![", "<!-- ", "```\n", "~~~\n", "-", "> ", "- 1. ", "* a ", "_a ", "**a __b ", "`", "`` ` ", "[a](", "[a](b \"", "<a ",
    "<script>", "&amp", "\\", "[[Fail:", "[[", "{{", "{|", "<ref>", "== ", "='", "''", "* ", " ", "\t", "<", "</", "[http://a ",
]


def unended():
    """Half a megabyte of each opener, and rulers and captions of 100,000 characters."""
    texts = [u * (500_000 // len(u)) for u in OPENERS]
    texts += [c * 100_000 for c in "-=*_#>"] + ["[[Fail:x.png|" + "kapsyen " * 12_500 + "]]", "== " + " " * 100_000 + "x =="]
    return texts


@pytest.mark.parametrize("clean", [markup.wikitext_clean, markup.html_text, markup.squeeze_lines])
def test_openers_without_an_end_neither_crash_nor_stall(spark, clean):
    texts = unended()
    began = time.monotonic()
    df = spark.createDataFrame([(t,) for t in texts], "raw string").repartition(4)
    assert df.select(F.length(clean(F.col("raw"))).alias("n")).agg(F.count("n")).first()[0] == len(texts)
    assert time.monotonic() - began < 60


def test_wikitext_goldens(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(WIKI)], "id int, raw string")
    got = {r.id: r.t for r in df.select("id", markup.wikitext_clean(F.col("raw")).alias("t")).collect()}
    for i, (src, want) in enumerate(WIKI):
        norm = "\n".join(squeeze(x) for x in got[i].split("\n") if x.strip())
        assert norm == want, src


def test_html_text(spark):
    html = '<!DOCTYPE html><html><head><style>p{}</style><script>var t="</p>";</script></head><body><p>Satu <b>dua</b></p><!-- x --></body></html>'
    got = run(spark, markup.html_text, [(html, None)])
    assert got[0] == "Satu dua"


def test_front_matter_split(spark):
    df = spark.createDataFrame([("---\na: 1\n---\nbody",), ("no front",)], "raw string")
    got = df.select(markup.split_front_matter(F.col("raw")).alias("f")).collect()
    assert (got[0].f.meta, got[0].f.body) == ("a: 1", "body")
    assert (got[1].f.meta, got[1].f.body) == (None, "no front")


def test_squeeze_lines(spark):
    df = spark.createDataFrame([("  a  \n\n\n  b\t\n",)], "raw string")
    assert df.select(markup.squeeze_lines(F.col("raw")).alias("t")).first().t == "a\nb"
    df = spark.createDataFrame([("  a  \r\n　\nb c\x0b",)], "raw string")
    assert df.select(markup.squeeze_lines(F.col("raw")).alias("t")).first().t == "a\nb c"
