"""What reading markdown computes once, and what it does not look at twice."""

import re

from pyspark.sql import functions as F

from corpusterms.functions import blocks, commonmark
from corpusterms.operators import markdown
from corpusterms.plans import catalog


def _folds(df, over):
    plan = df._jdf.queryExecution().analyzed().toString()
    return len(re.findall(rf"aggregate\({over}#", plan))


def test_lines_are_folded_once(spark):
    df = spark.createDataFrame([(["# a", "b", "", "> c"],)], "lines array<string>")
    found = df.select(blocks.sources(blocks.read(F.col("lines"))).alias("s"))
    assert _folds(found, "lines") == 1  # before, 4
    assert found.first().s == ["a", "b", "c"]


def test_lines_behind_a_raw_block_are_folded_once(spark):
    df = spark.createDataFrame([(["a", "```", "b"],)], "lines array<string>")
    found = df.select(blocks.effect(F.col("lines")).alias("e"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(slice(") == 1  # before, one for each use of the state
    assert found.first().e.clean == ("`", 3, -1)


def test_plain_and_marked_pieces_stay_in_order(spark):
    pieces = ["a  b", "*c*", "d \te", "*c*", "", " ", "f &amp; g", "h i"]
    df = spark.createDataFrame([(pieces, [])], "pieces array<string>, labels array<string>")
    marked = commonmark.marked(F.col("pieces"))
    df = df.withColumn("marked", marked).withColumn("read", commonmark.texts(F.col("marked"), F.col("labels")))
    found = df.select("marked", markdown._assembled(F.col("pieces"), F.col("marked"), F.col("read")).alias("text")).first()
    assert found.marked == ["*c*", "*c*", "f &amp; g"]
    assert found.text == "a b\nc\nd e\nc\nf & g\nh i"


def test_long_texts_of_many_lines(spark):
    # More lines than a state holds, in one paragraph, in blocks, and in a quote.
    lines = [f"w{i}" for i in range(250)]
    texts = ["\n".join(lines), "\n\n".join(lines), "\n".join(f"> {w}" for w in lines), "a\r\nb\r\r\n\x00c", "+++\nx\n+++\n\ty\n\nz"]
    df = spark.createDataFrame(list(enumerate(texts)), "document long, text string")
    rows = {r.document: r.text for r in markdown.markdown_text(df).collect()}
    assert rows == {0: " ".join(lines), 1: "\n".join(lines), 2: " ".join(lines), 3: "a b\n�c", 4: "z"}


def test_single_spaces_are_kept(spark):
    df = spark.createDataFrame([(" a b  c\t d\n\ne \r",)], "text string")
    assert catalog._squeezed(df).first().text == "a b c d e"
