"""Words found by themselves are those of the whole grammar."""

import random

from pyspark.sql import functions as F

from corpusterms.functions import tokens
from corpusterms.operators import terms


def test_words_are_those_of_the_lane(spark):
    rnd = random.Random(3)
    parts = ["a", "B", "9", "zz", "-", "--", " ", "\t", "\n", "\x85", " ", "　", "é", "ß", "١", "Ａ", "K", "中", "😀", "'", ".", "%", "{", "|", "{|", "|}", "_", "\x00", "’", "–"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 20))) for _ in range(3000)] + ["", None, "a-b-c", "-a-", "{|", "x{| y\nz|}é w"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "document long, text string")
    lane = F.array_remove(tokens.word_lane(F.col("text")), "")
    found = df.select("text", tokens.word_array(F.col("text")).alias("words"), lane.alias("lane")).collect()
    assert [r.text for r in found if r.words != r.lane] == []
    assert sum("{|" in (r.text or "") for r in found) > 100


def test_words_are_looked_for_without_the_other_tokens(spark):
    # Before, each space and mark was a match with an empty word, taken out again.
    df = spark.createDataFrame([(1, "satu, dua")], "document long, text string")
    plan = terms.term_stats(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "\\p{Alnum}+" in plan
    assert plan.count("\\p{Alnum}+(") == 1  # and once
