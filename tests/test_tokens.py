"""Token grammar: goldens and a brute-force property check."""

import random

import pytest
from pyspark.sql import functions as F

from corpusterms.functions.tokens import PUNCT_CHARS, token_array, token_kind, word_array
from corpusterms.operators import tokens as T

# Goldens (white space already dropped); kind: t text, p punct, o omit.
GOLDEN = [
    ("a-b-c", [("a-b", "t"), ("-", "p"), ("c", "t")]),
    ("a--b", [("a", "t"), ("-", "p"), ("-", "p"), ("b", "t")]),
    ("2020-01-02", [("2020-01", "t"), ("-", "p"), ("02", "t")]),
    ("0.5", [("0", "t"), (".", "p"), ("5", "t")]),
    ("x_y q?", [("x", "t"), ("_", "o"), ("y", "t"), ("q", "t"), ("?", "o")]),
    ("Café", [("Caf", "t"), ("é", "o")]),
    ("é-a", [("é", "o"), ("-", "p"), ("a", "t")]),
    ("a-é", [("a", "t"), ("-", "p"), ("é", "o")]),
    ('{| class="w" | A-b ! c # tail', [('{| class="w" | A-b ! c ', "p"), ("#", "o"), ("tail", "t")]),
    ("{|", [("{|", "p")]),
    ("kata ganda", [("kata", "t"), ("ganda", "t")]),
    ("kata​ganda", [("kata", "t"), ("​", "o"), ("ganda", "t")]),
    ("", []),
    ("   \n\t ", []),
]
KIND = {"t": "text", "p": "punct", "o": "omit"}


def test_token_goldens(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "id int, text string")
    got = df.select("id", token_array(F.col("text")).alias("toks")).orderBy("id").collect()
    for row, (text, want) in zip(got, GOLDEN):
        assert row.toks == [w for w, _ in want], text
    kinds = (
        df.select("id", F.explode(token_array(F.col("text"))).alias("tok"))
        .select("id", "tok", token_kind(F.col("tok")).alias("kind"))
        .collect()
    )
    by_id = {}
    for r in kinds:
        by_id.setdefault(r.id, []).append((r.tok, r.kind))
    for i, (text, want) in enumerate(GOLDEN):
        assert by_id.get(i, []) == [(w, KIND[k]) for w, k in want], text


# --- brute force: the grammar as an ordered choice, one position at a time ---
ALNUM = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
ASCII_WS = set(" \t\r\n")
PUNCT = set(PUNCT_CHARS)


def _alnum_run(s, i):
    j = i
    while j < len(s) and s[j] in ALNUM:
        j += 1
    return j


def brute_tokens(s):
    out, i = [], 0
    while i < len(s):
        if s.startswith("{|", i):
            j = i + 2
            while j < len(s) and (s[j] in ALNUM or s[j] in ASCII_WS or s[j] in PUNCT):
                j += 1
        elif s[i] in ALNUM:
            j = _alnum_run(s, i)
            if j < len(s) and s[j] == "-" and j + 1 < len(s) and s[j + 1] in ALNUM:
                j = _alnum_run(s, j + 1)
        elif s[i] in ASCII_WS:
            j = i
            while j < len(s) and s[j] in ASCII_WS:
                j += 1
        else:
            j = i + 1
        out.append(s[i:j])
        i = j
    return [t for t in out if t.strip() != ""]


def test_tokens_match_brute_force(spark):
    rng = random.Random(7)
    alphabet = list("aZ09-- .,;:{|}'’–_?#é ​\n\t　x")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.toks for r in df.select("id", token_array(F.col("text")).alias("toks")).collect()}
    words = {r.id: r.w for r in df.select("id", word_array(F.col("text")).alias("w")).collect()}
    for i, t in enumerate(texts):
        want = brute_tokens(t)
        assert got[i] == want, repr(t)
        assert words[i] == [x for x in want if x[0] in ALNUM], repr(t)


def test_tokens_operator_positions(spark, corpus):
    df = T.tokens(corpus(("d", "Saluang, alat. x")))
    rows = [(r.pos, r.token, r.kind) for r in df.orderBy("pos").collect()]
    assert rows == [(0, "Saluang", "text"), (1, ",", "punct"), (2, "alat", "text"), (3, ".", "punct"), (4, "x", "text")]


def test_has_words_is_exact(spark):
    from corpusterms.functions.tokens import has_words

    rng = random.Random(11)
    alphabet = list("aZ9-{|}é ​.,#\n")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    texts += ["{| a b", "x {| a", "{|", "", "é", "{| é a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = df.select("id", has_words(F.col("text")).alias("h"), (F.size(word_array(F.col("text"))) > 0).alias("w"))
    bad = [(texts[r.id], r.h, r.w) for r in got.collect() if r.h != r.w]
    assert not bad


def test_corpus_is_dealt_anew_only_on_request(spark):
    from corpusterms.sources.tables import documents_corpus

    base = "/root/testdata/sf0.001"
    assert documents_corpus(spark, base).rdd.getNumPartitions() == 1
    assert documents_corpus(spark, base, partitions=5).rdd.getNumPartitions() == 5


WHITE = set("\t\n\x0b\x0c\r \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}


def _strip_ws(s):
    return "".join(ch for ch in s if ch not in WHITE)


def test_properties_hypothesis(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    from corpusterms.operators import terms

    alphabet = st.sampled_from(list("aB7-{|}., é_\n\t\xa0​’–xyz"))

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text(alphabet=alphabet, max_size=30), min_size=1, max_size=40))
    def check(texts):
        df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "document string, text string")
        toks = {r.document: r.t for r in df.select("document", token_array(F.col("text")).alias("t")).collect()}
        occ = {r.document: r.s for r in terms.term_info(df).groupBy("document").agg(F.sum("occurence").alias("s")).collect()}
        for i, t in enumerate(texts):
            d = str(i)
            assert _strip_ws("".join(toks[d])) == _strip_ws(t)
            assert occ.get(d, 0) == sum(1 for x in toks[d] if x[0] in ALNUM)

    check()
