import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusterms.llm import language_id as L

from .conftest import SF


def table_of(texts):
    rows = Counter()
    shorter = {}
    for lang, text in texts:
        points = L._points(L.letters(text))
        for k in range(1, L.ORDER + 1):
            for i in range(len(points) - k + 1):
                gram = int(L.gram_hashes(points[i : i + k], k)[0])
                low = (int(L.gram_hashes(points[i : i + k - 1], k - 1)[0]), int(L.gram_hashes(points[i + 1 : i + k], k - 1)[0])) if k > 1 else (0, 0)
                rows[lang, k, gram] += 1
                shorter[k, gram] = low
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    cols = [(lang, k, signed(g), signed(shorter[k, g][0]), signed(shorter[k, g][1]), n) for (lang, k, g), n in rows.items()]
    return pa.table(dict(zip(["lang", "order", "gram", "context", "tail", "count"], map(list, zip(*cols)))))


def brute_probability(texts, alphabet, context, char):
    """Interpolated Kneser-Ney by the definition, on strings."""
    grams = {k: Counter(t[i : i + k] for t in texts for i in range(len(t) - k + 1)) for k in range(1, L.ORDER + 1)}

    def count(k, g):
        return grams[k][g] if k == L.ORDER else len({x[0] for x in grams[k + 1] if x[1:] == g})

    def p(k, ctx, c):
        if k == 0:
            return 1 / (alphabet + 1)
        n = {g: count(k, g) for g in grams[k]}
        ones, twos = sum(v == 1 for v in n.values()), sum(v == 2 for v in n.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        of = {g: v for g, v in n.items() if g[:-1] == ctx and v}
        mass = sum(of.values())
        low = p(k - 1, ctx[1:], c)
        return low if not mass else max(of.get(ctx + c, 0) - d, 0) / mass + d * len(of) / mass * low

    return p(len(context) + 1, context, char)


def test_probabilities_by_definition():
    texts = [("a", "abracadabra abra cada"), ("b", "cabbage bad cab")]
    m = L.fit(table_of(texts))
    alphabet = len(m.hashes[0])
    own = [L.letters(t) for lang, t in texts if lang == "a"]
    text = L.letters("cabra zz abad")
    points = L._points(text)
    grams = [L.gram_hashes(points, k) for k in range(1, L.ORDER + 1)]
    got = L._log_probabilities(m, grams, L.ORDER, np.arange(L.ORDER - 1, len(points)))
    for row, e in enumerate(range(L.ORDER - 1, len(text))):
        want = brute_probability(own, alphabet, text[e - L.ORDER + 1 : e], text[e])
        assert math.isclose(got[row][0], math.log(want), rel_tol=1e-4), (text[e - 3 : e + 1], got[row][0], math.log(want))


def test_probabilities_sum_to_one():
    m = L.fit(table_of([("a", "abracadabra abra cada"), ("b", "cabbage bad")]))
    for context in (" ab", "bra", "zzz"):
        total = 0.0
        for c in " abcrdgez":  # the alphabet, and one letter for all unknown ones
            points = L._points(context + c)
            grams = [L.gram_hashes(points, k) for k in range(1, L.ORDER + 1)]
            total += np.exp(L._log_probabilities(m, grams, L.ORDER, np.array([3]))[0][0])
        assert abs(total - 1) < 0.02, (context, total)


def test_slices_add_up(monkeypatch):
    m = L.fit(table_of([("a", "abracadabra abra cada"), ("b", "cabbage bad cab")]))
    text = L.letters("abba cadabra " * 20)
    whole, n = L.cross_entropies(m, text)
    for size in (1, 2, 7, 50):
        monkeypatch.setattr(L, "SLICE", size)
        again, k = L.cross_entropies(m, text)
        assert k == n and np.allclose(whole, again, rtol=1e-5)


def test_held_out_accuracy(spark):
    from corpusterms.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    got = QUERIES["op8_language_id"](spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 20 and np.mean([r.lang == r.lang_pred for r in got]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_awkward_rows(spark, documents):
    known = spark.read.parquet(f"{SF}/documents.parquet")
    models = L.train(known)
    got = L.identify(documents, models).select("row.*", "lang_pred", "accepted", "score").collect()
    assert len(got) == documents.count()
    for r in got:
        blank = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == blank and (not blank or not r.accepted)
    foreign = spark.createDataFrame([(1, "Это совсем другой язык, и букв таких модели не видели.")], "doc_id long, text string")
    assert not L.identify(foreign, models).first().accepted
    assert L.identify(documents.limit(0), models).collect() == []
    nothing = L.train(known.withColumn("lang", F.lit(None).cast("string")))
    assert nothing is None and {r.lang_pred for r in L.identify(documents, nothing).collect()} == {"und"}


def test_pipeline_form_keeps_clean_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = L.drop_unknown(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()


def test_every_label_is_learnt(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for i in range(60):  # each language has letters of its own, the last one a single row
        letters = [chr(0x4E00 + 12 * i + j) for j in range(12)]
        for _ in range(60 if i == 0 else 2 if i < 59 else 1):
            rows.append((len(rows), " ".join("".join(rnd.choices(letters, k=4)) for _ in range(40)), f"l{i:02}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    models = L.train(docs)
    assert models.languages == sorted({r[2] for r in rows})
    got = L.identify(docs, models).select("row.*", "lang_pred", "accepted").collect()
    assert len(got) == len(rows) and all(r.lang == r.lang_pred and r.accepted for r in got)
    assert L.drop_unknown(docs).count() == len(rows)
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert L.drop_unknown(nulls).count() == len(rows)


def test_languages_fitted_apart_are_as_fitted_together(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.limit(40).select("doc_id", "text")
    a, b = [
        sorted((r.row.doc_id, r.lang_pred, r.score, r.cross_entropy) for r in L.identify(some, L.train(docs, together=n)).collect())
        for n in (50, 1)
    ]
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert np.allclose([x[2:] for x in a], [x[2:] for x in b], rtol=1e-4)
