import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusterms.llm import fm_index, spelling
from corpusterms.llm.queries import QUERIES

from .conftest import SF

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary(texts, least_chars=5, least=3, every=97):
    counts = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UP, LOW))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least_chars:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


def brute_near(words):
    """Words that share a deletion are the only candidates."""
    by = {}
    for w in words:
        for cut in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(cut, []).append(w)
    near = {w: set() for w in words}
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    return near


def brute(words):
    near, form = brute_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def family(rnd, size, letters="abc", length=(5, 9)):
    return sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(*length))) for _ in range(size)})


@pytest.mark.parametrize("seed", range(8))
def test_index_counts_occurrences_in_both_directions(seed):
    rnd = random.Random(seed)
    words = family(rnd, 30, "abé", (1, 6))
    index = fm_index.Index(words)
    joined = "\0" + "".join(w + "\0" for w in words)
    code = {c: i for i, c in enumerate("\0" + "".join(map(chr, index.alphabet)))}
    for _ in range(100):
        i = rnd.randrange(len(joined))
        part = joined[i : i + rnd.randint(1, 5)]
        want = sum(joined.startswith(part, j) for j in range(len(joined)))
        for half, letters in ((index.left, part[::-1]), (index.right, part)):
            lo, hi = np.array([0]), np.array([len(joined) + 1])
            for c in letters:
                lo, hi, _ = half.extend(np.array([code[c]]), lo, hi)
            assert hi[0] - lo[0] == want


@pytest.mark.parametrize("seed", range(30))
def test_search_scheme_finds_every_word_one_edit_away(seed):
    rnd = random.Random(seed)
    words = family(rnd, rnd.choice([2, 50, 400]), rnd.choice(["a", "ab", "abcdefgé"]), rnd.choice([(5, 6), (1, 7), (5, 60)]))
    index, near = fm_index.Index(words), brute_near(words)
    length = index.lengths
    every = np.arange(len(words))
    fore, _ = index.near(every, length // 2, length * 0, False)
    back, _ = index.near(every, length * 0, length - length // 2, True)
    found = {w: set() for w in words}
    for a, b in [*fore.tolist(), *back.tolist()]:
        found[words[a]].add(words[b])
    assert found == near


def test_long_runs_of_one_letter():
    words = ["a" * n for n in (3000, 3001, 3002, 3005)] + ["a" * 1500 + "b" + "a" * 1500]
    index = fm_index.Index(sorted(words))
    length = index.lengths
    fore, _ = index.near(np.arange(5), length // 2, length * 0, False)
    assert len({tuple(p) for p in fore.tolist()}) == 2 + 2 + 4  # also 3000 and 3001 with the b


def test_query_by_definition(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(vocabulary(texts))
    assert got(QUERIES["op11_spelling"](spark, SF)) == want
    assert len(want) > 1000 and sum(r[1] is not None for r in want) > 10


def test_awkward_rows(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(spelling.variants(documents, every=97)) == brute(vocabulary(rows))
    assert got(spelling.variants(documents, least=1, every=3)) == brute(vocabulary(rows, least=1, every=3))
    assert got(spelling.variants(documents.limit(0))) == []


@pytest.mark.parametrize("crowd", [10**9, 200, 1])
def test_crowded_halves_are_halved_again(spark, crowd):
    rnd = random.Random(7)
    words = family(rnd, 150, "ab", (5, 8)) + ["common" + w for w in family(rnd, 150, "ab", (4, 9))]
    words += [w + "ending" for w in family(rnd, 100, "ab", (4, 9))]
    counts = {w: rnd.randrange(1, 40) for w in words}
    text = " ".join(w for w, n in counts.items() for _ in range(n))
    df = spark.createDataFrame([(1, text), (None, None), (2, "")], "doc_id long, text string")
    want = brute(vocabulary([(1, text)], least=1, every=10**10))
    assert got(spelling.variants(df, least=1, every=None, shard=500, crowd=crowd)) == want
    assert any(r[2] not in (r[0], r[1]) for r in want)  # some chains are longer than a step


def test_long_texts_are_read_in_slices(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 10)
    text = "Hällo wörld’s hello-hallo HALLO hello ÀÿÖ÷× hallo " * 30
    df = spark.createDataFrame([(5, text)], "doc_id long, text string")
    assert got(spelling.variants(df, every=2)) == brute(vocabulary([(5, text)], every=2))
