import random
import re
from collections import Counter, defaultdict

import pytest

from corpusterms.llm import ngram_join
from corpusterms.llm.components import components

from .conftest import same

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, k=5, percent=75):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    parent, links = list(range(len(rows))), Counter()

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x] if j > i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)], links[i]) for i, (d, _) in enumerate(rows)]


def test_awkward_rows(documents, rows):
    same(ngram_join.ngram_join(documents), brute(rows))


# 300: clusters are cut into blocks; common 6: shared passages skip the buckets
@pytest.mark.parametrize("block, common", [(1_000_000, 500_000), (300, 500_000), (1_000_000, 6), (300, 6)])
def test_families(spark, monkeypatch, block, common):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "REPEATED", 2)
    monkeypatch.setattr(ngram_join, "CHUNK", 3000)
    monkeypatch.setattr(ngram_join, "SCAN", 2000)
    monkeypatch.setattr(ngram_join, "BUCKET", 3000)
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(30))
    rows = []
    for family in range(6):
        base = [rnd.choice(vocabulary) + str(family) for _ in range(150)]
        for _ in range(12):
            w = list(base)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(150)] = rnd.choice(vocabulary)
            rows.append((len(rows) * 7 % 97, " ".join(w) + (" " + passage if rnd.random() < 0.4 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert len({c for _, _, c, _ in want}) < len(rows) and max(n for *_, n in want) > 5
    same(ngram_join.ngram_join(df), want)


def test_empty_table_and_pipeline_form(documents, rows):
    assert ngram_join.ngram_join(documents.limit(0)).collect() == []
    kept = ngram_join.drop_near_copies(documents)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c, _ in brute(rows)}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_null_and_repeated_ids_keep_one_row_of_each_group(spark):
    def text(w, n=60):
        return " ".join(f"{w}{i}" for i in range(n))

    rows = [(None, text("a"), "a"), (None, text("b"), "b"), (None, text("b", 59), "c"), (5, text("d"), "d")]
    rows += [(5, text("e", 59), "e"), (2, text("e"), "f"), (8, text("g"), "g"), (8, text("g", 59), "h"), (8, text("g"), "g")]
    rows += [(None, None, "i"), (1, " ", "j")]  # without shingles: alike to nothing
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = ngram_join.drop_near_copies(docs)
    assert got.columns == docs.columns
    got = sorted(r.source for r in got.collect())
    assert len(got) == 7 and {"a", "d", "f", "i", "j"} <= set(got)
    assert len({"b", "c"} & set(got)) == 1 and len({"g", "h"} & set(got)) == 1


def written(path):
    """Data files by table below ``path``."""
    return Counter(p.parent.relative_to(path).as_posix() for p in path.rglob("part-*.parquet"))


def cached(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def test_steps_write_only_what_they_leave(spark, tmp_path):
    before = cached(spark)
    star = spark.createDataFrame([(i, 100) for i in range(101, 140)], "a long, b long")
    assert len(components(star, str(tmp_path / "star")).collect()) == 40
    assert set(written(tmp_path / "star")) == {"0"}  # a star needs no step
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.root for r in components(path, str(tmp_path / "path")).collect()} == {0}
    steps = written(tmp_path / "path")
    assert 1 < len(steps) <= 8 and all(t.isdigit() for t in steps)
    assert cached(spark) == before


def test_few_tables_are_written_and_nothing_stays_cached(spark, monkeypatch, tmp_path, documents, rows):
    monkeypatch.setattr(ngram_join, "scratch", lambda spark: str(tmp_path))
    before = cached(spark)
    got = ngram_join.ngram_join(documents)
    tables = {t.split("/")[0] for t in written(tmp_path)}
    assert tables == {"sets", "classes", "lists", "clusters", "verified", "joined", "result"}
    assert cached(spark) == before
    same(got, brute(rows))


def test_a_kept_side_lets_a_skewed_join_be_split(spark, tmp_path):
    from contextlib import ExitStack

    from pyspark.sql import functions as F

    from corpusterms.storage import kept, stored

    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    old = {k: spark.conf.get(k) for k in small}
    rows = spark.range(0, 100_000, 1, 8).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("u"), "id")
    rows = stored(rows, str(tmp_path / "rows"))
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        with ExitStack() as until:
            joined = rows.join(kept(rows.groupBy("u").agg(F.min("id").alias("m")), until), "u")
            assert len(joined.collect()) == 100_000
            assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
