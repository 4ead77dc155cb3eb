"""N-gram Jaccard self-join by a grouped prefix join.

Documents are sets of word shingles (64-bit hashes; the sets themselves are
named by a 64-bit hash together with their size).  Two sets link when
``100 * |A n B| >= percent * |A u B|``.

1. Documents with the same set form a class; everything below works on
   classes, so thousands of copies cost as much as one.
2. All shingles are ordered by (document frequency over the corpus, hash).
   Counting runs over packed arrays, bucket by bucket; shingles known to be
   very common come last in the order and skip the buckets, so that no bucket
   gathers the sets of a shingle that is everywhere.  A shingle of one
   class alone can't be in an intersection: only the others go on, and a set's
   *prefix* (the rarest ``n - ceil(t*n) + 1``) is what is left of it then.
   Two sets that link share a shingle of both prefixes.
3. Classes that share a prefix shingle, directly or through others, are
   brought together, each class once.  Such a cluster that is too large for a
   task is cut into blocks by a hash of the class, and every pair of blocks is
   a task: nothing is left out and no task grows with the data.
4. In a task, classes with the same prefix and size collapse into a group;
   group pairs are filtered by size and by the overlap that the prefixes
   still allow; the rest is expanded into members and each pair is verified
   by its exact intersection.  A task returns a row per class: the links it
   found and the least class it reached.
5. Blocks' results meet in connected components.

Defined results: null or blank texts have an empty set and link with nothing
(component: their own id); fewer words than ``words`` make one shingle of
them all; repeated rows link with each other like other copies; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kept, least_rows, parts, scratch, stored
from .components import components

#: Shingles of a bucket, of a chunk that is packed, and of one that is looked
#: through for repeated ones; words whose hashes a task keeps.
BUCKET = 1_000_000
CHUNK = 1_000_000
SCAN = 250_000
WORDS_KEPT = 100_000
#: A shingle of so many sets (or of a millionth of all shingles, if that is
#: more) is common: its sets are not gathered in one bucket.  It is found by
#: the chunks in which it occurs so many times.
COMMON = 500_000
REPEATED = 4
#: Shared shingles of the classes that one task compares.
BLOCK = 1_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _word_hashes():
    import xxhash

    class Hashes(dict):
        def __missing__(self, word):
            if len(self) >= WORDS_KEPT:
                self.clear()
            h = self[word] = xxhash.xxh3_64_intdigest(word)
            return h

    return Hashes()  # a task's own: an idle worker holds no words


def shingle_set(text: bytes | None, words: int, hashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text."""
    # bytes.split() parts at exactly the six ASCII white-space characters.
    seq = (text or b"").translate(_LOWER).split()
    if not seq:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, seq), np.uint64, len(seq))
    k = min(words, len(w))
    n = len(w) - k + 1
    h = np.full(n, 0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(k):
        h ^= w[i : n + i]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def set_key(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


SETS = "doc_id long, n long, key long, token long, held long"


def _document_sets(words: int):
    """A row per document (size and name of its set); and rows ``(token, held)``
    for the shingles that many distinct sets of a chunk hold."""

    def rows(doc, n, key, token, held):
        return pa.RecordBatch.from_arrays(
            [doc, *(pa.array(x, pa.int64()) for x in (n, key, token, held))], [c.split()[0] for c in SETS.split(", ")]
        )

    def repeated(sets):
        token, held = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        token, held = token[held >= REPEATED].view(np.int64), held[held >= REPEATED]
        none = [None] * len(token)
        return rows(pa.array(none, pa.int64()), none, none, token, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _word_hashes()
        sets, gathered = {}, 0
        for b in batches:
            n, keys = [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), words, hashes)
                n.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                if len(s) and keys[-1] not in sets:
                    sets[keys[-1]] = s
                    gathered += len(s)
                    if gathered >= SCAN:
                        yield repeated(sets)
                        sets, gathered = {}, 0
            yield rows(b.column(0), n, keys, [None] * len(n), [None] * len(n))
        if sets:
            yield repeated(sets)

    return run


def _planes(a: np.ndarray) -> bytes:
    """Bytes of a sorted array, plane by plane (the upper planes compress)."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


PACKED = "bucket long, tokens binary, places binary, keys binary"


def _packed_shingles(words: int, bits: int, common: np.ndarray):
    """Shingles of the distinct sets of a chunk, packed by hash bucket.

    The ``common`` ones (sorted) are a bucket of the chunk's own, below zero:
    that they are shared is known, so they need not meet those of other chunks.
    """

    def pack(sets: dict[int, np.ndarray], own: int):
        keys = np.fromiter(sets, np.int64, len(sets))
        tokens = np.concatenate(list(sets.values()))
        places = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets.values()])
        sets.clear()
        order = np.argsort(tokens)
        tokens, places = tokens[order], places[order]
        del order
        bucket = (tokens >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
            bucket[common[at] == tokens] = own
            order = np.argsort(bucket, kind="stable")
            bucket, tokens, places = bucket[order], tokens[order], places[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            used, place = np.unique(places[lo:hi], return_inverse=True)
            yield int(bucket[lo]), _planes(tokens[lo:hi]), place.astype(np.uint16).tobytes(), keys[used].tobytes()

    def batch(sets, own):
        cols = list(zip(*pack(sets, own), strict=True))
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["bucket", "tokens", "places", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes = _word_hashes()
        own = -1 - (TaskContext.get().partitionId() << 32)
        sets, held = {}, 0
        for b in batches:
            for t in b.column(0):
                s = shingle_set(t.as_py(), words, hashes)
                if len(s) and (key := set_key(s)) not in sets:
                    sets[key] = s
                    held += len(s)
                    if held >= CHUNK or len(sets) == 65_536:
                        yield batch(sets, own)
                        held, own = 0, own - 1
        if sets:
            yield batch(sets, own)

    return run


def _shared_shingles(t: pa.Table) -> pa.Table:
    """Of one bucket: (key, token, df) of the shingles of two sets or more."""
    tokens = np.concatenate([_unplanes(x.as_py(), np.uint64) for x in t.column("tokens")])
    keys = np.concatenate(
        [
            np.frombuffer(k.as_py(), np.int64)[np.frombuffer(p.as_py(), np.uint16)]
            for p, k in zip(t.column("places"), t.column("keys"), strict=True)
        ]
    )
    order = np.lexsort((keys, tokens))
    tokens, keys = tokens[order], keys[order]
    new = np.ones(len(tokens), bool)  # the same set may come from several chunks
    new[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
    tokens, keys = tokens[new], keys[new]
    first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    df = np.diff(np.r_[first, len(tokens)])
    df = np.repeat(df, df)
    if t.column("bucket")[0].as_py() < 0:  # common: behind all others in the order, whatever the count here
        df[:] = 1 << 40
    many = df > 1
    return pa.table(
        {
            "key": pa.array(keys[many], pa.int64()),
            "token": pa.array(tokens[many].view(np.int64), pa.int64()),
            "df": pa.array(df[many], pa.int64()),
        }
    )


def _slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of many slices, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def linked_members(n, prefix, copies, side, tokens, percent: int, across: bool):
    """Links within one cluster (or, ``across``, between a block pair's sides).

    ``n``: set sizes; ``prefix``: how many of ``tokens[i]`` (shared shingles,
    rarest first) lie in the prefix.  Returns (links weighted by copies, root
    index) by member.
    """
    count = len(n)
    links, root = np.zeros(count, np.int64), np.arange(count)
    lengths = np.array([len(t) for t in tokens], np.int64)
    _, local = np.unique(np.concatenate(tokens), return_inverse=True)
    starts = np.cumsum(lengths) - lengths

    groups: dict[tuple, list[int]] = {}
    for i in np.argsort(n, kind="stable"):
        p = local[starts[i] : starts[i] + prefix[i]]
        groups.setdefault((int(n[i]), int(lengths[i]), p.tobytes()), []).append(int(i))
    members = list(groups.values())
    lead = np.array([m[0] for m in members])
    gn, gp = n[lead], prefix[lead]
    rest = gn - (gn - lengths[lead] + gp)  # behind the prefix, shared or not
    at = _slices(starts[lead], gp)
    owner = np.repeat(np.arange(len(members)), gp)
    order = np.argsort(local[at], kind="stable")
    posted, post_token = owner[order], local[at][order]
    mark = np.zeros(int(local.max()) + 1, bool)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for g, own in enumerate(members):
        mine = local[starts[lead[g]] : starts[lead[g]] + gp[g]]
        lo, hi = np.searchsorted(post_token, mine, "left"), np.searchsorted(post_token, mine, "right")
        near, common = np.unique(posted[_slices(lo, hi - lo)], return_counts=True)
        later = near >= g  # sizes ascend: the others have seen this pair
        near, common = near[later], common[later]
        big, small = np.maximum(gn[near], gn[g]), np.minimum(gn[near], gn[g])
        fits = 100 * small >= percent * big
        bound = np.minimum(common + np.maximum(rest[near], rest[g]), small)
        fits &= (100 + percent) * bound >= percent * (gn[near] + gn[g])
        near = near[fits]
        for place, x in enumerate(own):
            others = [y for h in near for y in (own[place + 1 :] if h == g else members[h])]
            if not others:
                continue
            y = np.array(others)
            if across:
                y = y[side[y] != side[x]]
                if not len(y):
                    continue
            mark[local[starts[x] : starts[x] + lengths[x]]] = True
            hits = np.r_[0, np.cumsum(mark[local[_slices(starts[y], lengths[y])]])]
            mark[local[starts[x] : starts[x] + lengths[x]]] = False
            ends = np.cumsum(lengths[y])
            inter = hits[ends] - hits[ends - lengths[y]]
            y = y[100 * inter >= percent * (n[x] + n[y] - inter)]
            if len(y):
                links[x] += copies[y].sum()
                links[y] += copies[x]
                for z in np.unique(root[y]):
                    a, b = find(x), find(z)
                    root[max(a, b)] = min(a, b)
    return links, np.array([find(i) for i in range(count)], np.int64)


def _verified(percent: int):
    def run(t: pa.Table) -> pa.Table:
        clusters = np.array(t.column("cluster"))
        out = {"key": [], "root": [], "links": [], "torn": []}
        col = {c: np.array(t.column(c)) for c in ("key", "n", "prefix", "copies", "side", "torn")}
        across = bool(t.column("across")[0].as_py())
        tokens = t.column("tokens")
        order = np.argsort(clusters, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(clusters[order])) + 1):
            lists = [np.array(tokens[int(i)].values) for i in own]
            given = (col[c][own] for c in ("n", "prefix", "copies", "side"))
            links, root = linked_members(*given, lists, percent, across)
            for name, values in (("key", col["key"][own]), ("root", col["key"][own][root]), ("links", links), ("torn", col["torn"][own])):
                out[name].append(values.astype(np.int64))
        return pa.table({k: pa.array(np.concatenate(v), pa.int64()) for k, v in out.items()})

    return run


def ngram_join(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)``, a row per document."""
    with ExitStack() as until:
        return _joined(docs, words, percent, until)


def _joined(docs: DataFrame, words: int, percent: int, until: ExitStack) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    path = scratch(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = stored(text.mapInArrow(_document_sets(words), SETS), f"{path}/sets")
    sets = found.where("token is null").select("doc_id", "n", "key")
    classes = stored(
        sets.where("key is not null")
        .groupBy("key")
        .agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")),
        f"{path}/classes",
    )
    total = classes.agg(F.sum("n")).first()[0] or 0
    bits = min(24, (total // BUCKET).bit_length())

    # At most a million shingles can be common, by what they add up to.
    common = found.where("token is not null").groupBy("token").agg(F.sum("held").alias("held"))
    common = common.where(F.col("held") >= max(COMMON, total // 1_000_000)).select("token").collect()
    common = np.sort(np.array([r["token"] for r in common], np.int64).view(np.uint64))

    packed = text.select("text").mapInArrow(_packed_shingles(words, bits, common), PACKED)
    shared = packed.groupBy("bucket").applyInArrow(_shared_shingles, "key long, token long, df long")
    # Rarest first.  A common shingle may come once for each chunk with the set.
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"])
    tokens = F.array_distinct(tokens)
    lists = shared.groupBy("key").agg(tokens.alias("tokens")).join(classes, "key")
    # What is left of the prefix behind the shingles that no other set has.
    need = F.ceil(F.col("n") * percent / F.lit(100)).cast("long")
    prefix = F.size("tokens") - need + 1
    lists = stored(
        lists.select("key", "n", "copies", "first_doc", "tokens", prefix.cast("long").alias("prefix")).where("prefix > 0"),
        f"{path}/lists",
    )

    # Clusters: classes that share prefix shingles, directly or through others.
    posted = lists.select("key", F.explode(F.slice("tokens", F.lit(1), F.col("prefix").cast("int"))).alias("token"))
    stars = posted.groupBy("token").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most")
    stars = kept(stars.select("token", "least"), until)
    edges = posted.join(stars, "token").where("key != least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    clusters = kept(components(edges, f"{path}/clusters"), until)

    members = lists.join(clusters.select(F.col("node").alias("key"), F.col("root").alias("cluster")), "key")
    sizes = members.groupBy("cluster").agg(F.sum(F.size("tokens")).alias("held"))
    sizes = kept(sizes.withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int")), until)
    held = sizes.agg(F.sum("held")).first()[0] or 0
    bundles = parts(spark, BLOCK, held)
    members = members.join(sizes.select("cluster", "blocks"), "cluster")
    columns = ["cluster", "key", "n", "prefix", "copies", "tokens"]
    whole = members.where("blocks = 1").select(
        *columns,
        F.lit(0).alias("side"),
        F.lit(0).alias("torn"),
        F.lit(False).alias("across"),
        F.concat(F.lit("whole"), F.pmod(F.xxhash64("cluster"), F.lit(bundles))).alias("task"),
    )
    cut = members.where("blocks > 1").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select(
        *columns,
        (F.col("mine") > F.col("other")).cast("int").alias("side"),
        F.lit(1).alias("torn"),
        (F.col("mine") != F.col("other")).alias("across"),
        F.concat_ws("/", "cluster", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"),
    )
    verified = whole.union(cut).groupBy("task").applyInArrow(
        _verified(percent), "key long, root long, links long, torn long"
    )
    verified = stored(verified, f"{path}/verified")

    # A class met in several tasks has several roots: join them up.
    named = verified.groupBy("key").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    torn = verified.where("torn = 1 and key != root").select(F.col("key").alias("a"), F.col("root").alias("b"))
    joined = components(torn, f"{path}/joined").select(F.col("node").alias("key"), F.col("root").alias("top"))
    named = named.join(joined, "key", "left").select("key", F.coalesce("top", "root").alias("root"), "links")
    named = kept(named.join(classes.select("key", "first_doc"), "key"), until)
    tops = kept(named.groupBy("root").agg(F.min("first_doc").alias("component_id")), until)
    named = named.join(tops, "root").select("key", "links", "component_id")
    result = classes.join(named, "key", "left").select(
        "key",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "first_doc").alias("component_id"),
    )
    result = stored(result, f"{path}/result")
    return sets.join(result, "key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """One row of ``docs`` for each component: that of the least ``doc_id``."""

    def grouped(rows: DataFrame) -> DataFrame:
        return ngram_join(rows, words, percent).select("doc_id", F.col("component_id").alias("group"))

    return least_rows(docs, grouped)
