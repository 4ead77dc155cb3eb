"""The registered queries of this package and their SQL twins.

Each query applies one operator, with production parameters, to its whole
table and derives the asked digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, byte_bpe, chat_format, exact_dedup, html_text, language_id, ngram_join, packing, phrases, sharding, spelling, warc, winnowing
from .common import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def op1_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op1_ngram_join"] = op1_ngram_join


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op4_exact_dedup"] = op4_exact_dedup
ORACLE["op4_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def packed_pieces(docs: DataFrame) -> DataFrame:
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "padded_length",
    )


def op5_packing(spark, sf_dir):
    return packed_pieces(table(spark, sf_dir, "documents"))


QUERIES["op5_packing"] = op5_packing


def op7_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode_column(docs, ranks, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode_column(encoded, ranks, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES["op7_byte_bpe"] = op7_byte_bpe


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.identify(docs.select("doc_id", "text"), models)
    doc = found.select("row.doc_id", "lang_pred", "score", "cross_entropy", "accepted")
    return doc.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


QUERIES["op8_language_id"] = op8_language_id


def op2_sharding(spark, sf_dir):
    placed = sharding.interleaved_shards(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source")


QUERIES["op2_sharding"] = op2_sharding


def op10_winnowing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = winnowing.with_edits(docs).withColumn("edited_mark", winnowing.winnow(F.col("edited")))
    return prints.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnowing.spelled(F.col("mark")).alias("fingerprint"),
        winnowing.spelled(F.col("edited_mark")).alias("edited_fingerprint"),
        winnowing.likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
        winnowing.likeness(F.col("mark"), F.col("next_mark")).alias("near_next"),
    )


QUERIES["op10_winnowing"] = op10_winnowing


def op6_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    probe = spark.range(2).select(F.lit(-7).cast("long"), "id", role, said)
    return chat_format.read_back(chat_format.format_conversations(turns.union(probe)))


QUERIES["op6_chat_format"] = op6_chat_format
# Lengths: an escaped text has a character more for each backslash, < and [;
# an example is as long as all turns up to its target.
ORACLE["op6_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), w AS (
  SELECT *,
    length(regexp_replace(text, '([\<\[\]])', 'xx', 'g')) + CASE role
      WHEN 'user' THEN 18 WHEN 'system' THEN 16 WHEN 'assistant' THEN 7
      ELSE 20 + length(regexp_replace(role, '([\<\[\]])', 'xx', 'g')) END AS chars
  FROM t
), c AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
  FROM w
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant' OR from_end = 1), 0)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def op9_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    # The table has no capture times: a second a page, from a fixed day on, over
    # some thirty years (then again; pages of one second are told apart by id).
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(10**9)))
    path = f"{scratch(spark)}/archives"
    warc.write_archives(warc.captures(pages.withColumn("captured", when)), path)
    index = warc.read_index(spark, path)
    return index.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position"
    )


QUERIES["op9_warc"] = op9_warc


def op3_html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = html_text.main_text(pages)
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES["op3_html_text"] = op3_html_text


def op12_best_fit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = best_fit.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    # Digests before the pieces are placed: the ids themselves need not move.
    digests = pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "task", "rank"
    )
    return best_fit.place(digests, counted=pieces)


QUERIES["op12_best_fit"] = op12_best_fit


def op13_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES["op13_phrases"] = op13_phrases
ORACLE["op13_phrases"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), p AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d
), words AS (
  SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(w) AS w FROM p) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM words GROUP BY lang
), two AS (
  SELECT lang, g[1] AS w1, g[2] AS w2, count(*) AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS g FROM p) GROUP BY ALL
), three AS (
  SELECT lang, g[1] AS w1, g[2] AS w2, g[3] AS w3, count(*) AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM p) GROUP BY ALL
), long AS (
  SELECT t.lang, t.w1, t.w2, t.w3, t.f AS a, a.f AS l1, b.f AS r1, c.f AS l2, e.f AS r2,
    (1000000::HUGEINT * t.f * t.f) // (a.f::HUGEINT * b.f) AS s1, (1000000::HUGEINT * t.f * t.f) // (c.f::HUGEINT * e.f) AS s2
  FROM three t
  JOIN words a ON a.lang = t.lang AND a.w = t.w1
  JOIN two b ON b.lang = t.lang AND b.w1 = t.w2 AND b.w2 = t.w3
  JOIN two c ON c.lang = t.lang AND c.w1 = t.w1 AND c.w2 = t.w2
  JOIN words e ON e.lang = t.lang AND e.w = t.w3
  WHERE t.f >= 10
), held AS (
  SELECT lang, w1, w2, max(a) AS a
  FROM (SELECT lang, w1, w2, a FROM long UNION ALL SELECT lang, w2, w3, a FROM long) GROUP BY ALL
), scored AS (
  SELECT lang, w1 || ' ' || w2 || ' ' || w3 AS phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END AS l,
    CASE WHEN s1 <= s2 THEN r1 ELSE r2 END AS r, least(s1, s2) AS score FROM long
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2, t.f, a.f, b.f, (1000000::HUGEINT * t.f * t.f) // (a.f::HUGEINT * b.f)
  FROM two t
  JOIN words a ON a.lang = t.lang AND a.w = t.w1
  JOIN words b ON b.lang = t.lang AND b.w = t.w2
  LEFT JOIN held h ON h.lang = t.lang AND h.w1 = t.w1 AND h.w2 = t.w2
  WHERE t.f >= 10 AND (h.a IS NULL OR 100 * h.a < 50 * t.f)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "binary") AS rank FROM scored
)
SELECT r.lang, rank, phrase, a, l, r.r, n, score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""


def op11_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op11_spelling"] = op11_spelling
