"""DuckDB twins of the registered queries (the correctness oracle).

Written the plain relational way -- unnest the tokens, ``GROUP BY``,
``COUNT(DISTINCT ...)``, joins, as the reference's SQL recipes do -- so they
check the in-row counting and the join-free summary of the Spark operators.
Only the token grammar (one regex, RE2-compatible) is shared.  Cleaned texts
are not cleaned here: the documents' markup is built from their columns, so
the text that should come out is built from the columns too.
"""

from __future__ import annotations

from ..functions.tokens import COMPOUND_RE, PUNCT_CLASS, TOKEN_RE, WORD_LANE_RE
from ..functions import markup as M
from . import catalog


def _q(pattern: str) -> str:
    """A dollar-quoted SQL string (patterns hold single quotes)."""
    assert "$re$" not in pattern
    return "$re$" + pattern + "$re$"


def RS(x: str) -> str:
    """Round to 9 significant digits, as ``functions.scores.round_sig``."""
    return f"CAST(printf('%.8e', {x}) AS DOUBLE)"


def _source(name: str) -> tuple[str, str, str]:
    """(table, key expression, text expression) of a corpus."""
    return {
        "documents": ("documents", "doc_id", "text"),
        "conversations": ("conversations", "CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)", "text"),
        "benchmark": ("benchmark", "item_id", "text"),
        "new": ("(SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))", "doc_id", "text"),
    }[name]


def _terms_ctes(src: str = "documents") -> str:
    """words -> ti(document, term, lower, occurence) -> dc(term_count, token_total)."""
    table, key, text = _source(src)
    return f"""
words AS (
    SELECT {key} AS document,
           unnest(list_filter(regexp_extract_all(coalesce({text}, ''), {_q(WORD_LANE_RE)}, 1),
                              lambda x: x IS NOT NULL AND x <> '')) AS term
    FROM {table}
),
ti AS (
    SELECT document, term, lower(term) AS lower, count(*) AS occurence
    FROM words GROUP BY document, term
),
dc AS (
    SELECT document, count(*) AS term_count, CAST(sum(occurence) AS BIGINT) AS token_total
    FROM ti GROUP BY document
)"""


def _term_info_sql(src: str = "documents", where: str = "TRUE") -> str:
    return f"""WITH {_terms_ctes(src)}
SELECT ti.document, term, lower, occurence, occurence / term_count AS frequency
FROM ti JOIN dc ON dc.document = ti.document
WHERE {where}"""


def _recipe_ctes(src: str = "documents", idf_sql: str = "") -> str:
    """The recipe's counting / docinfo / terminfo / docfreq / final CTEs."""
    return f"""{_terms_ctes(src)},
counting AS (
    SELECT COUNT(DISTINCT document) AS documents FROM ti
),
terminfo AS (
    SELECT occurence / CAST(token_total AS DOUBLE) AS frequency, lower, ti.document
    FROM ti JOIN dc ON dc.document = ti.document
),
docfreq AS (
    SELECT COUNT(DISTINCT document) AS docfreq, (SELECT documents FROM counting) AS doctotal, lower
    FROM ti GROUP BY lower
),
final AS (
    SELECT {idf_sql} AS idf, frequency AS tf, docfreq.lower
    FROM docfreq JOIN terminfo ON terminfo.lower = docfreq.lower
)"""


_X = "(doctotal / CAST(docfreq AS DOUBLE))"
SERIES_IDF = (
    f"2*(({_X}/1) + ({_X}*{_X}*{_X}/3) + ({_X}*{_X}*{_X}*{_X}*{_X}/5)"
    f" + ({_X}*{_X}*{_X}*{_X}*{_X}*{_X}*{_X}/7))"
)
LOG10_IDF = "log10(doctotal / (1.0 + docfreq))"


def _summary_sql(src: str = "documents", idf_sql: str = SERIES_IDF, limit: int | None = None) -> str:
    order = f"ORDER BY maxtfidf DESC, lower LIMIT {limit}" if limit else ""
    return f"""WITH {_recipe_ctes(src, idf_sql)},
summary AS (
    SELECT MAX(tf*idf) AS maxtfidf, AVG(tf*idf) AS meantfidf, MIN(tf*idf) AS mintfidf, lower
    FROM final GROUP BY lower
),
picked AS (SELECT * FROM summary {order})
SELECT {RS("maxtfidf")} AS maxtfidf, {RS("meantfidf")} AS meantfidf, {RS("mintfidf")} AS mintfidf, lower
FROM picked"""


def _lanes(n: int, src: str = "documents") -> str:
    table, key, text = _source(src)
    idx = ", ".join(f"lane[i + {k}] AS w{k}" for k in range(n))
    ok = " AND ".join(f"w{k} IS NOT NULL AND w{k} <> ''" for k in range(n))
    term = " || ' ' || ".join(f"w{k}" for k in range(n))
    lowers = ", ".join(f"lower(w{k}) AS lower{k + 1}" for k in range(n))
    return f"""WITH lanes AS (
    SELECT {key} AS document, regexp_extract_all(coalesce({text}, ''), {_q(WORD_LANE_RE)}, 1) AS lane
    FROM {table}
),
pos AS (
    SELECT document, lane, unnest(range(1, len(lane) - {n - 2})) AS i FROM lanes WHERE len(lane) >= {n}
),
grams AS (
    SELECT document, {idx} FROM pos
),
rows AS (
    SELECT document, {term} AS term, {lowers} FROM grams WHERE {ok}
)"""


def _ngram_rows_sql(n: int, src: str = "documents") -> str:
    lowers = ", ".join(f"lower{k + 1}" for k in range(n))
    return _lanes(n, src) + f"\nSELECT document, term, {lowers}, CAST(1 AS BIGINT) AS occurence FROM rows"


def _ngram_counts_sql(n: int) -> str:
    lowers = ", ".join(f"lower{k + 1}" for k in range(n))
    return _lanes(n) + f"\nSELECT document, term, {lowers}, count(*) AS occurence FROM rows GROUP BY ALL"


_PUNCT_START = "^[" + PUNCT_CLASS + "]"

_TOKENS_SQL = f"""WITH t AS (
    SELECT doc_id AS document, regexp_extract_all(coalesce(text, ''), {_q(TOKEN_RE)}, 1) AS toks
    FROM documents
),
u AS (
    SELECT document, CAST(generate_subscripts(toks, 1) - 1 AS BIGINT) AS pos, unnest(toks) AS token FROM t
)
SELECT document, pos, token,
       CASE WHEN regexp_matches(token, {_q(_PUNCT_START)}) THEN 'punct'
            WHEN regexp_matches(token, '^[A-Za-z0-9]') THEN 'text'
            ELSE 'omit' END AS kind
FROM u"""

W = catalog.WORD

ORACLE: dict[str, str] = {
    "tokens": _TOKENS_SQL,
    "token_kinds": f"""WITH k AS ({_TOKENS_SQL})
SELECT kind, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens FROM k GROUP BY kind""",
    "term_info": _term_info_sql(),
    "doc_info": f"""WITH {_terms_ctes()}
SELECT d.doc_id AS document, coalesce(dc.term_count, 0) AS term_count
FROM documents d LEFT JOIN dc ON dc.document = d.doc_id""",
    "term_doc_info": f"""WITH {_terms_ctes()}
SELECT lower AS term, count(*) AS doc_count FROM ti GROUP BY lower""",
    "compound_terms": _term_info_sql(where=f"regexp_matches(term, {_q(COMPOUND_RE)})"),
    "term_postings": _term_info_sql(where=f"lower = lower('{W}')"),
    "corpus_counts": f"""WITH {_terms_ctes()}
SELECT COUNT(DISTINCT document) AS documents, COUNT(DISTINCT lower) AS unique_tokens,
       CAST(SUM(occurence) AS BIGINT) AS token_total
FROM ti""",
    "doc_tokens": f"""WITH {_terms_ctes()}
SELECT document, CAST(SUM(occurence) AS BIGINT) AS token_total FROM ti GROUP BY document""",
    "term_frequency": f"""WITH {_terms_ctes()},
doc AS (SELECT SUM(occurence) AS tokens, document FROM ti GROUP BY document)
SELECT ti.document, term, lower, occurence / CAST(tokens AS DOUBLE) AS frequency
FROM ti JOIN doc ON doc.document = ti.document""",
    "doc_frequency": f"""WITH {_terms_ctes()}
SELECT lower, COUNT(DISTINCT document) AS docfreq FROM ti GROUP BY lower""",
    "doc_frequency_total": f"""WITH {_terms_ctes()},
counting AS (SELECT COUNT(DISTINCT document) AS documents FROM ti)
SELECT lower, COUNT(DISTINCT document) AS docfreq, (SELECT documents FROM counting) AS doctotal
FROM ti GROUP BY lower""",
    "tf_idf": f"""WITH {_terms_ctes()},
counting AS (SELECT COUNT(DISTINCT document) AS documents FROM ti),
docfreq AS (
    SELECT COUNT(DISTINCT document) AS docfreq, (SELECT documents FROM counting) AS doctotal, lower
    FROM ti GROUP BY lower
)
SELECT ti.document, ti.term, ti.lower, ti.occurence / CAST(dc.token_total AS DOUBLE) AS tf,
       docfreq, doctotal, doctotal / CAST(docfreq AS DOUBLE) AS power_of_idf
FROM ti JOIN dc ON dc.document = ti.document JOIN docfreq ON docfreq.lower = ti.lower
ORDER BY docfreq, ti.lower, ti.document, ti.term""",
    "tf_idf_series": f"""WITH {_terms_ctes()},
counting AS (SELECT COUNT(DISTINCT document) AS documents FROM ti),
docfreq AS (
    SELECT COUNT(DISTINCT document) AS docfreq, (SELECT documents FROM counting) AS doctotal, lower
    FROM ti GROUP BY lower
)
SELECT lower, docfreq, doctotal, {RS(SERIES_IDF)} AS idf FROM docfreq""",
    "tf_idf_summary": _summary_sql(),
    "tf_idf_summary_log10": _summary_sql(idf_sql=LOG10_IDF),
    "top_terms": _summary_sql(limit=catalog.TOP_K),
    "word_idf": f"""WITH {_terms_ctes()},
p AS (SELECT count(*) AS postings FROM ti WHERE lower = lower('{W}')),
n AS (SELECT count(*) AS documents FROM documents)
SELECT lower('{W}') AS word, documents, postings, {RS("log10(documents / (1.0 + postings))")} AS idf
FROM p, n""",
    "rank_word": f"""WITH {_terms_ctes()},
postings AS (
    SELECT ti.document, term, lower, occurence, occurence / CAST(term_count AS DOUBLE) AS frequency
    FROM ti JOIN dc ON dc.document = ti.document WHERE lower = lower('{W}')
),
scored AS (
    SELECT *, log10((SELECT count(*) FROM documents) / (1.0 + (SELECT count(*) FROM postings))) AS idf
    FROM postings
),
ranked AS (
    SELECT *, coalesce(frequency, 0.0) * idf AS tfidf FROM scored
    ORDER BY tfidf DESC, document, term LIMIT {catalog.RANK_K}
)
SELECT document, term, lower, occurence, frequency AS frequency, {RS("idf")} AS idf,
       {RS("tfidf")} AS tfidf
FROM ranked""",
    "registry_count": "SELECT count(*) AS documents FROM documents",
    "processed_documents": "SELECT DISTINCT doc_id AS document FROM documents",
    "new_documents": f"""SELECT d.doc_id AS document, d.text FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
ORDER BY d.doc_id LIMIT {catalog.BATCH_SIZE}""",
    "ngram_rows_2": _ngram_rows_sql(2),
    "ngram_rows_3": _ngram_rows_sql(3),
    "ngram_counts_2": _ngram_counts_sql(2),
    "ngram_counts_3": _ngram_counts_sql(3),
    "conversation_terms": _term_info_sql("conversations"),
    "benchmark_summary": _summary_sql("benchmark"),
}


def _term_info_from(subquery: str, where: str = "TRUE") -> str:
    """term_info over a corpus subquery with columns (document, text)."""
    return f"""WITH src AS {subquery},
words AS (
    SELECT document,
           unnest(list_filter(regexp_extract_all(coalesce(text, ''), {_q(WORD_LANE_RE)}, 1),
                              lambda x: x IS NOT NULL AND x <> '')) AS term
    FROM src
),
ti AS (
    SELECT document, term, lower(term) AS lower, count(*) AS occurence
    FROM words GROUP BY document, term
),
dc AS (SELECT document, count(*) AS term_count FROM ti GROUP BY document)
SELECT ti.document, term, lower, occurence, occurence / term_count AS frequency
FROM ti JOIN dc ON dc.document = ti.document
WHERE {where}"""


def _lit(s: str) -> str:
    """A SQL string literal; newlines become chr(10)."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def _concat(*items: str) -> str:
    return " || ".join(items)


_ID = "CAST(doc_id AS VARCHAR)"
_Q3 = "'" * 3

MD_DOC = _concat(
    _lit("---\ntitle: d"), _ID, _lit("\nlang: "), "lang", _lit("\n---\n# "), "source",
    _lit("\n\n"), "text",
    _lit("\n\n> **"), "lang", _lit("** [pautan](http://x.example/"), _ID,
    _lit(' "t") and `kod` <b>html</b>\n\n- item *'), "source",
    _lit('*\n\n![alt](i.png "tajuk")\n\n```\nfenced '), "lang", _lit('\n```\n\n[lab]: http://x "def"\n'),
)
_WS = r"'[ \t\r\n]+', ' ', 'g'"


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, {_WS}))"


# What the dressed documents say: see catalog.markdown_document, wiki_document.
_MD_TEXT = f"""(SELECT doc_id AS document, {_squeezed(
    _concat("source", "' '", "text", "' '", "lang", "' pautan and html item '", "source", "' tajuk lab def'")
)} AS text FROM documents)"""
_WIKI_TEXT = _squeezed(
    _concat("'## '", "source", "' '", "lang", "' '", "text", "' '", "lang", "' - item '", _ID, "' luar'")
)
# Pages: cut out the one script and the one style, drop what stands between
# < and >, then decode the references that occur.
_PAGE_TEXT = f"""(
    WITH cut AS (
        SELECT page_id, array_to_string(list_transform(string_split(html, '<script>'),
            lambda x, i: CASE WHEN i = 1 THEN x ELSE split_part(x, '</script>', 2) END), ' ') AS h FROM pages
    ), bare AS (
        SELECT page_id, array_to_string(list_transform(string_split(h, '<style>'),
            lambda x, i: CASE WHEN i = 1 THEN x ELSE split_part(x, '</style>', 2) END), ' ') AS h FROM cut
    ), pieces AS (
        SELECT page_id, array_to_string(list_transform(string_split(h, '<'),
            lambda x, i: CASE WHEN i = 1 THEN x ELSE substr(x, strpos(x, '>') + 1) END), ' ') AS t FROM bare
    )
    SELECT page_id AS document, {_squeezed(
        "regexp_replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;?', '&', 'g')"
    )} AS text FROM pieces)"""
_FM = M._FRONT_MATTER_PARTS_RE

ORACLE.update(
    {
        "markdown_text": f"SELECT * FROM {_MD_TEXT}",
        "markdown_terms": _term_info_from(_MD_TEXT),
        "front_matter": f"""WITH d AS (SELECT doc_id AS document, {MD_DOC} AS raw FROM documents)
SELECT document,
       CASE WHEN regexp_matches(raw, {_q(M.FRONT_MATTER_RE)}) THEN regexp_extract(raw, {_q(_FM)}, 1) END AS meta,
       regexp_replace(raw, {_q(M.FRONT_MATTER_RE)}, '') AS body
FROM d""",
        "wikitext_clean": f"SELECT doc_id AS document, {_WIKI_TEXT} AS text FROM documents",
        "page_text": f"SELECT * FROM {_PAGE_TEXT}",
        "page_terms": _term_info_from(_PAGE_TEXT),
    }
)

ORACLE.update(
    {
        "term_tokens": f"SELECT * FROM ({_TOKENS_SQL}) WHERE kind = 'text'",
        "stored_frequency": f"""WITH {_terms_ctes()}
SELECT ti.document, ti.term, ti.lower, ti.occurence / CAST(doc_info.term_count AS DOUBLE) AS frequency
FROM ti JOIN dc AS doc_info ON doc_info.document = ti.document""",
    }
)

# The window form yields the same bag as the array form.
ORACLE.update({"ngram_rows_window_2": _ngram_rows_sql(2), "ngram_rows_window_3": _ngram_rows_sql(3)})

# Unicode white space at the ends of lines.
_BLANKS = "' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || chr(8195) || chr(12288)"


def _lines(x: str) -> str:
    """``x`` line by line, trimmed, without empty lines."""
    return f"""array_to_string(list_filter(list_transform(string_split({x}, chr(10)),
        lambda l: trim(l, {_BLANKS})), lambda l: l <> ''), chr(10))"""


_PAGE = f"CASE WHEN text IS NULL THEN '' ELSE {_lines("text || chr(10) || '== ' || lang || ' =='")} END"
_CLEAN = f"CASE WHEN text IS NULL THEN '' ELSE {_squeezed("text || ' ## ' || lang")} END"

ORACLE.update(
    {
        "page_documents": f"""SELECT 'r' || {_ID} || '.wiki' AS document, {_PAGE} AS text, 'Page ' || {_ID} AS title,
       '[[Muzik|' || lang || ']] ' || repeat(chr(39), 3) || {_ID} || repeat(chr(39), 3) AS comment, 2 AS revisions
FROM documents""",
        "clean_documents": f"""SELECT 'r' || {_ID} || '.wiki.md' AS document, lang || ' ' || {_ID} AS comment, 1 AS revisions,
       {_CLEAN} AS text FROM documents""",
        "squeeze_lines": f"SELECT doc_id AS document, {_lines('text || chr(10) || lang')} AS text FROM documents",
        "skip_done": f"""SELECT 'r' || {_ID} || '.wiki.md' AS document FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "wiki_terms": _term_info_from(f"""(SELECT 'r' || {_ID} || '.wiki.md' AS document,
    CASE WHEN text IS NULL THEN '' ELSE text || ' ' || lang END AS text FROM documents)"""),
        "batch_term_info": _term_info_sql("new"),
        "batch_doc_info": f"""WITH {_terms_ctes("new")}
SELECT d.doc_id AS document, coalesce(dc.term_count, 0) AS term_count
FROM {_source("new")[0]} d LEFT JOIN dc ON dc.document = d.doc_id""",
        "batch_term_doc_delta": f"""WITH {_terms_ctes("new")}
SELECT lower AS term, count(*) AS doc_count FROM ti GROUP BY lower""",
        "batch_ngram_two": _ngram_rows_sql(2, "new"),
        "batch_ngram_three": _ngram_rows_sql(3, "new"),
        "enriched_summary": _summary_sql(),
        "summary_modes": f"""WITH {_terms_ctes()},
per AS (
    SELECT ti.lower, occurence / CAST(term_count AS DOUBLE) AS tf FROM ti JOIN dc ON dc.document = ti.document
),
scored AS (
    SELECT lower, tf * log10((SELECT count(*) FROM documents) / (1.0 + count(*) OVER (PARTITION BY lower))) AS x FROM per
)
SELECT lower, {RS("max(x)")} AS maxtfidf, {RS("avg(x)")} AS meantfidf, {RS("min(x)")} AS mintfidf,
       {RS("stddev_samp(x)")} AS sdtfidf
FROM scored GROUP BY lower""",
        "count_rows_2": _ngram_counts_sql(2),
    }
)
ORACLE["rank_report"] = (
    ORACLE["rank_word"].rsplit("SELECT", 1)[0]
    + "SELECT 'TFIDF is ' || printf('%.5f', tfidf) || ' for ' || CAST(document AS VARCHAR) || ' ' || term AS line FROM ranked"
)

# Texts in pieces give what whole ones give, a dump read back what its pages gave.
ORACLE.update({"pieced_" + n: ORACLE[n] for n in ("tokens", "term_info", "doc_info", "ngram_rows_2", "ngram_counts_3")})
ORACLE["dump_documents"] = ORACLE["page_documents"]
ORACLE["folder_terms"] = _term_info_from("(SELECT CAST(doc_id AS VARCHAR) AS document, text FROM documents)")
ORACLE["store_summary"] = ORACLE["tf_idf_summary"]
ORACLE["store_term_doc_info"] = ORACLE["term_doc_info"]
ORACLE["rank_word_blocks"] = ORACLE["rank_word"]
ORACLE["concurrent_batches"] = ORACLE["doc_info"]
ORACLE["indexed_new_documents"] = """SELECT d.doc_id AS document, d.text FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""
