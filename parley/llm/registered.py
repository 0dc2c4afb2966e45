"""The queries of this package and, where SQL can express one, the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.codes import codebooks_digest, compressed
from parley.llm.common import table
from parley.llm.decontamination import contaminated
from parley.llm.jaccard import similar_documents
from parley.llm.langid import held_out, identify
from parley.llm.lines import dedup_lines
from parley.llm.neighbours import nearest_neighbours
from parley.llm.packing import pack_documents
from parley.llm.pieces import encode_texts
from parley.llm.rendering import extract_text
from parley.llm.spelling import spelling_variants
from parley.llm.substrings import dedup_substrings
from parley.llm.tokens import length_histogram, suffix_sums
from parley.llm.urls import Rule, filter_urls

#: The vocabulary that token counts and packing use.
VOCABULARY = "word_bpe_49k.json"
#: The model whose pieces texts are encoded in.
PIECES = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: A line's key, and the lines of every text with their keys.
_KEY = (
    "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
_LINES = f"""
lines AS (
  SELECT doc_id, pos, line, {_KEY} AS key
  FROM (
    SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM %s)
  )
),
repeated AS (
  SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
),
judged AS (
  SELECT l.*, r.key IS NOT NULL AND l.doc_id <> r.first_doc AS gone FROM lines l LEFT JOIN repeated r USING (key)
)
"""
ORACLES["op2_line_dedup"] = f"""
WITH {_LINES % "documents"}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return suffix_sums(length_histogram(docs, public_tokenizers.path(VOCABULARY)))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), docs.filter(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


#: Hosts, with their subdomains, and paths that are decided without a model.
URL_RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op10_substring_dedup"] = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
windows AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 34], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS pos FROM texts WHERE len(words) >= 35)
),
again AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
starts AS (SELECT DISTINCT doc_id, pos, true AS hit FROM windows SEMI JOIN again USING (win)),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts),
judged AS (
  SELECT doc_id, pos, word, coalesce(bool_or(hit) OVER (
    PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone
  FROM placed LEFT JOIN starts USING (doc_id, pos)
),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS text
  FROM judged GROUP BY doc_id
)
SELECT t.doc_id, len(t.words)::BIGINT AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_documents(docs, percent=90, words=3).select("doc_id", "n_shingles", "component_id")


ORACLES["op9_ngram_jaccard_join"] = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 2], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS pos FROM texts WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
  SELECT x, y FROM shared s JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * s.n >= 90 * (a.n + b.n - s.n)
),
reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
),
least AS (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""


@query
def op11_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_texts(docs, public_tokenizers.path(PIECES))
    return encoded.select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op12_memoised_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded, books = compressed(vectors)
    return coded.select(
        F.col("id").alias("vec_id"), "code", "error", "label_error",
        F.lit(codebooks_digest(books)).alias("codebooks_sha256"),
    )


def _rounds_sql(rounds: int) -> str:
    """Common table expressions near0, book1, near1, ... of the rounds of the codebooks."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""
near{k} AS MATERIALIZED (
  SELECT vec_id, label, p, any_value(v) AS v, min(16 * d + e) % 16 AS e, min(16 * d + e) // 16 AS d
  FROM (
    SELECT a.*, e, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))::BIGINT AS d
    FROM cut a JOIN book{k} b USING (p)
  ) GROUP BY vec_id, label, p
)""")
        if k < rounds:
            out.append(f"""
mean{k} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
    SELECT p, e, i, sum(v[i])::BIGINT AS s, count(*) AS n
    FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM near{k}) GROUP BY p, e, i
  ) GROUP BY p, e
),
book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (p, e)
)""")
    return ",".join(out)


ORACLES["op12_memoised_cells"] = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
cut AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS v
  FROM (SELECT *, unnest(range(8)) AS p FROM kept)
),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM cut QUALIFY e < 16
),{_rounds_sql(6)},
coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM near6 GROUP BY vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book6) AS codebooks_sha256
FROM coded
"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
