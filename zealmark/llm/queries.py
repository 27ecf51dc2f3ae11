"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zealmark.llm.chat_format import ASSISTANT, format_conversations, read_back
from zealmark.llm.common import remainder, table
from zealmark.llm.decontaminate import find_benchmark
from zealmark.llm.fingerprint import fingerprint_documents
from zealmark.llm.jaccard_join import near_duplicates
from zealmark.llm.language import identify_language, learn_languages
from zealmark.llm.main_text import extract_main_text
from zealmark.llm.mixture import mix_sources
from zealmark.llm.quality_rules import judge_quality
from zealmark.llm.sharded_lloyd import cluster_vectors
from zealmark.llm.spelling import group_spellings
from zealmark.llm.token_files import tokenize_corpus
from zealmark.llm.toxicity import learn_toxicity, score_toxicity
from zealmark.llm.warc import archive_pages

TOKENIZER = "word_bpe_49k.json"
# The conversation whose texts are nothing but control strings of a chat template
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn_toxicity(docs.where(remainder("doc_id", 4) != 2), table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_languages(docs.select("doc_id", "text", "lang").where(remainder("doc_id", 5) != 0))
    return identify_language(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, ASSISTANT, CONTROL_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_conversations(turns.unionByName(probe)))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_corpus(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "class")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark, table(spark, sf_dir, "pages"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))


def op13_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_main_text,
        op2_toxicity,
        op3_language,
        op4_mixture,
        op5_fingerprint,
        op6_chat_format,
        op7_decontaminate,
        op8_token_files,
        op9_jaccard_join,
        op10_warc,
        op11_quality_rules,
        op12_spelling,
        op13_sharded_lloyd,
    )
    return {query.__name__: query for query in found}


# DuckDB statements of the operators that SQL expresses over whole tables; its regular expressions work on code points.
WINDOW_HITS = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words FROM documents),
bw AS (SELECT cast(item_id AS varchar) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words FROM benchmark),
win AS (SELECT DISTINCT item, least(len(words), 10) AS n, list_slice(words, i, i + least(len(words), 10) - 1) AS win
  FROM bw, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS t(i) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT doc_id, s.n, i, list_slice(words, i, i + s.n - 1) AS win FROM w, sizes s, unnest(range(1, len(words) - s.n + 2)) AS t(i)),
hits AS (SELECT spots.doc_id, spots.i, spots.n, win.item FROM spots JOIN win ON spots.n = win.n AND spots.win = win.win),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
SHINGLE_CLASSES = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [words]
  ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: list_slice(words, i, i + 4))) END AS s FROM w),
named AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN sha256(cast(list_sort(s) AS varchar)) END AS node, s FROM sets),
one AS (SELECT node, any_value(n) AS n, any_value(s) AS s FROM named WHERE node IS NOT NULL GROUP BY node),
tokens AS (SELECT node, n, unnest(s) AS t FROM one),
common AS (SELECT a.node AS a, b.node AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n_both FROM tokens a JOIN tokens b ON a.t = b.t AND a.node < b.node GROUP BY a.node, b.node),
links AS (SELECT a, b FROM common WHERE 100 * n_both >= 75 * (na + nb - n_both)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT node, node FROM one UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least AS (SELECT reach.a AS node, min(named.doc_id) AS component_id FROM reach JOIN named ON named.node = reach.b GROUP BY reach.a)
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM named LEFT JOIN least USING (node)
"""
ARCHIVE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY sha1(payload)) AS kept FROM p),
b AS (SELECT *, list_transform(range(0, 32), lambda i: CAST('0x' || substr(hex || '0000000000', CAST(floor(i * 5 / 4) AS integer) + 1, 2) AS integer)) AS pairs FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((pairs[i + 1] >> (3 - (i * 5) % 4)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM b
"""

QUALITY = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT r, i, list_slice(words, i, i + 7) AS win FROM w, unnest(range(1, len(words) - 6)) AS u(i)),
again AS (SELECT r, win FROM win GROUP BY r, win HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM win JOIN again USING (r, win), unnest(range(0, 8)) AS u(k) GROUP BY r),
f AS (SELECT w.*, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
  OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
  OR 10 * len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{L}'))) > 2 * n_words
  OR 2 * len(regexp_extract_all(text, '\p{Lu}')) > len(regexp_extract_all(text, '\p{L}'))
  OR 5 * len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) > n_words
  OR 10 * len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) > 3 * n_lines
  OR 10 * len(list_filter(lines, lambda l: regexp_matches(l, '\A[\x20\x09-\x0D]*[-*•●][\x20\x09-\x0D]'))) > 9 * n_lines
  OR contains(lower(text), 'lorem ipsum')) AS kept FROM b
"""
SPELLINGS = """
WITH RECURSIVE t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(cast(doc_id AS varchar), '') || ':' || run)) AS hex FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(hex) // 2), lambda i: CAST('0x' || substr(hex, 2 * i + 1, 2) AS bigint))),
  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS h FROM each, t),
kept AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS bigint) AS n FROM kept WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM v, unnest(range(0, length(word))) AS u(i)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT v.word, d.word, d.n FROM v JOIN d ON d.rest = v.word UNION SELECT d.word, v.word, v.n FROM v JOIN d ON d.rest = v.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS top, max(near_n) AS top_n FROM near GROUP BY word),
form AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 2 * n THEN top END AS form, CASE WHEN top_n >= 2 * n THEN top_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk(word, here) AS (SELECT word, word FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON walk.here = form.word WHERE form.form IS NOT NULL),
ends AS (SELECT walk.word, walk.here AS root FROM walk JOIN form ON walk.here = form.word WHERE form.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM form JOIN ends USING (word)
"""


def clusters(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """Lloyd's rounds written out one after the other, in whole numbers."""
    whole = f"len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    parts = [
        f"x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS double)) AS bigint)) AS v FROM embeddings WHERE {whole})",
        "f AS MATERIALIZED (SELECT r, i, v[i] AS x FROM x, unnest(range(1, len(v) + 1)) AS u(i))",
        f"first AS (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(cast(vec_id AS varchar), '')), v) - 1 AS c FROM x QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, i, v[i] AS x FROM first, unnest(range(1, len(v) + 1)) AS u(i))",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT r, c, CAST(sum((f.x - c{n}.x) * (f.x - c{n}.x)) AS bigint) AS d FROM f JOIN c{n} USING (i) GROUP BY r, c)")
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN f USING (r) GROUP BY c, i)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce(CAST((s - ((s % n) + n) % n) // n AS bigint), x) AS x FROM c{n} LEFT JOIN s{n} USING (c, i))")
    parts.append(f"h AS (SELECT c, sha256(string_agg(cast(x AS varchar), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return "WITH " + ",\n".join(parts) + (
        "\nSELECT vec_id, CAST(c AS integer) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS bigint) AS cluster_inertia, CAST(sum(d) OVER () AS bigint) AS inertia, centroid_sha256"
        f" FROM a{rounds} JOIN x USING (r) JOIN h USING (c)"
    )


def oracle_sql() -> dict[str, str]:
    return {
        "op7_decontaminate": WINDOW_HITS,
        "op9_jaccard_join": SHINGLE_CLASSES,
        "op10_warc": ARCHIVE,
        "op11_quality_rules": QUALITY,
        "op12_spelling": SPELLINGS,
        "op13_sharded_lloyd": clusters(),
    }
