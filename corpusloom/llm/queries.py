"""Registered queries of the pipeline's operators, over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import math
import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import (
    block_repeats, byte_bpe, decontaminate, embedding_imi, filter_audit, html_main, langid_cnn, line_dedup, ngram_join, quality_mil,
    spelling_trie, suffix_dedup, token_orc,
)
from corpusloom.llm.common import new_path, table

#: Vocabularies of public tokenizers, at the same place on every executor.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
TOKENIZERS = os.path.dirname(RANKS)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *decontaminate.digests())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = quality_mil.held_out()
    network = quality_mil.train(docs.where(~held_out), labels.where(~held_out))
    scored = quality_mil.score(docs.select("doc_id", "text"), network)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= quality_mil.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_imi.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = byte_bpe.decode(byte_bpe.encode(docs, RANKS).drop("text"), RANKS)
    return decoded.select("doc_id", *byte_bpe.digests(decoded))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id", F.col("line_counts.lines").alias("n_lines"), F.col("line_counts.copies").alias("n_copies"),
        F.col("line_counts.near_copies").alias("n_near_copies"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid_cnn.held_out()
    network = langid_cnn.train(docs.where(~held_out))
    predicted = langid_cnn.predict(docs.select("doc_id", "text"), network)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove(docs).select("doc_id", *suffix_dedup.digests())


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    path = new_path(spark, "tokens")
    token_orc.write(docs, WORD_BPE, path, files=max(8, math.ceil(size / token_orc.FILE_BYTES)))
    return token_orc.checksums(token_orc.read(spark, path))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_main.extract(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_trie.group(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_block_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = block_repeats.remove(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_embedding_near_dup": op3_embedding_near_dup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_language": op7_language,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_orc": op9_token_orc,
    "op10_html_main_text": op10_html_main_text,
    "op11_filter_audit": op11_filter_audit,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_block_repeats": op13_block_repeats,
    "pipeline": corpus_pipeline.run,
}

#: Windows of ten words, compared word by word.
_WORDS = """regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
_OP1 = f"""
WITH i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
iw AS (SELECT item_id, array_to_string(w[k + 1:k + 10], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM iw),
g AS (SELECT doc_id, k, n, array_to_string(w[k + 1:k + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS k FROM d, lengths)),
h AS (SELECT g.doc_id, g.k, g.n, iw.item_id FROM g JOIN iw USING (win, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a),
k AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM k LEFT JOIN n USING (vec_id)
"""

_OP6 = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1:k + 5], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a),
k AS (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM k LEFT JOIN n USING (doc_id)
"""

#: DuckDB counts edits of bytes, so letters beyond ASCII (up to 31 in a pair of lines) become control characters first.
_OP5 = """
WITH lines AS (SELECT doc_id, p, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents)),
firsts AS (SELECT line, min(ROW(doc_id, p)) AS first, length(line) AS n FROM lines WHERE line <> '' GROUP BY line),
pairs AS MATERIALIZED (SELECT a.line AS a, b.line AS b, greatest(2, floor(sqrt(least(a.n, b.n)) / 4)) AS k
    FROM firsts a JOIN firsts b ON a.line <> b.line AND a.first < b.first AND a.n >= 24 AND b.n >= 24
    AND abs(a.n - b.n) <= greatest(2, floor(sqrt(least(a.n, b.n)) / 4))
    AND levenshtein(a.line, b.line) <= 4 * greatest(2, floor(sqrt(least(a.n, b.n)) / 4))),
spelt AS (SELECT a, b, k, array_to_string(list_distinct(regexp_extract_all(concat(a, b), '[^\\x00-\\x7F]')), '') AS wide,
    (SELECT string_agg(chr(CAST(i AS INT)), '' ORDER BY i) FROM range(1, 32) r(i)) AS spare FROM pairs),
near AS (SELECT DISTINCT b AS line FROM spelt WHERE levenshtein(translate(a, wide, spare), translate(b, wide, spare)) <= k),
judged AS (SELECT l.doc_id, l.p, l.line, coalesce(ROW(l.doc_id, l.p) > g.first, false) AS again, n.line IS NOT NULL AS near
    FROM lines l LEFT JOIN firsts g ON l.line = g.line LEFT JOIN near n ON l.line = n.line),
c AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_copies, count(*) FILTER (near AND NOT again) AS n_near_copies,
    coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT again AND NOT near), '') AS kept FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_copies, 0) AS n_copies, coalesce(n_near_copies, 0) AS n_near_copies,
    sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN c USING (doc_id)
"""

#: Every order replayed on the numbers of documents by part and failed filters (bits 1 to 16 for A to E).
_OP11 = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(d.doc_id > first_id, false) AS INT) AS failed,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d JOIN firsts USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT [a.letter, b.letter, c.letter, d.letter, e.letter] AS letters, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT array_to_string(letters, '') AS filter_order, step, letters[step] AS letter, bits[step] AS bit,
    CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM orders, range(1, 6) r(step)),
s AS (SELECT part, filter_order, CAST(step AS INT) AS step, letter, count(*),
    coalesce(sum(n) FILTER (failed & (before + bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (failed & before = 0 AND failed & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (failed & before <> 0 AND failed & bit <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (failed = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (failed & before = 0 AND failed & bit <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (failed & before = 0 AND failed & bit <> 0), 0) AS toxic_lost
    FROM c, steps GROUP BY part, filter_order, step, letter, bit, before)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM s
"""

#: crc32 by its table, computed here; near words are looked for by leaving out one letter; roots by recursion.
_OP12 = """
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents)
    WHERE length(run) >= 6 GROUP BY ALL),
octets AS (SELECT doc_id, run, n, flatten(list_transform(string_split(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run), ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) - 64 AS BIGINT)] END)) AS o FROM runs),
marked AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, o),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h FROM octets, crc),
spelt AS (SELECT n, CASE WHEN h % 199 = 0 THEN concat(substring(run, 1, CAST(h % length(run) AS BIGINT)),
    substring(run, CAST(h % length(run) AS BIGINT) + 2)) ELSE run END AS word FROM marked),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, p, concat(substring(word, 1, p), substring(word, p + 2)) AS rest FROM words, range(0, 64) r(p) WHERE p < length(word)),
near AS (SELECT DISTINCT a.word, b.word AS near, b.n FROM cut a JOIN cut b USING (rest, p) WHERE a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min(ROW(-n, near)) AS top FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top[1] >= 5 * w.n THEN top[2] END AS form,
    CASE WHEN -top[1] >= 5 * w.n THEN CAST(-top[1] AS BIGINT) END AS form_n FROM words w LEFT JOIN best USING (word)),
way(word, place, form) AS (SELECT word, word, form FROM formed UNION ALL
    SELECT way.word, f.word, f.form FROM way JOIN formed f ON way.form = f.word)
SELECT f.word, f.form, way.place AS root, f.n, f.n_near, f.form_n FROM formed f JOIN way ON f.word = way.word AND way.form IS NULL
"""

#: Windows compared word by word.
_OP13 = """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 35], ' ') AS win FROM (SELECT doc_id, w, unnest(range(len(w) - 34)) AS p FROM d)),
again AS (SELECT win FROM s GROUP BY win HAVING count(*) > 1),
cut AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM s JOIN again USING (win)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

SQL: dict[str, str] = {
    "op1_decontamination": _OP1,
    "op3_embedding_near_dup": _OP3,
    "op5_line_dedup": _OP5,
    "op6_ngram_join": _OP6,
    "op11_filter_audit": _OP11,
    "op12_spelling_variants": _OP12,
    "op13_block_repeats": _OP13,
}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
