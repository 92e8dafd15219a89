"""Queries over choosing and decoding files."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.catalog.corpus import code_files, files_cte, q
from corpusloom.catalog.registry import query
from corpusloom.catalog.scalar_queries import documents, path_expr
from corpusloom.functions.text import decode_text, file_extension
from corpusloom.operators.files import (
    not_ignored, profile_sample, select_files, size_in_range, with_language,
)

_EXTENSION_ROWS = ", ".join(
    f"({q(ext)}, {q(language)}, {rank})"
    for rank, (ext, language) in enumerate(K.LANGUAGE_BY_EXTENSION)
)


def _listing(spark, sf_dir):
    """Documents as a listing of files with paths of many shapes."""
    return documents(spark, sf_dir).select(
        "doc_id", F.expr(path_expr("string")).alias("path"), "text"
    )


@query("lang_dispatch", f"""
SELECT doc_id, language, CAST(ext_rank AS INTEGER) AS ext_rank
FROM (SELECT doc_id, regexp_extract({path_expr('VARCHAR')}, '(\\.[^./]+)$', 1) AS e FROM documents)
JOIN (VALUES {_EXTENSION_ROWS}) AS known(ext, language, ext_rank) ON e = ext""")
def lang_dispatch(spark, sf_dir):
    files = _listing(spark, sf_dir).withColumn(
        "ext", file_extension(F.substring_index("path", "/", -1))
    )
    return with_language(files).select("doc_id", "language", "ext_rank")


@query("path_exclude", "SELECT doc_id, path FROM (SELECT doc_id, "
       + path_expr("VARCHAR") + " AS path FROM documents) WHERE "
       + " AND ".join(f"NOT contains(path, {q(p)})" for p in K.IGNORED_PATH_PARTS))
def path_exclude(spark, sf_dir):
    return _listing(spark, sf_dir).where(not_ignored(F.col("path"))).select("doc_id", "path")


@query("path_exclude_segment", "SELECT doc_id, path FROM (SELECT doc_id, "
       + path_expr("VARCHAR") + " AS path FROM documents) WHERE "
       + "len(list_intersect(string_split(path, '/'), ["
       + ", ".join(q(p) for p in K.IGNORED_PATH_PARTS) + "])) = 0")
def path_exclude_segment(spark, sf_dir):
    kept = not_ignored(F.col("path"), match="segment")
    return _listing(spark, sf_dir).where(kept).select("doc_id", "path")


@query("size_filter", f"""
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size FROM documents
WHERE strlen(text) BETWEEN {K.MIN_FILE_BYTES} AND {K.MAX_FILE_BYTES}""")
def size_filter(spark, sf_dir):
    sized = documents(spark, sf_dir).select(
        "doc_id", F.octet_length("text").cast("bigint").alias("size")
    )
    return sized.where(size_in_range(F.col("size")))


# every seventh document is broken by a byte that UTF-8 does not have; line
# ends are LF, CR LF or CR
_ENDED = """CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), chr(13) || chr(10))
  ELSE replace(text, chr(10), chr(13)) END"""


@query("decode_text", "SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0")
def decode_text_query(spark, sf_dir):
    raw = documents(spark, sf_dir).select(
        "doc_id",
        F.expr(f"CASE WHEN doc_id % 7 = 0 THEN concat(X'FF', encode({_ENDED}, 'UTF-8')) "
               f"ELSE encode({_ENDED}, 'UTF-8') END").alias("content"),
    )
    return raw.select("doc_id", decode_text(F.col("content")).alias("text")).where(
        F.col("text").isNotNull()
    )


@query("profile_sample", f"""
WITH {files_cte()}
SELECT repo, path, CAST(file_seq AS INTEGER) AS file_seq FROM (
  SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY ext_rank, path) AS file_seq
  FROM code_files) WHERE file_seq <= {K.PROFILE_FILES}""")
def profile_sample_query(spark, sf_dir):
    files = select_files(code_files(spark, sf_dir))
    return profile_sample(files).select("repo", "path", "file_seq")
