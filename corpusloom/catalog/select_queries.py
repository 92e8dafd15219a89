"""Queries over choosing examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import sql as S
from corpusloom.catalog.corpus import code_files, table
from corpusloom.catalog.registry import query
from corpusloom.catalog.scalar_queries import _CODE, _NAME, documents
from corpusloom.catalog.style_queries import profile_cte, sampled_profile
from corpusloom.catalog.unit_queries import _with_python
from corpusloom.functions.naming import complexity, naming_style
from corpusloom.operators.files import select_files
from corpusloom.operators.ranking import rank_all
from corpusloom.operators.select import (
    attach_style, dedup_first, exclude_names, files_within_cap, group_preview,
    matches_style, order_places, passes_quality, priority, quality_order, rank_examples, with_priority,
)
from corpusloom.operators.units import extract_examples, parse_files
from corpusloom.sources.staging import stage

CAP = 150
BEST = 1500


def _examples(spark, sf_dir):
    return extract_examples(select_files(code_files(spark, sf_dir)))


@query("file_cap", _with_python(f"""
SELECT repo, path, CAST(n_units AS INTEGER) AS n_units, CAST(before AS BIGINT) AS units_before
FROM (SELECT *, coalesce(sum(n_units) OVER (PARTITION BY repo ORDER BY ext_rank, path
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT repo, ext_rank, path, count(*) AS n_units FROM units GROUP BY ALL))
WHERE before < {CAP}"""))
def file_cap(spark, sf_dir):
    parsed = parse_files(select_files(code_files(spark, sf_dir)))
    return files_within_cap(parsed, CAP).select("repo", "path", "n_units", "units_before")


@query("dedup_normalized", f"""
SELECT doc_id, code_hash FROM (
  SELECT doc_id, code_hash, row_number() OVER (PARTITION BY code_hash ORDER BY doc_id) AS rn
  FROM (SELECT doc_id, {S.code_hash('text')} AS code_hash FROM documents)) WHERE rn = 1""")
def dedup_normalized(spark, sf_dir):
    unique = dedup_first(documents(spark, sf_dir), code="text", keys=(), order=("doc_id",))
    return unique.select("doc_id", "code_hash")


@query("dedup_units", _with_python(f"""
SELECT repo, path, seq, kind AS type, code_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, code_hash ORDER BY ext_rank, path, seq) AS rn
  FROM (SELECT *, {S.code_hash('code')} AS code_hash FROM units)) WHERE rn = 1"""))
def dedup_units(spark, sf_dir):
    return dedup_first(_examples(spark, sf_dir)).select(
        "repo", "path", "seq", "metadata.type", "code_hash"
    )


# short, long and generic cases among texts that are code-like
_GENERIC = f"CASE doc_id % 5 WHEN 0 THEN 'Test' WHEN 1 THEN 'tests' WHEN 2 THEN NULL ELSE {_NAME} END"


@query("quality_filter", f"""
SELECT doc_id FROM (SELECT doc_id, {_CODE} AS x, {_GENERIC} AS name FROM documents)
WHERE {S.passes_quality('x', 'name')}""")
def quality_filter_query(spark, sf_dir):
    rows = documents(spark, sf_dir).selectExpr("doc_id", f"{_CODE} AS x", f"{_GENERIC} AS name")
    return rows.where(passes_quality(F.col("x"), F.col("name"))).select("doc_id")


_DOCUMENTED = "CASE doc_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END"


@query("priority_flag", f"""
SELECT doc_id, {S.priority('documented', 'style')} AS priority
FROM (SELECT doc_id, {_DOCUMENTED} AS documented, {S.naming_style('name')} AS style
      FROM (SELECT doc_id, {_NAME} AS name FROM documents))""")
def priority_flag(spark, sf_dir):
    rows = documents(spark, sf_dir).select(
        "doc_id", F.expr(_DOCUMENTED).alias("documented"), naming_style(F.expr(_NAME)).alias("style")
    )
    return rows.select("doc_id", priority(F.col("documented"), F.col("style")).alias("priority"))


@query("quality_order", f"""
SELECT *, CAST(row_number() OVER (ORDER BY is_high DESC, complexity DESC, has_docstring DESC, doc_id) AS INTEGER) AS rank
FROM (SELECT doc_id, coalesce(priority = 'high', FALSE) AS is_high, complexity, has_docstring
  FROM (SELECT doc_id, complexity, coalesce(documented, FALSE) AS has_docstring,
          {S.priority('documented', 'style')} AS priority
        FROM (SELECT doc_id, {_DOCUMENTED} AS documented, {S.complexity('text')} AS complexity,
                {S.naming_style(f'({_NAME})')} AS style FROM documents)))""")
def quality_order_query(spark, sf_dir):
    rows = documents(spark, sf_dir).select(
        "doc_id", F.expr(_DOCUMENTED).alias("has_docstring"),
        complexity(F.col("text")).alias("complexity"),
        naming_style(F.expr(_NAME)).alias("naming_style"),
    )
    flagged = rows.select("doc_id", F.struct(
        priority(F.col("has_docstring"), F.col("naming_style")).alias("priority"),
        "complexity", "has_docstring").alias("metadata"))
    ordered = rank_all(flagged, [], [*quality_order(), F.col("doc_id").asc()])
    m = F.col("metadata")
    return ordered.select(
        "doc_id", "rank", F.coalesce(m["priority"] == "high", F.lit(False)).alias("is_high"),
        m["complexity"].alias("complexity"),
        F.coalesce(m["has_docstring"], F.lit(False)).alias("has_docstring"),
    )


_RANKED = f"""row_number() OVER (PARTITION BY repo ORDER BY coalesce(priority = 'high', FALSE) DESC,
  coalesce(complexity, 0) DESC, coalesce(has_docstring, FALSE) DESC, ext_rank, path, seq)"""


@query("topk_examples", _with_python(f"""
SELECT repo, path, seq, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, {_RANKED} AS rank FROM (
    SELECT *, {S.priority('has_docstring', 'naming_style')} AS priority FROM (
      SELECT repo, ext_rank, path, seq, {S.EXAMPLE_METADATA} FROM units)))
WHERE rank <= {BEST}"""))
def topk_examples(spark, sf_dir):
    places = stage(order_places(with_priority(_examples(spark, sf_dir))), "places")
    return rank_examples(places, BEST)


FEW, MANY = 150, 5000


@query("topk_examples_few_and_many", _with_python(f"""
SELECT k, repo, path, seq, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, {_RANKED} AS rank FROM (
    SELECT *, {S.priority('has_docstring', 'naming_style')} AS priority FROM (
      SELECT 'all' AS repo, ext_rank, path, seq, {S.EXAMPLE_METADATA} FROM units)))
JOIN (VALUES ({FEW}), ({MANY})) AS limits(k) ON rank <= k"""))
def topk_examples_few_and_many(spark, sf_dir):
    """All files in one repository; a small and a large limit, found in the same way."""
    examples = with_priority(_examples(spark, sf_dir)).withColumn("repo", F.lit("all"))
    places = stage(order_places(examples), "places")
    few, many = (rank_examples(places, k).withColumn("k", F.lit(k)) for k in (FEW, MANY))
    return few.unionByName(many).select("k", "repo", "path", "seq", "rank")


def _with_profile(statement: str, all_files: bool = False) -> str:
    """WITH clause that has the files, all units and the profiles."""
    units = _with_python("")[len("WITH "):]
    defined = ("parts AS (", "code_files AS (")
    profile = profile_cte(all_files)
    start = profile.index("py_names AS (")
    assert all(d in units for d in defined)
    return f"WITH {units}, {profile[start:]}\n{statement}"


@query("attach_style", _with_profile("""
SELECT units.repo, path, seq, style_context FROM units LEFT JOIN profile USING (repo)"""))
def attach_style_query(spark, sf_dir):
    profile = sampled_profile(spark, sf_dir)
    return attach_style(_examples(spark, sf_dir), profile, ["style_context"]).select(
        "repo", "path", "seq", "style_context"
    )


@query("style_match", _with_profile(f"""
SELECT repo, path, seq, coalesce(CASE
  WHEN contains(kind, 'function') THEN {S.naming_style('name')} = functions_preferred
  WHEN contains(kind, 'class') THEN {S.naming_style('name')} = classes_preferred END, FALSE)
  AS matches
FROM units LEFT JOIN profile USING (repo)"""))
def style_match(spark, sf_dir):
    columns = ["functions_preferred", "classes_preferred"]
    rows = attach_style(_examples(spark, sf_dir), sampled_profile(spark, sf_dir), columns)
    m = F.col("metadata")
    return rows.select("repo", "path", "seq", matches_style(
        m["type"], m["name"], F.col(columns[0]), F.col(columns[1])).alias("matches"))


@query("group_preview", """
SELECT url[:instr(url, '.')] AS dir, array_to_string(list_sort(array_agg(name))[1:5], ' ') AS items,
  greatest(count(*) - 5, 0) AS more
FROM (SELECT url, url || '#' || page_id AS name FROM pages) GROUP BY ALL""")
def group_preview_query(spark, sf_dir):
    listing = table(spark, sf_dir, "pages").select(
        F.expr("substring(url, 1, instr(url, '.'))").alias("dir"),
        F.concat_ws("#", "url", "page_id").alias("name"),
    )
    return group_preview(listing).select("dir", F.array_join("items", " ").alias("items"), "more")


@query("generic_name_anti", f"""
SELECT doc_id, name FROM (SELECT doc_id, {_NAME} AS name FROM documents)
WHERE lower(coalesce(name, '')) NOT IN
  (SELECT lower(split_part(text, ' ', 1)) FROM benchmark)""")
def generic_name_anti(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.expr(_NAME).alias("name"))
    words = table(spark, sf_dir, "benchmark").select(F.split_part(
        F.col("text"), F.lit(" "), F.lit(1)).alias("name"))
    return exclude_names(rows, words, "name", ["doc_id"])
