"""Queries over the style of repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.catalog import sql as S
from corpusloom.catalog.corpus import (
    PYTHON_ORGANIZATION, code_files, files_cte, python_docstrings_cte, python_imports_cte,
    python_names_cte, q,
)
from corpusloom.catalog.registry import SQL, query
from corpusloom.operators.files import profile_sample, select_files
from corpusloom.operators.style import (
    analyzed_files, count_facts, file_facts, import_sample, style_counts, style_profile,
)


def _facts(spark, sf_dir, *extensions):
    return file_facts(select_files(code_files(spark, sf_dir, *extensions)))


def _counts(spark, sf_dir, categories, *extensions):
    counts = count_facts(_facts(spark, sf_dir, *extensions))
    return counts.where(F.col("category").isin(*categories)).select(
        "repo", "category", "value", "n"
    )


# --- facts in SQL: (repo, path, category, value, pos) --------------------------
_STYLED_PY = f"""SELECT repo, path,
  CASE WHEN category = 'variables' AND {S.is_upper('name')} THEN 'constants' ELSE category END
    AS category,
  CASE WHEN category = 'variables' AND {S.is_upper('name')} THEN 'UPPER_CASE'
    ELSE {S.naming_style('name')} END AS value, pos
FROM py_names"""

_STYLED_DOCS = f"""SELECT repo, path, 'docstrings' AS category, {S.docstring_style('doc')} AS value, pos
FROM py_docs"""


def _pattern_names(language: str, patterns) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT repo, path, '{category}' AS category, {S.naming_style('m')} AS value,
  {rank << 24} + i AS pos FROM (
    SELECT repo, path, unnest(ms) AS m, unnest(range(len(ms))) AS i FROM (
      SELECT repo, path, regexp_extract_all(content, {q(pattern)}, 1) AS ms
      FROM code_files WHERE language = '{language}'))"""
        for rank, (category, pattern) in enumerate(patterns)
    )


# lines of the files that are profiled; the broken Python file is not
_LINES = f"""lines AS (
  SELECT repo, path, line, i, length(rtrim(line, {S.WS})) AS len,
         length(line) - length(ltrim(line, {S.WS})) AS lead
  FROM (SELECT repo, path, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (
    SELECT repo, path, {S.lines('content')} AS ls FROM code_files
    WHERE language IN ('python', 'javascript', 'java') AND stem <> 'b'))
  WHERE {S.strip('line')} <> '')"""

_INDENTATION = """SELECT repo, path, 'indentation' AS category,
  CASE WHEN starts_with(line, chr(9)) THEN 'tabs' ELSE 'spaces' END AS value, 2 * i AS pos
FROM lines WHERE lead > 0
UNION ALL
SELECT repo, path, 'indentation', lead || '_spaces', 2 * i + 1
FROM lines WHERE lead > 0 AND NOT starts_with(line, chr(9))"""


def _count_sql(ctes: str, facts: str, categories) -> str:
    return f"""WITH {ctes}
SELECT repo, category, value, count(*) AS n FROM ({facts})
WHERE category IN {S.in_list(categories)} GROUP BY ALL"""


_NAMES = ("functions", "classes", "variables", "constants")


@query("style_names_python",
       _count_sql(f"{files_cte('.py')}, {python_names_cte()}", _STYLED_PY, _NAMES))
def style_names_python(spark, sf_dir):
    return _counts(spark, sf_dir, _NAMES, ".py")


@query("style_names_js", _count_sql(
    files_cte(".js", ".ts"), _pattern_names("javascript", K.JAVASCRIPT_NAME_PATTERNS), _NAMES))
def style_names_js(spark, sf_dir):
    return _counts(spark, sf_dir, _NAMES, ".js", ".ts")


@query("style_names_java", _count_sql(
    files_cte(".java"), _pattern_names("java", K.JAVA_NAME_PATTERNS), _NAMES))
def style_names_java(spark, sf_dir):
    return _counts(spark, sf_dir, _NAMES, ".java")


@query("style_docstrings", _count_sql(
    f"{files_cte('.py')}, {python_docstrings_cte()}", _STYLED_DOCS, ("docstrings",)))
def style_docstrings(spark, sf_dir):
    return _counts(spark, sf_dir, ["docstrings"], ".py")


@query("style_indentation", _count_sql(f"{files_cte()}, {_LINES}", _INDENTATION, ("indentation",)))
def style_indentation(spark, sf_dir):
    return _counts(spark, sf_dir, ["indentation"])


_HAS_IMPORTS_FIRST = S.in_list([s for s, first, _ in PYTHON_ORGANIZATION if first])


@query("file_organization", f"""
WITH {files_cte('.py')}
SELECT repo, 'imports_first' AS value, count(*) AS n FROM code_files
WHERE stem IN {_HAS_IMPORTS_FIRST} GROUP BY repo
UNION ALL
SELECT repo, 'main_at_end', count(*) FROM code_files
WHERE stem <> 'b' AND contains(array_to_string({S.lines('content')}[-10:], {S.NL}),
  {q(K.MAIN_GUARD)}) GROUP BY repo""")
def file_organization(spark, sf_dir):
    return _counts(spark, sf_dir, ["organization"], ".py").drop("category")


@query("line_length_stats", f"""
WITH {files_cte()}, {_LINES}
SELECT repo, count(*) AS n_lines, CAST(sum(len) AS BIGINT) AS total_length,
  count(*) FILTER (WHERE len > 80) AS over_80, count(*) FILTER (WHERE len > 100) AS over_100,
  round_even(sum(len) / count(*), 1) AS avg_line_length
FROM lines GROUP BY repo""")
def line_length_stats(spark, sf_dir):
    counts = count_facts(_facts(spark, sf_dir)).where(F.col("category") == "lines")
    return counts.select(
        "repo", F.col("n").alias("n_lines"), "total_length", "over_80", "over_100",
        F.bround(F.col("total_length") / F.col("n"), 1).alias("avg_line_length"),
    )


# --- the profile of the sampled files ------------------------------------------
_FIRST_FILES = f" WHERE file_seq <= {K.PROFILE_FILES}"
_SAMPLED = f"""{files_cte()}, {python_names_cte()}, {python_docstrings_cte()}, {_LINES},
sample AS (SELECT * FROM (
  SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY ext_rank, path) AS file_seq
  FROM code_files){_FIRST_FILES}),
facts AS ({_STYLED_PY} UNION ALL {_STYLED_DOCS}
  UNION ALL {_pattern_names('javascript', K.JAVASCRIPT_NAME_PATTERNS)}
  UNION ALL {_pattern_names('java', K.JAVA_NAME_PATTERNS)}
  UNION ALL {_INDENTATION}),
counted AS (
  SELECT repo, category, value, count(*) AS n, min(file_seq * 4294967296 + pos) AS first_seq
  FROM facts JOIN sample USING (repo, path) GROUP BY ALL),
best AS (
  SELECT repo, category, value FROM (
    SELECT *, row_number() OVER (PARTITION BY repo, category ORDER BY n DESC, first_seq) AS rn
    FROM counted) WHERE rn = 1),
measured AS (
  SELECT repo, count(*) AS n_lines,
    CASE WHEN count(*) FILTER (WHERE len > 100) * 10 > count(*) THEN 120
         WHEN count(*) FILTER (WHERE len > 80) * 5 > count(*) THEN 100 ELSE 80 END AS max_length
  FROM lines JOIN sample USING (repo, path) GROUP BY repo)"""


def profile_cte(all_files: bool = False) -> str:
    """`profile(repo, style_context, ...)`; also defines `code_files` and `parts`."""
    sampled = _SAMPLED.replace(_FIRST_FILES, "") if all_files else _SAMPLED
    def of(category: str) -> str:
        return f"max(value) FILTER (WHERE category = '{category}')"

    return f"""{sampled},
profile AS (
  SELECT repo, f AS functions_preferred, c AS classes_preferred, v AS variables_preferred,
    i AS preferred_indentation, d AS docstring_preferred,
    max_length AS preferred_line_length,
    coalesce(nullif(concat_ws(' | ', 'Functions: ' || f, 'Classes: ' || c, 'Indentation: ' || i,
      'Max line length: ' || max_length, 'Documentation: ' || d), ''), '{K.DEFAULT_STYLE_CONTEXT}')
      AS style_context
  FROM (SELECT repo, {of('functions')} AS f, {of('classes')} AS c, {of('variables')} AS v,
          {of('indentation')} AS i, {of('docstrings')} AS d FROM best GROUP BY repo)
  FULL JOIN measured USING (repo) RIGHT JOIN (SELECT DISTINCT repo FROM sample) USING (repo))"""


def sampled_profile(spark, sf_dir):
    files = select_files(code_files(spark, sf_dir))
    sample = profile_sample(files)
    return style_profile(style_counts(sample), sample)


@query("style_profile_all_files", f"""WITH {profile_cte(all_files=True)}, analyzed AS (
  SELECT repo, count(*) AS analyzed_files FROM sample GROUP BY repo)
SELECT repo, functions_preferred, classes_preferred, variables_preferred, preferred_indentation,
  docstring_preferred, CAST(preferred_line_length AS INTEGER) AS preferred_line_length, style_context,
  analyzed_files
FROM profile JOIN analyzed USING (repo)""")
def style_profile_all_files(spark, sf_dir):
    """The whole profile, of every file and not of the first ones."""
    sample = profile_sample(select_files(code_files(spark, sf_dir)), None)
    profile = style_profile(style_counts(sample), sample).select(
        "repo", "functions_preferred", "classes_preferred", "variables_preferred", "preferred_indentation",
        "docstring_preferred", "preferred_line_length", "style_context",
    )
    return profile.join(analyzed_files(sample), "repo")


@query("preferred_style", f"""WITH {profile_cte()}
SELECT repo, functions_preferred, classes_preferred, variables_preferred FROM profile""")
def preferred_style(spark, sf_dir):
    return sampled_profile(spark, sf_dir).select(
        "repo", "functions_preferred", "classes_preferred", "variables_preferred"
    )


@query("preferred_indent", f"""WITH {profile_cte()}
SELECT repo, preferred_indentation FROM profile""")
def preferred_indent(spark, sf_dir):
    return sampled_profile(spark, sf_dir).select("repo", "preferred_indentation")


@query("preferred_line_length", f"""WITH {profile_cte()}
SELECT repo, CAST(preferred_line_length AS INTEGER) AS preferred_line_length FROM profile""")
def preferred_line_length_query(spark, sf_dir):
    return sampled_profile(spark, sf_dir).select("repo", "preferred_line_length")


@query("style_context", f"""WITH {profile_cte()}, analyzed AS (
  SELECT repo, count(*) AS analyzed_files FROM sample GROUP BY repo)
SELECT repo, style_context, analyzed_files FROM profile JOIN analyzed USING (repo)""")
def style_context_query(spark, sf_dir):
    sample = profile_sample(select_files(code_files(spark, sf_dir)))
    profile = style_profile(style_counts(sample), sample).select("repo", "style_context")
    return profile.join(analyzed_files(sample), "repo")


@query("import_sample", f"""
WITH {files_cte()}, {python_imports_cte()}, sample AS (SELECT * FROM (
  SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY ext_rank, path) AS file_seq
  FROM code_files) WHERE file_seq <= {K.PROFILE_FILES}),
counted AS (
  SELECT repo, path, imports[1:{K.IMPORTS_PER_FILE}] AS head, coalesce(sum(least(len(imports), 5))
    OVER (PARTITION BY repo ORDER BY file_seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM py_imports JOIN sample USING (repo, path))
SELECT repo, path, CAST(before + i AS BIGINT) AS seq, statement FROM (
  SELECT repo, path, before, unnest(head) AS statement, unnest(range(len(head))) AS i
  FROM counted WHERE before < {K.IMPORTS_TOTAL})""")
def import_sample_query(spark, sf_dir):
    sample = profile_sample(select_files(code_files(spark, sf_dir)))
    return import_sample(file_facts(sample))


@query("import_sample_all_files", SQL["import_sample"].replace(_FIRST_FILES, ""))
def import_sample_all_files(spark, sf_dir):
    return import_sample(file_facts(profile_sample(select_files(code_files(spark, sf_dir)), None)))
