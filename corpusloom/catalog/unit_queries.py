"""Queries over code units: one per kind, all together, errors, own kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.catalog import sql as S
from corpusloom.catalog.corpus import code_files, files_cte, python_units_cte, q
from corpusloom.catalog.registry import query
from corpusloom.operators.files import select_files
from corpusloom.operators.kinds import PatternKind
from corpusloom.operators.registry import DEFAULT_REGISTRY, ExtractorRegistry
from corpusloom.plans.dataset import extract
from corpusloom.operators.units import explode_errors, extract_examples, parse_files

_METADATA_COLUMNS = ("type", "name", "file", "language", "lines", "complexity", "has_docstring",
                     "arg_count", "method_count", "naming_style", "doc_style")
# the style context is left as a marker here; `attach_style` is another query
_STYLE = "<style>"


def _flat(examples):
    context = F.concat("context_prefix", F.coalesce("context_suffix", F.lit(_STYLE)))
    return examples.select(
        "repo", "path", "instruction", context.alias("input_context"), "output",
        *[F.col(f"metadata.{c}").alias(c) for c in _METADATA_COLUMNS],
    )


def _examples(spark, sf_dir, registry, *extensions):
    return extract_examples(select_files(code_files(spark, sf_dir, *extensions)), registry)


_FLAT_SQL = f"""SELECT repo, path, {S.instruction()} AS instruction,
  {S.context(q(_STYLE))} AS input_context, code AS output, {S.EXAMPLE_METADATA}"""

_EXTENSIONS = {
    language: [e for e, l in K.LANGUAGE_BY_EXTENSION if l == language]
    for _, language in K.LANGUAGE_BY_EXTENSION
}
_QUERY_NAMES = {
    "javascript_function": "extract_js_function",
    "javascript_arrow_function": "extract_js_arrow",
    "javascript_class": "extract_js_class",
}


def _add_pattern_query(kind: PatternKind) -> None:
    extensions = _EXTENSIONS[kind.language]
    known = "NULL::VARCHAR AS doc, NULL::VARCHAR AS others, NULL::INTEGER AS args, NULL::INTEGER AS methods"
    statement = f"""WITH {files_cte(*extensions)},
units AS (SELECT *, {known} FROM ({S.kept_units(kind.kind)}))
{_FLAT_SQL} FROM units"""
    only = ExtractorRegistry(extensions=DEFAULT_REGISTRY.extensions, kinds=(kind,))

    @query(_QUERY_NAMES.get(kind.kind, f"extract_{kind.kind}"), statement)
    def run(spark, sf_dir):
        return _flat(_examples(spark, sf_dir, only, *extensions))


for _kind in DEFAULT_REGISTRY.kinds:
    _add_pattern_query(_kind)


def _with_python(statement: str, *extensions: str) -> str:
    """WITH clause that has both `code_files` and `py_units`."""
    parts_and_units = python_units_cte()
    only_files = files_cte(*extensions).split("code_files AS (", 1)[1]
    return f"WITH {parts_and_units}, code_files AS ({only_files}, {S.all_units_cte()}\n{statement}"


def _python_query(name: str, kind: str) -> None:
    statement = _with_python(f"{_FLAT_SQL} FROM units WHERE kind = '{kind}'", ".py")

    @query(name, statement)
    def run(spark, sf_dir):
        rows = _flat(_examples(spark, sf_dir, DEFAULT_REGISTRY, ".py"))
        return rows.where(F.col("type") == kind)


_python_query("extract_python", "python_function")
_python_query("extract_python_doc", "python_documented_function")
_python_query("extract_python_class", "python_class")


@query("extract_all", _with_python(f"{_FLAT_SQL} FROM units"))
def extract_all(spark, sf_dir):
    return _flat(_examples(spark, sf_dir, DEFAULT_REGISTRY))


_ERRORS_SQL = f"""
WITH {files_cte('.py')}, broken AS (
SELECT repo, path, 'file' AS unit_kind, NULL::VARCHAR AS unit, 'SyntaxError' AS error
FROM code_files WHERE stem = 'b'
UNION ALL
SELECT repo, path || '.js', 'file', NULL, 'UnicodeDecodeError' FROM code_files WHERE stem = 'm')
"""


def _broken_files(spark, sf_dir):
    files = code_files(spark, sf_dir, ".py").select(
        "repo", "path", F.encode("content", "UTF-8").alias("content"), "size"
    )
    # the manager files once more, with a byte that is not UTF-8 in front
    undecodable = files.where(F.col("path").contains("/m")).select(
        "repo", F.concat("path", F.lit(".js")).alias("path"),
        F.concat(F.unhex(F.lit("FF")), "content").alias("content"), "size",
    )
    return files.unionByName(undecodable)


@query("extract_errors", _ERRORS_SQL + "SELECT * FROM broken")
def extract_errors(spark, sf_dir):
    return explode_errors(parse_files(select_files(_broken_files(spark, sf_dir))))


@query("dataset_errors", _ERRORS_SQL + """
SELECT *, count(*) OVER () AS counted FROM broken""")
def dataset_errors(spark, sf_dir):
    """Errors of a build: a table and a count, both from the pass that writes the units."""
    found = extract(_broken_files(spark, sf_dir))
    return found.errors.withColumn("counted", F.lit(found.counts["errors"]).cast("bigint"))


# a kind of one's own: asynchronous members of an API object
_OWN = PatternKind(
    kind="js_api_member", language="javascript", pattern=r"(\w+): async function \(x\) \{[^{}]*\}",
    min_lines=2, instruction="Write the API member ", context="API object",
)


@query("custom_extractor", f"""
WITH {files_cte('.js')}
SELECT repo, path, 'Write the API member load' || cap AS instruction,
  'File: ' || name || ' | API object' AS input_context,
  'load' || cap || ': async function (x) {{' || chr(10) || '    return x;' || chr(10) || '  }}'
    AS output,
  'js_api_member' AS type, 'load' || cap AS name
FROM code_files""")
def custom_extractor(spark, sf_dir):
    registry = DEFAULT_REGISTRY.with_pattern(_OWN)
    rows = _flat(_examples(spark, sf_dir, registry, ".js"))
    return rows.where(F.col("type") == _OWN.kind).select(
        "repo", "path", "instruction", "input_context", "output", "type", "name"
    )
