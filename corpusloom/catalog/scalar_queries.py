"""Queries over text and name functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.catalog import sql as S
from corpusloom.catalog.corpus import q, spread, table
from corpusloom.catalog.registry import query
from corpusloom.functions import chat, naming, spec, text
from corpusloom.plans.chat import render_conversations

# Expressions below are plain enough to mean the same in Spark and in DuckDB.
# `documents` has neither tabs nor comments; this makes code-like text of it.
_CODE = (
    "replace(replace(text, '. ', chr(10) || chr(9) || '#'), ', ', '  ' || chr(10) || '    ')"
)
# names of many shapes, made of the first two words of a text
_W1 = "split_part(text, ' ', 1)"
_W2 = "split_part(text, ' ', 2)"


def _ascii_upper(x: str) -> str:
    # `upper` of a sharp s is not the same everywhere
    return f"translate({x}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


_NAME = f"""CASE doc_id % 14
  WHEN 0 THEN lower({_W1}) || '_' || lower({_W2}) WHEN 1 THEN {_W1}
  WHEN 2 THEN lower({_W1}) || 'X' || {_W2} WHEN 3 THEN {_ascii_upper(_W1)} || '_' || {_ascii_upper(_W2)}
  WHEN 4 THEN lower({_W1}) WHEN 5 THEN {_ascii_upper(_W1)} WHEN 6 THEN 'A_' || {_W1}
  WHEN 7 THEN 'get' || {_W1} WHEN 8 THEN 'reset_' || {_W1} WHEN 9 THEN 'Compute' || {_W1}
  WHEN 10 THEN 'check_' || {_W1} WHEN 11 THEN {_W1} || 'Manager'
  WHEN 12 THEN {_W1} || '_handler' ELSE '_' END"""
_DOC = f"""CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '.' || text
  WHEN 3 THEN text || ' Args: x Returns: y' WHEN 4 THEN ':param a: ' || text || ' :return: b'
  WHEN 5 THEN '\"\"\"' || text || '\"\"\"' ELSE text END"""
_PATH = """CASE doc_id % 12
  WHEN 0 THEN 'r0/environment/' WHEN 1 THEN 'r0/.github/' WHEN 2 THEN 'r0/src/com'
  WHEN 3 THEN 'r1/node_modules/x/' WHEN 4 THEN 'r1/pkg/migrations/' WHEN 5 THEN ''
  WHEN 6 THEN 'r1/distance/' WHEN 7 THEN 'r2/a/b/c/' WHEN 8 THEN 'r2/targets/'
  WHEN 9 THEN 'r2/.next/' ELSE 'r3/src/' END || CASE doc_id % 3 WHEN 0 THEN 'bine' ELSE 'main' END
  || CAST(doc_id AS {text})"""
_EXT = """CASE doc_id % 13 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts'
  WHEN 3 THEN '.java' WHEN 4 THEN '.cpp' WHEN 5 THEN '.c' WHEN 6 THEN '.h' WHEN 7 THEN '.hpp'
  WHEN 8 THEN '.go' WHEN 9 THEN '.rs' WHEN 10 THEN '.md' WHEN 11 THEN '.PY' ELSE '' END"""


def path_expr(kind: str) -> str:
    return f"({_PATH.format(text=kind)}) || ({_EXT})"


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


def _over(expression: str, alias: str, fn):
    """Query `doc_id, fn(expression)` over all documents."""
    def run(spark, sf_dir):
        return documents(spark, sf_dir).select("doc_id", F.expr(expression).alias("x")).select(
            "doc_id", fn(F.col("x")).alias(alias)
        )

    return run


def _sql_over(expression: str, alias: str, value: str) -> str:
    return f"SELECT doc_id, {value} AS {alias} FROM (SELECT doc_id, {expression} AS x FROM documents)"


def _scalar(name: str, expression: str, alias: str, fn, value: str) -> None:
    query(name, _sql_over(expression, alias, value))(_over(expression, alias, fn))


_scalar("complexity_score", "text || ' elif CLASS showcase'", "complexity",
        naming.complexity, S.complexity("x"))
_scalar("naming_style", _NAME, "naming_style", naming.naming_style, S.naming_style("x"))
_scalar("docstring_style3", f"coalesce({_DOC}, '')", "doc_style",
        naming.docstring_style_basic, S.docstring_basic("x"))
_scalar("docstring_style6", _DOC, "doc_style", naming.docstring_style, S.docstring_style("x"))
_scalar("line_count", _CODE, "lines", text.line_count, S.line_count("x"))
_scalar("nonblank_lines", f"chr(10) || chr(9) || chr(10) || {_CODE} || chr(10) || ' '", "lines",
        text.nonblank_line_count, S.nonblank("x"))
_scalar("normalize_code", f"'#include' || chr(10) || chr(10) || {_CODE}", "code",
        text.normalize_code, S.normalize("x"))
_scalar("clean_code", f"chr(10) || '  ' || chr(10) || {_CODE} || ' ' || chr(10)", "code",
        text.clean_code, S.clean_code("x"))
_scalar("word_count", _CODE, "words", text.word_count,
        rf"CAST(len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) AS INTEGER)")


@query("function_instruction", f"""
SELECT doc_id, {S.function_instruction('name', 'doc')} AS instruction
FROM (SELECT doc_id, {_NAME} AS name, {_DOC} AS doc FROM documents)""")
def function_instruction(spark, sf_dir):
    rows = documents(spark, sf_dir).selectExpr("doc_id", f"{_NAME} AS name", f"{_DOC} AS doc")
    return rows.select(
        "doc_id", naming.function_instruction(F.col("name"), F.col("doc")).alias("instruction")
    )


_METHODS = f"CASE doc_id % 5 WHEN 0 THEN 'run reProcess_all' WHEN 1 THEN {_W2} ELSE '' END"


@query("class_instruction", f"""
SELECT doc_id, {S.class_instruction('name', 'doc', 'methods')} AS instruction
FROM (SELECT doc_id, {_NAME} AS name, {_DOC} AS doc, {_METHODS} AS methods FROM documents)""")
def class_instruction(spark, sf_dir):
    rows = documents(spark, sf_dir).selectExpr(
        "doc_id", f"{_NAME} AS name", f"{_DOC} AS doc", f"{_METHODS} AS methods"
    )
    methods = F.split("methods", " ")
    return rows.select(
        "doc_id",
        naming.class_instruction(F.col("name"), F.col("doc"), methods).alias("instruction"),
    )


@query("short_path", f"""
SELECT doc_id, array_to_string(string_split(x, '/')[-2:], '/') AS file
FROM (SELECT doc_id, {path_expr('VARCHAR')} AS x FROM documents)""")
def short_path(spark, sf_dir):
    return _over(path_expr("string"), "file", text.short_path)(spark, sf_dir)


@query("prompt_request", f"""
SELECT doc_id, '{K.GENERATION_MODEL}' AS model,
  {q(K.GENERATION_PROMPT_HEAD)} || {S.clean_code('x')} || {q(K.GENERATION_PROMPT_TAIL)} AS prompt,
  FALSE AS stream, 'json' AS format, {S.NL} || {S.NL} || '|```' AS stop
FROM (SELECT doc_id, {_CODE} AS x FROM documents)""")
def prompt_request(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.expr(_CODE).alias("x"))
    request = chat.generation_request(F.col("x"))
    return rows.select("doc_id", request.alias("r")).select(
        "doc_id", "r.model", "r.prompt", "r.stream", "r.format",
        F.array_join("r.options.stop", "|").alias("stop"),
    )


# raw answers: plain, prefixed, quoted, as JSON, as JSON of the wrong shape, cut off
_JSON = {"duckdb": "CAST(to_json({{'response': {x}}}) AS VARCHAR)",
         "spark": "to_json(named_struct('response', {x}))"}


def _raw_response(engine: str) -> str:
    def as_json(x: str) -> str:
        return _JSON[engine].format(x=x)

    return f"""CASE doc_id % 12
      WHEN 0 THEN {as_json("'\"Prompt: ' || text || '\"'")} WHEN 1 THEN {as_json('text')}
      WHEN 2 THEN '  Here''s a PROMPT: prompt:  ' || text || '  '
      WHEN 3 THEN '\"\"User prompt: The prompt would be: ' || text || '!\"\"'
      WHEN 4 THEN '{{"response": 5}}' WHEN 5 THEN '{{"response": null}}'
      WHEN 6 THEN '{{"other": "' || CAST(doc_id AS {'VARCHAR' if engine == 'duckdb' else 'string'}) || '"}}'
      WHEN 7 THEN '{{bad ' || text WHEN 8 THEN 'Prompt:' || {_W1}
      WHEN 9 THEN {as_json("text")} || ' trailing'
      WHEN 10 THEN chr(9) || {as_json("'A suitable prompt would be: ' || text || '?'")} || chr(10)
      ELSE '''' || text || '''' END"""


def _clean_response_sql() -> str:
    expression = S.strip(f"trim(trim({S.strip('answer')}, '\"'), '''')")
    for prefix in K.RESPONSE_PREFIXES:
        expression = (
            f"list_transform([{expression}], lambda t: CASE WHEN "
            f"starts_with(lower(t), {q(prefix.lower())}) "
            f"THEN {S.strip(f't[{len(prefix) + 1}:]')} ELSE t END)[1]"
        )
    return f"""
SELECT doc_id, CASE WHEN length(t) BETWEEN {K.MIN_RESPONSE_CHARS} AND {K.MAX_RESPONSE_CHARS}
  THEN CASE WHEN t[-1] IN ('.', '!', '?') THEN t ELSE t || '.' END END AS instruction
FROM (SELECT doc_id, {expression} AS t FROM (
  SELECT doc_id, CASE
    WHEN NOT starts_with({S.strip('raw')}, '{{') THEN raw
    WHEN NOT json_valid(raw) THEN NULL
    WHEN json_type(raw, '$.response') IS NULL THEN ''
    WHEN json_type(raw, '$.response') = 'VARCHAR' THEN json_extract_string(raw, '$.response')
    END AS answer
  FROM (SELECT doc_id, {_raw_response('duckdb')} AS raw FROM documents)))"""


@query("clean_response", _clean_response_sql())
def clean_response(spark, sf_dir):
    return _over(_raw_response("spark"), "instruction", chat.clean_response)(spark, sf_dir)


# texts in which each rung of the fallback is the first to apply for some rows
_FALLBACK = """lower(text) || CASE doc_id % 9 WHEN 0 THEN ' Class X: def __init__'
  WHEN 1 THEN ' CLASS x' WHEN 2 THEN ' def f return ' WHEN 3 THEN ' def f'
  WHEN 4 THEN ' import a' WHEN 5 THEN ' from a' WHEN 6 THEN ' if __name__'
  WHEN 7 THEN ' try:' ELSE '' END"""
_F = "lower(x)"
_scalar(
    "fallback_prompt", _FALLBACK, "prompt", chat.fallback_prompt,
    f"""CASE
      WHEN contains({_F}, 'class ') THEN CASE WHEN contains({_F}, 'def __init__')
        THEN 'Create a class with proper initialization and methods.'
        ELSE 'Write a class with the necessary methods.' END
      WHEN contains({_F}, 'def ') THEN CASE WHEN contains({_F}, 'return ')
        THEN 'Write a function that processes input and returns a result.'
        ELSE 'Create a function to handle the required functionality.' END
      WHEN regexp_matches({_F}, 'import |from ')
        THEN 'Write code with the necessary imports and implementation.'
      WHEN contains({_F}, 'if __name__') THEN 'Create a script with a main execution block.'
      WHEN regexp_matches({_F}, 'try:|except') THEN 'Write code with proper error handling.'
      ELSE 'Write the necessary code implementation.' END""",
)

_CONTEXT = "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE source END"


@query("to_messages", f"""
SELECT doc_id, p AS pos, ['system', 'user', 'assistant'][p + 1] AS role,
  [{q(K.SYSTEM_MESSAGE)}, {S.user_content('lang', 'context')}, text][p + 1] AS content
FROM (SELECT *, unnest([0, 1, 2]) AS p FROM
  (SELECT doc_id, lang, text, {_CONTEXT} AS context FROM documents))""")
def to_messages(spark, sf_dir):
    rows = documents(spark, sf_dir).select(
        "doc_id", chat.to_messages(F.col("lang"), F.expr(_CONTEXT), F.col("text")).alias("m")
    )
    return rows.select("doc_id", F.posexplode("m").alias("pos", "m")).select(
        "doc_id", "pos", "m.role", "m.content"
    )


@query("chatml_render", """
SELECT conv_id, coalesce(string_agg(part, chr(10) ORDER BY turn) || chr(10), '')
  || '<|im_start|>assistant' || chr(10) AS text
FROM (SELECT conv_id, turn, CASE WHEN role IN ('system', 'user', 'assistant')
    THEN '<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' END AS part FROM conversations)
GROUP BY conv_id""")
def chatml_render(spark, sf_dir):
    return render_conversations(table(spark, sf_dir, "conversations"))


_SPEC = """'{{' || CASE WHEN o_orderkey % 5 = 0 THEN '"ui": {{}}' ELSE
  '"module": {{"name": "m' || CAST(o_orderkey AS {text}) || '"}}' END
  || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ', "entities": [{{"name": "' || o_orderstatus
     || '", "fields": [{{"name": "f"}}' || repeat(', {{"name": "g"}}', CAST(o_custkey % 7 AS INT))
     || ']}}' || repeat(', {{"fields": []}}', CAST(o_orderkey % 4 AS INT)) || ', {{"name": "'
     || o_orderpriority || '"}}]' END
  || CASE WHEN o_orderkey % 4 = 1 THEN ', "api": {{"style": "grpc", "endpoints": ["a"'
     || repeat(', "b"', CAST(o_custkey % 5 AS INT)) || ']}}'
     WHEN o_orderkey % 4 = 2 THEN ', "api": {{"base_path": "/v' || o_orderstatus || '"}}' ELSE '' END
  || CASE WHEN o_orderkey % 5 = 1 THEN ', "ui": {{"framework": "vue", "routes": ["/"]}}' ELSE '' END
  || CASE WHEN o_orderkey % 2 = 1 THEN ', "persistence": {{"driver": "sqlite"}}' ELSE '' END
  || CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE '}}' END"""


@query("spec_profile", f"""
SELECT o_orderkey, CASE WHEN s IS NOT NULL THEN coalesce(s ->> '$.module.name', 'unknown') END AS module_name,
  CASE WHEN s IS NOT NULL THEN coalesce(array_to_string(list_transform(CAST(s -> '$.entities' AS JSON[]),
    lambda e: coalesce(e ->> '$.name', 'Unknown') || ' with '
      || coalesce(json_array_length(e, '$.fields'), 0) || ' fields'), '; '), '') END AS entities,
  CASE WHEN s IS NOT NULL THEN coalesce(s ->> '$.api.style', 'rest') END AS api_style,
  CASE WHEN s IS NOT NULL THEN coalesce(s ->> '$.api.base_path', '/api') END AS base_path,
  CASE WHEN s IS NOT NULL THEN CAST(coalesce(json_array_length(s, '$.api.endpoints'), 0) AS INTEGER) END AS endpoints_count,
  CASE WHEN s IS NOT NULL THEN coalesce(s ->> '$.ui.framework', 'react') END AS ui_framework,
  CASE WHEN s IS NOT NULL THEN CAST(coalesce(json_array_length(s, '$.ui.routes'), 0) AS INTEGER) END AS routes_count,
  CASE WHEN s IS NOT NULL THEN coalesce(s ->> '$.persistence.driver', 'postgres') END AS persistence
FROM (SELECT o_orderkey, TRY_CAST({_SPEC.format(text='VARCHAR')} AS JSON) AS s FROM orders)""")
def spec_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr(_SPEC.format(text="string")).alias("s")
    )
    profile = rows.select("o_orderkey", spec.spec_profile(F.col("s")).alias("p"))
    return profile.select(
        "o_orderkey", "p.module_name", F.array_join("p.entities", "; ").alias("entities"),
        "p.api_style", "p.base_path", "p.endpoints_count", "p.ui_framework", "p.routes_count",
        "p.persistence",
    )
