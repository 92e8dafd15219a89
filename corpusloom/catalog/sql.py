"""Pieces of DuckDB SQL shared by the queries' reference statements."""

from __future__ import annotations

from corpusloom import constants as K
from corpusloom.catalog.corpus import q

WS = "(" + " || ".join(f"chr({c})" for c in K.WHITESPACE_CODEPOINTS) + ")"
NL = "chr(10)"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def lines(x: str) -> str:
    return f"string_split({x}, {NL})"


def line_count(x: str) -> str:
    return f"CAST(len({lines(x)}) AS INTEGER)"


def nonblank(x: str) -> str:
    return f"CAST(len(list_filter({lines(x)}, lambda s: {strip('s')} <> '')) AS INTEGER)"


def normalize(x: str) -> str:
    stripped = f"list_transform({lines(x)}, lambda s: {strip('s')})"
    kept = f"list_filter({stripped}, lambda s: s <> '' AND NOT starts_with(s, '#'))"
    return f"coalesce(array_to_string({kept}, {NL}), '')"


def code_hash(x: str) -> str:
    return f"md5({normalize(x)})"


def complexity(x: str) -> str:
    return "CAST(" + " + ".join(
        f"len(string_split(lower({x}), '{w}')) - 1" for w in K.COMPLEXITY_KEYWORDS
    ) + " AS INTEGER)"


def is_lower(x: str) -> str:
    return rf"(regexp_matches({x}, '\p{{Ll}}') AND NOT regexp_matches({x}, '[\p{{Lu}}\p{{Lt}}]'))"


def is_upper(x: str) -> str:
    return rf"(regexp_matches({x}, '\p{{Lu}}') AND NOT regexp_matches({x}, '[\p{{Ll}}\p{{Lt}}]'))"


def naming_style(x: str) -> str:
    return rf"""CASE
      WHEN NOT regexp_full_match(replace({x}, '_', ''), '[\p{{L}}\p{{N}}]+') THEN 'mixed'
      WHEN contains({x}, '_') AND {is_lower(x)} THEN 'snake_case'
      WHEN NOT contains({x}, '_') AND regexp_matches({x}, '^\p{{Lu}}') THEN 'PascalCase'
      WHEN regexp_matches({x}, '^\p{{Ll}}.*\p{{Lu}}') THEN 'camelCase'
      WHEN contains({x}, '_') AND {is_upper(x)} THEN 'UPPER_CASE'
      WHEN {is_lower(x)} THEN 'lowercase' ELSE 'mixed' END"""


def sentence(x: str) -> str:
    return f"string_split({x}, '.')[1]"


def function_instruction(name: str, doc: str) -> str:
    low = f"lower({name})"
    return f"""CASE
      WHEN coalesce({sentence(doc)}, '') <> '' THEN 'Write a function that ' || lower({sentence(doc)})
      WHEN contains({low}, 'get') THEN 'Create a getter function named ' || {name}
      WHEN contains({low}, 'set') THEN 'Create a setter function named ' || {name}
      WHEN regexp_matches({low}, 'calculate|compute')
        THEN 'Write a calculation function named ' || {name}
      WHEN regexp_matches({low}, 'validate|check')
        THEN 'Create a validation function named ' || {name}
      ELSE 'Implement a function named ' || {name} END"""


def class_instruction(name: str, doc: str, methods: str) -> str:
    """`methods` is text: the method names joined by spaces."""
    low = f"lower({name})"
    return f"""CASE
      WHEN coalesce({sentence(doc)}, '') <> '' THEN 'Create a class that ' || lower({sentence(doc)})
      WHEN contains({low}, 'manager')
        THEN 'Design a ' || {name} || ' class for managing resources'
      WHEN contains({low}, 'handler')
        THEN 'Create a ' || {name} || ' class for handling operations'
      WHEN contains(lower(coalesce({methods}, '')), 'process')
        THEN 'Implement a ' || {name} || ' class with processing capabilities'
      ELSE 'Create a ' || {name} || ' class with appropriate methods' END"""


def docstring_basic(x: str) -> str:
    return f"""CASE WHEN contains({x}, 'Args:') AND contains({x}, 'Returns:') THEN 'google_style'
      WHEN contains({x}, ':param') AND contains({x}, ':return') THEN 'sphinx_style'
      ELSE 'basic' END"""


def docstring_style(x: str) -> str:
    return f"""CASE WHEN coalesce({x}, '') = '' THEN 'none'
      WHEN contains({x}, 'Args:') AND contains({x}, 'Returns:') THEN 'google_style'
      WHEN contains({x}, ':param') AND contains({x}, ':return') THEN 'sphinx_style'
      WHEN len(string_split({x}, '\"\"\"')) > 2 OR len(string_split({x}, '''''''')) > 2
        THEN 'triple_quote'
      WHEN len({lines(x)}) = 1 THEN 'single_line' ELSE 'multi_line' END"""


def clean_code(x: str) -> str:
    body = (
        f"trim(array_to_string(list_transform({lines(x)}, lambda s: rtrim(s, {WS})), {NL}), {NL})"
    )
    return f"""CASE WHEN len({lines(body)}) > {K.PROMPT_CODE_LINES}
      THEN array_to_string({lines(body)}[1:{K.PROMPT_CODE_LINES}], {NL}) || {NL} || {q(K.TRUNCATION_MARKER)}
      ELSE {body} END"""


def user_content(instruction: str, context: str) -> str:
    return (
        f"CASE WHEN coalesce({context}, '') <> '' THEN {instruction} || {NL} || {NL} || "
        f"'Context: ' || {context} ELSE {instruction} END"
    )


def units_cte(kind: str) -> str:
    """Units of one pattern kind from `code_files`, before keep rules."""
    spec = {k[0]: k for k in K.UNIT_KINDS}[kind]
    _, language, group, *_ = spec
    pattern = q(K.UNIT_PATTERNS[kind])
    return f"""SELECT repo, path, name AS file, ext_rank, language, '{kind}' AS kind, pos,
      regexp_extract(code, {pattern}, {group}) AS name, code
    FROM (SELECT f.*, unnest(m) AS code, unnest(range(len(m))) AS pos
          FROM (SELECT *, regexp_extract_all(content, {pattern}, 0) AS m
                FROM code_files WHERE language = '{language}') f)"""


def kept_units(kind: str) -> str:
    spec = {k[0]: k for k in K.UNIT_KINDS}[kind]
    rules = [f"len({lines('code')}) >= {spec[3]}"]
    if kind == "java_method":
        rules.append(r"NOT regexp_matches(name, '^\p{Lu}')")
    if kind == "cpp_function":
        rules.append(f"lower(name) NOT IN {in_list(K.CPP_CONTROL_WORDS)}")
    return f"SELECT * FROM ({units_cte(kind)}) WHERE " + " AND ".join(rules)


KEEP_PYTHON = f"""(kind = 'python_class' AND {line_count('code')} <= {K.MAX_UNIT_LINES}
   OR kind = 'python_function' AND NOT starts_with(name, '__')
      AND {line_count('code')} BETWEEN {K.MIN_UNIT_LINES} AND {K.MAX_PYTHON_FUNCTION_LINES}
      AND {complexity('code')} <= {K.MAX_COMPLEXITY})"""


def all_units_cte() -> str:
    """`units`: kept units of every kind; needs `code_files` and `py_units`.

    Columns repo, ext_rank, path, seq, kind, name, code, doc, others, args,
    methods, file, language, complexity and the other metadata.
    """
    ranks: dict[str, int] = {}
    selects = []
    for kind, language, *_ in K.UNIT_KINDS:
        rank = ranks.get(language, 0)
        ranks[language] = rank + 1
        selects.append(
            f"SELECT repo, ext_rank, path, {rank << 32} + pos AS seq, kind, name, code, "
            f"NULL::VARCHAR AS doc, NULL::VARCHAR AS others, NULL::INTEGER AS args, "
            f"NULL::INTEGER AS methods, file, language FROM ({kept_units(kind)})"
        )
    python = f"""SELECT repo, 0 AS ext_rank, path, seq, kind, name, code, doc, others, args,
      methods, file, 'python' AS language FROM py_units WHERE {KEEP_PYTHON}"""
    documented = f"""SELECT repo, 0 AS ext_rank, path, seq + 1 AS seq,
      'python_documented_function' AS kind, name, code, doc, others, args, methods, file,
      'python' AS language FROM py_units
      WHERE kind = 'python_function' AND {KEEP_PYTHON}
        AND length(doc) > {K.DOCUMENTED_FUNCTION_MIN_CHARS}"""
    body = "\n UNION ALL ".join([python, documented, *selects])
    return f"units AS ({body})"


def by_kind(position: int) -> str:
    cases = " ".join(
        f"WHEN '{k[0]}' THEN {q(k[position])}" for k in K.UNIT_KINDS if k[position] is not None
    )
    return f"CASE kind {cases} END"


def instruction() -> str:
    return f"""CASE kind
      WHEN 'python_function' THEN {function_instruction('name', 'doc')}
      WHEN 'python_class' THEN {class_instruction('name', 'doc', 'others')}
      WHEN 'python_documented_function' THEN {q(K.DOCUMENTED_FUNCTION_INSTRUCTION)}
      ELSE {by_kind(4)} || name END"""


def context(style: str) -> str:
    return f"""CASE WHEN kind = 'python_documented_function' THEN 'Purpose: ' || {sentence('doc')}
      ELSE 'File: ' || file || ' | ' || coalesce({by_kind(5)}, {style}) END"""


# metadata that is derived from a unit; its name, file and language are columns
DERIVED_METADATA = f"""kind AS type,
  CASE WHEN kind = 'python_function' THEN {line_count('code')} END AS lines,
  CASE WHEN kind = 'python_function' THEN {complexity('code')} END AS complexity,
  CASE WHEN kind IN ('python_function', 'python_class') THEN coalesce(doc, '') <> '' END
    AS has_docstring,
  CASE WHEN kind = 'python_function' THEN args END AS arg_count,
  CASE WHEN kind = 'python_class' THEN methods END AS method_count,
  CASE WHEN kind <> 'python_documented_function' THEN {naming_style('name')} END AS naming_style,
  CASE WHEN kind = 'python_documented_function' THEN {docstring_basic('doc')} END AS doc_style"""


EXAMPLE_METADATA = f"name, 'src/' || file AS file, language, {DERIVED_METADATA}"


def passes_quality(code: str, name: str) -> str:
    return f"""{line_count(code)} BETWEEN {K.MIN_UNIT_LINES} AND {K.MAX_UNIT_LINES}
      AND lower(coalesce({name}, '')) NOT IN {in_list(K.GENERIC_NAMES)}
      AND {nonblank(code)} >= {K.MIN_NONBLANK_LINES}"""


def priority(documented: str, style: str) -> str:
    return f"""CASE WHEN coalesce({documented}, FALSE)
      OR coalesce({style} IN {in_list(K.PREFERRED_NAMING)}, FALSE) THEN 'high' END"""
