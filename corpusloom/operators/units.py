"""Files -> code units -> training examples.

Every file yields one array of units, so all languages and kinds share a
single pass over the corpus; there is no union of per-kind scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import constants as K
from corpusloom.functions.naming import (
    class_instruction, complexity_in_lambda, docstring_style_basic, first_sentence,
    function_instruction, naming_style,
)
from corpusloom.functions.text import line_count, short_path
from corpusloom.operators.kinds import FunctionKind
from corpusloom.operators.python_units import UNITS
from corpusloom.operators.regex_units import match_units
from corpusloom.operators.registry import DEFAULT_REGISTRY, ExtractorRegistry
from corpusloom.schemas import METADATA

UNIT_ORDER = ("ext_rank", "path", "seq")


def _pattern_units(registry: ExtractorRegistry) -> Column:
    """Array of pattern units; a file is only matched for its own language."""
    content = F.col("content")
    result = F.lit(None)
    for language in registry.pattern_languages():
        kinds = [k for k in registry.kinds if k.language == language]
        found = F.concat(*[match_units(content, k, rank) for rank, k in enumerate(kinds)])
        result = F.when(F.col("language") == language, found).otherwise(result)
    return result


def _keep_function_unit(u: Column) -> Column:
    """Keep rules of the units that a language function reports."""
    lines = line_count(u["code"])
    is_function = u["kind"] == "python_function"
    good_function = (
        ~F.startswith(u["name"], F.lit("__"))
        & lines.between(K.MIN_UNIT_LINES, K.MAX_PYTHON_FUNCTION_LINES)
        & (complexity_in_lambda(u["code"]) <= K.MAX_COMPLEXITY)
    )
    good_class = lines <= K.MAX_UNIT_LINES
    return u["error"].isNull() & F.when(is_function, good_function).when(
        u["kind"] == "python_class", good_class
    ).otherwise(F.lit(True))


def _with_documented(units: Column) -> Column:
    """Add the second example of well-documented functions."""
    documented = F.filter(
        units,
        lambda u: (u["kind"] == "python_function")
        & (F.length(u["docstring"]) > K.DOCUMENTED_FUNCTION_MIN_CHARS),
    )
    extra = F.transform(
        documented,
        lambda u: u.withField("kind", F.lit("python_documented_function")).withField(
            "seq", u["seq"] + 1
        ),
    )
    return F.concat(units, extra)


def _widen(units: Column) -> Column:
    """Pattern units in the schema of function units."""
    none = F.lit(None)
    return F.transform(
        units,
        lambda u: F.struct(
            u["kind"].alias("kind"), u["seq"].alias("seq"), u["name"].alias("name"),
            u["code"].alias("code"), none.cast("string").alias("docstring"),
            none.cast("int").alias("arg_count"), none.cast("int").alias("method_count"),
            none.cast("array<string>").alias("methods"), none.cast("string").alias("error"),
        ),
    )


def parse_files(files: DataFrame, registry: ExtractorRegistry = DEFAULT_REGISTRY) -> DataFrame:
    """One row per file: `units` kept, `errors` met, and `n_units`.

    Input: files as returned by `files.select_files`.
    """
    parsed = files
    arrays = [_widen(_pattern_units(registry))] if registry.kinds else []
    raw = []
    for i, (language, fn) in enumerate(registry.functions):
        # other languages pass NULL, so their text never crosses into Python
        text = F.when(F.col("language") == language, F.col("content"))
        parsed = parsed.withColumn(f"_raw{i}", fn(text))
        raw.append(F.col(f"_raw{i}"))
    for column in raw:
        arrays.append(_with_documented(F.filter(column, _keep_function_unit)))
    no_units = F.array().cast(UNITS)
    found = F.coalesce(*arrays, no_units)
    errors = F.coalesce(
        *[F.filter(c, lambda u: u["error"].isNotNull()) for c in raw], no_units
    )
    undecodable = F.array(
        F.struct(F.lit("file").alias("kind"), F.lit(None).cast("string").alias("name"),
                 F.lit("UnicodeDecodeError").alias("error"))
    )
    slim_errors = F.transform(
        errors, lambda u: F.struct(u["kind"].alias("kind"), u["name"].alias("name"),
                                   u["error"].alias("error"))
    )
    return parsed.select(
        "repo", "ext_rank", "path", "language",
        found.alias("units"),
        F.when(F.col("content").isNull(), undecodable).otherwise(slim_errors).alias("errors"),
    ).withColumn("n_units", F.size("units"))


def explode_units(parsed: DataFrame) -> DataFrame:
    """One row per unit.

    An outer explode, because for an inner one the optimizer adds a filter on
    the array's size below it, which would run every extractor a second time.
    """
    rows = parsed.select("repo", "ext_rank", "path", "language", F.inline_outer("units"))
    return rows.where(F.col("kind").isNotNull())


def explode_errors(parsed: DataFrame) -> DataFrame:
    """Side table of what could not be read: whole files and single units."""
    rows = parsed.select("repo", "path", F.inline_outer("errors"))
    return rows.where(F.col("kind").isNotNull()).select(
        "repo", "path", F.col("kind").alias("unit_kind"), F.col("name").alias("unit"), "error"
    )


def units_and_errors(parsed: DataFrame) -> DataFrame:
    """One row per unit, and one per error, with its `error` and without code; one explode of one array."""
    none = F.lit(None)
    errors = F.transform(
        "errors",
        lambda e: F.struct(
            e["kind"].alias("kind"), none.cast("bigint").alias("seq"), e["name"].alias("name"),
            none.cast("string").alias("code"), none.cast("string").alias("docstring"),
            none.cast("int").alias("arg_count"), none.cast("int").alias("method_count"),
            none.cast("array<string>").alias("methods"), e["error"].alias("error"),
        ),
    )
    return explode_units(parsed.withColumn("units", F.concat("units", errors)))


def _by_kind(registry: ExtractorRegistry, attribute) -> Column:
    kinds = F.create_map(*[
        c for k in (*registry.kinds, *registry.function_kinds) for c in (F.lit(k.kind), F.lit(attribute(k)))
    ])
    return F.element_at(kinds, F.col("kind"))


def to_examples(units: DataFrame, registry: ExtractorRegistry = DEFAULT_REGISTRY, keep: tuple[str, ...] = ()) -> DataFrame:
    """Units as examples: instruction, context parts, output and metadata, and the columns to `keep`.

    `context_suffix` is NULL where the style context of the repository belongs;
    `attach_style` fills it in after rows have been selected.
    """
    kind, name, code, doc = (F.col(c) for c in ("kind", "name", "code", "docstring"))
    is_function = kind == "python_function"
    is_documented = kind == "python_documented_function"
    is_class = kind == "python_class"
    is_python = is_function | is_documented | is_class

    instruction = (
        F.when(is_function, function_instruction(name, doc))
        .when(is_class, class_instruction(name, doc, F.col("methods")))
        .when(is_documented, K.DOCUMENTED_FUNCTION_INSTRUCTION)
        .otherwise(F.concat(
            F.coalesce(_by_kind(registry, lambda k: k.instruction), F.lit(FunctionKind.instruction)), name))
    )
    file_prefix = F.concat(F.lit("File: "), F.substring_index("path", "/", -1), F.lit(" | "))
    prefix = F.when(
        is_documented, F.concat(F.lit("Purpose: "), first_sentence(doc))
    ).otherwise(file_prefix)
    suffix = F.when(is_documented, F.lit("")).when(
        ~is_python, _by_kind(registry, lambda k: k.context)
    )

    has_doc = F.coalesce(doc, F.lit("")) != ""
    values = {
        "type": kind,
        "name": name,
        "file": short_path(F.col("path")),
        "language": F.col("language"),
        "lines": F.when(is_function, line_count(code)),
        "complexity": F.when(is_function, complexity_in_lambda(code)),
        "has_docstring": F.when(is_function | is_class, has_doc),
        "arg_count": F.when(is_function, F.col("arg_count")),
        "method_count": F.when(is_class, F.col("method_count")),
        "naming_style": F.when(~is_documented, naming_style(name)),
        "doc_style": F.when(is_documented, docstring_style_basic(doc)),
        "style_focus": F.lit(True),
    }
    metadata = F.struct(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA.fields
    ])
    return units.select(
        "repo", *UNIT_ORDER,
        instruction.alias("instruction"),
        prefix.alias("context_prefix"),
        suffix.alias("context_suffix"),
        code.alias("output"),
        metadata.alias("metadata"),
        *keep,
    )


def extract_examples(files: DataFrame, registry: ExtractorRegistry = DEFAULT_REGISTRY) -> DataFrame:
    return to_examples(explode_units(parse_files(files, registry)), registry)
