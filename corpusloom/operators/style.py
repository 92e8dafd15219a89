"""Style profile per repository.

Each file yields an array of facts `(category, value, pos, n, total_length,
over_80, over_100)`; the last three are of lines alone.  One explode and one hash
aggregation turn the facts of all files into `style_counts`; the profile is a
second, much smaller aggregation.

`pos` orders the facts inside a file, `file_seq` the files inside the sample, or
`(ext_rank, path)` all files; together they decide which of two equally frequent
values was seen first.  `n` is how often a file has the fact; its lines, and names
that a Python file repeats, are counted where it is parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom import constants as K
from corpusloom.functions.naming import docstring_style, is_upper, naming_style
from corpusloom.operators.files import FILE_ORDER
from corpusloom.operators.python_units import text_facts
from corpusloom.operators.ranking import top_k_per_group
from corpusloom.operators.regex_units import unicode_shorthands

_OF_LINES = ("total_length", "over_80", "over_100")
FACTS = "array<struct<category:string,value:string,pos:bigint,n:bigint," + ",".join(f"{c}:bigint" for c in _OF_LINES) + ">>"


def _fact(category: Column, value: Column, pos: Column, n=1, measured: Column | None = None) -> Column:
    """`measured` has what only lines have."""
    return F.struct(
        category.alias("category"),
        value.alias("value"),
        pos.cast("bigint").alias("pos"),
        (n if isinstance(n, Column) else F.lit(n)).cast("bigint").alias("n"),
        *[(F.lit(None) if measured is None else measured[c]).cast("bigint").alias(c) for c in _OF_LINES],
    )


def pattern_name_facts(content: Column, patterns) -> Column:
    """Naming styles of everything the patterns name, each match counted."""

    def of_pattern(rank: int, category: str, pattern: str) -> Column:
        names = F.regexp_extract_all(content, F.lit(unicode_shorthands(pattern)), F.lit(1))
        return F.transform(
            names,
            lambda name, i: _fact(F.lit(category), naming_style(name), F.lit(rank << 24) + i),
        )

    return F.concat(*[of_pattern(r, c, p) for r, (c, p) in enumerate(patterns)])


def javascript_name_facts(content: Column) -> Column:
    return pattern_name_facts(content, K.JAVASCRIPT_NAME_PATTERNS)


def java_name_facts(content: Column) -> Column:
    return pattern_name_facts(content, K.JAVA_NAME_PATTERNS)


def python_name_facts(facts: Column) -> Column:
    def one(n: Column) -> Column:
        constant = (n["category"] == "variables") & is_upper(n["name"])
        return _fact(
            F.when(constant, "constants").otherwise(n["category"]),
            F.when(constant, "UPPER_CASE").otherwise(naming_style(n["name"])),
            n["pos"], n=n["n"],
        )

    return F.transform(facts["names"], one)


def docstring_facts(facts: Column) -> Column:
    return F.transform(
        facts["docstrings"],
        lambda d: _fact(F.lit("docstrings"), docstring_style(d["text"]), d["pos"]),
    )


def line_facts(facts: Column) -> Column:
    """Length and indentation of the lines that are not blank."""
    lines = facts["lines"]
    measured = _fact(F.lit("lines"), F.lit(None).cast("string"), lines["pos"], lines["n"], lines)
    indentation = F.transform(
        facts["indentation"], lambda i: _fact(F.lit("indentation"), i["value"], i["pos"], i["n"]))
    return F.concat(F.when(lines.isNotNull(), F.array(measured)).otherwise(F.array().cast(FACTS)), indentation)


def main_at_end(content: Column) -> Column:
    tail = F.substring_index(content, "\n", -K.MAIN_GUARD_TAIL_LINES)
    return F.contains(tail, F.lit(K.MAIN_GUARD))


def _organization_facts(content: Column, facts: Column) -> Column:
    def flag(condition: Column, value: str) -> Column:
        return F.when(
            condition, F.array(_fact(F.lit("organization"), F.lit(value), F.lit(0)))
        ).otherwise(F.array().cast(FACTS))

    return F.concat(
        flag(facts["imports_first"], "imports_first"),
        flag(main_at_end(content), "main_at_end"),
    )


def file_facts(files: DataFrame) -> DataFrame:
    """`facts` per file, and `imports` of Python files.  One parse per file.

    A Python file that does not parse has no facts at all.
    """
    content, language = F.col("content"), F.col("language")
    # texts of languages that are not profiled never cross into Python
    profiled = F.when(language.isin("python", "javascript", "java"), content)
    measured = files.withColumn("_facts", text_facts(profiled, language == "python"))
    found = F.col("_facts")
    of_python = F.concat(
        python_name_facts(found), docstring_facts(found), line_facts(found),
        _organization_facts(content, found),
    )
    facts = (
        F.when((language == "python") & found.isNotNull(), of_python)
        .when(language == "javascript", F.concat(javascript_name_facts(content), line_facts(found)))
        .when(language == "java", F.concat(java_name_facts(content), line_facts(found)))
    )
    keys = [c for c in ("repo", "ext_rank", "path", "file_seq") if c in files.columns]
    return measured.select(*keys, "language", facts.alias("facts"), found["imports"].alias("imports"))


def count_facts(facts: DataFrame) -> DataFrame:
    """`style_counts`: one row per repository, category and value."""
    seq = F.lit(0) if "file_seq" not in facts.columns else F.col("file_seq")
    # outer, so that no filter on the array is added and evaluates it twice
    rows = facts.select(
        "repo", seq.cast("bigint").alias("file_seq"), F.inline_outer("facts")
    ).where(F.col("category").isNotNull())
    return rows.groupBy("repo", "category", "value").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.min(F.shiftleft("file_seq", 32) + F.col("pos")).alias("first_seq"),
        *_sums_of_lines(),
    )


def _sums_of_lines() -> list[Column]:
    return [F.sum("total_length").alias("total_length"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("over_80", "over_100")]]


def count_all_facts(facts: DataFrame) -> DataFrame:
    """`style_counts` of files that have no number: `first_seq` is the place
    `(ext_rank, path, pos)`.  Every task counts what it reads first, so what is
    moved are a few rows per repository and task, and none per file."""
    rows = facts.select("repo", *FILE_ORDER, F.inline_outer("facts")).where(F.col("category").isNotNull())
    return rows.groupBy("repo", "category", "value").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.min(F.struct(*FILE_ORDER, "pos")).alias("first_seq"),
        *_sums_of_lines(),
    )


def style_counts(sample: DataFrame) -> DataFrame:
    count = count_facts if "file_seq" in sample.columns else count_all_facts
    return count(file_facts(sample))


def preferred(category: str) -> Column:
    """Most frequent value of a category; the first seen wins a tie."""
    return F.min_by(
        F.when(F.col("category") == category, F.col("value")),
        F.when(F.col("category") == category, F.struct(-F.col("n"), "first_seq")),
    )


def _of_lines(column: str) -> Column:
    return F.sum(F.when(F.col("category") == "lines", F.col(column)))


def preferred_line_length(n: Column, over_80: Column, over_100: Column) -> Column:
    return F.when(n > 0, F.when(over_100 / n > 0.1, 120).when(over_80 / n > 0.2, 100).otherwise(80))


def style_context(functions, classes, indentation, line_length, docstrings) -> Column:
    """The known parts of a profile as one line of text."""
    labelled = [
        ("Functions: ", functions), ("Classes: ", classes), ("Indentation: ", indentation),
        ("Max line length: ", line_length), ("Documentation: ", docstrings),
    ]
    text = F.concat_ws(" | ", *[F.concat(F.lit(k), v.cast("string")) for k, v in labelled])
    return F.when(text == "", K.DEFAULT_STYLE_CONTEXT).otherwise(text)


def style_profile(counts: DataFrame, repositories: DataFrame | None = None) -> DataFrame:
    """One row per repository, with its `style_context`.

    `repositories` (with a column `repo`) adds those of which no style is known."""
    rows = counts.groupBy("repo").agg(
        preferred("functions").alias("functions_preferred"),
        preferred("classes").alias("classes_preferred"),
        preferred("variables").alias("variables_preferred"),
        preferred("indentation").alias("preferred_indentation"),
        preferred("docstrings").alias("docstring_preferred"),
        _of_lines("n").alias("n_lines"),
        _of_lines("total_length").alias("total_length"),
        _of_lines("over_80").alias("over_80"),
        _of_lines("over_100").alias("over_100"),
    )
    if repositories is not None:
        rows = repositories.select("repo").distinct().join(rows, "repo", "left")
    limit = preferred_line_length(F.col("n_lines"), F.col("over_80"), F.col("over_100"))
    return (
        rows.withColumn("avg_line_length",
                        F.bround(F.col("total_length") / F.col("n_lines"), 1))
        .withColumn("preferred_line_length", limit)
        .withColumn("style_context", style_context(
            F.col("functions_preferred"), F.col("classes_preferred"),
            F.col("preferred_indentation"), F.col("preferred_line_length"),
            F.col("docstring_preferred"),
        ))
        .drop("total_length", "over_80", "over_100")
    )


def analyzed_files(sample: DataFrame) -> DataFrame:
    """Files looked at per repository, whatever became of them."""
    return sample.groupBy("repo").agg(F.count(F.lit(1)).alias("analyzed_files"))


def import_sample(sample_facts: DataFrame) -> DataFrame:
    """First imports of each file, files taken while fewer than the total.

    Works on `file_facts` of a profile sample, so a repository's window has at
    most as many rows as the sample.  Of all files, those taken are among the
    first `IMPORTS_TOTAL` with imports, as each adds one at least.
    """
    head = F.slice("imports", 1, K.IMPORTS_PER_FILE)
    files = sample_facts.where(F.size("imports") > 0)
    if "file_seq" not in files.columns:
        slim = files.select("repo", *FILE_ORDER, "imports")
        files = top_k_per_group(slim, ["repo"], list(FILE_ORDER), K.IMPORTS_TOTAL, rank="file_seq")
    files = files.select("repo", "path", "file_seq", head.alias("head"), F.size(head).alias("n"))
    before = Window.partitionBy("repo").orderBy("file_seq").rowsBetween(
        Window.unboundedPreceding, -1
    )
    taken = files.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(
        F.col("before") < K.IMPORTS_TOTAL
    )
    return taken.select("repo", "path", "before", F.posexplode("head").alias("i", "statement")).select(
        "repo", "path", (F.col("before") + F.col("i")).alias("seq"), "statement"
    )
