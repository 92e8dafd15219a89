"""Names, docstrings, complexity and the instructions derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from corpusloom import constants as K
from corpusloom.functions.text import count_substring, line_count

_LOWER = r"\p{IsLowercase}"
_UPPER = r"\p{IsUppercase}"
_UPPER_OR_TITLE = r"[\p{IsUppercase}\p{Lt}]"
_LOWER_OR_TITLE = r"[\p{IsLowercase}\p{Lt}]"


def is_lower(c: Column) -> Column:
    return c.rlike(_LOWER) & ~c.rlike(_UPPER_OR_TITLE)


def is_upper(c: Column) -> Column:
    return c.rlike(_UPPER) & ~c.rlike(_LOWER_OR_TITLE)


def starts_upper(c: Column) -> Column:
    return c.rlike("^" + _UPPER)


def naming_style(name: Column) -> Column:
    n = F.coalesce(name, F.lit(""))
    has_underscore = F.contains(n, F.lit("_"))
    return (
        F.when(~n.rlike(r"^_*[\p{L}\p{N}][\p{L}\p{N}_]*\z"), "mixed")
        .when(has_underscore & is_lower(n), "snake_case")
        .when(~has_underscore & starts_upper(n), "PascalCase")
        .when(n.rlike("^" + _LOWER) & n.rlike(_UPPER), "camelCase")
        .when(has_underscore & is_upper(n), "UPPER_CASE")
        .when(is_lower(n), "lowercase")
        .otherwise("mixed")
    )


def _keyword_count(low: Column) -> Column:
    return reduce(
        lambda a, b: a + b, [count_substring(low, w) for w in K.COMPLEXITY_KEYWORDS]
    )


def complexity(code: Column) -> Column:
    """Keyword occurrences, not word-bounded: `elif` counts as an `if`."""
    return _keyword_count(F.lower(code))


def complexity_in_lambda(code: Column) -> Column:
    """The same for use inside a higher-order function or a condition, where
    Spark does not share common subexpressions: the text is lowered once."""
    return F.transform(F.array(F.lower(code)), _keyword_count)[0]


def _has(c: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def docstring_style_basic(doc: Column) -> Column:
    return (
        F.when(_has(doc, "Args:") & _has(doc, "Returns:"), "google_style")
        .when(_has(doc, ":param") & _has(doc, ":return"), "sphinx_style")
        .otherwise("basic")
    )


def docstring_style(doc: Column) -> Column:
    d = F.coalesce(doc, F.lit(""))
    quotes = (count_substring(d, '"""') >= 2) | (count_substring(d, "'''") >= 2)
    return (
        F.when(d == "", "none")
        .when(_has(d, "Args:") & _has(d, "Returns:"), "google_style")
        .when(_has(d, ":param") & _has(d, ":return"), "sphinx_style")
        .when(quotes, "triple_quote")
        .when(line_count(d) == 1, "single_line")
        .otherwise("multi_line")
    )


def first_sentence(doc: Column) -> Column:
    return F.substring_index(doc, ".", 1)


def function_instruction(name: Column, doc: Column) -> Column:
    purpose = F.lower(first_sentence(F.coalesce(doc, F.lit(""))))
    low = F.lower(name)
    return (
        F.when(purpose != "", F.concat(F.lit("Write a function that "), purpose))
        .when(_has(low, "get"), F.concat(F.lit("Create a getter function named "), name))
        .when(_has(low, "set"), F.concat(F.lit("Create a setter function named "), name))
        .when(_has(low, "calculate", "compute"),
              F.concat(F.lit("Write a calculation function named "), name))
        .when(_has(low, "validate", "check"),
              F.concat(F.lit("Create a validation function named "), name))
        .otherwise(F.concat(F.lit("Implement a function named "), name))
    )


def class_instruction(name: Column, doc: Column, methods: Column) -> Column:
    """`methods` is the array of method names without the `__` ones."""
    purpose = F.lower(first_sentence(F.coalesce(doc, F.lit(""))))
    low = F.lower(name)

    def around(before: str, after: str) -> Column:
        return F.concat(F.lit(before), name, F.lit(after))

    return (
        F.when(purpose != "", F.concat(F.lit("Create a class that "), purpose))
        .when(_has(low, "manager"), around("Design a ", " class for managing resources"))
        .when(_has(low, "handler"), around("Create a ", " class for handling operations"))
        .when(_has(F.lower(F.array_join(methods, " ")), "process"),
              around("Implement a ", " class with processing capabilities"))
        .otherwise(around("Create a ", " class with appropriate methods"))
    )
