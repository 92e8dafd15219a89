r"""Code units found by a pattern, as an array per file.

A pattern runs once over the text for whole matches; the name is taken by
matching again on the (short) match only.  That cannot change the result: no
pattern looks behind its start or ahead of its end.

Plain patterns with nested repetition overflow the JVM's stack on long input,
so the patterns below are possessive where giving back cannot help a match:
the pieces of a body start with different characters, and list tails start
with a comma.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusloom import constants as K
from corpusloom.functions.naming import starts_upper
from corpusloom.functions.text import line_count
from corpusloom.operators.kinds import PatternKind

_BODY = r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"
_LIST_TAIL = r"(?:\s*,\s*\w+)*"
_WORDS = r"(?:\w+\s+)*(\w+)"
_WORDS_POSSESSIVE = r"(?:\w+\s+(?=\w))*+(\w+)"

# Unicode word and space characters, spelled out because the engine's own
# shorthands are ASCII
_WORD = r"[\p{L}\p{N}_]"
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def unicode_shorthands(pattern: str) -> str:
    r"""Replace `\w`, `\s` and a leading `\b` by Unicode equivalents."""
    return (
        pattern.replace(r"\b", rf"(?<!{_WORD})(?={_WORD})")
        .replace(r"\w", _WORD)
        .replace(r"\s", _SPACE)
    )


def stack_safe(pattern: str) -> str:
    """Possessive form of one of the built-in patterns."""
    return (
        pattern.replace(K.BODY, _BODY)
        .replace(_WORDS, _WORDS_POSSESSIVE)
        .replace(_LIST_TAIL, _LIST_TAIL + "+")
    )


def spark_pattern(pattern: str) -> str:
    return unicode_shorthands(stack_safe(pattern))


def _keep_rule(kind: str):
    if kind == "java_method":
        return lambda name: ~starts_upper(name)
    if kind == "cpp_function":
        return lambda name: ~F.lower(name).isin(*K.CPP_CONTROL_WORDS)
    return None


DEFAULT_KINDS = tuple(
    PatternKind(
        kind=kind, language=language, pattern=K.UNIT_PATTERNS[kind], group=group,
        min_lines=min_lines, instruction=instruction, context=context,
        spark_pattern=spark_pattern(K.UNIT_PATTERNS[kind]), keep=_keep_rule(kind),
    )
    for kind, language, group, min_lines, instruction, context in K.UNIT_KINDS
)


def match_units(content: Column, kind: PatternKind, rank: int) -> Column:
    """Array of `(kind, seq, name, code)` for one kind of unit in one text."""
    pattern = F.lit(kind.spark_pattern or kind.pattern)
    found = F.transform(
        F.regexp_extract_all(content, pattern, F.lit(0)),
        lambda code, i: F.struct(
            F.lit(kind.kind).alias("kind"),
            (F.lit(rank << 32) + i).alias("seq"),
            F.regexp_extract(code, kind.spark_pattern or kind.pattern, kind.group).alias("name"),
            code.alias("code"),
        ),
    )
    rules = []
    if kind.min_lines > 1:
        rules.append(lambda u: line_count(u["code"]) >= kind.min_lines)
    if kind.keep is not None:
        rules.append(lambda u: kind.keep(u["name"]))
    for rule in rules:
        found = F.filter(found, rule)
    return found
