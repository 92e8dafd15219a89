"""Description of a kind of code unit that one pattern finds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column


@dataclass(frozen=True)
class PatternKind:
    """A kind of code unit found by one pattern.

    `pattern` is plain; `spark_pattern` may hold an equivalent that is safe on
    long inputs (see `regex_units`).  `context` of None means that the style
    context of the repository is put into the example's context.
    """

    kind: str
    language: str
    pattern: str
    group: int = 1
    min_lines: int = 1
    instruction: str = "Write code named "
    context: str | None = None
    spark_pattern: str | None = None
    keep: Callable[[Column], Column] | None = field(default=None, compare=False)


@dataclass(frozen=True)
class FunctionKind:
    """A kind of code unit that a language's function yields: how its examples are asked for."""

    kind: str
    instruction: str = "Write code named "
    context: str | None = None
