"""Which extensions exist, and how code units are found in each language."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, functions as F

from corpusloom import constants as K
from corpusloom.operators.kinds import FunctionKind, PatternKind
from corpusloom.operators.python_units import python_units
from corpusloom.operators.regex_units import DEFAULT_KINDS


@dataclass(frozen=True)
class ExtractorRegistry:
    """Immutable; the `with_*` methods return an extended registry.

    `functions` maps a language to a function `content column -> array of
    units` (schema `python_units.UNITS`), for languages a pattern cannot parse.
    """

    extensions: tuple[tuple[str, str], ...]
    kinds: tuple[PatternKind, ...]
    functions: tuple[tuple[str, Callable[[Column], Column]], ...] = ()
    function_kinds: tuple[FunctionKind, ...] = ()

    def with_extension(self, ext: str, language: str) -> "ExtractorRegistry":
        return replace(self, extensions=self.extensions + ((ext, language),))

    def with_pattern(self, kind: PatternKind) -> "ExtractorRegistry":
        return replace(self, kinds=self.kinds + (kind,))

    def with_function(self, language: str, fn: Callable[[Column], Column],
                      kinds: tuple[FunctionKind, ...] = ()) -> "ExtractorRegistry":
        """`kinds` describes the kinds of units that `fn` yields; others are asked for by name."""
        return replace(
            self, functions=self.functions + ((language, fn),), function_kinds=self.function_kinds + tuple(kinds)
        )

    def extension_map(self) -> Column:
        """Literal map extension -> (language, ext_rank)."""
        pairs = []
        for rank, (ext, language) in enumerate(self.extensions):
            pairs += [
                F.lit(ext),
                F.struct(F.lit(language).alias("language"), F.lit(rank).alias("ext_rank")),
            ]
        return F.create_map(*pairs)

    def pattern_languages(self) -> list[str]:
        return list(dict.fromkeys(k.language for k in self.kinds))


DEFAULT_REGISTRY = ExtractorRegistry(
    extensions=K.LANGUAGE_BY_EXTENSION,
    kinds=DEFAULT_KINDS,
    functions=(("python", python_units),),
)
