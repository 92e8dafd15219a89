"""Choosing examples: cap, dedup, quality, priority, order, limits, styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import constants as K
from corpusloom.functions.naming import naming_style
from corpusloom.functions.text import code_hash, line_count, nonblank_line_count
from corpusloom.operators.ranking import (
    cutoffs, first_per_key, rank_all, salted_join, sums_before, top_k, top_k_per_group, up_to,
)
from corpusloom.sources.staging import stage

EXAMPLE_ORDER = ("ext_rank", "path", "seq")


def cap_cutoffs(files: DataFrame, max_units: int, n: str = "n_units", keys: tuple[str, ...] = ("repo",),
                order: tuple[str, ...] = ("ext_rank", "path")) -> DataFrame:
    """The file of each repository that brings its units to the cap: one row
    `(keys, cutoff)`; repositories that stay below it have none.

    `files` is narrow and staged; the first order column has few values."""
    return cutoffs(files, list(keys), [order[0]], list(order[1:]), n, max_units)


def files_within_cap(files: DataFrame, max_units: int, n: str = "n_units",
                     keys: tuple[str, ...] = ("repo",),
                     order: tuple[str, ...] = ("ext_rank", "path")) -> DataFrame:
    """Files taken in order while the units taken so far are fewer than the cap.

    Only keys, order and counts are looked at: they are staged, the cap is
    found by prefix sums, and what is taken has its own prefix sums."""
    counted = stage(files.select(*keys, *order, n), "counts").where(F.col(n) > 0)
    found = cap_cutoffs(counted, max_units, n, keys, order)
    taken = up_to(counted, found, list(keys), list(order), list(order[1:]))
    return sums_before(taken, list(keys), list(order), n, "units_before")


def dedup_first(df: DataFrame, code: str = "output", keys: tuple[str, ...] = ("repo",),
                order: tuple[str, ...] = EXAMPLE_ORDER) -> DataFrame:
    """First example of every normalized text.

    Copies of a text collapse inside each input split before the shuffle, so a
    text that makes up a third of the corpus arrives once per split.
    """
    hashed = df.withColumn("code_hash", code_hash(F.col(code)))
    return first_per_key(hashed, [*keys, "code_hash"], list(order))


def is_generic_name(name: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).isin(*K.GENERIC_NAMES)


def passes_quality(code: Column, name: Column) -> Column:
    return (
        line_count(code).between(K.MIN_UNIT_LINES, K.MAX_UNIT_LINES)
        & ~is_generic_name(name)
        & (nonblank_line_count(code) >= K.MIN_NONBLANK_LINES)
    )


def priority(has_docstring: Column, style: Column) -> Column:
    """'high' or NULL."""
    return F.when(
        F.coalesce(has_docstring, F.lit(False)) | style.isin(*K.PREFERRED_NAMING), "high"
    )


def with_priority(examples: DataFrame) -> DataFrame:
    m = F.col("metadata")
    return examples.withColumn(
        "metadata", m.withField("priority", priority(m["has_docstring"], m["naming_style"]))
    )


def quality_filter(examples: DataFrame) -> DataFrame:
    return examples.where(passes_quality(F.col("output"), F.col("metadata.name")))


def quality_order(metadata: str = "metadata") -> list[Column]:
    """Descending quality; ties keep their sequence."""
    m = F.col(metadata)
    return [
        F.coalesce(m["priority"] == "high", F.lit(False)).desc(),
        F.coalesce(m["complexity"], F.lit(0)).desc(),
        F.coalesce(m["has_docstring"], F.lit(False)).desc(),
    ]


_PLACE = ("repo", "path", "seq")


def order_columns(metadata: str = "metadata") -> dict[str, Column]:
    """`quality_order` as ascending columns with few values and without nulls."""
    m = F.col(metadata)
    return {
        "_high": ~F.coalesce(m["priority"] == "high", F.lit(False)),
        "_complexity": -F.coalesce(m["complexity"], F.lit(0)),
        "_documented": ~F.coalesce(m["has_docstring"], F.lit(False)),
    }


def rank_examples(places: DataFrame, k: int | None = None) -> DataFrame:
    """`(repo, path, seq, rank)` of the k best examples of each repository, or of all.

    `places` is a staged table of `repo`, `EXAMPLE_ORDER` and `order_columns`;
    the plan is the same for every k."""
    coarse, fine = [*order_columns(), EXAMPLE_ORDER[0]], list(EXAMPLE_ORDER[1:])
    narrow = places.select("repo", *coarse, *fine)
    kept = narrow if k is None else top_k(narrow, ["repo"], coarse, fine, k)
    return rank_all(kept, ["repo"], [*coarse, *fine]).select(*_PLACE, "rank")


def fetch(examples: DataFrame, decided: DataFrame) -> DataFrame:
    """The decided examples, whole: their texts are moved once, by a join on the
    place, which no hot group shares; they are never sorted."""
    return examples.join(decided.hint("shuffle_hash"), list(_PLACE))


def best_examples(examples: DataFrame, k: int | None = None) -> DataFrame:
    """The k best examples of each repository, or all of them, with their `rank`."""
    written = stage(examples, "examples")
    return fetch(written, rank_examples(order_places(written), k))


def order_places(examples: DataFrame) -> DataFrame:
    """What `rank_examples` needs of examples; stage it unless they are staged."""
    return examples.select("repo", *EXAMPLE_ORDER, *[c.alias(name) for name, c in order_columns().items()])


def matches_style(kind: Column, name: Column, functions: Column, classes: Column) -> Column:
    """Whether a unit is named the way its repository names such units."""
    style = naming_style(name)
    wanted = F.when(F.contains(kind, F.lit("function")), functions).when(
        F.contains(kind, F.lit("class")), classes
    )
    return F.coalesce(style == wanted, F.lit(False))


def attach_style(examples: DataFrame, profile: DataFrame, columns: list[str]) -> DataFrame:
    """Add per-repository columns to examples; NULL without a profile."""
    return salted_join(
        examples, profile.select("repo", *columns), ["repo"], "left", ["path", "seq"]
    )


def exclude_names(examples: DataFrame, names: DataFrame, name: str, salt_columns: list[str]) -> DataFrame:
    """Drop examples with a name in `names` (one column of that name), ignoring case.

    For a list of one's own; the built-in one is part of the quality filter.
    """
    listed = names.select(F.lower(F.col(name)).alias("_name")).distinct()
    lowered = examples.withColumn("_name", F.lower(F.coalesce(name, F.lit(""))))
    return salted_join(lowered, listed, ["_name"], "left_anti", salt_columns).drop("_name")


def input_context(examples: DataFrame) -> DataFrame:
    """Fill the context from its parts and the repository's style context."""
    style = F.coalesce(F.col("style_context"), F.lit(K.DEFAULT_STYLE_CONTEXT))
    return examples.withColumn(
        "input_context",
        F.concat(F.col("context_prefix"), F.coalesce(F.col("context_suffix"), style)),
    ).drop("context_prefix", "context_suffix", "style_context")


def group_preview(listing: DataFrame, k: int = 5, group: str = "dir", item: str = "name") -> DataFrame:
    """First k items of each group and how many more there are."""
    totals = listing.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    head = top_k_per_group(listing.select(group, item), [group], [item], k, rank="_rank")
    shown = head.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct("_rank", item))).alias("_items")
    )
    return totals.join(shown, group).select(
        group,
        F.transform("_items", lambda x: x[item]).alias("items"),
        F.greatest(F.col("n") - k, F.lit(0)).alias("more"),
    )
