"""Operators over a table of files: dispatch, exclusion, size, decoding, sample.

A file table has `repo, path, size, content` (`content` as bytes or text);
`name` and `ext` are derived from the path where absent.  Scan order inside a
repository is `(ext_rank, path)`: it needs no numbering pass, so no operator
has to sort a whole repository in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import constants as K
from corpusloom.functions.text import base_name, decode_text, file_extension
from corpusloom.operators.ranking import top_k_per_group
from corpusloom.operators.registry import DEFAULT_REGISTRY, ExtractorRegistry

FILE_ORDER = ("ext_rank", "path")


def not_ignored(path: Column, parts=K.IGNORED_PATH_PARTS, match: str = "substring") -> Column:
    """Path exclusion; `substring` is the default rule, so `env` also drops
    `environment/`.  `match="segment"` compares whole path components."""
    words = "|".join(re.escape(p) for p in parts)
    pattern = words if match == "substring" else f"(?:^|/)(?:{words})(?:/|$)"
    return ~path.rlike(pattern)


def size_in_range(size: Column, low=K.MIN_FILE_BYTES, high=K.MAX_FILE_BYTES) -> Column:
    return size.between(low, high)


def with_language(files: DataFrame, registry: ExtractorRegistry = DEFAULT_REGISTRY) -> DataFrame:
    """Keep files with a known extension; add `language` and `ext_rank`.

    The lookup table is a literal map of the registered extensions (ten by
    default), so it is folded into the scan's projection instead of joined.
    """
    entry = F.element_at(registry.extension_map(), F.col("ext"))
    return (
        files.withColumn("_entry", entry)
        .where(F.col("_entry").isNotNull())
        .withColumn("language", F.col("_entry.language"))
        .withColumn("ext_rank", F.col("_entry.ext_rank"))
        .drop("_entry")
    )


def select_files(
    files: DataFrame,
    registry: ExtractorRegistry = DEFAULT_REGISTRY,
    match: str = "substring",
    decode: bool = True,
) -> DataFrame:
    """Files of a corpus that take part in a dataset.

    The size and path predicates only touch narrow columns and reach the scan;
    `content` is decoded after them; that of undecodable files is NULL.
    """
    if "name" not in files.columns:
        files = files.withColumn("name", base_name(F.col("path")))
    if "ext" not in files.columns:
        files = files.withColumn("ext", file_extension(F.col("name")))
    kept = files.where(size_in_range(F.col("size"))).where(not_ignored(F.col("path"), match=match))
    kept = with_language(kept, registry)
    if decode:
        kept = kept.withColumn("content", decode_text(F.col("content")))
    return kept


def profile_sample(files: DataFrame, k: int | None = K.PROFILE_FILES) -> DataFrame:
    """First `k` files of each repository, with their rank as `file_seq`;
    with None all files, which need no rank.

    The ranking only reads the listing, in which Spark prunes each repository to
    `k` rows inside every input split; the texts of the files that it names are
    read and decoded after it, and only of languages that have a style analysis.
    The join keeps the narrow listing in hand and lets the texts pass: Spark's
    estimate of their size knows nothing of exploded rows, so without the hint it
    may broadcast all of them.
    """
    profiled = F.col("language").isin("python", "javascript", "java")
    content = F.when(profiled, F.col("content")).alias("content")
    if k is None:
        return files.select("repo", "ext_rank", "path", "language", content)
    listing = files.select("repo", "ext_rank", "path", "language")
    first = top_k_per_group(listing, ["repo"], list(FILE_ORDER), k, rank="file_seq")
    texts = files.where(profiled).select("repo", "path", "content")
    return first.hint("shuffle_hash").join(texts, ["repo", "path"], "left").select(*listing.columns, "content", "file_seq")
