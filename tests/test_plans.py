"""Plans: what is scanned, shuffled and evaluated."""

import contextlib
import io
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom import DatasetConfig, build_dataset, build_style_profile
from corpusloom.catalog.corpus import code_files
from corpusloom.operators.files import profile_sample, select_files
from corpusloom.operators.python_units import UNITS
from corpusloom.operators.registry import ExtractorRegistry
from corpusloom.operators.select import dedup_first, files_within_cap, order_columns, rank_examples
from corpusloom.operators.units import explode_units, extract_examples, parse_files
from corpusloom.plans.dataset import select_examples


def plan(frame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


@pytest.fixture
def stored(spark, files, tmp_path):
    path = str(tmp_path / "files")
    files(("r/a.py", "# " + "x" * 200), ("s/b.js", "// " + "x" * 200)).write.parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(stored):
    listing = plan(select_files(stored, decode=False).select("path", "language"))
    assert "GreaterThanOrEqual(size,100)" in listing and "LessThanOrEqual(size,100000)" in listing
    assert "content" not in re.search(r"ReadSchema: (.*)", listing).group(1)


def test_files_of_one_row_group_use_all_cores(spark, tmp_path):
    parts = spark.range(1000).selectExpr("id AS p_partkey", "'red blue' AS p_name", "CAST(id % 9 AS INT) AS p_size")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    limit = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "1k")  # many splits, of which one has the rows
    try:
        assert spark.read.parquet(str(tmp_path / "part.parquet")).rdd.getNumPartitions() >= 4
        held = [r["count"] for r in code_files(spark, str(tmp_path), ".js").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set(limit, before)
    assert sum(held) == 1000 and max(held) <= 1000 / spark.sparkContext.defaultParallelism


def test_extractors_run_once(stored):
    text = plan(extract_examples(select_files(stored)))
    assert len(re.findall(r"^\(\d+\) ArrowEvalPython", text, re.M)) == 1
    assert "Exchange" not in text


@pytest.fixture
def counted_parses(spark):
    """A registry whose only extractor counts the texts it is given."""
    seen = spark.sparkContext.accumulator(0)

    def units(column):
        @F.pandas_udf(UNITS)
        def run(texts: pd.Series) -> pd.Series:
            seen.add(int(texts.notna().sum()))
            return texts.map(lambda t: None if t is None else [{
                "kind": "python_class", "seq": i, "name": f"C{i}", "code": f"class C{i}:\n    x = {i}\n    y = 1\n", "docstring": None,
                "arg_count": None, "method_count": 0, "methods": [], "error": None} for i in range(4)])

        return run(column)

    return seen, ExtractorRegistry(extensions=((".py", "python"), (".js", "javascript")), kinds=(), functions=(("python", units),))


def test_counting_units_extracts_once(stored, counted_parses):
    seen, registry = counted_parses
    assert files_within_cap(parse_files(select_files(stored), registry), 10).count() == 1
    assert seen.value == 1


@pytest.mark.parametrize("cap", [None, 2, 5000])
def test_building_extracts_once(stored, counted_parses, cap):
    seen, registry = counted_parses
    rows = select_examples(stored, DatasetConfig(max_examples=cap, registry=registry)).collect()
    assert seen.value == 1 and len(rows) == min(4, cap or 4)


@pytest.mark.parametrize("cap", [None, 150, 5000])
def test_texts_are_moved_once_and_never_sorted(stored, cap):
    text = plan(select_examples(stored, DatasetConfig(max_examples=cap)))
    sorts = re.findall(r"^\(\d+\) Sort\nInput \[\d+\]: \[(.*?)\]\n", text, re.M)
    moved = [m for m in re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text, re.M) if "output#" in m]
    assert len(moved) == 1 and not any("output#" in s for s in sorts)


def test_every_limit_has_the_same_plan(spark):
    frame = spark.range(100).select(F.lit("r").alias("repo"), F.lit(0).alias("ext_rank"), F.format_string("p%04d", "id").alias("path"),
                                    F.lit(0).alias("seq"), *[F.lit(False).alias(c) for c in order_columns()])
    def shape(k):
        return re.findall(r"^\(\d+\) (\w+)", plan(rank_examples(frame, k)), re.M)
    assert shape(150) == shape(5000)


def test_only_sampled_files_are_read_with_their_texts(stored):
    text = plan(profile_sample(select_files(stored)))
    tree = text.split("\n\n")[0]
    ranking = tree[tree.index("WindowGroupLimit"):]
    schemas = re.findall(r"ReadSchema: (.*)", text)
    assert len(schemas) == 2 and sum("content" in s for s in schemas) == 1
    for columns in re.findall(r"^\(\d+\) (?:Window|WindowGroupLimit|Sort)\nInput \[\d+\]: \[(.*?)\]\n", text, re.M):
        assert ranking and ("content#" not in columns or "path#" in columns and "ext_rank#" not in columns)


def test_texts_of_the_sample_are_never_broadcast(spark, stored):
    # the estimate of exploded rows is that of the rows before
    many = stored.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(60)))).withColumn("path", F.format_string("%s/%d.py", "repo", "copy"))
    sample = profile_sample(select_files(many.drop("copy")))
    assert "Broadcast" not in plan(sample)
    assert sample.where("content IS NOT NULL").count() == 100


def test_profile_parses_once(stored):
    text = plan(build_style_profile(stored))
    assert len(re.findall(r"^\(\d+\) ArrowEvalPython", text, re.M)) == 1


def test_groups_are_pruned_before_the_shuffle(stored):
    for frame in (profile_sample(select_files(stored)),
                  dedup_first(explode_units(parse_files(select_files(stored)))
                              .withColumnRenamed("code", "output"))):
        tree = plan(frame).split("\n\n")[0]
        assert tree.count("WindowGroupLimit") == 2


def test_no_whole_table_window_no_cross_join_no_hint(stored):
    for config in (DatasetConfig(), DatasetConfig(max_examples=5000, staged=False), DatasetConfig(max_examples=5000)):
        text = plan(build_dataset(stored, config))
        assert "SinglePartition" not in text and "CartesianProduct" not in text
        assert "BroadcastNestedLoopJoin" not in text
        windows = re.findall(r"^\(\d+\) Window\n.*\nArguments: .*?\], \[(.*?)\]", text, re.M)
        assert windows
        assert all("repo" in w for w in windows)


def test_sizes_are_exact_with_default_settings(spark):
    frame = spark.range(3000).select(
        F.lit("r").alias("repo"), F.lit(0).alias("ext_rank"),
        F.format_string("p%05d", "id").alias("path"), F.lit(1).alias("n_units"))
    taken = files_within_cap(frame.repartition(4), 2500)
    assert taken.count() == 2500 and taken.agg(F.max("path")).first()[0] == "p02499"
