"""Cap, dedup, ranking and joins against brute force, with a hot group."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.ranking import cutoffs, rank_all, sums_before, top_k, top_k_per_group
from corpusloom.operators.select import (
    attach_style, dedup_first, exclude_names, files_within_cap, group_preview, is_generic_name,
    matches_style, passes_quality, with_priority, best_examples,
)
from corpusloom.functions.text import normalize_code


@pytest.fixture
def small_limit(spark):
    """Make k = 5 already too large for pruning before the shuffle."""
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(key, "4")
    yield
    spark.conf.unset(key)


def hot_rows(n=600, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.6 else f"g{rng.randint(0, 20)}", i, rng.randint(0, 50))
            for i in range(n)]


@pytest.mark.parametrize("k", [1, 3, 5, 40])
def test_top_k_is_exact_when_salted(spark, small_limit, k):
    rows = hot_rows()
    frame = spark.createDataFrame(rows, "g string, i int, v int").repartition(7)
    got = top_k_per_group(frame, ["g"], [F.col("v").desc(), "i"], k)
    want = set()
    for g in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        want |= {(r[1], p + 1) for p, r in enumerate(ranked[:k])}
    assert {(r.i, r["rank"]) for r in got.collect()} == want


def brute_cap(rows, cap):
    taken = []
    for repo in {r[0] for r in rows}:
        total = 0
        for _, rank, path, n in sorted(r for r in rows if r[0] == repo):
            if total >= cap:
                break
            if n:
                taken.append((repo, path, total))
            total += n
    return set(taken)


@pytest.mark.parametrize("cap", [1, 5, 30, 10_000])
def test_cap_is_exact_when_salted(spark, small_limit, cap):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else f"r{rng.randint(0, 5)}", rng.randint(0, 9), f"p{i}",
             rng.choice([0, 0, 1, 2, 7])) for i in range(400)]
    frame = spark.createDataFrame(rows, "repo string, ext_rank int, path string, n_units int")
    got = files_within_cap(frame.repartition(5), cap).collect()
    assert {(r.repo, r.path, r.units_before) for r in got} == brute_cap(rows, cap)


def test_cap_stops_after_the_file_that_fills_it(spark):
    rows = [("r", 0, "a", 3), ("r", 0, "b", 4), ("r", 0, "c", 5)]
    frame = spark.createDataFrame(rows, "repo string, ext_rank int, path string, n_units int")
    assert sorted(r.path for r in files_within_cap(frame, 5).collect()) == ["a", "b"]


def test_dedup_keeps_the_first(spark):
    rows = [("r", 0, "b.py", 0, "x\n# c"), ("r", 0, "a.py", 4, " x"), ("r", 0, "a.py", 2, "x "),
            ("s", 0, "a.py", 0, "x"), ("r", 1, "0.js", 0, "x"), ("r", 0, "c.py", 0, "y")]
    frame = spark.createDataFrame(rows, "repo string, ext_rank int, path string, seq bigint, output string")
    unique = dedup_first(frame.repartition(3))
    got = sorted((r.repo, r.path, r.seq) for r in unique.collect())
    assert got == [("r", "a.py", 2), ("r", "c.py", 0), ("s", "a.py", 0)]
    assert dedup_first(unique.drop("code_hash")).count() == 3


def test_dedup_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["boiler\nplate" if rng.random() < 0.4 else f"t{rng.randint(0, 60)}\n" for _ in range(500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(6)
    got = dedup_first(frame, code="t", keys=(), order=("i",)).collect()
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t.strip(), i)
    assert sorted(r.i for r in got) == sorted(first.values())


def test_quality(spark):
    cases = [("a\nb\nc", "x", True), ("a\nb", "x", False), ("a\n" * 99 + "b", "x", True),
             ("a\n" * 100 + "b", "x", False), ("a\n \n", "x", False), ("a\nb\n", "x", True),
             ("a\nb\nc", "Foo", False), ("a\nb\nc", "tests", True), ("a\nb\nc", None, True)]
    frame = spark.createDataFrame([(i, c, n) for i, (c, n, _) in enumerate(cases)],
                                  "i int, c string, n string")
    got = {r.i for r in frame.where(passes_quality(F.col("c"), F.col("n"))).collect()}
    assert got == {i for i, case in enumerate(cases) if case[2]}
    assert frame.where(is_generic_name(F.col("n"))).count() == 1


def examples(spark, rows):
    """(repo, path, seq, complexity, has_docstring, naming_style)"""
    frame = spark.createDataFrame(
        rows, "repo string, path string, seq bigint, c int, d boolean, s string")
    return frame.select(
        "repo", F.lit(0).alias("ext_rank"), "path", "seq", F.lit("x").alias("output"),
        F.struct(F.col("c").alias("complexity"), F.col("d").alias("has_docstring"),
                 F.col("s").alias("naming_style")).alias("metadata"))


def test_order_and_limit(spark):
    rows = [("r", "a", 0, None, None, "mixed"), ("r", "b", 0, None, None, "camelCase"),
            ("r", "c", 0, 3, False, "mixed"), ("r", "d", 0, 3, True, "mixed"),
            ("r", "e", 0, 3, False, "snake_case"), ("r", "f", 0, None, None, "PascalCase"),
            ("r", "g", 0, 0, True, "lowercase")]
    ranked = best_examples(with_priority(examples(spark, rows).repartition(4)), 6).orderBy("rank")
    assert [r.path for r in ranked.collect()] == ["d", "e", "g", "b", "f", "c"]


def test_order_does_not_depend_on_partitions(spark, small_limit):
    rng = random.Random(4)
    rows = [("hot", f"p{rng.randint(0, 30)}", i, rng.randint(0, 3), rng.random() < 0.5, "camelCase")
            for i in range(300)]
    results = []
    for n in (1, 3, 8):
        best = best_examples(with_priority(examples(spark, rows).repartition(n)), 50)
        results.append(sorted((r["rank"], r.path, r.seq) for r in best.collect()))
    assert results[0] == results[1] == results[2]


def test_attach_style_keeps_every_example(spark):
    rows = [("hot" if i % 3 else f"r{i}", f"p{i}", i, 0, False, "mixed") for i in range(200)]
    profile = spark.createDataFrame([("hot", "H"), ("r0", "Z")], "repo string, style_context string")
    got = attach_style(examples(spark, rows), profile, ["style_context"]).collect()
    assert sorted(r.seq for r in got) == list(range(200))
    assert all(r.style_context == {"hot": "H", "r0": "Z"}.get(r.repo) for r in got)


def test_exclude_names(spark):
    rows = spark.createDataFrame([(1, "Foo"), (2, "bar"), (3, None), (4, "foo")], "i int, name string")
    names = spark.createDataFrame([("FOO",), ("foo",)], "name string")
    assert sorted(r.i for r in exclude_names(rows, names, "name", ["i"]).collect()) == [2, 3]


def test_style_match(spark):
    rows = spark.createDataFrame(
        [("python_function", "a_b"), ("java_method", "aB"), ("python_class", "Ab"),
         ("javascript_arrow_function", "aB"), ("go_struct", "Ab")], "kind string, name string")
    got = rows.coalesce(1).select(matches_style(
        F.col("kind"), F.col("name"), F.lit("snake_case"), F.lit(None).cast("string"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, False]


def test_group_preview(spark):
    rows = [("a", f"n{i}") for i in range(8)] + [("b", "z"), ("b", "y")]
    got = {r.dir: (r["items"], r.more) for r in group_preview(
        spark.createDataFrame(rows, "dir string, name string")).collect()}
    assert got == {"a": (["n0", "n1", "n2", "n3", "n4"], 3), "b": (["y", "z"], 0)}


def test_normal_form_is_idempotent(spark):
    frame = spark.createDataFrame([(" a\n\n#b\n c",), ("",)], "t string")
    once = frame.select(normalize_code(F.col("t")).alias("t"))
    assert once.select(normalize_code(F.col("t")).alias("t")).collect() == once.collect()


def test_rank_of_all_rows_of_one_group(spark):
    frame = spark.range(5000).select(
        F.when(F.col("id") % 50 == 0, "small").otherwise("big").alias("repo"), (F.col("id") * 7919 % 5003).alias("x"))
    rows = rank_all(frame.repartition(3), ["repo"], [F.col("x").desc()]).collect()
    for repo in ("small", "big"):
        own = sorted((r for r in rows if r.repo == repo), key=lambda r: -r.x)
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))


def weighted(spark, n=3000):
    """One group holds nearly all rows, and one coarse value most of those."""
    rng = random.Random(5)
    rows = [("big" if i % 100 else f"g{i % 700}", 0 if rng.random() < 0.8 else rng.randint(-3, 3), f"p{i * 7919 % n:05d}", rng.choice([0, 1, 1, 5]))
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, c int, f string, n int").repartition(7)


@pytest.mark.parametrize("limit", [1, 7, 150, 2999, 10_000])
def test_limits_against_brute_force(spark, limit):
    rows, frame = weighted(spark)
    reached, first, before = {}, set(), {}
    for g in {r[0] for r in rows}:
        total = 0
        for place, row in enumerate(sorted(r for r in rows if r[0] == g)):
            before[row[0], row[2]] = total
            total += row[3]
            if place < limit:
                first.add((g, row[2]))
            if total >= limit and g not in reached:
                reached[g] = (row[1], row[2])
    found = cutoffs(frame, ["g"], ["c"], ["f"], "n", limit).collect()
    assert {r.g: tuple(r.cutoff) for r in found} == reached and len(found) == len(reached)
    assert {(r.g, r.f) for r in top_k(frame, ["g"], ["c"], ["f"], limit).collect()} == first
    if limit == 1:
        assert {(r.g, r.f): r.b for r in sums_before(frame, ["g"], ["c", "f"], "n", "b").collect()} == before


def test_limits_of_nothing(spark):
    _, frame = weighted(spark, 10)
    assert cutoffs(frame.limit(0), ["g"], ["c"], ["f"], "n", 3).count() == 0
    assert top_k(frame.limit(0), ["g"], ["c"], ["f"], 3).count() == 0
    assert cutoffs(frame.withColumn("n", F.lit(0)), ["g"], ["c"], ["f"], "n", 1).count() == 0
