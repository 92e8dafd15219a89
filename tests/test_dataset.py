"""The whole pipeline, enrichment, sources and sinks."""

import json
import os

import pytest
from pyspark.sql import functions as F

import corpusloom
from corpusloom import DatasetConfig, build_dataset, extract, training_text
from corpusloom.operators.enrich import enrich_instructions
from corpusloom.operators.files import select_files
from corpusloom.operators.summary import dataset_summary
from corpusloom.plans.chat import render_chunks, render_conversations
from corpusloom.schemas import METADATA
from corpusloom.sources import codefiles, jsonl
from corpusloom.sources.staging import stage

PAD = "x" * 120
PY = f'''# {PAD}
import os

def load_file(path, mode):
    """Load a file from disk. Then return it."""
    if path:
        return open(path, mode)
    return None

class Store:
    size = 1

    def put(self, item):
        self.item = item
'''
JS = f"// {PAD}\nfunction test(a) {{\n  return a;\n}}\nfunction foo(a) {{\n  return a;\n}}\n" \
     "function keep(a) {\n  return a;\n}\n"


@pytest.fixture
def corpus(files):
    return files(("r/src/a.py", PY), ("r/src/b.py", PY), ("r/src/a.js", JS),
                 ("r/build/c.py", PY), ("s/lib/a.py", PY), ("s/lib/small.py", "x = 1"))


def test_pipeline(corpus):
    rows = build_dataset(corpus).orderBy("repo", "rank").collect()
    got = [(r.repo, r.metadata.type, r.metadata.name, r.metadata.file) for r in rows]
    assert got == [
        ("r", "python_function", "load_file", "src/a.py"), ("r", "python_class", "Store", "src/a.py"),
        ("r", "javascript_function", "keep", "src/a.js"),
        ("s", "python_function", "load_file", "lib/a.py"), ("s", "python_class", "Store", "lib/a.py")]
    user = rows[0].messages[1].content
    assert user.startswith("Write a function that load a file from disk\n\nContext: File: a.py | ")
    # five of nine functions in the sample have one-word names
    assert "| Functions: lowercase | Classes: PascalCase | Indentation: spaces |" in user
    assert rows[0].messages[2].role == "assistant"
    assert rows[0].metadata.priority == "high" and rows[0].metadata.complexity == 2


def test_documented_twin_never_survives(corpus):
    kinds = {r.metadata.type for r in build_dataset(corpus).collect()}
    assert "python_documented_function" not in kinds


@pytest.mark.parametrize("config", [
    DatasetConfig(max_examples=900, staged=False), DatasetConfig(max_examples=5000), DatasetConfig(max_examples=900)])
def test_variants_agree(corpus, config):
    def content(rows):
        return sorted((r.example_id, r["rank"], str(r.messages)) for r in rows)

    want = content(build_dataset(corpus).collect())
    assert content(build_dataset(corpus, config).collect()) == want
    assert content(build_dataset(corpus.repartition(5), config).collect()) == want


def test_cap_counts_raw_units(corpus):
    # a.py has three raw units (one is the documented twin), so b.py is not taken
    rows = build_dataset(corpus, DatasetConfig(max_examples=3)).where("repo = 'r'").collect()
    assert {r.metadata.name for r in rows} == {"load_file", "Store"}
    assert max(r["rank"] for r in rows) <= 3


def test_empty_corpus(corpus):
    assert build_dataset(corpus.where("false")).count() == 0


def test_example_ids_are_unique(corpus):
    data = build_dataset(corpus)
    assert data.count() == data.select("example_id").distinct().count()


def test_path_rules(files):
    table = files(
        ("r0/environment/a.py", PY), ("r0/.github/a.js", JS), ("r0/src/combine.py", PY),
        ("r0/src/ok.py", PY), ("r0/src/A.PY", PY), ("r0/_x/__init__.py", PY), ("r0/a.cpp.txt", PY))
    assert sorted(r.path for r in select_files(table).collect()) == [
        "r0/_x/__init__.py", "r0/src/ok.py"]
    segments = select_files(table, match="segment").collect()
    assert sorted(r.path for r in segments) == [
        "r0/.github/a.js", "r0/_x/__init__.py", "r0/environment/a.py", "r0/src/combine.py",
        "r0/src/ok.py"]


def test_size_limits(files):
    sizes = (99, 100, 100_000, 100_001)
    table = files(*[(f"r/{n}.go", "x" * n) for n in sizes])
    assert sorted(r.size for r in select_files(table).collect()) == [100, 100_000]


def examples(spark, *rows):
    frame = spark.createDataFrame(list(rows), "i int, output string, instruction string")
    null = [F.lit(None).cast(f.dataType).alias(f.name) for f in METADATA.fields]
    return frame.withColumn("metadata", F.struct(*null))


def test_enrichment(spark):
    def infer(requests):
        return [f"Prompt: explain {json.loads(r)['prompt'].count('QQ')} things" for r in requests]

    got = {r.i: r for r in enrich_instructions(
        examples(spark, (1, "QQ QQ", "given"), (2, " \n", None), (3, None, "given")), infer,
        concurrency=2).collect()}
    assert (got[1].instruction, got[1].prompt_source) == ("explain 2 things.", "model")
    assert got[1].metadata.original_instruction == "given" and got[1].metadata.llm_generated_prompt
    assert (got[2].instruction, got[2].prompt_source) == ("Write some code.", "heuristic")
    assert (got[3].instruction, got[3].prompt_source) == ("given", "template")


@pytest.mark.parametrize("infer", [
    lambda requests: 1 / 0, lambda requests: [], lambda requests: [None] * len(requests)])
def test_enrichment_falls_back(spark, infer):
    got = {r.i: r for r in enrich_instructions(
        examples(spark, (1, "class A", ""), (2, "x", "given")), infer).collect()}
    assert got[1].instruction == "Write a class with the necessary methods."
    assert (got[2].instruction, got[2].prompt_source) == ("given", "template")


def test_a_fixed_number_of_tasks_is_dealt_bounded_shares(spark, monkeypatch, tmp_path):
    from corpusloom.operators import enrich

    log = str(tmp_path)

    def infer(requests):
        import os
        import uuid

        with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
            f.write(str(len(requests)))
        return [f"Prompt: explain {json.loads(r)['prompt'].count('QQ')} things" for r in requests]

    rows = [(i, "QQ " * (i + 1), None) for i in range(120)] + [(200, " ", None), (201, None, "given")]
    size = len(json.dumps("QQ " * 60))
    monkeypatch.setattr(enrich, "TASK_BYTES", 10 * size, raising=False)
    got = {r.i: r.instruction for r in enrich_instructions(examples(spark, *rows), infer, concurrency=2).collect()}
    assert len(got) == 122 and all(got[i] == f"explain {i + 1} things." for i in range(120))
    shares = [int(open(os.path.join(log, n)).read()) for n in os.listdir(log)]
    assert sum(shares) == 120 and max(shares) < 30  # two tasks would have 60 each


def test_model_is_asked_for_final_examples_only(spark, corpus, tmp_path):
    log = str(tmp_path)

    def infer(requests):
        import os
        import uuid

        with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
            f.write(str(len(requests)))
        return ["Describe this piece of code"] * len(requests)

    rows = build_dataset(corpus, DatasetConfig(infer=infer)).collect()
    asked = sum(int(open(os.path.join(log, n)).read()) for n in os.listdir(log))
    assert asked == len(rows) and {r.prompt_source for r in rows} == {"model"}
    assert rows[0].messages[1].content.startswith("Describe this piece of code.\n\nContext: ")


def test_conversations(spark):
    turns = [("c", i * 10**6, ("user", "assistant", "tool")[i % 3], f"t{i}") for i in range(50)]
    frame = spark.createDataFrame(turns + [("d", 0, "tool", "x"), ("e", 1, "user", None)],
                                  "conv_id string, turn bigint, role string, text string")
    whole = {r.conv_id: r.text for r in render_conversations(frame.repartition(3)).collect()}
    chunks = render_chunks(frame.repartition(3), turns_per_row=7 * 10**6).where("conv_id = 'c'")
    parts = [r.text for r in chunks.orderBy("chunk").collect()]
    opener = "<|im_start|>assistant\n"
    assert len(parts) == 8 and "\n".join([*parts, opener]) == whole["c"] and "t2<" not in whole["c"]
    assert whole["d"] == opener and whole["e"] == f"<|im_start|>user\n<|im_end|>\n{opener}"


def test_one_failing_request_costs_no_other(spark):
    def infer(requests):
        if any("QQ7" in r for r in requests):
            raise KeyError("no answer")
        return ["Prompt: say something useful"] * len(requests)

    rows = enrich_instructions(examples(spark, *[(i, f"QQ{i} ", "given") for i in range(9)]), infer).collect()
    assert {r.i for r in rows if r.prompt_source == "template"} == {7}
    assert {r.i: r.prompt_error for r in rows if r.prompt_error} == {7: "KeyError"}


def test_profile_of_repositories_without_facts(spark, files):
    frame = files(("r/a.py", PY), ("s/b.py", "def broken(:\n" + "#" * 200))
    rows = {r.repo: r for r in corpusloom.build_style_profile(frame).collect()}
    assert rows["s"].style_context == "Standard conventions" and rows["r"].style_context != "Standard conventions"


def test_summary(corpus):
    rows = dataset_summary(build_dataset(corpus).where("repo = 'r'")).collect()
    got = {(r.dimension, r.value): r for r in rows}
    total = got["all", "all"]
    assert total.n == sum(r.n for r in rows if r.dimension == "type")
    assert total.n == sum(r.n for r in rows if r.dimension == "language")
    assert total.files == 2 and total.with_docstring == 1 and total.generated_prompts == 0


def test_written_files(spark, corpus, tmp_path):
    data = stage(build_dataset(corpus), "dataset")
    jsonl.write_messages(data, str(tmp_path / "m"))
    jsonl.write_metadata(data, str(tmp_path / "meta"))
    jsonl.write_messages(data, str(tmp_path / "bare"), with_id=False)
    jsonl.write_sample(data, str(tmp_path / "sample"), ["repo", "rank"])
    back = jsonl.rejoin_metadata(jsonl.read_jsonl(spark, str(tmp_path / "m")),
                                 jsonl.read_metadata(spark, str(tmp_path / "meta")))
    columns = ["example_id", "messages", "metadata"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(
        map(str, data.select(columns).collect()))
    bare = json.loads(spark.read.text(str(tmp_path / "bare")).first()[0])
    assert list(bare) == ["messages"] and list(bare["messages"][0]) == ["role", "content"]
    meta = json.loads(spark.read.text(str(tmp_path / "meta")).first()[0])
    assert None not in meta.values()
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "sample"), wholetext=True).collect())
    assert len(json.loads(text)) == data.count() and text.count("\n") > 10
    assert training_text(data).first().text.startswith("<|im_start|>system\n")


def test_bad_line_is_an_error(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"messages": []}\n{broken\n')
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("splits, slices", [(1, 1), (256, 1), (3, 4)])
def test_reading_a_tree(spark, tmp_path, splits, slices):
    paths = ["r0/pkg/__init__.py", "r0/_priv.py", "r0/a/b/c/d.go", "r1/x.ts", "r1/.x.js"]
    skipped = ["r0/vendor/x.py", "r1/readme.md", "r1/a.PY", "top.py"]
    for p in paths + skipped:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"# {p} {PAD}")
    (tmp_path / "r0/small.py").write_text("x")
    codefiles.register(spark)
    tree = spark.read.format("codefiles").option("path", str(tmp_path)).option(
        "splits", splits).option("slices", slices).load()
    rows = tree.collect()
    assert sorted(r.path for r in rows) == sorted(paths)
    assert all(bytes(r.content).decode().startswith(f"# {r.path}") for r in rows)
    assert {r.repo for r in rows} == {"r0", "r1"}
    one = spark.read.format("codefiles").option("path", str(tmp_path / "r1")).option("repo", "me").load()
    assert {(r.repo, r.path) for r in one.collect()} == {("me", "r1/x.ts"), ("me", "r1/.x.js")}
    assert corpusloom.build_style_profile(tree).count() == 2


def write_files(root, paths, text=f"# {PAD}"):
    for path in paths:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def test_a_directory_of_any_size_is_never_held(tmp_path):
    import tracemalloc

    (tmp_path / "r").mkdir()
    for i in range(8000):
        (tmp_path / "r" / f"{i:05d}.py").write_text("# 1")
    rules = codefiles.Rules((".py",))
    reader = codefiles.CodeFilesReader({"path": str(tmp_path), "splits": "4"}, rules)
    parts = reader.partitions()
    found = [work for part in parts for work in part.work]
    assert len(parts) == 4
    tracemalloc.start()
    assert sum(1 for work in found for _ in reader._entries(work)) == 8000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500_000  # 8,000 entries and their paths are over 1.5 MB
    assert sum(batch.num_rows for part in parts for batch in reader.read(part)) == 8000


def scan(spark, path, **options):
    return spark.read.format("codefiles").options(path=str(path), **options).load()


def test_partitions_are_few_and_even(tmp_path):
    write_files(tmp_path, [f"r{i}/a.py" for i in range(2000)])
    # one repository outweighs all others, in one directory
    write_files(tmp_path, [f"huge/src/m{i}.py" for i in range(4000)], "#" * 700)
    for plan_dirs in ("4096", "50"):
        reader = codefiles.CodeFilesReader(
            {"path": str(tmp_path), "splits": "32", "planDirs": plan_dirs}, codefiles.Rules((".py",), low=100, high=100_000))
        parts = reader.partitions()
        assert len(parts) == 32
        sizes = [sum(r.num_rows for r in reader.read(p)) for p in parts]
        assert sum(sizes) == 6000
        if plan_dirs == "4096":
            shares = [sum(sum(b.column("size").to_pylist()) for b in reader.read(p)) for p in parts]
            assert max(shares) < 1.4 * sum(shares) / 32
    few = codefiles.CodeFilesReader({"path": str(tmp_path / "r1"), "repo": "r1"}, codefiles.Rules()).partitions()
    assert len(few) == 1


def test_rules_as_options(spark, tmp_path):
    write_files(tmp_path, ["r/a.py", "r/b.kt", "r/environment/c.py", "r/env/d.py", "r/notes/e.py", "r/f.py"])
    (tmp_path / "r/f.py").write_text("x")
    codefiles.register(spark)

    def paths(**options):
        return sorted(r.path for r in scan(spark, tmp_path, **options).collect())

    assert paths() == ["r/a.py", "r/notes/e.py"]
    assert paths(extensions=".kt") == ["r/b.kt"]
    assert paths(extensions="*", ignored="notes") == ["r/a.py", "r/b.kt", "r/env/d.py", "r/environment/c.py"]
    assert paths(pathMatch="segment") == ["r/a.py", "r/environment/c.py", "r/notes/e.py"]
    assert paths(minBytes="1", maxBytes="5") == ["r/f.py"]
    with pytest.raises(Exception, match="pathMatch"):
        paths(pathMatch="glob")
    codefiles.register(spark, corpusloom.operators.registry.DEFAULT_REGISTRY.with_extension(".kt", "kotlin"))
    assert paths() == ["r/a.py", "r/b.kt", "r/notes/e.py"]


@pytest.mark.parametrize("condition, pushed", [
    ("ext = '.py'", True), ("ext IN ('.js', '.go')", True), ("NOT ext = '.py'", True), ("size > 200", True), ("size <= 200", True),
    ("repo = 'r1'", True), ("path LIKE 'r1/%'", True), ("path LIKE '%deep%'", True), ("name LIKE '%.js'", True),
    ("size BETWEEN 150 AND 400", True), ("length(path) > 8", False), ("ext = '.py' OR size > 300", False),
])
def test_filters_are_applied_by_the_scan(spark, tmp_path, condition, pushed):
    for i, path in enumerate(["r0/a.py", "r0/deep/b.js", "r1/c.py", "r1/deep/er/d.go"]):
        write_files(tmp_path, [path], "#" * (150 + 100 * i))
    codefiles.register(spark)
    tree = scan(spark, tmp_path)
    plain = spark.createDataFrame(tree.collect(), tree.schema)
    found = tree.where(condition)
    assert sorted(r.path for r in found.collect()) == sorted(r.path for r in plain.where(condition).collect())
    assert (" Filter (" not in found._jdf.queryExecution().executedPlan().toString()) == pushed


def test_names_that_are_no_text_and_unreadable_files(spark, tmp_path):
    write_files(tmp_path, ["r/a.py"])
    with open(os.path.join(os.fsencode(tmp_path), b"r/\xff\xe9.py"), "wb") as f:
        f.write(b"x" * 200)
    os.symlink("nowhere", tmp_path / "r/gone.py")
    os.symlink(tmp_path / "r", tmp_path / "r/again.py")
    codefiles.register(spark)
    assert sorted(r.path for r in scan(spark, tmp_path).collect()) == ["r/\\xff\\xe9.py", "r/a.py"]
    rows = {r.path: (r.size, r.error) for r in scan(spark, tmp_path, errors="rows").collect()}
    assert rows == {"r/\\xff\\xe9.py": (200, None), "r/a.py": (122, None), "r/gone.py": (None, "FileNotFoundError")}
    assert scan(spark, tmp_path, errors="rows").where("size > 0").count() == 2


def test_equal_names_below_several_roots(spark, tmp_path):
    write_files(tmp_path, ["x/one/a.py", "y/one/a.py", "y/two/a.py", "z/x/one/a.py"])
    codefiles.register(spark)
    roots = ",".join(str(tmp_path / r) for r in ("x", "y", "z/x"))
    rows = spark.read.format("codefiles").option("path", roots).load().select("repo", "path").collect()
    assert len({r.path for r in rows}) == 4 and all(r.path == f"{r.repo}/a.py" for r in rows)
    assert {"y/one", "two"} < {r.repo for r in rows}


def test_errors_and_counts_of_a_build(files):
    corpus = files(("r/a.py", PY), ("r/a.js", JS), ("r/bad.py", f"# {PAD}\ndef (\n"), ("s/raw.js", b"\xff" + JS.encode()))
    found = extract(corpus)
    assert sorted(map(tuple, found.errors.collect())) == [
        ("r", "r/bad.py", "file", None, "SyntaxError"), ("s", "s/raw.js", "file", None, "UnicodeDecodeError")]
    kinds = {r.type: r["count"] for r in found.units.groupBy("metadata.type").count().collect()}
    assert found.counts == kinds | {"errors": 2, "error:file": 2}
    want = sorted(r.example_id for r in build_dataset(corpus).collect())
    assert sorted(r.example_id for r in build_dataset(corpus, extraction=found).collect()) == want
    lazy = DatasetConfig(staged=False)
    unwritten = extract(corpus, lazy)
    assert unwritten.counts is None and unwritten.errors.count() == 2
    assert sorted(r.example_id for r in build_dataset(corpus, lazy, unwritten).collect()) == want


def test_errors_of_nothing(files, spark):
    found = extract(files(("r/readme.md", "x" * 200)))
    assert found.counts == {} and found.errors.count() == 0 and found.units.count() == 0
