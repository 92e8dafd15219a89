"""Style profiles of small repositories."""

import pytest
from pyspark.sql import functions as F

from corpusloom import build_style_profile
from corpusloom.operators.files import profile_sample, select_files
from corpusloom.operators.style import (
    analyzed_files, count_facts, file_facts, import_sample, preferred_line_length, style_context, style_counts,
    style_profile,
)

PAD = "//" + "x" * 60 + "\n//" + "y" * 60 + "\n"
PY_PAD = PAD.replace("//", "# ")


@pytest.fixture
def profile(files):
    def run(*pairs):
        sample = profile_sample(select_files(files(*pairs)))
        return {r.repo: r for r in style_profile(style_counts(sample)).collect()}

    return run


def test_first_seen_wins_a_tie(profile):
    snake = PY_PAD + "def a_b(): pass\ndef c_d(): pass\n"
    camel = PAD + "function aB() {}\nfunction cD() {}\n"
    assert profile(("r/z.py", snake), ("r/a.js", camel))["r"].functions_preferred == "snake_case"
    assert profile(("r/z.ts", PAD + "function a_b() {}"), ("r/a.js", PAD + "function aB() {}"))[
        "r"].functions_preferred == "camelCase"


def test_names_that_are_counted(files):
    code = PAD + "const aB = async (x) => 1;\nfoo_bar: async function() {}\nclass A {}\nfunction F() {}\n"
    counts = style_counts(profile_sample(select_files(files(("r/a.js", code)))))
    got = {(r.category, r.value): r.n for r in counts.collect() if r.category in ("functions", "classes")}
    assert got == {("functions", "PascalCase"): 1, ("functions", "camelCase"): 1,
                   ("functions", "snake_case"): 1, ("classes", "PascalCase"): 1}


def test_python_variables_and_constants(files):
    code = PY_PAD + "A = B_C = 1\nd = 2\nself.e = f, g = 3, 4\nasync def h(): i_j = 1\n"
    counts = style_counts(profile_sample(select_files(files(("r/a.py", code)))))
    got = {(r.category, r.value): r.n for r in counts.collect()
           if r.category in ("variables", "constants", "functions")}
    assert got == {("constants", "UPPER_CASE"): 2, ("variables", "lowercase"): 1,
                   ("variables", "snake_case"): 1}


def test_indentation(files):
    code = PAD + "\ta\n  b\n  c\n\t\n    d\n"
    counts = style_counts(profile_sample(select_files(files(("r/a.java", code)))))
    got = {r.value: r.n for r in counts.collect() if r.category == "indentation"}
    assert got == {"tabs": 1, "spaces": 3, "2_spaces": 2, "4_spaces": 1}


def test_indentation_prefers_the_kind_over_the_width(profile):
    assert profile(("r/a.java", PAD + "  b\n  c\n"))["r"].preferred_indentation == "spaces"


def test_lengths(profile):
    lines = ["a" * 10 + "  "] * 2 + [""] + ["b" * 20]
    row = profile(("r/a.js", PAD + "\n".join(lines)))["r"]
    assert row.n_lines == 5 and row.avg_line_length == round((62 + 62 + 10 + 10 + 20) / 5, 1)


@pytest.mark.parametrize("n, over_80, over_100, want", [
    (100, 11, 11, 120), (100, 21, 5, 100), (100, 20, 10, 80), (100, 0, 0, 80), (0, 0, 0, None)])
def test_preferred_line_length(spark, n, over_80, over_100, want):
    row = spark.range(1).select(preferred_line_length(F.lit(n), F.lit(over_80), F.lit(over_100)))
    assert row.first()[0] == want


def test_context_text(spark):
    null = F.lit(None).cast("string")
    row = spark.range(1).select(
        style_context(null, null, null, null, null).alias("a"),
        style_context(F.lit("snake_case"), null, F.lit("tabs"), F.lit(80), null).alias("b")).first()
    assert row.a == "Standard conventions"
    assert row.b == "Functions: snake_case | Indentation: tabs | Max line length: 80"


def test_broken_and_other_files_say_nothing(profile, files):
    pairs = (("r/a.py", PY_PAD + "def (\n"), ("r/b.go", PAD + "func a_b() {}"))
    assert profile(*pairs) == {}
    sample = profile_sample(select_files(files(*pairs)))
    assert analyzed_files(sample).first().analyzed_files == 2


def test_organization(files):
    first = PY_PAD + 'import a\nx = 1\nif __name__ == "__main__":\n    x()\n'
    doc = '"""' + PY_PAD + '"""\nimport a\n'
    early = PY_PAD + 'if __name__ == "__main__":\n    x()\n' + "x = 1\n" * 10
    counts = style_counts(profile_sample(select_files(files(
        ("r/a.py", first), ("r/b.py", doc), ("r/c.py", early), ("r/d.py", PY_PAD)))))
    got = {r.value: r.n for r in counts.collect() if r.category == "organization"}
    assert got == {"imports_first": 2, "main_at_end": 1}


def test_sample_is_the_first_files_in_scan_order(files):
    pairs = [(f"r/{i:03}.js", PAD) for i in range(60)] + [(f"r/{i:03}.py", PY_PAD) for i in range(30)]
    got = profile_sample(select_files(files(*pairs))).orderBy("file_seq").collect()
    assert [r.path for r in got] == [f"r/{i:03}.py" for i in range(30)] + [
        f"r/{i:03}.js" for i in range(20)]
    assert [r.file_seq for r in got] == list(range(1, 51))


def test_import_sample(files):
    many = PY_PAD + "".join(f"import m{i}\n" for i in range(7))
    pairs = [(f"r/{i:02}.py", many) for i in range(12)] + [("r/zz.py", PY_PAD)]
    facts = file_facts(profile_sample(select_files(files(*pairs))))
    got = import_sample(facts).orderBy("seq").collect()
    assert len(got) == 50 and [r.seq for r in got] == list(range(50))
    assert [r.statement for r in got[:6]] == [f"import m{i}" for i in range(5)] + ["import m0"]


def test_import_sample_may_pass_the_total(files):
    odd = PY_PAD + "import a, b\nfrom . import c\n"
    pairs = [(f"r/{i:02}.py", odd) for i in range(20)]
    facts = file_facts(profile_sample(select_files(files(*pairs))))
    got = import_sample(facts).orderBy("seq").collect()
    assert len(got) == 51
    assert [r.statement for r in got[:3]] == ["import a", "import b", "from  import c"]


def test_profile_of_all_files(files):
    snake = "// " + "x" * 100 + "\nfunction get_it(x) {\n  return 1;\n}\n"
    camel = "// " + "x" * 100 + "\nfunction getIt(x) {\n\treturn 1;\n}\n"
    pairs = [(f"r/a{i:03}.js", snake) for i in range(50)] + [(f"r/b{i:03}.js", camel) for i in range(70)]
    # a tie is for the value seen first
    pairs += [("s/b.js", snake), ("s/a.js", camel)]
    rows = {r.repo: r for r in build_style_profile(files(*pairs)).collect()}
    assert rows["r"].functions_preferred == "camelCase" and rows["r"].preferred_indentation == "tabs"
    assert rows["r"].n_lines == 120 * 4
    assert rows["s"].functions_preferred == "camelCase"


def test_names_that_a_file_repeats_are_counted_where_it_is_parsed(files):
    text = PY_PAD + "a = 1\nb = 2\n" + "a = a + 1\n" * 30 + "def f(x):\n    a = b = x\n    return a\n"
    facts = file_facts(select_files(files(("r/a.py", text))))
    names = [f for r in facts.collect() for f in r.facts if f.category in ("variables", "functions")]
    assert sorted((f.category, f.pos, f.n) for f in names) == [("functions", 33, 1), ("variables", 1, 32), ("variables", 2, 2)]
    counts = {(r.category, r.value): r.n for r in count_facts(facts).collect()}
    assert counts[("variables", "lowercase")] == 34 and counts[("functions", "lowercase")] == 1
