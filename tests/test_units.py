"""Code units: edge cases of each language, errors, long inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.operators.files import select_files
from corpusloom.operators.kinds import FunctionKind, PatternKind
from corpusloom.operators.regex_units import DEFAULT_KINDS, match_units
from corpusloom.operators.registry import DEFAULT_REGISTRY
from corpusloom.operators.units import explode_errors, extract_examples, parse_files

PAD = "x" * 120


@pytest.fixture
def found(files):
    """(type, name, output) of the examples in one file, in order."""
    def run(path, content, registry=DEFAULT_REGISTRY):
        rows = extract_examples(select_files(files((f"r/{path}", content)), registry), registry)
        return [(r.metadata.type, r.metadata.name, r.output) for r in rows.orderBy("seq").collect()]

    return run


def kinds(rows):
    return [(kind, name) for kind, name, _ in rows]


def test_python_units(found):
    code = f'''# {PAD}
async def skipped(a):
    x = 1
    return x

class A:
    def __init__(self):
        a = 1
        return a

    def method(self, a, *b, c=1):
        """A docstring that is long enough. Yes."""
        return a

def short(): pass
'''
    got = found("src/a.py", code)
    assert kinds(got) == [
        ("python_class", "A"), ("python_function", "method"),
        ("python_documented_function", "method")]


def test_python_limits(found):
    def lines(n):
        return "".join("    a = 1\n" for _ in range(n))

    code = (f"# {PAD}\ndef fits():\n{lines(49)}\ndef too_long():\n{lines(50)}\n"
            f"class Fits:\n{lines(99)}\nclass TooLong:\n{lines(100)}\n"
            "def simple():\n" + "    a = 0 if a else 1\n" * 19
            + "def complex():\n" + "    a = 0 if a else 1\n" * 20)
    assert kinds(found("a.py", code)) == [
        ("python_function", "fits"), ("python_class", "Fits"), ("python_function", "simple")]


def test_python_metadata(files):
    code = f'# {PAD}\nclass A:\n    def __a(self): pass\n    def b(self, x): pass\n    async def c(self): pass\n'
    row = extract_examples(select_files(files(("r/p/q/a.py", code)))).first()
    m = row.metadata
    assert (m.file, m.method_count, m.has_docstring, m.naming_style, m.lines) == (
        "q/a.py", 2, False, "PascalCase", None)
    assert m.style_focus and row.context_prefix == "File: a.py | " and row.context_suffix is None


def test_javascript_braces(found):
    code = f"""// {PAD}
function two(x) {{
  if (x) {{ return 1; }}
}}
function three(x) {{
  if (x) {{ while (x) {{ x-- }} }}
}}
function oneline() {{ return 1; }}
const go = (a) => {{
  return a;
}}
"""
    assert kinds(found("a.ts", code)) == [
        ("javascript_function", "two"), ("javascript_arrow_function", "go")]


def test_java_constructor_is_no_method(found):
    code = f"""// {PAD}
class Foo {{
  public Foo(int a) {{
    b = a;
    c = a;
  }}
  private static final int run(int a) throws X , Y {{
    int b = a;
    return b;
  }}
}}
"""
    assert kinds(found("a.java", code)) == [("java_method", "run"), ("java_class", "Foo")]


def test_cpp_control_words(found):
    code = f"""// {PAD}
  else if (x) {{
    a();
    b();
  }}
int* find(int a) const {{
  b();
  return a;
}}
"""
    assert kinds(found("a.hpp", code)) == [("cpp_function", "find")]


def test_go_results(found):
    code = f"""// {PAD}
func f() *T {{
  return x
}}
func g() (int, error) {{
  return x
}}
type A struct {{ x int }}
"""
    assert kinds(found("a.go", code)) == [("go_function", "g"), ("go_struct", "A")]


def test_rust(found):
    code = f"// {PAD}\npub struct A<T> {{ a: T }}\nfn f<T>(a: T) -> Result<A, B>\n{{\n  a\n}}\n"
    assert kinds(found("a.rs", code)) == [("rust_function", "f"), ("rust_struct", "A")]


def test_unicode_words(found):
    code = f"// {PAD}\nfunction\u00a0élan_名() {{\n  a\n}}\n"
    assert kinds(found("a.js", code)) == [("javascript_function", "élan_名")]


def test_errors_are_kept_aside(files):
    bad = select_files(files(
        ("r/a.py", f"def (:\n# {PAD}"), ("r/b.js", b"\xff" * 200), ("r/c.py", f"\ufeff# {PAD}"),
        ("r/d.py", f"# {PAD}\ndef ok(a):\n    b = a\n    return b\n"),
        ("r/e.py", f"# {PAD}\nx = " + "-" * 3000 + "1")))
    errors = {r.path: r.error for r in explode_errors(parse_files(bad)).collect()}
    assert errors["r/a.py"] == "SyntaxError" and errors["r/b.js"] == "UnicodeDecodeError"
    assert "r/d.py" not in errors and "r/c.py" in errors


def test_brace_flood(spark):
    text = "function f(a) {" + "{}" * 30_000 + "\n\n}"
    kind = DEFAULT_KINDS[0]
    frame = spark.createDataFrame([(text,)], "content string")
    assert frame.select(F.size(match_units(F.col("content"), kind, 0))).first()[0] == 1


def test_long_lists(spark):
    text = "class A implements B" + ", C" * 19_000 + " {" + "\n" * 8 + "}"
    kind = next(k for k in DEFAULT_KINDS if k.kind == "java_class")
    frame = spark.createDataFrame([(text,)], "content string")
    assert frame.select(F.size(match_units(F.col("content"), kind, 0))).first()[0] == 1


def test_long_heads(spark):
    """Heads that fill a whole file of the largest size."""
    texts = {
        "java_method": "public " + "a " * 49_000 + "f(int a) throws X" + ", Y" * 500 + " {\n\n\n}",
        "cpp_function": "int" + " " * 45_000 + "f(" + "a" * 50_000 + ") {\n\n\n}",
        "rust_function": "fn f<" + "T," * 24_000 + ">(" + "x" * 20_000 + ") -> " + "R " * 9_000 + "{\n\n}",
        "go_function": "func (" + "a," * 20_000 + ") f(" + "b," * 20_000 + ") (int) {\n\n}",
    }
    for kind in DEFAULT_KINDS:
        if kind.kind in texts:
            frame = spark.createDataFrame([(texts[kind.kind],)], "content string")
            found = frame.select(F.size(match_units(F.col("content"), kind, 0))).first()[0]
            assert found == 1, kind.kind


@pytest.mark.parametrize("kind", DEFAULT_KINDS, ids=lambda k: k.kind)
def test_possessive_patterns_find_the_same(spark, kind):
    """Random token soup: same matches and names as the plain pattern."""
    rng = random.Random(kind.kind)
    tokens = ["function ", "class ", "A", "b ", "const ", "= ", "=> ", "async ", "(", ")", "{", "}",
              "\n", " ", "public ", "static ", "throws X", ", Y", "extends Z ", "implements W",
              ": ", "func ", "type ", "struct ", "fn ", "pub ", "-> i32 ", "<T>", "*", "&", "inline ",
              "() {", "{}", "int f() {", "\t"]
    texts = ["".join(rng.choices(tokens, k=rng.randint(3, 40))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, content string").repartition(4)
    got = {r.i: [(u.code, u.name) for u in r.u] for r in rows.select(
        "i", match_units(F.col("content"), PatternKind(
            kind.kind, kind.language, kind.pattern, kind.group,
            spark_pattern=kind.spark_pattern), 0).alias("u")).collect()}
    plain = re.compile(K.UNIT_PATTERNS[kind.kind])
    want = {i: [(m.group(0), m.group(kind.group)) for m in plain.finditer(t)]
            for i, t in enumerate(texts)}
    assert got == want


def test_own_kind_and_language(files):
    registry = DEFAULT_REGISTRY.with_extension(".kt", "kotlin").with_pattern(PatternKind(
        kind="kotlin_function", language="kotlin", pattern=r"fun (\w+)\(\) \{[^{}]*\}",
        min_lines=2, instruction="Write a Kotlin function named ", context="Kotlin"))
    table = files(("r/a.kt", f"// {PAD}\nfun go() {{\n}}\nfun short() {{ }}\n"))
    row, = extract_examples(select_files(table, registry), registry).collect()
    assert (row.instruction, row.context_suffix, row.metadata.language) == (
        "Write a Kotlin function named go", "Kotlin", "kotlin")


def test_own_function(files):
    def first_line(content):
        null = F.lit(None)
        return F.when(content.isNotNull(), F.array(F.struct(
            F.lit("note").alias("kind"), F.lit(0).cast("bigint").alias("seq"),
            F.lit("n").alias("name"), F.substring_index(content, "\n", 1).alias("code"),
            null.cast("string").alias("docstring"), null.cast("int").alias("arg_count"),
            null.cast("int").alias("method_count"), null.cast("array<string>").alias("methods"),
            null.cast("string").alias("error"))))

    registry = DEFAULT_REGISTRY.with_extension(".txt", "text").with_function(
        "text", first_line, kinds=[FunctionKind("note", "Write a note named ", "Notes")])
    table = files(("r/a.txt", f"hello\n{PAD}"), ("r/b.go", f"// {PAD}\ntype A struct {{}}"))
    got = extract_examples(select_files(table, registry), registry).orderBy("path").collect()
    assert [(r.metadata.type, r.output) for r in got] == [
        ("note", "hello"), ("go_struct", "type A struct {}")]
    assert (got[0].instruction, got[0].context_suffix) == ("Write a note named n", "Notes")
    plain = DEFAULT_REGISTRY.with_extension(".txt", "text").with_function("text", first_line)
    row, = extract_examples(select_files(files(("r/a.txt", f"hello\n{PAD}")), plain), plain).collect()
    assert row.instruction == "Write code named n"
