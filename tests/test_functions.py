"""Literal cases of the text, naming and chat functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.functions import chat, naming, spec, text


def values(spark, inputs, fn, schema="x string"):
    """fn over the inputs, in order."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, {schema}")
    got = rows.coalesce(1).select("i", fn(F.col(schema.split()[0])).alias("y")).orderBy("i")
    return [r.y for r in got.collect()]


def test_naming_styles(spark):
    cases = {
        "foo_bar": "snake_case", "FooBar": "PascalCase", "fooBar": "camelCase",
        "FOO_BAR": "UPPER_CASE", "foo": "lowercase", "FOO": "PascalCase",
        "Foo_Bar": "mixed", "foo_Bar": "camelCase", "_x": "snake_case", "_": "mixed",
        "": "mixed", "a-b": "mixed", "été_un": "snake_case", "Été": "PascalCase",
        "_FOO": "UPPER_CASE", "foo\n": "mixed", None: "mixed", "__init__": "snake_case",
        "1a": "lowercase", "x1_y2": "snake_case", "名前": "mixed",
    }
    assert values(spark, list(cases), naming.naming_style) == list(cases.values())


def test_complexity_counts_substrings(spark):
    assert values(spark, ["elif", "IF if", "", "withif", "defor", "classy function"],
                  naming.complexity) == [1, 2, 0, 2, 2, 2]


@pytest.mark.parametrize("doc, style", [
    (None, "none"), ("", "none"), ("Args: a Returns: b", "google_style"), ("Args: a", "single_line"),
    (":param a :return b", "sphinx_style"), ('"""a"""', "triple_quote"), ("'''a'''", "triple_quote"),
    ('"""a', "single_line"), ("a\nb", "multi_line"),
])
def test_docstring_style(spark, doc, style):
    assert values(spark, [doc], naming.docstring_style) == [style]


def test_instructions(spark):
    rows = spark.createDataFrame(
        [("target", None), ("reset", ""), ("compute_x", ".a"), ("check", None), ("run", "Do It. Now"),
         ("run", None)], "name string, doc string")
    got = [r[0] for r in rows.coalesce(1).select(
        naming.function_instruction(F.col("name"), F.col("doc"))).collect()]
    assert got == [
        "Create a getter function named target", "Create a setter function named reset",
        "Write a calculation function named compute_x", "Create a validation function named check",
        "Write a function that do it", "Implement a function named run",
    ]


def test_class_instructions(spark):
    rows = spark.createDataFrame(
        [("FileManager", []), ("AHandler", []), ("A", ["run", "do_Process"]), ("A", []), ("A", None)],
        "name string, methods array<string>")
    none = F.lit(None).cast("string")
    got = [r[0] for r in rows.coalesce(1).select(
        naming.class_instruction(F.col("name"), none, F.col("methods"))).collect()]
    assert got == [
        "Design a FileManager class for managing resources",
        "Create a AHandler class for handling operations",
        "Implement a A class with processing capabilities",
        "Create a A class with appropriate methods", "Create a A class with appropriate methods",
    ]


def test_lines(spark):
    texts = ["", "a", "a\n", "\n\n", " \n\ta\n\u2003", "a\x0bb"]
    assert values(spark, texts, text.line_count) == [1, 1, 2, 3, 3, 1]
    assert values(spark, texts, text.nonblank_line_count) == [0, 1, 1, 0, 1, 1]
    assert values(spark, ["", " a  b\n\x1cc", "\u3000", "a\u00a0b"], text.word_count) == [0, 3, 0, 2]


def test_normal_form_and_hash(spark):
    code = "\tif x:\n\n   # note\n#include <x>\n  y \u2003\n"
    assert values(spark, [code, "", "#a"], text.normalize_code) == ["if x:\ny", "", ""]
    assert values(spark, [code], text.code_hash) == [hashlib.md5(b"if x:\ny").hexdigest()]


def test_paths(spark):
    paths = ["a/b/c.py", "c.py", "/c.py", "a/b/.profile", "Makefile", "x.tar.gz"]
    assert values(spark, paths, text.short_path) == [
        "b/c.py", "c.py", "/c.py", "b/.profile", "Makefile", "x.tar.gz"]
    names = ["c.py", ".profile", "Makefile", "x.tar.gz", ".py", "A.PY"]
    assert values(spark, names, text.file_extension) == [".py", "", "", ".gz", "", ".PY"]


def test_decoding(spark):
    raw = [b"a\r\nb\rc\n", b"\xff\x61", "é".encode(), b""]
    got = values(spark, [bytearray(r) for r in raw], text.decode_text, "x binary")
    assert got == ["a\nb\nc\n", None, "é", ""]


def test_code_for_a_prompt(spark):
    long = "\n".join(f"l{i} " for i in range(40))
    want = "\n".join(f"l{i}" for i in range(30)) + "\n    # ... (truncated)"
    exactly = "\n".join(f"l{i}" for i in range(30))
    got = values(spark, [" \n\n  a\t\n\n b \n \n", " \n ", long, exactly], text.clean_code)
    assert got == ["  a\n\n b", "", want, exactly]


@pytest.mark.parametrize("raw, want", [
    ('{"response": "\\"Prompt: write a parser\\""}', "write a parser."),
    ("123456789", None), ("1234567890", "1234567890."), ("x" * 500, "x" * 500 + "."),
    ("x" * 501, None), ("{bad json here}", None), ('{"response": 12345678901}', None),
    ('{"response": null}', None), ('{"other": "a long enough text"}', None),
    ('{"response": "a long enough text"} trailing', None),
    ('{"response": "a long enough text"} {}', None),
    ("{'response': 'a long enough text'}", None),
    ("  Here's a prompt: PROMPT: do the work!", "do the work!"),
    ("Prompt: Here's a prompt: do it", "Here's a prompt: do it."),
    ("'\"quoted in the middle\"'", '"quoted in the middle".'),
    ("why would you do this?", "why would you do this?"), (None, None),
])
def test_model_answers(spark, raw, want):
    assert values(spark, [raw], chat.clean_response) == [want]


def test_fallback_prompts(spark):
    codes = ["class A:\n def __init__(s): pass", "CLASS a", "def f():\n return 1", "def f(): pass",
             "from a", "if __name__", "try:", "x = 1", "if __name__ # import x"]
    got = values(spark, codes, chat.fallback_prompt)
    assert [g.split()[0:3] for g in got] == [
        ["Create", "a", "class"], ["Write", "a", "class"], ["Write", "a", "function"],
        ["Create", "a", "function"], ["Write", "code", "with"], ["Create", "a", "script"],
        ["Write", "code", "with"], ["Write", "the", "necessary"], ["Write", "code", "with"]]


def test_messages_and_chatml(spark):
    row = spark.range(1).select(
        chat.to_messages(F.lit("do"), F.lit(""), F.lit("x")).alias("m")).select(
        F.col("m")[1]["content"].alias("user"), chat.chatml(F.col("m")).alias("t"),
        chat.chatml(F.col("m"), opener=True).alias("o")).first()
    assert row.user == "do"
    assert row.t.endswith("<|im_start|>user\ndo<|im_end|>\n<|im_start|>assistant\nx<|im_end|>")
    assert row.o == row.t + "\n<|im_start|>assistant\n"
    roles = spark.sql("SELECT array(named_struct('role', 'tool', 'content', 'x'),"
                      " named_struct('role', 'system', 'content', 's')) AS m")
    assert roles.select(chat.chatml(F.col("m"))).first()[0] == "<|im_start|>system\ns<|im_end|>"


def test_spec_defaults(spark):
    row = spark.range(1).select(spec.spec_profile(F.lit("{}")).alias("p")).select("p.*").first()
    assert row.asDict() == {
        "module_name": "unknown", "entities": [], "api_style": "rest", "base_path": "/api",
        "endpoints_count": 0, "ui_framework": "react", "routes_count": 0, "persistence": "postgres"}


def test_fixed_values():
    """As written down once more: a slip in the constants would be the same in the SQL."""
    assert (K.MIN_FILE_BYTES, K.MAX_FILE_BYTES, K.PROFILE_FILES, K.MAX_EXAMPLES) == (100, 100_000, 50, 5000)
    assert (K.MIN_UNIT_LINES, K.MAX_UNIT_LINES, K.MAX_PYTHON_FUNCTION_LINES, K.MIN_NONBLANK_LINES) == (3, 100, 50, 2)
    assert set(K.GENERIC_NAMES) == {"test", "temp", "tmp", "foo", "bar", "example", "demo"}
    assert set(K.PREFERRED_NAMING) == {"snake_case", "camelCase", "PascalCase"} and K.MAX_COMPLEXITY == 20
    assert sorted(K.COMPLEXITY_KEYWORDS) == [
        "case", "class", "def", "except", "for", "function", "if", "switch", "try", "while", "with"]
    assert len(K.IGNORED_PATH_PARTS) == 16 and K.DEFAULT_STYLE_CONTEXT == "Standard conventions"


def test_broken_specs_have_no_profile(spark):
    rows = spark.createDataFrame([("{bad",), (None,), ("[1]",), ("3",), ("{}",)], "s string")
    got = {r.s: r.p for r in rows.select("s", spec.spec_profile(F.col("s")).alias("p")).collect()}
    assert [k for k, v in got.items() if v is not None] == ["{}"]
