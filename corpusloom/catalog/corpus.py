"""Code files derived from the `part` table, in Spark and in SQL.

Every part yields one file per template, with `@id@` (snake case), `@Id@`
(capitalized), `@n@` (size) and `@k@` (key) filled in.  A third of the parts
lives in one repository, `mono`; the others share small ones, eight keys each.
Names and sizes repeat, so many units are copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_PAD = " generated fixture file: padding so that every file passes the lower size limit of one hundred bytes\n"
_PY = "#" + _PAD
_C = "//" + _PAD

_PY_FUNCTION = _PY + '''def get_@id@(a, b: int):
    """Return the size of the part. More text."""
    # comment
    if a:
        return @n@
    return b

async def skipped(a):
    x = 1
    return x
'''
_PY_MANAGER = _PY + '''class @Id@Manager:
    size = @n@

    def __init__(self):
        self.x = @n@
'''
_PY_MODULE = _PY + '''import os
import sys, json
from typing import List, Dict
from . import helpers

MAX_SIZE = @n@
default_size = @n@


class @Id@Handler(Base):
    """Handle the part.

    Args:
        item: one
    Returns:
        a list
    """

    def process_item(self, item, *rest, flag=False, **kw) -> List[int]:
        for part in item:
            while part:
                part -= @n@
        return [item]


def validate_@id@(value):
    value = value + @n@
    return value


if __name__ == "__main__":
    validate_@id@(@k@)
'''
_PY_NESTED = _PY + '''@cache
def compute_@id@(a, b):
    """:param a: first
    :return: sum
    """
    def inner_set(x):
        y = x + @n@
        return y
    return inner_set(a) + b
'''
_PY_LARGE = (
    _PY + "def long_@id@(a):\n" + "    a = a + 1\n" * 50 + "    return a\n\n"
    + "def many_@id@(a):\n" + "    a = 0 if a else 1\n" * 20 + "    return a\n\n"
    + "class @Id@Table:\n" + "    a = @n@\n" * 100
)
_PY_BROKEN = _PY + "def broken_@id@(:\n    return @n@\n"

_JS = _C + '''function get_@id@(x) {
  if (x) {
    return @n@;
  }
  return 0;
}
const make@Id@ = async (a) => {
  const y = @n@;
  return y;
}
class @Id@ extends Base {
  size() {
    return @n@;
  }
}
function deep(x) {
  if (x) {
    while (x) { x -= { n: @k@ }; }
  }
}
function short() { return 1; }
const api = {
  load@Id@: async function (x) {
    return x;
  },
}
'''
_TS = _C + '''export class @Id@Store {
\tconst a = @n@;
\tget size() {
\t\treturn this.a;
\t}
}
function test(a: number) {
\treturn a +
\t\t@n@;
}
'''
_JAVA = _C + '''public class @Id@ extends Base implements A, B {
  public @Id@(int a) {
    this.a = a;
    this.b = a;
  }
  public static int get@Id@(int a) throws X, Y {
    int b = a;
    return b + @n@;
  }
}
'''
_CPP = _C + '''inline int get_@id@(int a) {
  int b = a;
  return b + @n@;
}
class @Id@ : public Base {
  int a;
  int b;
  int c;
  int d;
};
'''
_HEADER = _C + '''static char* name_@id@(int a) const {
  if (a) {
    return names[@k@];
  }
  else if (b) {
    int c = a;
    return c;
  }
}
'''
_GO = _C + '''func (r T) Get@Id@(a int) int {
\tb := a
\treturn b + @n@
}
type @Id@ struct {
\tA int
\tB int
}
func pointer(a int) *T {
\tb := a
\treturn b
}
'''
_RUST = _C + '''pub fn get_@id@<T>(a: T) -> i32 {
    let b = @n@;
    b
}
pub struct @Id@<T> {
    a: T,
    b: i32,
}
'''

# stem, extension, text
TEMPLATES = (
    ("f", ".py", _PY_FUNCTION), ("m", ".py", _PY_MANAGER), ("u", ".py", _PY_MODULE),
    ("s", ".py", _PY_NESTED), ("l", ".py", _PY_LARGE), ("b", ".py", _PY_BROKEN),
    ("f", ".js", _JS), ("t", ".ts", _TS), ("f", ".java", _JAVA), ("f", ".cpp", _CPP),
    ("h", ".h", _HEADER), ("f", ".go", _GO), ("f", ".rs", _RUST),
)

# What the Python templates contain, worked out by hand:
# stem, kind, seq, name, code, docstring, arguments, methods, other method names
_DOC_F = "Return the size of the part. More text."
_DOC_U = "Handle the part.\n\nArgs:\n    item: one\nReturns:\n    a list"
_DOC_S = ":param a: first\n:return: sum"
PYTHON_UNITS = (
    ("f", "python_function", 2, "get_@id@",
     'def get_@id@(a, b: int):\n    """Return the size of the part. More text."""\n'
     "    if a:\n        return @n@\n    return b",
     _DOC_F, 2, None, None),
    ("m", "python_class", 2, "@Id@Manager",
     "class @Id@Manager:\n    size = @n@\n\n    def __init__(self):\n        self.x = @n@",
     None, None, 1, ""),
    ("u", "python_class", 14, "@Id@Handler",
     'class @Id@Handler(Base):\n    """Handle the part.\n\n    Args:\n        item: one\n'
     '    Returns:\n        a list\n    """\n\n'
     "    def process_item(self, item, *rest, flag=False, **kw) -> List[int]:\n"
     "        for part in item:\n            while part:\n                part -= @n@\n"
     "        return [item]",
     _DOC_U, None, 1, "process_item"),
    ("u", "python_function", 16, "validate_@id@",
     "def validate_@id@(value):\n    value = value + @n@\n    return value",
     None, 1, None, None),
    ("u", "python_function", 22, "process_item",
     "def process_item(self, item, *rest, flag=False, **kw) -> List[int]:\n"
     "    for part in item:\n        while part:\n            part -= @n@\n    return [item]",
     None, 2, None, None),
    ("s", "python_function", 2, "compute_@id@",
     '@cache\ndef compute_@id@(a, b):\n    """:param a: first\n    :return: sum\n    """\n\n'
     "    def inner_set(x):\n        y = x + @n@\n        return y\n    return inner_set(a) + b",
     _DOC_S, 2, None, None),
    ("s", "python_function", 6, "inner_set",
     "def inner_set(x):\n    y = x + @n@\n    return y", None, 1, None, None),
)
# stem, category, name, position
PYTHON_NAMES = (
    ("f", "functions", "get_@id@", 1), ("f", "variables", "x", 6),
    ("m", "classes", "@Id@Manager", 1), ("m", "variables", "size", 2),
    ("m", "functions", "__init__", 3),
    ("u", "variables", "MAX_SIZE", 5), ("u", "variables", "default_size", 6),
    ("u", "classes", "@Id@Handler", 7), ("u", "functions", "validate_@id@", 8),
    ("u", "functions", "process_item", 11), ("u", "variables", "value", 12),
    ("s", "functions", "compute_@id@", 1), ("s", "functions", "inner_set", 3),
    ("s", "variables", "y", 5),
    ("l", "functions", "long_@id@", 1), ("l", "functions", "many_@id@", 2),
    ("l", "classes", "@Id@Table", 3),
) + tuple(("l", "variables", "a", 4 + i) for i in range(170))
PYTHON_DOCSTRINGS = (("f", _DOC_F, 1), ("u", _DOC_U, 7), ("s", _DOC_S, 1))
PYTHON_IMPORTS = (
    ("u", ("import os", "import sys", "import json", "from typing import List, Dict",
           "from  import helpers")),
)
PYTHON_ORGANIZATION = (("u", True, True),)  # stem, imports first, main at end

REPO = "CASE WHEN p_partkey % 3 = 0 THEN 'mono' ELSE 'r' || CAST(p_partkey {div} 8 AS {text}) END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table that was read in fewer splits than there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """Narrow rows whose work comes later, dealt evenly and in whole rounds of all cores.

    Splits say little about where rows are: all rows of a row group come from one split of its file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * max(3, -(-df.rdd.getNumPartitions() // cores)))


def _fill(text, id_, cap, n, k):
    out = F.replace(text, F.lit("@id@"), id_)
    out = F.replace(out, F.lit("@Id@"), cap)
    out = F.replace(out, F.lit("@n@"), n)
    return F.replace(out, F.lit("@k@"), k)


def code_files(spark: SparkSession, sf_dir: str, *extensions: str) -> DataFrame:
    """`repo, path, size, content`; only some extensions if any are named."""
    wanted = [t for t in TEMPLATES if not extensions or t[1] in extensions]
    templates = F.array(*[
        F.struct(F.lit(s).alias("stem"), F.lit(e).alias("ext"), F.lit(t).alias("text"))
        for s, e, t in wanted
    ])
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")).select(
        F.expr(REPO.format(div="div", text="string")).alias("repo"),
        F.col("p_partkey").cast("string").alias("k"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("id"),
        F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")).alias("cap"),
        F.col("p_size").cast("string").alias("n"),
        F.explode(templates).alias("t"),
    )
    content = _fill(F.col("t.text"), *[F.col(c) for c in ("id", "cap", "n", "k")])
    return parts.select(
        "repo",
        F.concat("repo", F.lit("/src/"), "t.stem", "k", "t.ext").alias("path"),
        content.alias("content"),
    ).withColumn("size", F.octet_length("content").cast("bigint"))


# --- the same in DuckDB ------------------------------------------------------

def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _filled(expression: str) -> str:
    for token, column in (("@id@", "id"), ("@Id@", "cap"), ("@n@", "n"), ("@k@", "k")):
        expression = f"replace({expression}, '{token}', {column})"
    return expression


def _unnest(rows: list[str]) -> str:
    return "unnest([" + ", ".join(rows) + "])"


def _row(**values) -> str:
    return "{" + ", ".join(f"'{k}': {v}" for k, v in values.items()) + "}"


PARTS_CTE = f"""parts AS (
  SELECT {REPO.format(div="//", text="VARCHAR")} AS repo, CAST(p_partkey AS VARCHAR) AS k,
         replace(p_name, ' ', '_') AS id,
         array_to_string(list_transform(string_split(p_name, ' '),
           lambda w: upper(w[1]) || lower(w[2:])), '') AS cap,
         CAST(p_size AS VARCHAR) AS n
  FROM part)"""

_RANKS = {".py": 0, ".js": 1, ".ts": 2, ".java": 3, ".cpp": 4, ".h": 6, ".go": 8, ".rs": 9}
_LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "javascript", ".java": "java",
              ".cpp": "cpp", ".h": "cpp", ".go": "go", ".rs": "rust"}


def files_cte(*extensions: str) -> str:
    rows = [
        _row(stem=q(s), ext=q(e), rank=_RANKS[e], language=q(_LANGUAGES[e]), body=q(t))
        for s, e, t in TEMPLATES if not extensions or e in extensions
    ]
    return f"""{PARTS_CTE}, code_files AS (
  SELECT repo, repo || '/src/' || t.stem || k || t.ext AS path, t.stem || k || t.ext AS name,
         t.stem AS stem, t.ext AS ext, t.rank AS ext_rank, t.language AS language,
         {_filled('t.body')} AS content, id, cap, n, k
  FROM (SELECT *, {_unnest(rows)} AS t FROM parts))"""


def python_units_cte() -> str:
    """`py_units`: what the Python files hold, from the hand-made table."""
    rows = [
        _row(stem=q(stem), kind=q(kind), seq=seq, name=q(name), code=q(code), doc=q(doc),
             args="NULL::INTEGER" if a is None else a,
             methods="NULL::INTEGER" if m is None else m, others=q(others))
        for stem, kind, seq, name, code, doc, a, m, others in PYTHON_UNITS
    ]
    return f"""{PARTS_CTE}, py_units AS (
  SELECT repo, repo || '/src/' || u.stem || k || '.py' AS path, u.stem || k || '.py' AS file,
         u.kind AS kind, u.seq AS seq, {_filled('u.name')} AS name, {_filled('u.code')} AS code,
         u.doc AS doc, u.args AS args, u.methods AS methods, u.others AS others
  FROM (SELECT *, {_unnest(rows)} AS u FROM parts))"""


def python_names_cte() -> str:
    rows = [_row(stem=q(s), category=q(c), name=q(n), pos=p) for s, c, n, p in PYTHON_NAMES]
    return f"""py_names AS (
  SELECT repo, repo || '/src/' || u.stem || k || '.py' AS path, u.category AS category,
         {_filled('u.name')} AS name, u.pos AS pos
  FROM (SELECT *, {_unnest(rows)} AS u FROM parts))"""


def python_docstrings_cte() -> str:
    rows = [_row(stem=q(s), doc=q(d), pos=p) for s, d, p in PYTHON_DOCSTRINGS]
    return f"""py_docs AS (
  SELECT repo, repo || '/src/' || u.stem || k || '.py' AS path, u.doc AS doc, u.pos AS pos
  FROM (SELECT *, {_unnest(rows)} AS u FROM parts))"""


def python_imports_cte() -> str:
    rows = [_row(stem=q(s), imports="[" + ", ".join(q(i) for i in imps) + "]")
            for s, imps in PYTHON_IMPORTS]
    return f"""py_imports AS (
  SELECT repo, repo || '/src/' || u.stem || k || '.py' AS path, u.imports AS imports
  FROM (SELECT *, {_unnest(rows)} AS u FROM parts))"""
