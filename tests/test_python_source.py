"""Python code written back, and lines counted next to the parser."""

import ast
import contextlib
import io

import pytest

from corpusloom.functions.python_source import written
from corpusloom.functions.text import WHITESPACE
from corpusloom.operators import python_units
from corpusloom.operators.files import select_files
from corpusloom.operators.style import count_all_facts, file_facts

SOURCES = [
    "def f(a, /, b: int=1, *c, d, e=2, **g) -> List[int]:\n  'doc'\n  return (a, b), *c\n",
    "def f(*, a): return lambda: (yield)\n",
    "def f(): x = 1,; return -x ** -2, (-x) ** 2, not (x and (y or z) and w), (a < b) < c, (a, b)[0], a[1:2, ::3], a[()]\n",
    "def f(): return (x if y else z) if (a if b else c) else (d if e else g), 1 .real, 1.5.real, 1e400, 2j, ..., b'x', u'y'\n",
    "def f():\n  (x) : int = 3\n  x.y: str\n  x += yield\n  del a, (b, c)\n  assert x, 'm'\n  global q, r\n  raise A from b\n",
    "async def f():\n  async with a as b, c: await (await d)\n  async for i, j in k: pass\n  else: return [x async for x, in y if z if w]\n",
    "def f():\n  try: pass\n  except (A, B) as e: raise\n  except: continue_()\n  else: x\n  finally: y\n  try: pass\n  except* A: pass\n",
    "def f():\n  if a: b\n  elif c: d\n  else:\n    if e: g\n    h\n  while (n := 3): break\n  else: print(*a, **b, c=d)\n",
    "@a.b(c)\n@d\nclass A(B, *C, metaclass=D, **E):\n  '''it's \"\"\"so\"\"\"\\\\ '''\n  def m(self):\n    '''\n    a\tb\n      c\"'''\n  class N: pass\n",
    "def f(): return {**a, 1: (b, c)}, {1, *a}, {*()}, {k: v for k, v in x}, {i for i in (yield)}, f'{a!r:>{w}} {{}}' 'b', {}\n",
    "def f[T: int, *U](x: T): pass\n",
    "def f(x):\n  match x:\n    case [1, *_] if y: pass\n    case {'a': b, **c} | A(d=1): pass\n",
    "def f():\n  import a.b as c, d\n  from . import e\n  from ..g import (h as i, j)\n  return a or b or (c or d), a @ b // (c % d), a << b | c ^ d & e\n",
    "def f(): return " + "(" * 90 + "1" + ",)" * 90 + "\n",
    "def f(): return " + " + ".join(["a"] * 400) + "\n",
]


@pytest.mark.parametrize("source", SOURCES)
def test_code_is_written_as_by_unparse(source):
    node = ast.parse(source).body[0]
    try:
        want = ast.unparse(node)
    except RecursionError:
        want = RecursionError
    try:
        got = written(node)
    except RecursionError:
        got = RecursionError
    assert got == want


def test_ordinary_units_do_not_need_unparse(monkeypatch):
    calls = []
    monkeypatch.setattr(python_units.ast, "unparse", lambda node: calls.append(node))
    found = python_units.units_of("class A(B):\n  '''Doc.'''\n  def m(self, a=1):\n    if a: return [a]\n    return self.x + a\n")
    assert [u["name"] for u in found] == ["A", "m"] and not calls
    assert found[1]["code"] == "def m(self, a=1):\n    if a:\n        return [a]\n    return self.x + a"


def test_units_of_too_many_statements_are_left_out():
    limit = python_units._LINE_LIMIT["python_function"]
    short, long = ("def {}():\n  try: pass\n  except E: pass\n" + "  a = 1; b = 2\n" * n for n in (1, limit))
    text = short.format("s") + long.format("l") + "class C:\n  x = 1\n" + "".join(f"  def m{i}(self): pass\n" for i in range(3))
    assert [u["name"] for u in python_units.units_of(text)] == ["s", "C", "m0", "m1", "m2"]


def _by_hand(text):
    """Facts of lines as rows: (category, value): [n, first place, total length, over 80, over 100]."""
    out = {}

    def add(key, pos, length=None):
        row = out.setdefault(key, [0, pos, None, 0, 0])
        row[0] += 1
        if length is not None:
            row[2:] = [(row[2] or 0) + length, row[3] + (length > 80), row[4] + (length > 100)]

    for i, line in enumerate(text.split("\n")):
        if length := len(line.rstrip(WHITESPACE)):
            lead = len(line) - len(line.lstrip(WHITESPACE))
            add(("lines", None), i, length)
            if lead:
                add(("indentation", "tabs" if line[0] == "\t" else "spaces"), 2 * i)
                if line[0] != "\t":
                    add(("indentation", f"{lead}_spaces"), 2 * i + 1)
    return out


TEXT = ("  a\n\n \t \n\tb  \n \u00a0c\u2003\n" + "x" * 81 + "\n    " + "y" * 101 + "\n  d\n" + "\u00e9" * 80 + "\n") * 40


def test_lines_are_counted_where_they_are_read(files):
    found = file_facts(select_files(files(("r/a.java", TEXT), ("r/b.js", TEXT)))).collect()
    for row in found:
        got = {(f.category, f.value): [f.n, f.pos, f.total_length, f.over_80 or 0, f.over_100 or 0] for f in row.facts}
        assert got == _by_hand(TEXT)
        assert len(row.facts) == len(got)  # an entry for each value, however many lines there are


def test_counting_all_facts_moves_no_row_per_file(files):
    counted = count_all_facts(file_facts(select_files(files(*[(f"r/{i}.java", TEXT) for i in range(5)]))))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        counted.explain()
    exchanges = [line for line in out.getvalue().splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "path" not in exchanges[0]
    rows = {(r.category, r.value): r for r in counted.collect()}
    for key, (n, pos, total, over_80, over_100) in _by_hand(TEXT).items():
        row = rows[key]
        assert (row.n, row.total_length, row.over_80, row.over_100) == (
            5 * n, total and 5 * total, 5 * over_80, 5 * over_100)
        assert (row.first_seq.path, row.first_seq.pos) == ("r/0.java", pos)
