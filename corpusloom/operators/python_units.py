"""Python code: the grammar is the interpreter's own, run in Arrow batches.

Two helpers look at one file's text.  Everything that can be said with column
expressions (line limits, complexity, naming, instructions) is left to Spark,
but for lines: measuring them one by one as rows costs many times as much as a
loop next to the parser, so the second helper counts those of all languages.
"""

from __future__ import annotations

import ast
import functools
import sys
import warnings

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from corpusloom import constants as K
from corpusloom.functions import python_source
from corpusloom.functions.python_source import written
from corpusloom.functions.text import WHITESPACE

UNITS = (
    "array<struct<kind:string,seq:bigint,name:string,code:string,docstring:string,"
    "arg_count:int,method_count:int,methods:array<string>,error:string>>"
)
FACTS = (
    "struct<names:array<struct<category:string,name:string,pos:bigint,n:bigint>>,"
    "docstrings:array<struct<text:string,pos:bigint>>,"
    "imports:array<string>,imports_first:boolean,"
    "lines:struct<pos:bigint,n:bigint,total_length:bigint,over_80:bigint,over_100:bigint>,"
    "indentation:array<struct<value:string,pos:bigint,n:bigint>>>"
)

_UNITS_ARROW = pa.list_(pa.struct([
    ("kind", pa.string()), ("seq", pa.int64()), ("name", pa.string()), ("code", pa.string()),
    ("docstring", pa.string()), ("arg_count", pa.int32()), ("method_count", pa.int32()),
    ("methods", pa.list_(pa.string())), ("error", pa.string()),
]))
_FACTS_ARROW = pa.struct([
    ("names", pa.list_(pa.struct([
        ("category", pa.string()), ("name", pa.string()), ("pos", pa.int64()), ("n", pa.int64())]))),
    ("docstrings", pa.list_(pa.struct([("text", pa.string()), ("pos", pa.int64())]))),
    ("imports", pa.list_(pa.string())), ("imports_first", pa.bool_()),
    ("lines", pa.struct([(c, pa.int64()) for c in ("pos", "n", "total_length", "over_80", "over_100")])),
    ("indentation", pa.list_(pa.struct([("value", pa.string()), ("pos", pa.int64()), ("n", pa.int64())]))),
])


def _quiet(of_batch):
    """What the parser remarks about texts is nobody's concern; saying so once for a batch is enough."""
    @functools.wraps(of_batch)
    def run(*columns: pa.Array) -> pa.Array:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return of_batch(*columns)

    return run


def _error(kind: str, seq: int, name: str | None, problem: Exception) -> dict:
    return {"kind": kind, "seq": seq, "name": name, "error": type(problem).__name__}


# fields of a node that hold statements, or what holds them
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")

# the same by type of node, for the few types that have any
_BLOCKS_OF = {
    kind: held for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.AST)
    and (held := tuple(b for b in _BLOCKS if b in kind._fields))
}

_KINDS = {ast.FunctionDef: "python_function", ast.ClassDef: "python_class"}

# units with more lines than this are not kept; see `constants`
_LINE_LIMIT = {
    "python_function": K.MAX_PYTHON_FUNCTION_LINES, "python_class": K.MAX_UNIT_LINES,
}


def _statements(root: ast.AST) -> tuple[list[ast.AST], list[tuple[int, int, int]]]:
    """The statements below a node, breadth first, the node itself first; and (place, begin, end) of each that holds
    others: those it holds directly are side by side.

    Functions, classes, assignments and imports are statements, so there is no
    need to look at expressions, which are most of a tree.
    """
    nodes, held = [root], []
    for i, node in enumerate(nodes):  # grows while it is read
        if blocks := _BLOCKS_OF.get(type(node)):
            begin = len(nodes)
            for block in blocks:
                nodes += getattr(node, block)
            held.append((i, begin, len(nodes)))
    return nodes, held


def _surely_too_long(nodes: list[ast.AST], held: list[tuple[int, int, int]]) -> set[int]:
    """Places of the units that have more statements than lines are kept.

    Every statement takes a line of its own when code is written back, so
    counting statements saves writing back most of the units that are too long."""
    if len(nodes) <= min(_LINE_LIMIT.values()):
        return set()
    counts = [1] * len(nodes)
    for i, begin, end in reversed(held):
        counts[i] = sum(counts[begin:end]) + isinstance(nodes[i], ast.stmt)
    return {i for i, _, _ in held if (kind := _KINDS.get(type(nodes[i]))) and counts[i] > _LINE_LIMIT[kind]}


def _unit(kind: str, seq: int, node) -> dict:
    unit = {
        "kind": kind, "seq": seq, "name": node.name,
        "code": written(node), "docstring": ast.get_docstring(node),
    }
    if kind == "python_function":
        unit["arg_count"] = len(node.args.args)
    else:
        methods = [n.name for n in node.body if isinstance(n, ast.FunctionDef)]
        unit["method_count"] = len(methods)
        unit["methods"] = [m for m in methods if not m.startswith("__")]
    return unit


def units_of(text: str) -> list[dict]:
    """Functions and classes of one file, breadth first; `async def` is not one."""
    try:
        tree = ast.parse(text)
    except Exception as problem:
        return [_error("file", 0, None, problem)]
    found = []
    nodes, held = _statements(tree)
    too_long = _surely_too_long(nodes, held)
    for i, node in enumerate(nodes):
        kind = _KINDS.get(type(node))
        if kind is None or i in too_long:
            continue
        try:
            found.append(_unit(kind, 2 * i, node))
        except Exception as problem:
            found.append(_error(kind, 2 * i, node.name, problem))
    return found


def facts_of(text: str) -> dict | None:
    """Style facts of one file; NULL when it does not parse.

    A name that a file gives more than once is one entry, with its first place and its number."""
    try:
        tree = ast.parse(text)
        names, docstrings, imports = [], [], []
        defined = {ast.FunctionDef: ("functions", {}), ast.ClassDef: ("classes", {})}
        variables: dict[str, dict] = {}
        for pos, node in enumerate(_statements(tree)[0]):
            kind = type(node)
            if kind is ast.Assign:
                for target in node.targets:
                    if type(target) is ast.Name:
                        if known := variables.get(target.id):
                            known["n"] += 1
                        else:
                            variables[target.id] = known = {"category": "variables", "name": target.id, "pos": pos, "n": 1}
                            names.append(known)
            elif kind in defined:
                category, seen = defined[kind]
                if known := seen.get(node.name):
                    known["n"] += 1
                else:
                    seen[node.name] = known = {"category": category, "name": node.name, "pos": pos, "n": 1}
                    names.append(known)
                if doc := ast.get_docstring(node):
                    docstrings.append({"text": doc, "pos": pos})
            elif kind is ast.Import:
                imports += [f"import {a.name}" for a in node.names]
            elif kind is ast.ImportFrom:
                listed = ", ".join(a.name for a in node.names)
                imports.append(f"from {node.module or ''} import {listed}")
        is_import = [isinstance(n, (ast.Import, ast.ImportFrom)) for n in tree.body]
        return {
            "names": names, "docstrings": docstrings, "imports": imports,
            "imports_first": all(is_import) or is_import[0],
        }
    except Exception:
        return None


def lines_of(text: str) -> dict:
    """Lengths and indentation of the lines that are not blank, counted.

    `pos` is where a file has a value first: the line's number, or for indentation twice that, and one more for its width."""
    first, n, total, over_80, over_100 = 0, 0, 0, 0, 0
    widths: dict[int, list[int]] = {}
    tabs = None
    for i, line in enumerate(text.split("\n")):
        body = line.lstrip(WHITESPACE)
        if not body:
            continue
        lead = len(line) - len(body)
        length = lead + len(body.rstrip(WHITESPACE))
        first = first if n else i
        n += 1
        total += length
        if length > 80:
            over_80 += 1
            over_100 += length > 100
        if not lead:
            continue
        if line[0] == "\t":
            if tabs is None:
                tabs = {"value": "tabs", "pos": 2 * i, "n": 0}
            tabs["n"] += 1
        elif lead in widths:
            widths[lead][1] += 1
        else:
            widths[lead] = [i, 1]
    indentation = [{"value": f"{w}_spaces", "pos": 2 * i + 1, "n": many} for w, (i, many) in widths.items()]
    if widths:
        indentation.append({"value": "spaces", "pos": 2 * min(i for i, _ in widths.values()),
                            "n": sum(many for _, many in widths.values())})
    if tabs:
        indentation.append(tabs)
    lines = {"pos": first, "n": n, "total_length": total, "over_80": over_80, "over_100": over_100} if n else None
    return {"lines": lines, "indentation": indentation}


def _measured(text: str | None, parsed: bool | None) -> dict | None:
    """Facts of one file: what its grammar tells if it is Python, and its lines. NULL for Python that does not parse."""
    if text is None:
        return None
    facts = facts_of(text) if parsed else {}
    return None if facts is None else facts | lines_of(text)


@_quiet
def _units_batch(content: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else units_of(t) for t in content.to_pylist()], _UNITS_ARROW
    )


@_quiet
def _facts_batch(content: pa.Array, parsed: pa.Array) -> pa.Array:
    return pa.array([_measured(t, p) for t, p in zip(content.to_pylist(), parsed.to_pylist())], _FACTS_ARROW)


def python_units(content: Column) -> Column:
    return F.arrow_udf(_units_batch, UNITS)(content)


def text_facts(content: Column, is_python: Column) -> Column:
    """Lines of a text, and what the grammar tells of it if it is Python; NULL for Python that does not parse."""
    return F.arrow_udf(_facts_batch, FACTS)(content, is_python)


# tasks receive these helpers by value: executors need no installed copy
cloudpickle.register_pickle_by_value(python_source)
cloudpickle.register_pickle_by_value(sys.modules[__name__])
