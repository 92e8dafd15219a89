"""Python statements written back as code: what `ast.unparse` gives, several times as fast.

Expressions are built as strings and statements as lines. What is rare (patterns, type parameters, deep nesting) is left to
`ast.unparse`, and so is everything on versions of Python that write code differently.
"""

from __future__ import annotations

import ast
import sys
from collections.abc import Callable

# versions whose `ast.unparse` this module has been compared with
_SAME_AS = ((3, 13),)

# how tightly an expression binds, as in the grammar
(_NAMED, _TUPLE, _YIELD, _TEST, _OR, _AND, _NOT, _CMP, _BOR, _BXOR, _BAND, _SHIFT, _ARITH, _TERM, _FACTOR, _POWER, _AWAIT,
 _ATOM) = range(18)
_EXPR = _BOR

# deeper code is left to `ast.unparse`, which alone decides what is too deep
_ROOM = 60

_BINARY = {
    ast.Add: (" + ", _ARITH), ast.Sub: (" - ", _ARITH), ast.Mult: (" * ", _TERM), ast.MatMult: (" @ ", _TERM),
    ast.Div: (" / ", _TERM), ast.Mod: (" % ", _TERM), ast.LShift: (" << ", _SHIFT), ast.RShift: (" >> ", _SHIFT),
    ast.BitOr: (" | ", _BOR), ast.BitXor: (" ^ ", _BXOR), ast.BitAnd: (" & ", _BAND), ast.FloorDiv: (" // ", _TERM),
    ast.Pow: (" ** ", _POWER),
}
_UNARY = {ast.Invert: ("~", _FACTOR), ast.Not: ("not ", _NOT), ast.UAdd: ("+", _FACTOR), ast.USub: ("-", _FACTOR)}
_COMPARE = {
    ast.Eq: " == ", ast.NotEq: " != ", ast.Lt: " < ", ast.LtE: " <= ", ast.Gt: " > ", ast.GtE: " >= ", ast.Is: " is ",
    ast.IsNot: " is not ", ast.In: " in ", ast.NotIn: " not in ",
}


class _Rare(Exception):
    """Something that is left to `ast.unparse`."""


def written(node: ast.stmt) -> str:
    """The code of a statement, as `ast.unparse` writes it."""
    if sys.version_info[:2] in _SAME_AS:
        try:
            lines: list[str] = []
            _statement(node, "", lines, _ROOM)
            return "\n".join(lines)
        except Exception:  # `ast.unparse` has its own problem with what is wrong
            pass
    return ast.unparse(node)


# --- expressions ---------------------------------------------------------------


def _expression(node: ast.expr, around: int, room: int) -> str:
    """An expression, in parentheses if `around` binds more tightly."""
    kind = type(node)
    if kind is ast.Name:
        return node.id
    write = _EXPRESSIONS.get(kind)
    if write is None or not room:
        raise _Rare
    return write(node, around, room - 1)


def _enclosed(text: str, own: int, around: int) -> str:
    return f"({text})" if around > own else text


def _listed(nodes: list[ast.expr], room: int) -> str:
    return ", ".join([_expression(n, _TEST, room) for n in nodes])


def _items(nodes: list[ast.expr], room: int) -> str:
    """The inside of a tuple."""
    return _expression(nodes[0], _TEST, room) + "," if len(nodes) == 1 else _listed(nodes, room)


def _constant(node, around, room):
    value = node.value
    kind = type(value)
    if kind is str or kind is int or value is None or kind is bool or kind is bytes:
        return "u" + repr(value) if node.kind == "u" else repr(value)
    if value is ...:
        return "..."
    if kind is float or kind is complex:
        text = repr(value)
        if "inf" not in text and "nan" not in text:
            return text
    raise _Rare


def _attribute(node, around, room):
    value = node.value
    text = _expression(value, _ATOM, room)
    if type(value) is ast.Constant and isinstance(value.value, int):
        text += " "
    return f"{text}.{node.attr}"


def _keywords(nodes: list[ast.keyword], room: int) -> list[str]:
    return [("**" if k.arg is None else k.arg + "=") + _expression(k.value, _TEST, room) for k in nodes]


def _arguments_of_call(args: list[ast.expr], keywords: list[ast.keyword], room: int) -> str:
    return ", ".join([_expression(a, _TEST, room) for a in args] + _keywords(keywords, room))


def _call(node, around, room):
    return f"{_expression(node.func, _ATOM, room)}({_arguments_of_call(node.args, node.keywords, room)})"


def _subscript(node, around, room):
    place = node.slice
    if type(place) is ast.Tuple and place.elts:
        inside = _items(place.elts, room)
    else:
        inside = _expression(place, _TEST, room)
    return f"{_expression(node.value, _ATOM, room)}[{inside}]"


def _slice(node, around, room):
    text = (_expression(node.lower, _TEST, room) if node.lower else "") + ":"
    if node.upper:
        text += _expression(node.upper, _TEST, room)
    return f"{text}:{_expression(node.step, _TEST, room)}" if node.step else text


def _binary(node, around, room):
    sign, own = _BINARY[type(node.op)]
    left, right = (own + 1, own) if own == _POWER else (own, own + 1)
    text = _expression(node.left, left, room) + sign + _expression(node.right, right, room)
    return f"({text})" if around > own else text


def _unary(node, around, room):
    sign, own = _UNARY[type(node.op)]
    return _enclosed(sign + _expression(node.operand, own, room), own, around)


def _boolean(node, around, room):
    sign, own = (" and ", _AND) if type(node.op) is ast.And else (" or ", _OR)
    # each further value is asked to bind more tightly than the one before; there is nothing above an atom
    parts = [_expression(v, min(own + i, _ATOM), room) for i, v in enumerate(node.values, 1)]
    # the parentheses are decided before the values are written
    return _enclosed(sign.join(parts), own, around)


def _compare(node, around, room):
    text = _expression(node.left, _CMP + 1, room)
    for op, value in zip(node.ops, node.comparators):
        text += _COMPARE[type(op)] + _expression(value, _CMP + 1, room)
    return _enclosed(text, _CMP, around)


def _tuple(node, around, room):
    if not node.elts:
        return "()"
    text = _items(node.elts, room)
    return f"({text})" if around > _TUPLE else text


def _list(node, around, room):
    return f"[{_listed(node.elts, room)}]"


def _set(node, around, room):
    return f"{{{_listed(node.elts, room)}}}" if node.elts else "{*()}"


def _dict(node, around, room):
    return "{" + ", ".join([
        f"{_expression(k, _TEST, room)}: {_expression(v, _TEST, room)}" if k is not None else "**" + _expression(v, _EXPR, room)
        for k, v in zip(node.keys, node.values)
    ]) + "}"


def _starred(node, around, room):
    return "*" + _expression(node.value, _EXPR, room)


def _conditional(node, around, room):
    body, test = _expression(node.body, _TEST + 1, room), _expression(node.test, _TEST + 1, room)
    return _enclosed(f"{body} if {test} else {_expression(node.orelse, _TEST, room)}", _TEST, around)


def _named(node, around, room):
    return _enclosed(f"{_expression(node.target, _ATOM, room)} := {_expression(node.value, _ATOM, room)}", _NAMED, around)


def _lambda(node, around, room):
    args = _parameters(node.args, room)
    return _enclosed(f"lambda{' ' + args if args else ''}: {_expression(node.body, _TEST, room)}", _TEST, around)


def _await(node, around, room):
    return _enclosed("await " + _expression(node.value, _ATOM, room), _AWAIT, around)


def _yield(node, around, room):
    return _enclosed("yield " + _expression(node.value, _ATOM, room) if node.value else "yield", _YIELD, around)


def _yield_from(node, around, room):
    return _enclosed("yield from " + _expression(node.value, _ATOM, room), _YIELD, around)


def _loops(generators: list[ast.comprehension], room: int) -> str:
    return "".join([
        (" async for " if g.is_async else " for ") + _expression(g.target, _TUPLE, room)
        + " in " + _expression(g.iter, _TEST + 1, room)
        + "".join([" if " + _expression(i, _TEST + 1, room) for i in g.ifs])
        for g in generators
    ])


def _comprehension(start: str, end: str) -> Callable:
    return lambda node, around, room: start + _expression(node.elt, _TEST, room) + _loops(node.generators, room) + end


def _dict_comprehension(node, around, room):
    pair = f"{_expression(node.key, _TEST, room)}: {_expression(node.value, _TEST, room)}"
    return f"{{{pair}{_loops(node.generators, room)}}}"


def _joined(node, around, room):
    return ast.unparse(node)  # never depends on what is around it


_EXPRESSIONS = {
    ast.Constant: _constant, ast.Attribute: _attribute, ast.Call: _call, ast.Subscript: _subscript, ast.Slice: _slice,
    ast.BinOp: _binary, ast.UnaryOp: _unary, ast.BoolOp: _boolean, ast.Compare: _compare, ast.Tuple: _tuple, ast.List: _list,
    ast.Set: _set, ast.Dict: _dict, ast.Starred: _starred, ast.IfExp: _conditional, ast.NamedExpr: _named,
    ast.Lambda: _lambda, ast.Await: _await, ast.Yield: _yield, ast.YieldFrom: _yield_from,
    ast.ListComp: _comprehension("[", "]"), ast.SetComp: _comprehension("{", "}"),
    ast.GeneratorExp: _comprehension("(", ")"), ast.DictComp: _dict_comprehension, ast.JoinedStr: _joined,
}


# --- statements ----------------------------------------------------------------


def _parameter(node: ast.arg, room: int) -> str:
    return f"{node.arg}: {_expression(node.annotation, _TEST, room)}" if node.annotation else node.arg


def _parameters(node: ast.arguments, room: int) -> str:
    plain = node.posonlyargs + node.args
    parts = [_parameter(a, room) for a in plain]
    for i, default in enumerate(node.defaults, len(plain) - len(node.defaults)):
        parts[i] += "=" + _expression(default, _TEST, room)
    if node.posonlyargs:
        parts[len(node.posonlyargs) - 1] += ", /"
    if node.vararg or node.kwonlyargs:
        parts.append("*" + (_parameter(node.vararg, room) if node.vararg else ""))
    for a, default in zip(node.kwonlyargs, node.kw_defaults):
        parts.append(_parameter(a, room) + ("=" + _expression(default, _TEST, room) if default else ""))
    if node.kwarg:
        parts.append("**" + _parameter(node.kwarg, room))
    return ", ".join(parts)


def _docstring(node: ast.Constant) -> str:
    text = node.value
    if node.kind != "u" and '"' not in text and "\\" not in text and text.replace("\n", "").replace("\t", "").isprintable():
        return f'"""{text}"""'
    # a docstring of a module is written alike, and without indentation
    return ast.unparse(ast.Module([ast.Expr(node)], []))


def _block(body: list[ast.stmt], indent: str, lines: list[str], room: int) -> None:
    if not room:
        raise _Rare
    for node in body:
        _statement(node, indent, lines, room - 1)


def _documented_block(body: list[ast.stmt], indent: str, lines: list[str], room: int) -> None:
    if body and type(body[0]) is ast.Expr:
        value = body[0].value
        if type(value) is ast.Constant and isinstance(value.value, str):
            lines.append(indent + _docstring(value))
            body = body[1:]
    _block(body, indent, lines, room)


def _decorated(node, indent, lines, room) -> None:
    if node.type_params:
        raise _Rare
    if lines:
        lines.append("")
    lines += [f"{indent}@{_expression(d, _TEST, room)}" for d in node.decorator_list]


def _function(node, indent, lines, room):
    _decorated(node, indent, lines, room)
    word = "def" if type(node) is ast.FunctionDef else "async def"
    returns = " -> " + _expression(node.returns, _TEST, room) if node.returns else ""
    lines.append(f"{indent}{word} {node.name}({_parameters(node.args, room)}){returns}:")
    _documented_block(node.body, indent + "    ", lines, room)


def _class(node, indent, lines, room):
    _decorated(node, indent, lines, room)
    bases = f"({_arguments_of_call(node.bases, node.keywords, room)})" if node.bases or node.keywords else ""
    lines.append(f"{indent}class {node.name}{bases}:")
    _documented_block(node.body, indent + "    ", lines, room)


def _assign(node, indent, lines, room):
    text = indent
    for target in node.targets:
        text += _expression(target, _TUPLE, room) + " = "
    lines.append(text + _expression(node.value, _TEST, room))


def _augmented(node, indent, lines, room):
    sign = _BINARY[type(node.op)][0].rstrip()
    lines.append(f"{indent}{_expression(node.target, _TEST, room)}{sign}= {_expression(node.value, _TEST, room)}")


def _annotated(node, indent, lines, room):
    target = _expression(node.target, _TEST, room)
    if not node.simple and type(node.target) is ast.Name:
        target = f"({target})"
    value = " = " + _expression(node.value, _TEST, room) if node.value else ""
    lines.append(f"{indent}{target}: {_expression(node.annotation, _TEST, room)}{value}")


def _simple(node, indent, lines, room):
    lines.append(indent + _expression(node.value, _YIELD, room))


def _return(node, indent, lines, room):
    lines.append(f"{indent}return {_expression(node.value, _TEST, room)}" if node.value else indent + "return")


def _word(word: str) -> Callable:
    return lambda node, indent, lines, room: lines.append(indent + word)


def _delete(node, indent, lines, room):
    lines.append(f"{indent}del {_listed(node.targets, room)}")


def _assert(node, indent, lines, room):
    message = ", " + _expression(node.msg, _TEST, room) if node.msg else ""
    lines.append(f"{indent}assert {_expression(node.test, _TEST, room)}{message}")


def _scope(word: str) -> Callable:
    return lambda node, indent, lines, room: lines.append(f"{indent}{word} {', '.join(node.names)}")


def _raise(node, indent, lines, room):
    text = f"{indent}raise {_expression(node.exc, _TEST, room)}" if node.exc else indent + "raise"
    lines.append(f"{text} from {_expression(node.cause, _TEST, room)}" if node.cause else text)


def _aliases(names: list[ast.alias]) -> str:
    return ", ".join([f"{a.name} as {a.asname}" if a.asname else a.name for a in names])


def _import(node, indent, lines, room):
    lines.append(f"{indent}import {_aliases(node.names)}")


def _import_from(node, indent, lines, room):
    lines.append(f"{indent}from {'.' * (node.level or 0)}{node.module or ''} import {_aliases(node.names)}")


def _else(body: list[ast.stmt], indent: str, lines: list[str], room: int, word: str = "else:") -> None:
    if body:
        lines.append(indent + word)
        _block(body, indent + "    ", lines, room)


def _if(node, indent, lines, room):
    word = "if"
    while True:
        lines.append(f"{indent}{word} {_expression(node.test, _TEST, room)}:")
        _block(node.body, indent + "    ", lines, room)
        if len(node.orelse) != 1 or type(node.orelse[0]) is not ast.If:
            break
        node, word = node.orelse[0], "elif"
    _else(node.orelse, indent, lines, room)


def _while(node, indent, lines, room):
    lines.append(f"{indent}while {_expression(node.test, _TEST, room)}:")
    _block(node.body, indent + "    ", lines, room)
    _else(node.orelse, indent, lines, room)


def _for(node, indent, lines, room):
    word = "for" if type(node) is ast.For else "async for"
    lines.append(f"{indent}{word} {_expression(node.target, _TUPLE, room)} in {_expression(node.iter, _TEST, room)}:")
    _block(node.body, indent + "    ", lines, room)
    _else(node.orelse, indent, lines, room)


def _with(node, indent, lines, room):
    word = "with" if type(node) is ast.With else "async with"
    items = [
        _expression(i.context_expr, _TEST, room) + (" as " + _expression(i.optional_vars, _TEST, room) if i.optional_vars else "")
        for i in node.items
    ]
    lines.append(f"{indent}{word} {', '.join(items)}:")
    _block(node.body, indent + "    ", lines, room)


def _try(node, indent, lines, room):
    word = "except" if type(node) is ast.Try else "except*"
    lines.append(indent + "try:")
    _block(node.body, indent + "    ", lines, room)
    for h in node.handlers:
        caught = " " + _expression(h.type, _TEST, room) if h.type else ""
        lines.append(f"{indent}{word}{caught}{' as ' + h.name if h.name else ''}:")
        _block(h.body, indent + "    ", lines, room)
    _else(node.orelse, indent, lines, room)
    _else(node.finalbody, indent, lines, room, "finally:")


_STATEMENTS = {
    ast.FunctionDef: _function, ast.AsyncFunctionDef: _function, ast.ClassDef: _class, ast.Assign: _assign,
    ast.AugAssign: _augmented, ast.AnnAssign: _annotated, ast.Expr: _simple, ast.Return: _return, ast.Pass: _word("pass"),
    ast.Break: _word("break"), ast.Continue: _word("continue"), ast.Delete: _delete, ast.Assert: _assert,
    ast.Global: _scope("global"), ast.Nonlocal: _scope("nonlocal"), ast.Raise: _raise, ast.Import: _import,
    ast.ImportFrom: _import_from, ast.If: _if, ast.While: _while, ast.For: _for, ast.AsyncFor: _for, ast.With: _with,
    ast.AsyncWith: _with, ast.Try: _try, ast.TryStar: _try,
}


def _statement(node: ast.stmt, indent: str, lines: list[str], room: int) -> None:
    write = _STATEMENTS.get(type(node))
    if write is None:
        raise _Rare
    write(node, indent, lines, room)
