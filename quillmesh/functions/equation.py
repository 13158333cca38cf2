"""Scoring equations: text to a Column through a white-listed syntax tree, never through eval.

Allowed are numbers, feature names, ``+ - * / % ^ **``, comparisons and the
functions in FUNCTIONS. A name that the frame lacks makes the result null.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.numeric import known, sigmoid
from quillmesh.functions.text import column_name


class EquationError(ValueError):
    """The text is no equation of this language."""


def _domain(ok: Callable[[Column], Column], fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(ok(x), fn(x))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "logreg": sigmoid,
    "sigmoid": sigmoid,
    "exp": F.exp,
    "log": _domain(lambda x: x > 0, F.ln),
    "log1p": _domain(lambda x: x > -1, F.log1p),
    "sqrt": _domain(lambda x: x >= 0, F.sqrt),
    "tanh": F.tanh,
    "sin": F.sin,
    "cos": F.cos,
    "abs": F.abs,
    "min": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)),
    "max": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)),
    "where": lambda c, a, b: F.when(c, a).otherwise(b),
    "clip": lambda x, a, b: F.when(x.isNotNull() & a.isNotNull() & b.isNotNull(), F.least(F.greatest(x, a), b)),
}
FUNCTIONS |= {"minimum": FUNCTIONS["min"], "maximum": FUNCTIONS["max"]}
CONSTANTS = {"pi": math.pi, "e": math.e}
BINARY: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a, b),
    ast.Mod: lambda a, b: F.pmod(a, F.nullif(b, F.lit(0.0))),
    ast.Pow: F.pow,
}
COMPARE: dict[type, Callable[[Column, Column], Column]] = {
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}


def parse(equation: str) -> ast.expr:
    try:
        return ast.parse(equation.strip().replace("^", "**"), mode="eval").body
    except SyntaxError as e:
        raise EquationError(f"not an equation: {equation!r}") from e


def variables(equation: str) -> list[str]:
    """The feature names an equation refers to, in order."""
    tree = parse(equation)
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    names = sorted(((n.lineno, n.col_offset, n.id) for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called))
    return list(dict.fromkeys(n for _, _, n in names if n not in CONSTANTS))


def compile_equation(equation: str, columns: Iterable[str]) -> Column:
    """The equation over columns, found by their own or their sanitised names."""
    known_names: dict[str, str] = {}
    for c in columns:
        known_names.setdefault(column_name(c), c)
        known_names.setdefault(c.replace("_", ""), c)
    known_names |= {c: c for c in columns}

    def build(node: ast.expr) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id in CONSTANTS and node.id not in known_names:
                return F.lit(CONSTANTS[node.id])
            return known(F.col(f"`{known_names[node.id]}`")) if node.id in known_names else F.lit(None).cast("double")
        if isinstance(node, ast.BinOp) and type(node.op) in BINARY:
            return BINARY[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in COMPARE:
            return COMPARE[type(node.ops[0])](build(node.left), build(node.comparators[0]))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and not node.keywords:
            try:
                return FUNCTIONS[node.func.id](*map(build, node.args))
            except TypeError as e:
                raise EquationError(f"wrong number of arguments for {node.func.id}") from e
        raise EquationError(f"{ast.dump(node)[:80]} is not allowed")

    if not equation or not equation.strip():
        return F.lit(None).cast("double")
    return build(parse(equation)).cast("double")
