"""Arithmetic expressions over column names, compiled to Columns."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The functions of the language. ``round`` is to even, as Python's.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "max": F.greatest, "min": F.least, "round": lambda x, *n: F.bround(x.cast("double"), *(n or (F.lit(0),))), "sqrt": lambda x: F.sqrt(x), "log": lambda x: F.ln(x),
    "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan,
}


def _divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _floor_divide(a: Column, b: Column) -> Column:
    return F.floor(_divide(a, b)).cast("double")


OPERATORS: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a.cast("double") + b, ast.Sub: lambda a, b: a.cast("double") - b, ast.Mult: lambda a, b: a.cast("double") * b, ast.Div: _divide, ast.FloorDiv: _floor_divide,
    ast.Mod: lambda a, b: a.cast("double") - _floor_divide(a, b) * b, ast.Pow: lambda a, b: F.pow(a, b),
}


def compile_expression(text: str, columns: set[str] | list[str]) -> Column:
    """A Column for ``+ - * / // % **``, signs, and the functions above; names are columns. ``//`` and ``%`` floor, with the
    divisor's sign. Division by zero gives null. Anything else raises ValueError."""
    known = set(columns)

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            if node.id not in known:
                raise ValueError(f"no column {node.id!r}")
            return F.col(node.id)
        if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
            return OPERATORS[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            return build(node.operand) if isinstance(node.op, ast.UAdd) else -build(node.operand)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and not node.keywords:
            return FUNCTIONS[node.func.id](*[build(a) for a in node.args])
        raise ValueError(f"not allowed in an expression: {ast.dump(node)[:80]}")

    return build(ast.parse(text, mode="eval"))
