"""Rule expressions: a small, closed language translated to Spark columns.

Names are looked up in a parameter map; ``==``, ``!=``, ``<``, ``<=``, ``>``, ``>=``,
``in``, ``not in``, ``and``, ``or``, ``not``, text and number literals and the listed
helpers are known.  Anything else is an error; nothing is ever evaluated as code.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

UNDEFINED = "UNDEFINED"


def value_of(params: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(params, F.lit(name)), F.lit(UNDEFINED))


def _number(params: Column, name: str) -> Column:
    return value_of(params, name).try_cast("double")


#: Values of SUBARRAY that mean the full frame, and the keys that describe a subarray (fixed values).
FULL_FRAME = ["FULL", "GENERIC", "N/A", "ANY", "*"]
SUBARRAY_KEYS = ["SUBARRAY", "SUBSTRT1", "SUBSTRT2", "SUBSIZE1", "SUBSIZE2"]


def _defined(params: Column, *names: str) -> Column:
    return reduce(and_, (value_of(params, n) != UNDEFINED for n in names))


def _listed(params: Column, key: str, names: tuple[str, ...]) -> Column:
    """All names are in a comma-separated list."""
    have = F.split(F.upper(value_of(params, key)), r"\s*,\s*")
    return reduce(and_, (F.array_contains(have, n.upper()) for n in names), F.lit(True))


#: Exposure types that take images, by instrument (fixed values).
IMAGING = {
    "NRC": ["IMAGE", "TACQ", "TACONF", "CORON", "TSIMAGE", "FOCUS", "DARK", "FLAT", "LED"],
    "MIR": ["IMAGE", "TACQ", "LYOT", "4QPM", "DARK", "FLATIMAGE", "CORONCAL"],
    "NRS": ["CONFIRM", "DARK", "FOCUS", "IMAGE", "MIMF", "TACONFIRM", "TACQ", "TASLIT", "VERIFY"],
    "NIS": ["IMAGE", "TACQ", "TACONFIRM", "AMI", "FOCUS", "DARK", "LAMP"],
    "FGS": ["IMAGE", "FOCUS", "SKYFLAT", "INTFLAT", "DARK", "ID-STACK"],
}

#: Helpers that expressions may call.  What is known of an array NAME stands under NAME.KIND, NAME.SHAPE, NAME.TYPE and NAME.COLUMNS.
HELPERS: dict[str, Callable[..., Column]] = {
    "is_full_frame": lambda p: value_of(p, "SUBARRAY").isin(FULL_FRAME),
    "is_subarray": lambda p: ~value_of(p, "SUBARRAY").isin([*FULL_FRAME, UNDEFINED]),
    "subarray_defined": lambda p: _defined(p, *SUBARRAY_KEYS),
    "is_defined": lambda p, *names: _defined(p, *names),
    "has_columns": lambda p, *names: _listed(p, "COLUMNS", names),
    "array_has_columns": lambda p, array, *names: _listed(p, f"{array}.COLUMNS", names),
    "has_column_type": lambda p, column, kind: F.upper(value_of(p, f"{column}.TYPE")) == kind.upper(),
    "ndim": lambda p, count: _number(p, "NAXIS") == count,
    "array_ndim": lambda p, array, count: F.size(F.split(value_of(p, f"{array}.SHAPE"), ",")) == count,
    "array_exists": lambda p, array: _defined(p, f"{array}.KIND"),
    "is_table": lambda p, array: value_of(p, f"{array}.KIND") == "TABLE",
    "is_image": lambda p, array: value_of(p, f"{array}.KIND") == "IMAGE",
    "has_type": lambda p, array, *kinds: F.upper(value_of(p, f"{array}.TYPE")).isin([k.upper() for k in kinds]),
    "is_imaging_mode": lambda p: value_of(p, "EXP_TYPE").isin([f"{i}_{mode}" for i, modes in IMAGING.items() for mode in modes]),
    "is_irs2": lambda p: value_of(p, "READPATT").contains("IRS2"),
    "contains": lambda p, name, part: value_of(p, name).contains(part),
    "one_of": lambda p, name, *values: value_of(p, name).isin(list(values)),
}
#: What a condition makes of presence where it holds; ``warn_only`` warns where it does not.
PRESENCES = {"required": "R", "optional": "O", "warning": "W", "subarray": "S", "full_frame": "F", "all_subarray": "A"}


class BadExpression(ValueError):
    """A rule expression outside the known language."""


def translate(text: str, params: Column) -> Column:
    """The boolean column of a rule expression over a parameter map."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise BadExpression(text) from e

    def operand(node: ast.expr) -> Column:
        if isinstance(node, ast.Name):
            return value_of(params, node.id)
        if isinstance(node, ast.Constant) and isinstance(node.value, (str, int, float)):
            return F.lit(node.value)
        raise BadExpression(text)

    def compare(op: ast.cmpop, a: ast.expr, b: ast.expr) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)) and isinstance(b, (ast.List, ast.Tuple, ast.Set)):
            found = operand(a).isin([x.value for x in b.elts if isinstance(x, ast.Constant)])
            return found if isinstance(op, ast.In) else ~found
        x, y = operand(a), operand(b)
        if any(isinstance(n, ast.Constant) and not isinstance(n.value, str) for n in (a, b)):
            x, y = x.try_cast("double"), y.try_cast("double")
        known = {ast.Eq: x == y, ast.NotEq: x != y, ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}
        if type(op) not in known:
            raise BadExpression(text)
        return known[type(op)]

    def condition(node: ast.expr) -> Column:
        if isinstance(node, ast.BoolOp):
            parts = [condition(v) for v in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(node.op, ast.And) else out | p
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~condition(node.operand)
        if isinstance(node, ast.Compare):
            terms = [node.left, *node.comparators]
            out = compare(node.ops[0], terms[0], terms[1])
            for op, a, b in zip(node.ops[1:], terms[1:], terms[2:]):
                out = out & compare(op, a, b)
            return out
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in HELPERS and not node.keywords:
            return HELPERS[node.func.id](params, *(a.value for a in node.args if isinstance(a, ast.Constant)))
        if isinstance(node, ast.Constant) and isinstance(node.value, bool):
            return F.lit(node.value)
        raise BadExpression(text)

    return condition(tree)


def presence_of(text: str, params: Column) -> Column:
    """Presence letter of a conditional presence: ``condition`` or ``required(condition)`` and the like; O where it does not hold."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise BadExpression(text) from e
    if isinstance(tree, ast.Call) and isinstance(tree.func, ast.Name) and tree.func.id in (*PRESENCES, "warn_only") and len(tree.args) <= 1 and not tree.keywords:
        holds = F.coalesce(translate(ast.unparse(tree.args[0]), params), F.lit(False)) if tree.args else F.lit(True)
        return F.when(holds, "R").otherwise("W") if tree.func.id == "warn_only" else F.when(holds, PRESENCES[tree.func.id]).otherwise("O")
    return F.when(F.coalesce(translate(text, params), F.lit(False)), "R").otherwise("O")


def names_in(text: str) -> list[str]:
    """Header keys that an expression reads."""
    tree = ast.parse(text.strip(), mode="eval")
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called})
