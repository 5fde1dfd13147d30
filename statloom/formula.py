"""Model formulas: `y ~ x + C(g) + a:b + a*b + log(x) - 1`, `Surv(time, event) ~ ...`, and `y ~ x | entity + time` for panels.

A formula is read once against a table, which fixes the levels of its categories; the design's columns are expressions, and
serve any table with the same names.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Functions that a term may use, by name, with or without the prefix np.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "log": F.log, "log10": F.log10, "log1p": F.log1p, "exp": F.exp, "expm1": F.expm1, "sqrt": F.sqrt, "abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan, "tanh": F.tanh, "floor": F.floor, "ceil": F.ceil,
    "sign": F.signum, "square": lambda c: c * c, "power": lambda c, k: F.pow(c, k), "minimum": F.least, "maximum": F.greatest,
}
#: Categories that a column may have at most.
LEVELS = 1_000


class FormulaError(ValueError):
    pass


def _expression(node: ast.AST) -> Column:
    """A column from arithmetic over names, numbers and FUNCTIONS."""
    if isinstance(node, ast.Expression):
        return _expression(node.body)
    if isinstance(node, ast.Name):
        return F.col(node.id).cast("double")
    if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
        return F.lit(float(node.value))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return -_expression(node.operand)
    if isinstance(node, ast.BinOp):
        a, b = _expression(node.left), _expression(node.right)
        for kind, f in ((ast.Add, lambda: a + b), (ast.Sub, lambda: a - b), (ast.Mult, lambda: a * b), (ast.Div, lambda: a / b), (ast.Pow, lambda: F.pow(a, b))):
            if isinstance(node.op, kind):
                return f()
    if isinstance(node, ast.Call):
        name = node.func.attr if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name) and node.func.value.id in ("np", "numpy") else getattr(node.func, "id", None)
        if name == "I" and len(node.args) == 1:
            return _expression(node.args[0])
        if name in FUNCTIONS:
            return FUNCTIONS[name](*map(_expression, node.args))
        raise FormulaError(f"no function {name!r}")
    raise FormulaError("a term is arithmetic over columns, numbers and known functions")


def _split(text: str, at: str) -> list[str]:
    """Parts between signs that stand outside brackets."""
    out, depth, now = [], 0, ""
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if depth < 0:
            raise FormulaError("a bracket closes that is not open")
        if c == at and not depth and not (at == "*" and (text[i + 1 : i + 2] == "*" or text[i - 1 : i] == "*")):
            out.append(now)
            now = ""
        else:
            now += c
    if depth:
        raise FormulaError("a bracket is left open")
    return [*out, now]


def _signed(text: str) -> list[tuple[str, str]]:
    """(sign, term) of a sum."""
    out, depth, now, sign = [], 0, "", "+"
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if c in "+-" and not depth and not re.search(r"\*\*\s*$", now):
            if now.strip():
                out.append((sign, now.strip()))
            now, sign = "", c
        else:
            now += c
    if now.strip():
        out.append((sign, now.strip()))
    elif out or sign != "+":
        raise FormulaError("a sum ends with a sign")
    return out


@dataclass
class Design:
    """What a formula says of a table: the response, the design's columns by name, and panel effects."""

    response: list[str]
    terms: list[tuple[str, ...]]  # factors of each product; () is the intercept
    levels: dict[str, list] = field(default_factory=dict)
    effects: list[str] = field(default_factory=list)

    @property
    def intercept(self) -> bool:
        return () in self.terms

    def response_columns(self) -> list[Column]:
        return [_expression(ast.parse(r, mode="eval")) for r in self.response]

    def _factor(self, name: str, whole: bool) -> list[tuple[str, Column]]:
        if name not in self.levels:
            return [(name, _expression(ast.parse(name, mode="eval")))]
        column = F.col(_category(name) or name)
        levels = self.levels[name] if whole else self.levels[name][1:]
        tag = "" if whole else "T."
        return [(f"{name}[{tag}{v}]", F.when(column.isNotNull(), (column == F.lit(v)).cast("double"))) for v in levels]

    def columns(self) -> list[tuple[str, Column]]:
        """(name, expression) of the design without the intercept. A category has a column for each level but the first, or for
        all levels where no intercept and no category before it stands for the first."""
        out: list[tuple[str, Column]] = []
        open_ = not self.intercept
        for term in self.terms:
            if not term:
                continue
            parts = []
            for f in term:
                whole = open_ and len(term) == 1 and f in self.levels
                open_ = open_ and not whole
                parts.append(self._factor(f, whole))
            for combo in product(*parts):
                value = combo[0][1]
                for _, c in combo[1:]:
                    value = value * c
                out.append((":".join(n for n, _ in combo), value))
        return out

    def frame(self, df: DataFrame, keep: Sequence[str] = (), response: bool = True) -> tuple[DataFrame, list[str], list[str]]:
        """df's design as columns y0.. and x0.., with `keep` and the effects beside; the design's names and its columns' names.
        Rows with a null in the design are left out."""
        named = self.columns()
        ys = [c.alias(f"y{i}") for i, c in enumerate(self.response_columns())] if response else []
        xs = [c.alias(f"x{i}") for i, (_, c) in enumerate(named)]
        rows = df.select(*ys, *xs, *dict.fromkeys([*keep, *self.effects]))
        names = [f"x{i}" for i in range(len(xs))]
        return rows.na.drop(subset=[*[f"y{i}" for i in range(len(ys))], *names]), [n for n, _ in named], names


def _category(name: str) -> str | None:
    m = re.fullmatch(r"C\(\s*([A-Za-z_]\w*)\s*\)", name)
    return m[1] if m else None


def parse(formula: str, df: DataFrame) -> Design:
    """Read a formula against a table. Text columns and those in C() are categories, whose sorted levels are collected."""
    if formula.count("~") != 1:
        raise FormulaError("a formula has one ~")
    left, right = (x.strip() for x in formula.split("~"))
    right, *bar = _split(right, "|")
    m = re.fullmatch(r"Surv\((.*)\)", left)
    response = [x.strip() for x in _split(m[1], ",")] if m else [left] if left else []
    terms: list[tuple[str, ...]] = [()]
    effects: list[str] = []
    for sign, term in _signed(right):
        term = re.sub(r"\s+", "", term)
        if term in ("0", "1", "-1"):
            keep = (term == "1") == (sign == "+")
            terms = [t for t in terms if t] if not keep else ([()] if () not in terms else []) + terms
            continue
        if term in ("EntityEffects", "TimeEffects", "FixedEffects"):
            effects += {"EntityEffects": ["entity"], "TimeEffects": ["time"], "FixedEffects": ["entity", "time"]}[term]
            continue
        factors = _split(term, "*")
        made = []
        for mask in range(1, 1 << len(factors)):
            made.append(tuple(dict.fromkeys(f for i, g in enumerate(factors) if mask >> i & 1 for f in _split(g, ":"))))
        for t in sorted(made, key=len) if len(factors) > 1 else [tuple(dict.fromkeys(_split(term, ":")))]:
            if sign == "-":
                terms = [u for u in terms if set(u) != set(t)]
            elif all(set(u) != set(t) for u in terms):
                terms.append(t)
    for b in bar:
        effects += [t for _, t in _signed(b)]
    terms.sort(key=lambda t: len(t) if t else 0)
    design, text = Design(response, terms, effects=effects[:2]), {c for c, t in df.dtypes if t in ("string", "boolean")}
    for f in dict.fromkeys(f for t in terms for f in t):
        column = _category(f) or (f if f in text else None)
        if column is None:
            ast.parse(f, mode="eval")
            continue
        levels = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(LEVELS + 1).collect()]
        if len(levels) > LEVELS:
            raise FormulaError(f"{column} has more than {LEVELS} levels")
        design.levels[f] = sorted(levels)
    design.columns()
    return design
