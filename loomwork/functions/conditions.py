"""Row filters in the syntax of a data-frame query string, as Column expressions.

A whitelist of syntax is translated: and, or, not, &, |, ~, comparisons (also
chained), in and not in with lists, arithmetic, names, `names with blanks` in
backticks, constants. Everything else is an error, raised before any data is
read. Missing values compare as they do in a data frame: != and `not in` hold.
Division by zero gives a missing value.
"""

from __future__ import annotations

import ast
import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError

_COMPARE = {
    ast.Lt: operator.lt,
    ast.LtE: operator.le,
    ast.Gt: operator.gt,
    ast.GtE: operator.ge,
    ast.Eq: operator.eq,
}
_ARITHMETIC = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: lambda a, b: F.try_divide(a, b),
    ast.Mod: lambda a, b: F.pmod(a, F.nullif(b, F.lit(0))),
    ast.Pow: lambda a, b: F.pow(a, b),
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)),
}


def condition(text: str, columns: list[str]) -> Column:
    """The filter of a query string over a table of these columns."""
    quoted: dict[str, str] = {}

    def name(m: re.Match) -> str:
        key = f"_quoted_{len(quoted)}"
        quoted[key] = m.group(1)
        return key

    source = re.sub(r"`([^`]+)`", name, text)
    # & and | bind tighter than comparisons in Python, but not in a query string; quoted text stays as it is
    parts = re.split(r"""('[^']*'|"[^"]*")""", source)
    parts[::2] = [p.replace("&", " and ").replace("|", " or ").replace("~", " not ") for p in parts[::2]]
    source = "".join(parts)
    try:
        tree = ast.parse(source.strip(), mode="eval").body
    except SyntaxError as e:
        raise ConfigError(f"not a query: {text!r}: {e.msg}", query=text) from e

    def bad(node: ast.AST) -> ConfigError:
        return ConfigError(f"{type(node).__name__} can't be used in a query: {text!r}", query=text)

    def value(n: ast.AST) -> Column:
        if isinstance(n, ast.Constant):
            if isinstance(n.value, (str, int, float, bool)):
                return F.lit(n.value)
            raise bad(n)
        if isinstance(n, ast.Name):
            c = quoted.get(n.id, n.id)
            if c not in columns:
                raise ConfigError(f"no column {c!r} for the query {text!r}; there are {', '.join(columns)}", query=text, column=c)
            return F.col(f"`{c}`")
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -value(n.operand)
        if isinstance(n, ast.BinOp) and type(n.op) in _ARITHMETIC:
            return _ARITHMETIC[type(n.op)](value(n.left), value(n.right))
        return truth(n)

    def one(a: ast.AST, op: ast.cmpop, b: ast.AST) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)) or (isinstance(b, (ast.List, ast.Tuple)) and isinstance(op, (ast.Eq, ast.NotEq))):
            if not isinstance(b, (ast.List, ast.Tuple)):
                raise bad(b)
            hit = F.coalesce(value(a).isin([ast.literal_eval(e) for e in b.elts]), F.lit(False))
            return hit if isinstance(op, (ast.In, ast.Eq)) else ~hit
        if isinstance(op, ast.NotEq):
            return F.coalesce(value(a) != value(b), F.lit(True))
        if type(op) not in _COMPARE:
            raise bad(op)
        return F.coalesce(_COMPARE[type(op)](value(a), value(b)), F.lit(False))

    def truth(n: ast.AST) -> Column:
        if isinstance(n, ast.BoolOp):
            return reduce(operator.and_ if isinstance(n.op, ast.And) else operator.or_, [truth(v) for v in n.values])
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return ~truth(n.operand)
        if isinstance(n, ast.Compare):
            sides = [n.left, *n.comparators]
            return reduce(operator.and_, [one(a, op, b) for a, op, b in zip(sides, n.ops, sides[1:], strict=False)])
        if isinstance(n, ast.Name):
            return value(n)
        if isinstance(n, ast.Constant) and isinstance(n.value, bool):
            return F.lit(n.value)
        raise bad(n)

    return truth(tree)


def query(df: DataFrame, text: str) -> DataFrame:
    """Rows of df for which the query string holds; checked against df's columns at once."""
    return df.filter(condition(text, df.columns))
