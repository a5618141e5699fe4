"""Small tools that an assistant calls, as columns: arithmetic, dates, shortening of evidence."""

import ast
import builtins
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The functions that an expression may call.
FUNCTIONS = ["abs", "round", "min", "max", "sqrt", "pow", "log", "log2", "log10", "sin", "cos", "tan", "asin", "acos", "atan", "exp", "ceil", "floor"]


def _power(a: float, b: float) -> float:
    """Whole numbers as long as the result is of a length to work with, else as a floating point number (too large: an error)."""
    whole = isinstance(a, int) and isinstance(b, int) and abs(b) * a.bit_length() <= 4096
    found = a**b if whole else float(a) ** float(b)
    if isinstance(found, complex):
        raise ValueError("no real power")
    return found


def _parts(node: ast.AST) -> list[ast.expr]:
    match node:
        case ast.BinOp(left=a, right=b):
            return [a, b]
        case ast.UnaryOp(operand=a):
            return [a]
        case ast.Call(args=args):
            return args
    return []


def _value(node: ast.AST, given: list[float]) -> float:
    """What a node gives for the values of its parts."""
    match node, given:
        case ast.Constant(value=int() | float() as number), [] if not isinstance(number, bool):
            return number
        case ast.Name(id="pi"), []:
            return math.pi
        case ast.Name(id="e"), []:
            return math.e
        case ast.BinOp(op=ast.Add()), [a, b]:
            return a + b
        case ast.BinOp(op=ast.Sub()), [a, b]:
            return a - b
        case ast.BinOp(op=ast.Mult()), [a, b]:
            return a * b
        case ast.BinOp(op=ast.Div()), [a, b]:
            return a / b
        case ast.BinOp(op=ast.FloorDiv()), [a, b]:
            return a // b
        case ast.BinOp(op=ast.Mod()), [a, b]:
            return a % b
        case (ast.BinOp(op=ast.Pow()), [a, b]) | (ast.Call(func=ast.Name(id="pow"), keywords=[]), [a, b]):
            return _power(a, b)
        case ast.UnaryOp(op=ast.USub()), [a]:
            return -a
        case ast.UnaryOp(op=ast.UAdd()), [a]:
            return a
        case ast.Call(func=ast.Name(id=name), keywords=[]), _ if name in FUNCTIONS:
            return getattr(math, name, None)(*given) if hasattr(math, name) else getattr(builtins, name)(*given)
    raise ValueError("not an arithmetic expression")


def evaluate(text: str) -> float:
    """An arithmetic expression of numbers, + - * / // % ** ^ (a power as **), parentheses, pi, e and FUNCTIONS; anything else is an error, as is what
    doesn't fit into a floating point number. Of any length; how deep parentheses nest is up to Python's parser (200)."""
    todo, nodes = [ast.parse(text.strip().replace("^", "**"), mode="eval").body], []
    while todo:  # parts come behind what they are parts of
        nodes.append(todo.pop())
        todo += _parts(nodes[-1])
    known: dict[int, float] = {}
    for node in reversed(nodes):
        known[id(node)] = _value(node, [known[id(p)] for p in _parts(node)])
    return float(known[id(nodes[0])])


def calculated(expression: Column) -> Column:
    """The value of each expression (see evaluate), null for null and for what isn't one."""

    def safe(text: str | None) -> float | None:
        try:
            return evaluate(text) if text is not None else None
        except (SyntaxError, ValueError, TypeError, ArithmeticError, RecursionError, MemoryError):
            return None

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([safe(t) for t in texts], dtype="float64")

    # NaN stands for no value on the way back from pandas
    return F.nanvl(run(expression), F.lit(None).cast("double"))


def date_parts(at: Column) -> dict[str, Column]:
    """date, time, weekday (1: Monday) of a time."""
    return {"date": F.date_format(at, "yyyy-MM-dd"), "time": F.date_format(at, "HH:mm:ss"), "weekday": F.weekday(at) + 1}


def days_between(start: Column, end: Column) -> Column:
    """Days from one date to another; null for what isn't a date."""
    return F.datediff(F.try_to_date(end.cast("string")), F.try_to_date(start.cast("string")))


def _upto(length: int):
    return lambda x: F.substring(x, 1, length)


def shortened(contents: Column, budget: int, caps: tuple[int, ...] = (600, 300, 150, 60)) -> Column:
    """The contents (array), each cut to the first of the caps by which all fit into the budget of characters; if none does, cut to the
    last one, as many of the first as fit, one at least."""
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda s, x: s + F.length(x))
    cut = [F.transform(contents, _upto(c)) for c in caps]
    last = cut[-1]
    # how many of the first fit: a running sum that stops at the budget
    fit = F.aggregate(last, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")), lambda s, x: F.struct((s["sum"] + F.length(x)).alias("sum"), F.when(s["sum"] + F.length(x) <= budget, s["n"] + 1).otherwise(s["n"]).alias("n")), lambda s: s["n"])
    whole = F.coalesce(*[F.when(total(c) <= budget, c) for c in [contents, *cut]])
    return F.coalesce(whole, F.slice(last, F.lit(1), F.greatest(F.lit(1), fit)))
