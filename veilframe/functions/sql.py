"""Composing Spark SQL expressions as text.

The functions of this package take and return SQL expression text; ``expr`` turns the
finished text into a Column. One parse replaces thousands of calls into the JVM, and the
same text works on a column, inside a lambda and in ``spark.sql``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Sql = str
_names = itertools.count(1)


def expr(sql: Sql) -> Column:
    return F.expr(sql)


def col(name: str) -> Sql:
    """A column or field by its whole name, dots included."""
    return f"`{name.replace('`', '``')}`"


def lit(value: str | int | bool) -> Sql:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    if "\\" in value and "'" not in value:
        return f"r'{value}'"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(items: Iterable[Sql]) -> Sql:
    return f"array({', '.join(items)})"


def when(test: Sql, then: Sql, otherwise: Sql) -> Sql:
    return f"if({test}, {then}, {otherwise})"


def _lambda(kind: str, arr: Sql, body: Callable[..., Sql], arity: int = 1) -> Sql:
    names = [f"v{next(_names)}" for _ in range(arity)]
    head = names[0] if arity == 1 else f"({', '.join(names)})"
    return f"{kind}({arr}, {head} -> {body(*names)})"


def transform(arr: Sql, body: Callable[[Sql], Sql]) -> Sql:
    return _lambda("transform", arr, body)


def transform_indexed(arr: Sql, body: Callable[[Sql, Sql], Sql]) -> Sql:
    return _lambda("transform", arr, body, 2)


def keep(arr: Sql, test: Callable[[Sql], Sql]) -> Sql:
    return _lambda("filter", arr, test)


def keep_indexed(arr: Sql, test: Callable[[Sql, Sql], Sql]) -> Sql:
    return _lambda("filter", arr, test, 2)


def any_of(arr: Sql, test: Callable[[Sql], Sql]) -> Sql:
    return _lambda("exists", arr, test)


def fold(arr: Sql, zero: Sql, step: Callable[[Sql, Sql], Sql]) -> Sql:
    return _lambda("aggregate", f"{arr}, {zero}", step, 2)


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """Evaluate ``value`` once and hand it to ``body``.

    Writing an expression twice evaluates it twice. Binding it to a lambda variable is the
    one way to name an intermediate result inside a single expression, which is what keeps
    each regex to one pass per row. The fold has nothing to fold: its start value goes to
    the finishing function as it is, without the copy that ``transform`` makes of a result.
    """
    acc, item, bound = (f"v{next(_names)}" for _ in range(3))
    return f"aggregate(cast(array() as array<int>), {value}, ({acc}, {item}) -> {acc}, {bound} -> {body(bound)})"


def struct(**fields: Sql) -> Sql:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def literal_map(pairs: Iterable[tuple[str, str | int]]) -> Sql:
    return "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in pairs) + ")"


_STRIDES = array(str(1 << i) for i in range(31))


def running(values: Sql, combine: Callable[[Sql, Sql], Sql]) -> Sql:
    """Inclusive prefix combination of a bound array in log2(n) passes.

    A running sum over slices is quadratic. Here pass ``s`` adds the element ``s`` places to
    the left, for s = 1, 2, 4, ...
    """
    passes = f"slice({_STRIDES}, 1, int(log2(size({values}))) + 1)"
    return fold(
        passes,
        values,
        lambda acc, s: transform_indexed(
            acc, lambda x, i: when(f"{i} >= {s}", combine(f"get({acc}, {i} - {s})", x), x)
        ),
    )


def running_sum(values: Sql) -> Sql:
    return running(values, lambda a, b: f"({a} + {b})")


def running_max(values: Sql) -> Sql:
    return running(values, lambda a, b: f"greatest({a}, {b})")
