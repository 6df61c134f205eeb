"""The few steps that run in Python workers, in Arrow batches.

Each one has no built-in counterpart: patterns that need a time limit, Unicode folding, and
the lenient CSV and JSON grammars of whole small files. The module is pickled by value, so
workers do not need the package installed.
"""

from __future__ import annotations

import csv
import io
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:  # the engine with a time limit; patterns that need it cannot be used without
    import regex as timed_regex
except ImportError:  # pragma: no cover
    timed_regex = None

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# as objects: a type written as text needs a session when the module is imported
_TEXTS = T.ArrayType(T.StringType())
_MATCH = T.StructType([T.StructField(name, T.IntegerType()) for name in ("n", "start", "end")])


def fold_key(value: str) -> str:
    """How exempt values are compared: composed, stripped, case-folded."""
    return unicodedata.normalize("NFC", value).strip().casefold()


@F.pandas_udf(T.ArrayType(_TEXTS))
def fold_texts(leaves: pd.Series) -> pd.Series:
    """The folded form of every span text of every leaf."""
    return leaves.map(lambda spans: [[fold_key(t) for t in texts] for texts in spans], na_action="ignore")


@F.pandas_udf(T.StringType())
def fold_values(values: pd.Series) -> pd.Series:
    return values.map(fold_key, na_action="ignore")


def timed_matches(sources: tuple[tuple[int, str, bool], ...], seconds: float, mark: bool):
    """UDF: array of texts -> numbered matches per text. ``sources`` are (number, pattern, is a
    case-blind literal). A pattern that takes too long on a text leaves a match from -1 to -1 there
    where ``mark`` is set, and else ends the job: what it should hide must not pass unseen."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(_MATCH)))
    def matches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def finder(source: str, literal: bool) -> Callable[[str], Iterator]:
            if literal:  # cannot blow up, and follows the standard library's idea of case
                return re.compile(re.escape(source), re.IGNORECASE).finditer
            pattern = timed_regex.compile(source)
            return lambda text: pattern.finditer(text, timeout=seconds)

        finders = [(n, finder(source, literal)) for n, source, literal in sources]

        def scan(text: str | None) -> list[dict]:
            found = []
            for n, find in finders if text is not None else ():
                try:
                    spans = [m.span() for m in find(text)]
                except TimeoutError:
                    if not mark:
                        raise RuntimeError(f"pattern {n} took more than {seconds} s on one text") from None
                    found.append({"n": n, "start": -1, "end": -1})
                    continue
                found += [{"n": n, "start": a, "end": b} for a, b in spans if b > a]
            return found

        for leaves in batches:
            yield leaves.map(lambda texts: [scan(t) for t in texts], na_action="ignore")

    return matches


class Tree:
    """A parsed CSV or JSON file as a list of slots (container, key, text), in reading order.

    Parsing notes where each text stands, so writing only fills the slots and prints the tree.
    """

    def __init__(self, fmt: str, content: str) -> None:
        self.fmt = fmt
        self.slots: list[tuple[list | dict, int | str, str]] = []
        if fmt == "csv":
            csv.field_size_limit(sys.maxsize)  # a cell may be as long as its file
            self.root: list = list(csv.reader(io.StringIO(content)))
        else:
            self.root = [json.loads(content)]
        todo: list[tuple[list | dict, int | str]] = [(self.root, 0)] if fmt == "json" else [(row, i) for row in self.root for i in range(len(row))]
        todo.reverse()
        while todo:
            holder, key = todo.pop()
            value = holder[key]
            if isinstance(value, str):
                self.slots.append((holder, key, value))
            elif isinstance(value, (list, dict)):
                keys = list(value) if isinstance(value, dict) else range(len(value))
                todo += [(value, k) for k in reversed(keys)]

    @property
    def texts(self) -> list[str]:
        return [text for _, _, text in self.slots]

    def filled(self, texts: list[str]) -> str:
        for (holder, key, _), text in zip(self.slots, texts, strict=True):
            holder[key] = text
        if self.fmt == "json":
            return json.dumps(self.root[0], ensure_ascii=False, indent=2)
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(self.root)
        return out.getvalue()


@F.pandas_udf(_TEXTS)
def file_leaves(formats: pd.Series, contents: pd.Series) -> pd.Series:
    """The anonymizable strings of a CSV or JSON file in order; null if it does not parse."""

    def read(fmt: str, content: str) -> list[str] | None:
        try:
            return Tree(fmt, content).texts
        except (ValueError, csv.Error, RecursionError):
            return None

    return pd.Series([None if c is None else read(f, c) for f, c in zip(formats, contents)], dtype=object)


@F.pandas_udf(T.StringType())
def file_from_leaves(formats: pd.Series, contents: pd.Series, leaves: pd.Series) -> pd.Series:
    """The file again, with its strings replaced one for one."""
    rows = zip(formats, contents, leaves)
    return pd.Series([None if x is None or c is None else Tree(f, c).filled(list(x)) for f, c, x in rows], dtype=object)


@F.pandas_udf(T.IntegerType())
def csv_width(records: pd.Series) -> pd.Series:
    """Cells of one CSV record."""
    return records.map(lambda raw: sum(map(len, csv.reader(io.StringIO(raw)))), na_action="ignore")


def _without_nulls(node: object) -> object:
    if isinstance(node, dict):
        return {k: _without_nulls(v) for k, v in node.items() if v is not None}
    return [_without_nulls(v) for v in node] if isinstance(node, list) else node


@F.pandas_udf(T.BooleanType())
def same_json(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether two JSON texts say the same, apart from the order of keys and null members; false where one is no JSON."""

    def same(a: str | None, b: str | None) -> bool:
        try:
            return a is not None and b is not None and _without_nulls(json.loads(a)) == _without_nulls(json.loads(b))
        except (ValueError, RecursionError):
            return False

    return pd.Series([same(a, b) for a, b in zip(left, right)], dtype=bool)
