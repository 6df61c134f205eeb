"""All detectors, propagation and overlap resolution.

``detect_pii`` is the whole of it in one expression. The analyzer resolves nested lambdas
one level per pass and stops after a hundred, so operators that nest it further use the two
halves in two columns: ``raw_pii`` first, ``finalized`` on top of it.
"""

from __future__ import annotations

from collections.abc import Mapping

from .detectors import PRIORITY, raw_spans
from .offsets import NO_SPANS
from .spans import finalize_spans
from .sql import Sql, let, when


def raw_pii(text: Sql, guarded: bool = True) -> Sql:
    """Everything the detectors find, overlaps included. ``text`` must be bound."""
    return when(f"{text} is null", NO_SPANS, raw_spans(text, guarded=guarded))


def finalized(text: Sql, raw: Sql, priority: Mapping[str, int] = PRIORITY) -> Sql:
    """Disjoint spans in order, empty for null. ``text`` and ``raw`` must be bound."""
    return when(f"{text} is null or {raw} is null", NO_SPANS, finalize_spans(text, raw, priority))


def detect_pii(text: Sql, guarded: bool = True) -> Sql:
    """Disjoint spans of ``text`` in order; empty for null."""
    return let(text, lambda t: let(raw_pii(t, guarded), lambda raw: finalized(t, raw)))
