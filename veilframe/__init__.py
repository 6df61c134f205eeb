"""Finding and replacing personal data in Spark tables and streams."""

from .operators.anonymize import anonymize_docs, deanonymize, deanonymize_rows, redact_placeholder
from .operators.detect import choose_spans, detect_docs, ingest_external_spans, with_spans
from .operators.pages import redact_pages
from .operators.reports import (
    consistency_check,
    highlight_docs,
    leak_check,
    roundtrip_check,
    summary_by_label,
    summary_rollup,
)
from .operators.span_tables import resolve_span_table
from .operators.tables import Anonymized, anonymize_nested, anonymize_table, pseudonymize_table
from .sources.files import anonymize_files
from .sources.formats import admit
from .sources.sinks import write_files, write_result
from .streaming.stream import anonymize_stream, pseudonymize_batches

__all__ = [
    "Anonymized",
    "admit",
    "anonymize_docs",
    "anonymize_files",
    "anonymize_nested",
    "anonymize_stream",
    "anonymize_table",
    "choose_spans",
    "consistency_check",
    "deanonymize",
    "deanonymize_rows",
    "detect_docs",
    "highlight_docs",
    "ingest_external_spans",
    "leak_check",
    "pseudonymize_batches",
    "pseudonymize_table",
    "redact_pages",
    "redact_placeholder",
    "resolve_span_table",
    "roundtrip_check",
    "summary_by_label",
    "summary_rollup",
    "with_spans",
    "write_files",
    "write_result",
]
