"""Label taxonomy: label -> token type and label <-> placeholder."""

from __future__ import annotations

from .sql import Sql, lit, literal_map

# Label, type used in tokens, placeholder.
TAXONOMY = (
    ("EMAIL", "EMAIL", "<PRIVATE_EMAIL>"),
    ("PHONE", "TEL", "<PRIVATE_PHONE>"),
    ("PERSON", "PERSONA", "<PRIVATE_PERSON>"),
    ("ADDRESS", "DOMICILIO", "<PRIVATE_ADDRESS>"),
    ("AR_DNI", "ID", "<ACCOUNT_NUMBER>"),
    ("AR_CUIT", "ID", "<ACCOUNT_NUMBER>"),
    ("AR_CBU", "ID", "<ACCOUNT_NUMBER>"),
    ("CREDIT_CARD", "ID", "<ACCOUNT_NUMBER>"),
    ("ACCOUNT", "ID", "<ACCOUNT_NUMBER>"),
    ("URL", "URL", "<PRIVATE_URL>"),
    ("DATE", "FECHA", "<PRIVATE_DATE>"),
    ("SECRET", "SECRETO", "<SECRET>"),
    ("IPV4", "IP", "<REDACTED>"),
    ("CUSTOM", "DATO", "<REDACTED>"),
)
DEFAULT_TYPE = "DATO"
DEFAULT_PLACEHOLDER = "<REDACTED>"
NUMERIC_TYPES = ("ID", "TEL", "IP")

# Placeholder of an external detector -> label.
PLACEHOLDER_LABEL = (
    ("<PRIVATE_PERSON>", "PERSON"),
    ("<PRIVATE_ADDRESS>", "ADDRESS"),
    ("<PRIVATE_EMAIL>", "EMAIL"),
    ("<PRIVATE_PHONE>", "PHONE"),
    ("<ACCOUNT_NUMBER>", "ACCOUNT"),
    ("<PRIVATE_DATE>", "DATE"),
    ("<PRIVATE_URL>", "URL"),
    ("<SECRET>", "SECRET"),
    ("<REDACTED>", "CUSTOM"),
)


def type_of(label: Sql) -> Sql:
    known = literal_map((lab, typ) for lab, typ, _ in TAXONOMY)
    free = f"regexp_replace(upper({label}), '[^A-Z]+', '')"
    return f"coalesce(try_element_at({known}, {label}), nullif({free}, ''), {lit(DEFAULT_TYPE)})"


def placeholder_of(label: Sql) -> Sql:
    known = literal_map((lab, ph) for lab, _, ph in TAXONOMY)
    return f"coalesce(try_element_at({known}, {label}), {lit(DEFAULT_PLACEHOLDER)})"


def label_of_placeholder(placeholder: Sql) -> Sql:
    """Null where the placeholder is unknown."""
    return f"try_element_at({literal_map(PLACEHOLDER_LABEL)}, {placeholder})"

