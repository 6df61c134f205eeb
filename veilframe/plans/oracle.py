"""The same results in DuckDB SQL.

RE2 has no look-around, so digit runs and word runs are wrapped in control characters first
and the patterns name those. Everything is built on two pieces: ``matches`` (offsets of a
pattern's matches) and ``spans`` (all detectors, propagation, overlap resolution).
"""

from __future__ import annotations

# Fixed values, stated here on their own so that a wrong constant of the engine shows: priorities of labels,
# (label, type in tokens, placeholder), and (placeholder, label).
PRIORITY = {
    "AR_CBU": 60, "AR_CUIT": 55, "SECRET": 50, "AR_DNI": 45, "CREDIT_CARD": 40, "EMAIL": 35, "IPV4": 25, "URL": 20, "PHONE": 10,
}
CUSTOM_PRIORITY = {**PRIORITY, "CUSTOM": 100}
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
_OPEN, _CLOSE, _MARK, _JOIN, _JOINED = (f"chr({n})" for n in (1, 2, 3, 4, 5))


def _pattern(text: str) -> str:
    """A pattern literal; \\x01 .. \\x05 are understood by RE2 itself."""
    return "'" + text.replace("'", "''") + "'"


_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_BODY = (
    r"(?:\+?\x01?\d{1,3}\x02?(?:[ .\-])?)?(?:\(\x01?\d{1,4}\x02?\)(?:[ .\-])?)?"
    r"\x01?\d{2,4}(?:\x02?[ .\-]\x01?\d{2,4}){1,4}\x02"
)
_DIGIT_RUNS = rf"regexp_replace(t, '\d+', {_OPEN} || '\0' || {_CLOSE}, 'g')"
_WORD_RUNS = rf"regexp_replace(t, '[\pL\pN_]+', {_OPEN} || '\0' || {_CLOSE}, 'g')"
# a separator between two digit runs is told apart from one that trails the last run
_CARD_RUNS = rf"regexp_replace({_DIGIT_RUNS}, '\x02([ \-])\x01', {_JOIN} || '\1' || {_JOINED}, 'g')"

# Fixed values, in RE2's terms: label, prepared text, what precedes the reported part, the reported part.
_DETECTORS = (
    ("EMAIL", "t", "", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("URL", "t", "", r"(?i)\b(?:https?://|www\.)[^\s<>()\[\]{}\x22\x27]+"),
    ("IPV4", "t", "", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"),
    ("SECRET", "t", "", r"\b(?:sk|pk|rk)-[A-Za-z0-9]{16,}\b"),
    ("SECRET", "t", "", r"\bAKIA[0-9A-Z]{16}\b"),
    ("SECRET", "t", "", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("SECRET", "t", "", r"\bxox[baprs]-[A-Za-z0-9\-]{10,}\b"),
    ("CREDIT_CARD", _CARD_RUNS, "", r"[\x01\x05](?:\d(?:\x04[ \-]\x05)?){12,18}\d(?:\x02[ \-]?|\x04)"),
    ("PHONE", _WORD_RUNS, r"(?:^|[^\pL\pN_.\x01\x02])\x01?", _BODY),
    ("AR_CUIT", _DIGIT_RUNS, "", r"\x01\d{2}(?:\x02[ \-]\x01)?\d{8}(?:\x02[ \-]\x01)?\d\x02"),
    ("AR_CBU", _DIGIT_RUNS, "", r"\x01\d{22}\x02"),
    ("AR_DNI", _DIGIT_RUNS, "", r"\x01\d{1,2}\x02\.\x01\d{3}\x02\.\x01\d{3}\x02"),
    (
        "AR_DNI",
        "t",
        r"(?i)\b(?:dni|d\.n\.i\.?|documento)\b[\s:n°º\-]*",
        r"(?:\d{1,2}\.?\d{3}\.?\d{3}|\d{7,8})",
    ),
)


def luhn(text: str) -> str:
    digits = rf"regexp_replace({text}, '\D', '', 'g')"
    each = (
        f"list_transform(string_split(reverse({digits}), ''), lambda c, i: "
        "CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN CAST(c AS INT) > 4 THEN 2 * CAST(c AS INT) - 9 "
        "ELSE 2 * CAST(c AS INT) END)"
    )
    return f"CASE WHEN length({digits}) < 13 THEN false ELSE list_sum({each}) % 10 = 0 END"


def cuit(text: str) -> str:
    digits = rf"regexp_replace({text}, '\D', '', 'g')"
    weights = "[5, 4, 3, 2, 7, 6, 5, 4, 3, 2]"
    total = f"list_sum(list_transform(string_split({digits}[1:10], ''), lambda c, i: CAST(c AS INT) * {weights}[i])) % 11"
    expected = f"CASE {total} WHEN 0 THEN 0 WHEN 1 THEN 9 ELSE 11 - {total} END"
    return f"CASE WHEN length({digits}) <> 11 THEN false ELSE {expected} = CAST({digits}[11] AS INT) END"


def phone(text: str) -> str:
    return rf"length(regexp_replace({text}, '\D', '', 'g')) >= 7"


_VALID = {"CREDIT_CARD": luhn, "PHONE": phone, "AR_CUIT": cuit}


def pieces_to_spans(source: str, pieces: str, label: str, order: int | str, keys: str = "tbl, id") -> str:
    """Offsets of the odd pieces of a list gap, match, gap, ..."""
    return f"""SELECT {keys}, {label} AS label,
        CAST(list_sum(list_transform(p[1:2 * j - 1], lambda x: length(x))) AS BIGINT) AS s,
        CAST(list_sum(list_transform(p[1:2 * j], lambda x: length(x))) AS BIGINT) AS e,
        p[2 * j] AS x, {order} AS ord
        FROM (SELECT *, unnest(range(1, (len(p) - 1) // 2 + 1)) AS j FROM (SELECT *, {pieces} AS p FROM {source}))"""


def matches(source: str, label: str, prepared: str, before: str, pattern: str, order: int) -> str:
    marked = (
        f"regexp_replace({prepared}, {_pattern(f'({before})({pattern})')}, "
        rf"'\1' || {_MARK} || '\2' || {_MARK}, 'g')"
    )
    strip = f"{_OPEN} || {_CLOSE} || {_JOIN} || {_JOINED}"
    pieces = f"list_transform(string_split({marked}, {_MARK}), lambda x: translate(x, {strip}, ''))"
    found = pieces_to_spans(source, pieces, f"'{label}'", order)
    return f"SELECT * FROM ({found}) WHERE {_VALID[label]('x')}" if label in _VALID else found


def raw(source: str, label: str | None = None) -> str:
    parts = [matches(source, d[0], *d[1:], order=i) for i, d in enumerate(_DETECTORS) if label in (None, d[0])]
    return "\nUNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


def weight(label: str, priority: dict[str, int]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in priority.items())
    return f"CASE {label} {cases} ELSE 0 END" if priority else "0"


def finalize(source: str, found: str, priority: dict[str, int], prefix: str) -> str:
    """CTEs ending in ``{prefix}spans``: propagate and resolve ``found`` over ``source``."""
    return f"""
    {prefix}frag AS (SELECT tbl, id, x, arg_min(label, (ord, s)) AS label, min((ord, s)) AS o FROM {found}
        WHERE length(trim(x, ' ' || chr(9) || chr(10) || chr(13))) >= 4 GROUP BY tbl, id, x),
    {prefix}occ AS (SELECT f.*, string_split(d.t, f.x) AS p FROM {prefix}frag f JOIN {source} d USING (tbl, id)),
    {prefix}more AS (SELECT tbl, id, label, CAST(list_sum(list_transform(p[1:j], lambda y: length(y))) + (j - 1) * length(x) AS BIGINT) AS s, x, o
        FROM (SELECT *, unnest(range(1, len(p))) AS j FROM {prefix}occ)),
    {prefix}cand AS (SELECT tbl, id, label, s, e, x, ord, s AS sub FROM {found} WHERE e > s
        UNION ALL SELECT tbl, id, label, s, s + length(x), x, 1000 + o[1], s FROM {prefix}more),
    {prefix}sorted AS (SELECT tbl, id, list({{'label': label, 's': s, 'e': e, 'x': x}}
        ORDER BY e - s DESC, {weight('label', priority)} DESC, s, ord, sub) AS l FROM {prefix}cand GROUP BY tbl, id),
    {prefix}kept AS (SELECT tbl, id, unnest(list_reduce(l, lambda a, y:
        CASE WHEN len(list_filter(a, lambda z: z.s < y.e AND z.e > y.s)) > 0 THEN a ELSE list_append(a, y) END, [])) AS k FROM {prefix}sorted),
    {prefix}spans AS (SELECT tbl, id, k.label AS label, k.s AS s, k.e AS e, k.x AS x FROM {prefix}kept)"""


def spans(texts_sql: str, prefix: str = "") -> str:
    """CTEs ``{prefix}src(tbl, id, grp, t)`` and ``{prefix}spans(tbl, id, label, s, e, x)``."""
    src = f"{prefix}src"
    return f"""{src} AS ({texts_sql}),
    {prefix}raw AS ({raw(src)}),{finalize(src, f"{prefix}raw", PRIORITY, prefix)}"""


def normalized(text: str) -> str:
    return rf"regexp_replace({text}, '-[ \t]*\n[ \t]*', '-', 'g')"


def type_of(label: str) -> str:
    cases = " ".join(f"WHEN '{lab}' THEN '{typ}'" for lab, typ, _ in TAXONOMY)
    free = f"coalesce(nullif(regexp_replace(upper({label}), '[^A-Z]', '', 'g'), ''), 'DATO')"
    return f"CASE {label} {cases} ELSE {free} END"


def placeholder_of(label: str) -> str:
    cases = " ".join(f"WHEN '{lab}' THEN '{ph}'" for lab, _, ph in TAXONOMY)
    return f"CASE {label} {cases} ELSE '<REDACTED>' END"


def label_of(placeholder: str, label: str) -> str:
    cases = " ".join(f"WHEN '{ph}' THEN '{lab}'" for ph, lab in PLACEHOLDER_LABEL)
    return f"CASE {placeholder} {cases} ELSE coalesce(upper({label}), 'PII') END"


def replaced(spans_cte: str, source: str, token: str, *, gap: str = "{}", output: str = "output") -> str:
    """``SELECT tbl, id, output``: every span of ``spans_cte`` becomes ``token``."""
    keep = gap.format("substring(d.t, prev + 1, s - prev)")
    tail = gap.format("substring(d.t, last_end + 1)")
    whole = gap.format("d.t")
    return f"""SELECT d.tbl, d.id, CASE WHEN r.body IS NULL THEN {whole} ELSE r.body || {tail} END AS {output}
    FROM {source} d LEFT JOIN (
        SELECT d.tbl, d.id, string_agg({keep} || tok, '' ORDER BY s) AS body, max(e) AS last_end
        FROM (SELECT *, {token} AS tok, coalesce(lag(e) OVER (PARTITION BY tbl, id ORDER BY s), 0) AS prev FROM {spans_cte}) q
        JOIN {source} d USING (tbl, id) GROUP BY d.tbl, d.id) r USING (tbl, id)"""


def mask(text: str, typ: str) -> str:
    s = f"trim({text}, ' ' || chr(9) || chr(10) || chr(13))"
    digits = rf"length(regexp_replace({s}, '\D', '', 'g'))"
    shown = f"least(4, length({s}) - 1)"
    words = (
        rf"array_to_string(list_transform(string_split_regex({s}, '\s+'), "
        "lambda w: w[1] || repeat('•', CAST(greatest(1, length(w) - 1) AS BIGINT))), ' ')"
    )
    return f"""CASE WHEN {typ} = 'EMAIL' AND contains({s}, '@') THEN
            CASE WHEN starts_with({s}, '@') THEN '•' ELSE {s}[1] END || '•••@' || substring({s}, instr({s}, '@') + 1)
        WHEN {typ} = 'URL' THEN '•••'
        WHEN {typ} IN ('ID', 'TEL', 'IP') OR {digits} >= 6 THEN
            regexp_replace({s}[1:length({s}) - {shown}], '[0-9A-Za-z]', '•', 'g') || right({s}, {shown})
        ELSE {words} END"""


def hashed(text: str, typ: str, pads: tuple[bytes, bytes]) -> str:
    ipad, opad = (f"unhex('{p.hex()}')" for p in pads)
    value = f"encode(lower(trim({text}, ' ' || chr(9) || chr(10) || chr(13))))"
    digest = f"sha256({opad} || unhex(sha256({ipad} || {value})))"
    return f"'«' || {typ} || '_' || {digest}[1:16] || '»'"
