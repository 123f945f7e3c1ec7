"""PostgreSQL's functions in SQL text, as Spark SQL text with the same results.

Each entry turns the texts of a call's arguments into an expression.  Names that a
result needs from Spark are written in capitals; the binder (``binding.py``) looks
only at small-letter ones, whose meaning depends on their arguments' types.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .functions.datetimes import _PATTERNS
from .functions.system import _TYPE_NAMES


class CallError(ValueError):
    """An SQLSTATE and what can't be done."""


def _string(text: str) -> str | None:
    """The value of an SQL string literal in Spark's form."""
    text = text.strip()
    if len(text) < 2 or text[0] != "'" or text[-1] != "'":
        return None
    return re.sub(r"\\(.)", r"\1", text[1:-1], flags=re.S)


def _wanted(text: str, what: str) -> str:
    value = _string(text)
    if value is None:
        raise CallError(f"0A000: {what} must be a literal")
    return value


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _error(state: str, message: str) -> str:
    return f"RAISE_ERROR({quoted(f'{state}: {message}')})"


def _from_one(start: str) -> str:
    return f"({start} + GREATEST(1 - ({start}), 0))"


def _substring(s: str, start: str | None = None, length: str | None = None) -> str:
    if start is None:
        m = re.fullmatch(r"(?s)(.*?) from (.*?)(?: for (.*))?", s)
        if not m:
            raise CallError("42601: substring takes a string and a position")
        s, start, length = m.groups()
    if length is None:
        return f"SUBSTRING({s}, {_from_one(start)})"
    kept = f"GREATEST(({start}) + ({length}) - {_from_one(start)}, 0)"
    return f"CASE WHEN ({length}) < 0 THEN {_error('22011', 'negative substring length not allowed')} ELSE SUBSTRING({s}, {_from_one(start)}, {kept}) END"


def _left(s: str, n: str) -> str:
    return f"SUBSTRING({s}, 1, CASE WHEN ({n}) >= 0 THEN ({n}) ELSE GREATEST(CHAR_LENGTH({s}) + ({n}), 0) END)"


def _right(s: str, n: str) -> str:
    kept = f"CASE WHEN ({n}) >= 0 THEN LEAST(({n}), CHAR_LENGTH({s})) ELSE GREATEST(CHAR_LENGTH({s}) + ({n}), 0) END"
    return f"SUBSTRING({s}, CHAR_LENGTH({s}) - {kept} + 1, {kept})"


def _initcap(s: str) -> str:
    runs = f"REGEXP_EXTRACT_ALL({s}, '[\\\\p{{L}}\\\\p{{N}}]+|[^\\\\p{{L}}\\\\p{{N}}]+', 0)"
    return f"ARRAY_JOIN(TRANSFORM({runs}, _w -> CONCAT(UPPER(SUBSTRING(_w, 1, 1)), LOWER(SUBSTRING(_w, 2)))), '')"


def _chr(n: str) -> str:
    def tail(shift: int) -> str:
        return f"HEX(128 | (SHIFTRIGHT({n}, {shift}) & 63))"

    heads = [(2048, f"HEX(192 | SHIFTRIGHT({n}, 6)), {tail(0)}"), (65536, f"HEX(224 | SHIFTRIGHT({n}, 12)), {tail(6)}, {tail(0)}")]
    wide = " ".join(f"WHEN {n} < {limit} THEN CONCAT({digits})" for limit, digits in heads)
    last = f"CONCAT(HEX(240 | SHIFTRIGHT({n}, 18)), {tail(12)}, {tail(6)}, {tail(0)})"
    bad = f"WHEN {n} <= 0 OR {n} > 1114111 THEN {_error('54000', 'character number is out of range')}"
    return f"CASE {bad} WHEN {n} < 128 THEN CHAR({n}) ELSE DECODE(UNHEX(CASE {wide} ELSE {last} END), 'UTF-8') END"


def _to_hex(n: str) -> str:
    return f"LOWER(HEX(IF(TYPEOF({n}) IN ('int', 'smallint', 'tinyint'), ({n}) & 4294967295, ({n}))))"


def _regexp_replace(s: str, pattern: str, new: str, flags: str = "''") -> str:
    """The first match only without flag g; ``\\1`` and ``\\&`` refer to groups."""
    pattern, new, flags = _wanted(pattern, "the pattern"), _wanted(new, "the replacement"), _wanted(flags, "the flags")
    pattern = ("(?i)" if "i" in flags else "") + pattern
    groups = re.compile(pattern).groups

    def java(shift: int) -> str:
        return re.sub(r"\\([0-9&])", lambda m: "$" + str((0 if m[1] == "&" else int(m[1])) + shift), new.replace("$", "\\$"))

    if "g" in flags:
        return f"REGEXP_REPLACE({s}, {quoted(pattern)}, {quoted(java(0))})"
    if re.search(r"\\[1-9]", pattern):
        raise CallError("0A000: back-references within a pattern need flag g")
    return f"REGEXP_REPLACE({s}, {quoted(f'(?s)^(.*?)({pattern})(.*)$')}, {quoted('$1' + java(2) + f'${groups + 3}')})"


def _format(pattern: str, *args: str) -> str:
    parts, rest = [], iter(args)
    for piece in re.split(r"(%[sIL%])", _wanted(pattern, "the format")):
        if piece == "%%":
            parts.append("'%'")
        elif re.fullmatch("%[sIL]", piece):
            arg = f"CAST({next(rest)} AS STRING)"
            parts.append({"%s": f"COALESCE({arg}, '')", "%I": _quote_ident(arg), "%L": f"COALESCE({_quote_literal(arg)}, 'NULL')"}[piece])
        elif piece:
            parts.append(quoted(piece))
    return f"CONCAT({', '.join(parts)})" if parts else "''"


def _quote_ident(s: str) -> str:
    return f"""CASE WHEN {s} RLIKE '^[_a-z][_a-z0-9]*$' THEN {s} ELSE CONCAT('"', REPLACE({s}, '"', '""'), '"') END"""


def _quote_literal(s: str) -> str:
    return f"""CONCAT("'", REPLACE(CAST({s} AS STRING), "'", "''"), "'")"""


def _string_to_array(s: str, sep: str) -> str:
    sep = _wanted(sep, "the delimiter")
    parts = f"SPLIT({s}, {quoted(re.escape(sep))}, -1)" if sep else f"ARRAY({s})"
    return f"CASE WHEN {s} = '' THEN CAST(ARRAY() AS ARRAY<STRING>) ELSE {parts} END"


def _trunc(x: str, places: str = "0") -> str:
    if not re.fullmatch(r"\s*-?\s*\d+\s*", places):
        raise CallError("0A000: the digits of trunc must be a literal")
    n = int(places.replace(" ", ""))
    unit = "1" + "0" * -n if n <= 0 else "0." + "0" * (n - 1) + "1"
    return f"(({x}) - ({x}) % {unit})"


def _positive(x: str, value: str, what: str = "logarithm") -> str:
    state = "2201E" if what == "logarithm" else "2201F"
    rules = [f"WHEN ({x}) < 0 THEN {_error(state, f'cannot take {what} of a negative number')}"]
    if what == "logarithm":
        rules.insert(0, f"WHEN ({x}) = 0 THEN {_error(state, 'cannot take logarithm of zero')}")
    return f"CASE {' '.join(rules)} ELSE {value} END"


def _log(x: str, y: str | None = None) -> str:
    if y is None:
        return _positive(x, f"LOG10({x})")
    return f"({_positive(y, f'LN({y})')} / {_positive(x, f'LN({x})')})"


def _century(x: str) -> str:
    return f"CAST(CASE WHEN YEAR({x}) > 0 THEN FLOOR((YEAR({x}) + 99) / 100) ELSE -FLOOR((99 - YEAR({x})) / 100) - 1 END AS INT)"


_FIELDS: dict[str, Callable[[str], str]] = {
    "dow": lambda x: f"(DAYOFWEEK({x}) - 1)", "isodow": lambda x: f"(WEEKDAY({x}) + 1)", "doy": lambda x: f"DAYOFYEAR({x})", "decade": lambda x: f"CAST(FLOOR(YEAR({x}) / 10) AS INT)",
    "century": _century, "isoyear": lambda x: f"EXTRACT(YEAROFWEEK FROM {x})", "milliseconds": lambda x: f"(EXTRACT(SECOND FROM {x}) * 1000)",
    "microseconds": lambda x: f"CAST(EXTRACT(SECOND FROM {x}) * 1000000 AS BIGINT)", "epoch": lambda x: f"(UNIX_MICROS(CAST({x} AS TIMESTAMP)) / CAST(1000000 AS DECIMAL(7, 0)))",
}
_PLAIN_FIELDS = {"year", "month", "day", "hour", "minute", "second", "week", "quarter"}


def _field(name: str, x: str) -> str:
    name = name.strip().strip("'").lower()
    if name in _FIELDS:
        return _FIELDS[name](x)
    if name not in _PLAIN_FIELDS:
        raise CallError(f"22023: unit {name!r} is not supported")
    return f"EXTRACT({name.upper()} FROM {x})"


def _extract(inside: str) -> str:
    m = re.fullmatch(r"(?s)\s*('?\w+'?)\s+from (.*)", inside)
    if not m:
        raise CallError("42601: EXTRACT takes a field and a source")
    return _field(m[1], m[2])


def _date_trunc(unit: str, x: str) -> str:
    name = _wanted(unit, "the unit").lower()
    if name in ("decade", "century"):
        step, shift = (10, 0) if name == "decade" else (100, 1)
        return f"CAST(MAKE_DATE(CAST(FLOOR((YEAR({x}) - {shift}) / {step}) * {step} + {shift} AS INT), 1, 1) AS TIMESTAMP_NTZ)"
    name = {"milliseconds": "millisecond", "microseconds": "microsecond"}.get(name, name)
    return f"CAST(DATE_TRUNC({quoted(name)}, {x}) AS TIMESTAMP_NTZ)"


def _to_char(x: str, pattern: str) -> str:
    text = _wanted(pattern, "the template")
    token = re.compile("|".join(sorted(_PATTERNS, key=len, reverse=True)))
    if not token.search(text):
        places = len(re.sub("[^09]", "", text.partition(".")[2]))
        return f"CAST(CAST(ROUND(CAST({x} AS DECIMAL(38, 10)), {places}) AS DECIMAL(38, {places})) AS STRING)"
    out, at = [], 0
    for m in token.finditer(text):
        out += [f"'{text[at : m.start()]}'"] * (m.start() > at) + [_PATTERNS[m[0]]]
        at = m.end()
    out += [f"'{text[at:]}'"] * (at < len(text))
    return f"DATE_FORMAT({x}, {quoted(''.join(out))})"


def _age(later: str, earlier: str | None = None) -> str:
    later, earlier = (later, earlier) if earlier else ("CURRENT_DATE()", later)
    return f"(CAST({later} AS TIMESTAMP_NTZ) - CAST({earlier} AS TIMESTAMP_NTZ))"


def _typeof(x: str) -> str:
    inner = f"REGEXP_REPLACE(REGEXP_REPLACE(TYPEOF({x}), '^array<(.*)>$', '$1'), '\\\\(.*\\\\)$', '')"
    names = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in (_TYPE_NAMES | {"decimal": "numeric"}).items())
    return f"CONCAT(CASE {inner} {names} ELSE {inner} END, IF(STARTSWITH(TYPEOF({x}), 'array'), '[]', ''))"


def _div(a: str, b: str) -> str:
    return f"CAST((({a}) - ({a}) % ({b})) / ({b}) AS DECIMAL(38, 0))"


def series(start: str, stop: str, step: str | None = None) -> str:
    """The array of generate_series(start, stop, step); empty where the step leads away."""
    decimal = re.compile(r"\d+\.\d*|\.\d+")
    none = f"SLICE(SEQUENCE({start}, {start}), 1, 0)"
    if any(decimal.search(part) and "'" not in part for part in (start, stop, step or "")):
        by = step or "1"
        count = f"FLOOR((({stop}) - ({start})) / ({by}))"
        return f"CASE WHEN {count} >= 0 THEN TRANSFORM(SEQUENCE(0, CAST({count} AS INT)), _i -> ({start}) + _i * ({by})) ELSE SLICE(ARRAY(({start}) + 0 * ({by})), 1, 0) END"
    if step is None or re.match(r"\s*(\d|INTERVAL '\s*\d)", step):
        return f"CASE WHEN ({start}) <= ({stop}) THEN SEQUENCE({start}, {stop}, {step or '1'}) ELSE {none if step is None or 'INTERVAL' not in step else f'SLICE(SEQUENCE({start}, {start}, {step}), 1, 0)'} END"
    if re.match(r"\s*-", step) or "INTERVAL '-" in step:
        return f"CASE WHEN ({start}) >= ({stop}) THEN SEQUENCE({start}, {stop}, {step}) ELSE {none} END"
    ahead = f"(({step}) > 0 AND ({start}) <= ({stop})) OR (({step}) < 0 AND ({start}) >= ({stop}))"
    return f"CASE WHEN ({step}) = 0 THEN {_error('22023', 'step size cannot equal zero')} WHEN {ahead} THEN SEQUENCE({start}, {stop}, {step}) ELSE {none} END"


def _whole(x: str) -> str:
    return f"CAST({x} AS STRING)"


CALLS: dict[str, Callable[..., str]] = {
    "concat": lambda *a: f"CONCAT_WS('', {', '.join(map(_whole, a))})", "initcap": _initcap, "left": _left, "right": _right, "substr": _substring, "substring": _substring,
    "strpos": lambda s, part: f"INSTR({s}, {part})", "to_hex": _to_hex, "chr": _chr, "regexp_replace": _regexp_replace, "format": _format,
    "quote_ident": _quote_ident, "quote_literal": _quote_literal, "ltrim": lambda s, c="' '": f"TRIM(LEADING {c} FROM {s})", "rtrim": lambda s, c="' '": f"TRIM(TRAILING {c} FROM {s})",
    "btrim": lambda s, c="' '": f"TRIM(BOTH {c} FROM {s})", "starts_with": lambda s, p: f"STARTSWITH({s}, {p})", "character_length": lambda s: f"CHAR_LENGTH({s})",
    "length": lambda s: f"CHAR_LENGTH({s})", "replace": lambda s, a, b: f"CASE WHEN {a} = '' THEN {s} ELSE REPLACE({s}, {a}, {b}) END",
    "string_to_array": _string_to_array, "array_to_string": lambda a, sep, *null: f"ARRAY_JOIN(CAST({a} AS ARRAY<STRING>), {', '.join([sep, *null])})",
    "array_length": lambda a, d="1": f"CASE WHEN ({d}) = 1 THEN NULLIF(SIZE({a}), 0) END", "array_upper": lambda a, d="1": f"CASE WHEN ({d}) = 1 THEN NULLIF(SIZE({a}), 0) END",
    "array_lower": lambda a, d="1": f"CASE WHEN ({d}) = 1 AND SIZE({a}) > 0 THEN 1 END", "array_position": lambda a, x: f"NULLIF(ARRAY_POSITION({a}, {x}), 0)",
    "array_append": lambda a, x: f"CASE WHEN {a} IS NULL THEN ARRAY({x}) ELSE ARRAY_APPEND({a}, {x}) END",
    "log": _log, "log10": _log, "ln": lambda x: _positive(x, f"LN({x})"), "sqrt": lambda x: _positive(x, f"SQRT({x})", "square root"), "trunc": _trunc, "div": _div,
    "extract": _extract, "date_part": lambda f, x: f"CAST({_field(_wanted(f, 'the field'), x)} AS DOUBLE)", "date_trunc": _date_trunc, "to_char": _to_char, "age": _age,
    "transaction_timestamp": lambda: "CURRENT_TIMESTAMP()", "statement_timestamp": lambda: "CURRENT_TIMESTAMP()", "clock_timestamp": lambda: "CURRENT_TIMESTAMP()",
    "pg_typeof": _typeof, "gen_random_uuid": lambda: "UUID()", "current_schemas": lambda *_: "ARRAY('public')", "current_schema": lambda: "'public'",
    "split_part": lambda s, sep, n: f"CASE WHEN ({n}) = 0 THEN {_error('22023', 'field position must not be zero')} ELSE SPLIT_PART({s}, {sep}, {n}) END",
}

#: Names that stand without brackets.
WORDS = {"localtimestamp": "LOCALTIMESTAMP()", "current_role": "CURRENT_USER()", "user": "CURRENT_USER()", "session_user": "CURRENT_USER()", "current_schema": "'public'", "current_catalog": "CURRENT_DATABASE()"}
