"""String functions, counted in code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import guarded


def _text(x: Column) -> Column:
    return x.cast("string")


def initcap(s: Column) -> Column:
    """A capital at the start of every run of letters and digits, small letters after."""
    runs = F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, F.lit(1), F.lit(1))), F.lower(F.substring(w, F.lit(2), F.char_length(w))))), "")


def substr(s: Column, start: Column, length: Column | None = None) -> Column:
    """Positions below one count but hold nothing; a negative length is an error."""
    first = F.greatest(start, F.lit(1))
    if length is None:
        return F.substring(s, first, F.char_length(s))
    return guarded(length < 0, "22011", "negative substring length not allowed", F.substring(s, first, F.greatest(start + length - first, F.lit(0))))


def btrim(s: Column, chars: Column | None = None) -> Column:
    return F.btrim(s, chars if chars is not None else F.lit(" "))


def ltrim(s: Column, chars: Column | None = None) -> Column:
    return F.ltrim(s, chars if chars is not None else F.lit(" "))


def rtrim(s: Column, chars: Column | None = None) -> Column:
    return F.rtrim(s, chars if chars is not None else F.lit(" "))


def replace(s: Column, old: Column, new: Column) -> Column:
    return F.when(old == "", s).otherwise(F.replace(s, old, new))


def strpos(s: Column, part: Column) -> Column:
    return F.position(part, s)


def concat(*args: Column) -> Column:
    """Nulls are left out."""
    return F.concat_ws("", *map(_text, args))


def concat_ws(sep: Column, *args: Column) -> Column:
    """Nulls are left out; a null separator gives null."""
    parts = F.filter(F.array(*map(_text, args)), lambda x: x.isNotNull())
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))
    return F.when(sep.isNotNull(), F.aggregate(rest, first, lambda a, x: F.concat(a, sep, x)))


def left(s: Column, n: Column) -> Column:
    """A negative count drops from the end."""
    return F.substring(s, F.lit(1), F.when(n >= 0, n).otherwise(F.greatest(F.char_length(s) + n, F.lit(0))))


def right(s: Column, n: Column) -> Column:
    """A negative count drops from the start."""
    size = F.char_length(s)
    kept = F.when(n >= 0, F.least(n, size)).otherwise(F.greatest(size + n, F.lit(0)))
    return F.substring(s, size - kept + 1, kept)


def _pad(f):
    def pad(s: Column, n: Column, fill: Column | None = None) -> Column:
        fill = fill if fill is not None else F.lit(" ")
        short = F.substring(s, F.lit(1), F.greatest(n, F.lit(0)))
        return F.when(n <= 0, F.lit("")).when((fill == "") | (F.char_length(s) >= n), short).otherwise(f(s, n, fill))

    return pad


def repeat(s: Column, n: Column) -> Column:
    return F.repeat(s, F.greatest(n, F.lit(0)))


def split_part(s: Column, sep: Column, n: Column) -> Column:
    return guarded(n == 0, "22023", "field position must not be zero", F.split_part(s, sep, n))


def char(n: Column) -> Column:
    """The character of any code point."""
    code = n.cast("long")

    def byte(base: int, shift: int, bits: int) -> Column:
        return F.lpad(F.hex(F.lit(base).bitwiseOR(F.shiftright(code, shift).bitwiseAND(F.lit(bits)))), 2, "0")

    two = F.concat(byte(0xC0, 6, 0x1F), byte(0x80, 0, 0x3F))
    three = F.concat(byte(0xE0, 12, 0x0F), byte(0x80, 6, 0x3F), byte(0x80, 0, 0x3F))
    four = F.concat(byte(0xF0, 18, 0x07), byte(0x80, 12, 0x3F), byte(0x80, 6, 0x3F), byte(0x80, 0, 0x3F))
    digits = F.when(code < 0x80, F.lpad(F.hex(code), 2, "0")).when(code < 0x800, two).when(code < 0x10000, three).otherwise(four)
    bad = (code <= 0) | (code > 0x10FFFF)
    return guarded(bad, "54000", "character number is out of range", F.decode(F.unhex(digits), "UTF-8"))


def to_hex(n: Column) -> Column:
    """Small hexadecimal digits; integers of up to 32 bits wrap at 32 bits."""
    return F.when(F.typeof(n).isin("int", "smallint", "tinyint"), to_hex32(n)).otherwise(F.lower(F.hex(n)))


def to_hex32(n: Column) -> Column:
    return F.lower(F.hex(n.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))


def quote_ident(s: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(s.rlike("^[_a-z][_a-z0-9]*$"), s).otherwise(quoted)


def quote_literal(s: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(_text(s), F.lit("'"), F.lit("''")), F.lit("'"))


def regexp_replace(s: Column, pattern: str, new: str, flags: str = "") -> Column:
    """The first match only, without flag g; flag i ignores case; ``\\1`` and ``\\&`` refer to groups."""
    pattern = ("(?i)" if "i" in flags else "") + pattern
    groups = re.compile(pattern).groups

    def java(shift: int) -> str:
        """The replacement in Java's form, its group numbers moved up by ``shift``."""
        escaped = new.replace("$", "\\$")
        return re.sub(r"\\([0-9&])", lambda m: "$" + str((0 if m[1] == "&" else int(m[1])) + shift), escaped)

    if "g" in flags:
        return F.regexp_replace(s, F.lit(pattern), F.lit(java(0)))
    if re.search(r"\\[1-9]", pattern):
        raise NotImplementedError("0A000: back-references within a pattern need flag g")
    # what is before the first match, the match, and the rest: the pattern's own groups follow number 2
    whole = f"(?s)\\A(.*?)({pattern})(.*)\\z"
    return F.regexp_replace(s, F.lit(whole), F.lit("$1" + java(2) + f"${groups + 3}"))


def formatted(pattern: str, *args: Column) -> Column:
    """%s text (null: nothing), %I identifier, %L literal (null: NULL), %% a percent sign."""
    parts, rest = [], iter(args)
    for piece in re.split(r"(%[sIL%])", pattern):
        if piece == "%%":
            parts.append(F.lit("%"))
        elif re.fullmatch("%[sIL]", piece):
            arg = next(rest)
            parts.append({
                "%s": lambda: F.coalesce(_text(arg), F.lit("")), "%I": lambda: quote_ident(_text(arg)),
                "%L": lambda: F.coalesce(quote_literal(arg), F.lit("NULL")),
            }[piece]())
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def string_to_array(s: Column, delimiter: str) -> Column:
    """The delimiter is literal; an empty string is an empty array."""
    if delimiter == "":
        return F.when(s == "", F.array().cast("array<string>")).otherwise(F.array(s))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, re.escape(delimiter), -1))


def array_to_string(a: Column, sep: str, null: str | None = None) -> Column:
    return F.array_join(a.cast("array<string>"), sep) if null is None else F.array_join(a.cast("array<string>"), sep, null)


FUNCTIONS = {
    "length": F.char_length, "char_length": F.char_length, "character_length": F.char_length, "octet_length": F.octet_length,
    "lower": F.lower, "upper": F.upper, "initcap": initcap, "substr": substr, "substring": substr, "btrim": btrim, "trim": btrim,
    "ltrim": ltrim, "rtrim": rtrim, "replace": replace, "translate": lambda s, a, b: F.call_function("translate", s, a, b),
    "strpos": strpos, "position": lambda part, s: F.position(part, s), "concat": concat, "concat_ws": concat_ws,
    "left": left, "right": right, "lpad": _pad(lambda s, n, f: F.call_function("lpad", s, n, f)), "rpad": _pad(lambda s, n, f: F.call_function("rpad", s, n, f)),
    "repeat": repeat, "reverse": F.reverse, "split_part": split_part, "starts_with": F.startswith, "md5": F.md5, "chr": char,
    "ascii": F.ascii, "to_hex": to_hex, "quote_ident": quote_ident, "quote_literal": quote_literal, "regexp_replace": regexp_replace,
    "format": formatted, "string_to_array": string_to_array, "array_to_string": array_to_string,
}
