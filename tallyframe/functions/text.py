"""Text functions: clean-up, statement tests, placeholders, number formats."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and prefixes that decide whether a statement only
# reads, and the white space that separates words.
READ_STARTS = ("SELECT", "WITH")
WRITE_WORDS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER",
    "CREATE", "ATTACH", "PRAGMA", "VACUUM", "REPLACE",
)
SPACES = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_STARTS = rf"(?iU)^\s*({'|'.join(READ_STARTS)})\b"
_WRITES = rf"(?iU)\b({'|'.join(WRITE_WORDS)})\b"
_SORTED = r"(?iU)\border\s+by\b"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_space(col: str | Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(_c(col), F.lit(SPACES))


def collapse_space(col: str | Column) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    blanks = F.translate(_c(col), SPACES, " " * len(SPACES))
    return F.btrim(F.regexp_replace(blanks, " {2,}", " "))


def starts_as_read(col: str | Column) -> Column:
    return _c(col).rlike(_STARTS)


# Letters outside ASCII that a search without regard to case takes for i or s.
_LOOKALIKES = ("\u017f", "\u0131", "\u0130")


def _holds_any(col: str | Column, words: Iterable[str]) -> Column:
    """A plain search that spares most texts the regular expression."""
    lower = F.lower(_c(col))
    plain = [F.contains(lower, F.lit(w.lower())) for w in words]
    odd = [F.contains(_c(col), F.lit(c)) for c in _LOOKALIKES]
    return reduce(Column.__or__, plain + odd)


def has_write_word(col: str | Column) -> Column:
    return _holds_any(col, WRITE_WORDS) & _c(col).rlike(_WRITES)


def asks_for_order(col: str | Column) -> Column:
    """True if the statement holds ORDER BY anywhere, subqueries included."""
    return _holds_any(col, ["order"]) & _c(col).rlike(_SORTED)


def quoted(col: str | Column) -> Column:
    """Text in quotes with control characters escaped, for messages."""
    out = F.replace(_c(col), F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    single, double = F.lit("'"), F.lit('"')
    return F.when(
        F.contains(out, single) & ~F.contains(out, double), F.concat(double, out, double)
    ).otherwise(F.concat(single, F.replace(out, single, F.lit("\\'")), single))


def fill(template: str | Column, name: str | Column, value: str | Column) -> Column:
    """Put ``value`` where the template holds ``{name}``; no value, no change."""
    mark = F.concat(F.lit("{"), _c(name), F.lit("}"))
    return F.coalesce(F.replace(_c(template), mark, _c(value)), _c(template))


def without_fence(col: str | Column) -> Column:
    """Drop a code fence around the text: the whole opening line, and the
    closing line if the text ends in one."""
    text = strip_space(col)
    fence = F.lit("```")
    first_break = F.locate("\n", text)
    body = F.when(first_break > 0, F.substr(text, first_break + 1)).otherwise(F.lit(""))
    last_line = F.substring_index(body, "\n", -1)
    before_last = F.left(body, F.greatest(F.length(body) - F.length(last_line) - 1, F.lit(0)))
    inner = F.when(F.startswith(strip_space(last_line), fence), before_last).otherwise(body)
    return F.when(F.startswith(text, fence), strip_space(inner)).otherwise(text)


def padded_id(prefix: str | Column, number: str | Column, width: int = 4) -> Column:
    """``prefix-0007``; a number longer than the width keeps all its digits."""
    return F.format_string(f"%s-%0{width}d", _c(prefix), _c(number))


def fixed(col: str | Column, places: int = 0) -> Column:
    """Fixed-point text; a tie goes to the even digit."""
    return F.format_string(f"%.{places}f", F.bround(_c(col).cast("double"), places))


def percent(col: str | Column, places: int = 1) -> Column:
    return F.concat(fixed(_c(col).cast("double") * 100, places), F.lit("%"))


def dollars(col: str | Column, places: int = 4, missing: str = "n/a") -> Column:
    shown = F.concat(F.lit("$"), fixed(col, places))
    return F.when(_c(col).isNull(), F.lit(missing)).otherwise(shown)


def iso_seconds(col: str | Column) -> Column:
    return F.date_format(_c(col), "yyyy-MM-dd'T'HH:mm:ss")
