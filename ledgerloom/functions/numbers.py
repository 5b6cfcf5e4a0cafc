"""Number, year and unit expressions. Each printed-number grammar is its own function; they differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = r"(?:19|20)\d\d"


def _double(text: Column) -> Column:
    return text.try_cast("double")


def parse_cell(text: Column) -> Column:
    """German table cell: grouped thousands, or one dot before three and more digits as decimals; English groups as a second try.

    ``166.825`` -> 166825, ``87.0596`` -> 87.0596, ``4.8`` -> null, ``10,696,470.77`` -> 10696470.77. Dashes and blanks are null.
    """
    t = F.trim(text)
    body = F.trim(F.regexp_replace(t, "^-+", ""))
    value = (
        F.when(body.rlike(r"^\d{1,3}(\.\d{3})+(,\d*)?$"), _double(F.translate(body, ",.", ".")))
        .when(body.rlike(r"^\d+\.\d{3,}$"), _double(body))
        .when(body.rlike(r"^\d+(,\d*)?$"), _double(F.replace(body, F.lit(","), F.lit("."))))
        .when(body.rlike(r"^\d{1,3}(,\d{3})+(\.\d*)?$"), _double(F.replace(body, F.lit(","), F.lit(""))))
    )
    return F.when(t.startswith("-"), -value).otherwise(value)


def parse_eur(text: Column, multiplier: Column) -> Column:
    """Cell in euros: brackets are negative, a leading plus is ignored, then ``parse_cell`` times the table's multiplier."""
    t = F.trim(text)
    bracketed = t.rlike(r"^\(.*\)$")
    inner = F.when(bracketed, F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)
    value = parse_cell(F.regexp_replace(inner, r"^\+\s*", ""))
    return F.when(bracketed, -F.abs(value)).otherwise(value) * multiplier


def prose_number(text: Column) -> Column:
    """Number in prose: a comma makes it German; otherwise dots group when there are several or the whole is grouped."""
    t = F.regexp_replace(F.regexp_replace(text, r"\s", ""), "[−–]", "-")
    grouped = t.rlike(r"^[+-]?\d{1,3}(\.\d{3})+$") | t.rlike(r"\..*\.")
    plain = F.when(F.contains(t, F.lit(",")), F.translate(t, ",.", ".")).when(grouped, F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
    return _double(F.regexp_replace(plain, r"^\+", ""))


def segment_number(text: Column) -> Column:
    """Number in a segment table: per cent sign dropped, a comma makes it German, several dots group, one dot is decimal."""
    t = F.regexp_replace(text, r"[%\s]", "")
    plain = F.when(F.contains(t, F.lit(",")), F.translate(t, ",.", ".")).when(t.rlike(r"\..*\."), F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
    return F.when(F.trim(text).rlike(r"^[+\-\s]*[\d.,]+\s*%?$"), _double(F.regexp_replace(plain, r"^\+", "")))


def max_year(text: Column) -> Column:
    """Latest four-digit year that stands between non-digits: a period header is keyed by its end."""
    years = F.transform(F.regexp_extract_all(text, F.lit(rf"(?<!\d)({YEAR})(?!\d)"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_max(years)


def sheet_year(sheet: Column) -> Column:
    """Fiscal year named in a sheet title as FYyyyy."""
    return F.nullif(F.regexp_extract(sheet, r"(?i)FY\s*(20\d\d)", 1), F.lit("")).cast("int")


def source_unit(text: Column) -> Column:
    """TEUR where a thousand-euro token occurs, else EUR where a euro token occurs, else null."""
    t = F.lower(text)
    return F.when(t.rlike("t€|teur|teuro|t euro"), "TEUR").when(t.rlike("€|eur"), "EUR")


def thousand_euro(text: Column) -> Column:
    """Whether a table's text declares thousands of euros."""
    return F.lower(text).rlike(r"t(?:eur|euro|sd\.?)|t€")


# Dates in prose, printed short or with the month's name.
DATE = r"(?iu)\b\d{1,2}\.\d{1,2}\.20\d\d\b|\b(?:zum|ab|seit)\s+\d{1,2}\.\s*(?:januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember)\s+20\d\d\b"


def prose_amounts(sentence: Column, unit: Column) -> Column:
    """All numbers of a sentence in euros, dates left out; empty where no unit is known."""
    bare = F.regexp_replace(sentence, DATE, "")
    found = F.regexp_extract_all(bare, F.lit(r"(?<!\w)((?:[+\-−–]\s*)?(?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d+)?)(?!\w)"), F.lit(1))
    scale = F.when(unit == "TEUR", 1000.0).otherwise(1.0)
    return F.when(unit.isNull(), F.array().cast("array<double>")).otherwise(F.transform(found, lambda x: prose_number(x) * scale))


def shown(value: Column, digits: int = 1) -> Column:
    """A figure as a statement prints it: fixed digits, negative ones in brackets."""
    body = F.format_string(f"%.{digits}f", F.abs(value))
    return F.when(value < 0, F.concat(F.lit("("), body, F.lit(")"))).otherwise(body)


def millions(value: Column, digits: int = 1) -> Column:
    """Euros shown in millions."""
    return shown(F.round(value / 1e6, digits), digits)


def export_number(text: Column) -> Column:
    """What an export writes for a cell: a plain machine number as it is, else the printed German number, else null."""
    return F.coalesce(F.when(text.rlike(r"^-?\d+\.\d{1,2}$"), _double(text)), parse_cell(text))


def leading_number(text: Column) -> Column:
    """Digits a text begins with, as a number."""
    return F.nullif(F.regexp_extract(text, r"^\s*(\d+)", 1), F.lit("")).try_cast("int")


def start_year(text: Column) -> Column:
    """First year a period names (2019/2020, 'vom 1.7.2019 bis zum 30.6.2020': 2019)."""
    return F.nullif(F.regexp_extract(text, rf"({YEAR})", 1), F.lit("")).cast("int")


def end_year(text: Column) -> Column:
    """Last year a period names."""
    return F.nullif(F.regexp_extract(text, rf"({YEAR})\D*$", 1), F.lit("")).cast("int")


def days_late(published: Column, deadline: Column) -> Column:
    """Days after the deadline, never negative; null without a deadline."""
    return F.when(published.isNotNull() & deadline.isNotNull(), F.greatest(F.lit(0), F.datediff(published, deadline)))


def within_cent(a: Column, b: Column) -> Column:
    """Equal to a cent, or to a billionth of the larger amount."""
    return F.abs(a - b) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)), F.lit(0.01))
