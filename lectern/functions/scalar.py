"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends as text libraries with universal line breaks see them.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def ratio(num, den) -> Column:
    """num / den, 0 where den is 0."""
    num, den = (F.col(x) if isinstance(x, str) else x for x in (num, den))
    return F.when(den != 0, num.cast("double") / den).otherwise(F.lit(0.0))


def ratio_or_null(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den)


def number(value: Column, default: float = 0.0) -> Column:
    """A tolerant number: thousands commas dropped; null, NaN, infinite or unreadable text gives the default."""
    x = F.replace(value.cast("string"), F.lit(","), F.lit("")).try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(default)).otherwise(x)


def blank(line: Column) -> Column:
    return line.rlike(r"(?U)^\s*$")


def lines(text: Column) -> Column:
    """The lines of a text without their ends; no empty line after a final line end, none in an empty text."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def newlines(text: Column) -> Column:
    """Line ends as files are read in text mode."""
    return F.regexp_replace(text, "\r\n?", "\n")


def normalised_char(c: Column) -> Column:
    """A character for confusion counts: gaps and invisible ones as a symbol, white space as a space, foreign ones as OTHER."""
    return (
        F.when(c.isNull() | (c == "") | c.rlike(r"^\p{C}$"), "∅")
        .when(c.rlike(r"(?U)^\s$"), " ")
        .when(c.rlike(r"^[\p{IsLatin}\p{N}\p{P}\p{Zs}]$"), c)
        .otherwise("OTHER")
    )


def bin_label(bin_: Column) -> Column:
    """0 as 0-10% and so on."""
    return F.when(bin_.isNotNull(), F.concat((bin_ * 10).cast("int"), F.lit("-"), (bin_ * 10 + 10).cast("int"), F.lit("%")))


def line_band(delta: Column) -> Column:
    d = F.abs(delta)
    return F.when(d <= 0, "Stable").when(d <= 1, "Minor mismatch").when(d <= 3, "Moderate instability").otherwise("Severe instability")


def line_flag(delta: Column, unmatched: Column) -> Column:
    d = F.abs(delta)
    return F.when(d > 3, "review_line_structure").when((d > 1) | (unmatched > 0), "monitor_line_structure").otherwise("line_structure_ok")


def hash_share(style: Column, id_: Column) -> Column:
    """A number in [0, 1] from the md5 of style and id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", style, id_)), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def issue_id(doc: Column, tag: Column, start: Column, end: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", doc, tag, start, end)), 1, 12)


def excel_safe(value: Column) -> Column:
    """A leading quote where a spreadsheet would read a formula."""
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def display_percent(x: Column, digits: int = 2) -> Column:
    return F.concat(F.format_number(x * 100, digits), F.lit("%"))


def compound_id(doc_id: Column) -> tuple[Column, Column]:
    """The parts of 'stem:file' before and after the first colon; without one, the whole id twice."""
    cut = F.locate(":", doc_id)
    return F.when(cut > 0, F.substring(doc_id, F.lit(1), cut - 1)).otherwise(doc_id), F.when(cut > 0, F.substring(doc_id, cut + 1, F.length(doc_id))).otherwise(doc_id)


def folder_name(value: Column, limit: int = 180) -> Column:
    """Letters, digits, dots, hyphens and underscores; other runs become one underscore."""
    return F.substring(F.regexp_replace(value, r"[^\w.\-]+", "_"), 1, limit)


def reference_file(stem: Column) -> Column:
    return F.concat(stem, F.lit("_GT.txt"))


def display_count(x: Column) -> Column:
    return F.format_number(x, 0)


def display_number(x: Column, digits: int = 2) -> Column:
    return F.format_number(x, digits)


def display_points(x: Column, digits: int = 2) -> Column:
    """Percentage points with their sign."""
    return F.concat(F.when(x >= 0, "+").otherwise(""), F.format_number(x, digits), F.lit(" pp"))
