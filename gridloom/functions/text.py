"""String expressions: escapes, names, codes, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xml_escape(c: Column) -> Column:
    for raw, put in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(put))
    return c


def csv_field(c: Column) -> Column:
    """RFC 4180: quoted where it holds a comma, quote or line end; quotes doubled."""
    return F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def safe_file_name(c: Column) -> Column:
    """Characters that file systems refuse become hyphens; an empty name becomes ``pattern``."""
    clean = F.trim(F.regexp_replace(c, r'[\\/:*?"<>|]+', "-"))
    return F.when(clean == "", F.lit("pattern")).otherwise(clean)


def sheet_name(c: Column) -> Column:
    """At most 31 characters without those that spreadsheets refuse."""
    clean = F.trim(F.regexp_replace(c, r"[\\/*?:\[\]]", " "))
    return F.substring(F.when(clean == "", F.lit("Sheet")).otherwise(clean), 1, 31)


def column_name(index: Column) -> Column:
    """Spreadsheet column of a number from 1 (A .. Z, AA ..), up to three letters."""
    n = index - 1
    letter = lambda k: F.char(65 + k)
    one, two = n, n - 26
    three = n - 26 - 676
    return (
        F.when(n < 26, letter(one))
        .when(n < 26 + 676, F.concat(letter(F.floor(two / 26)), letter(F.pmod(two, F.lit(26)))))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.pmod(F.floor(three / 26), F.lit(26))), letter(F.pmod(three, F.lit(26)))))
    )


def parse_hex(c: Column) -> tuple[Column, Column, Column]:
    return tuple(F.conv(F.substring(c, at, 2), 16, 10).cast("int") for at in (2, 4, 6))


def fixed4(c: Column) -> Column:
    """At most four decimals, without trailing zeros."""
    text = F.format_string("%.4f", F.floor(c * 10000 + 0.5) / 10000)
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def parse_codes(c: Column) -> Column:
    """Distinct codes of a list separated by white space or commas, in upper case, in order of first sight."""
    return F.array_distinct(F.filter(F.split(F.upper(c), r"[\s,，]+"), lambda x: x != ""))


def palette_group(code: Column) -> Column:
    return F.when(F.startswith(code, F.lit("ZG")), F.lit("ZG")).otherwise(F.substring(code, 1, 1))


def sha256_id(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def character_error_rate(truth: Column, found: Column) -> Column:
    """Edit distance over the truth's length; an empty truth counts any found text as one."""
    n = F.length(truth)
    return F.when(n == 0, F.when(F.length(found) == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.levenshtein(truth, found) / n)
