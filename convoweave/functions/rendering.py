"""Markdown, file names, labels and bars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wikilink(title: Column, alias: Column | None = None) -> Column:
    clean = lambda c: F.trim(F.translate(c, "[]|#^\\", ""))
    t = clean(title)
    plain = F.concat(F.lit("[["), t, F.lit("]]"))
    if alias is None:
        return plain
    a = clean(alias)
    return F.when((a != "") & (a != t), F.concat(F.lit("[["), t, F.lit("|"), a, F.lit("]]"))).otherwise(plain)


def sanitize_filename(title: Column, longest: int = 200) -> Column:
    x = F.btrim(F.translate(title, '<>:"/\\|?*', "-" * 9), F.lit(". "))
    cut = F.left(x, F.lit(longest))
    at_space = F.regexp_extract(cut, r"(?s)^(.*) [^ ]*$", 1)
    x = F.when(F.length(x) > longest, F.coalesce(F.nullif(at_space, F.lit("")), cut)).otherwise(x)
    return F.when(x == "", "Untitled").otherwise(x)


def escape_yaml(value: Column) -> Column:
    x = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.replace(F.replace(x, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


def strength_label(strength: Column) -> Column:
    return F.when(strength >= 0.8, "strong").when(strength >= 0.5, "moderate").otherwise("weak")


def callout(role: Column, content: Column) -> Column:
    head = F.when(role == "human", "> [!question]+ Human").otherwise("> [!info]+ Assistant")
    lines = F.transform(F.split(content, "\n"), lambda x: F.when(x == "", ">").otherwise(F.concat(F.lit("> "), x)))
    return F.concat_ws("\n", head, F.array_join(lines, "\n"))


def duration_label(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(whole / 3600).cast("string"), F.lit("h "), F.floor((whole % 3600) / 60).cast("string"), F.lit("m")))
    )


def bar(count: Column, most: Column, width: int) -> Column:
    return F.repeat(F.lit("#"), F.floor(count / most * width).cast("int"))


def seconds_label(seconds: float) -> str:
    """``duration_label`` for a number."""
    if seconds < 60:
        return f"{seconds:.1f}s"
    return f"{int(seconds // 60)}m {int(seconds % 60)}s" if seconds < 3600 else f"{int(seconds // 3600)}h {int(seconds % 3600 // 60)}m"


def size_label(size: int) -> str:
    return f"{size / 1024:.1f} KB" if size < 1024 * 1024 else f"{size / 1024 / 1024:.1f} MB"


def size(n: Column) -> Column:
    """``size_label`` for a column."""
    return F.when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / 1024, 1))).otherwise(F.format_string("%.1f MB", F.bround(n / 1024 / 1024, 1)))
