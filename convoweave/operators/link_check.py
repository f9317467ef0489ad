"""Link check and quality report of a vault's pages, made from their text alone.

``page_lines`` has (path, section, line) at least. Links are ``[[target]]``, ``[[target|shown]]``, ``[[target#heading]]``
and the embedded ``![[target]]``; a link to a heading of its own page is none. A target means every page that answers to
it, whatever the case of letters: by its path without ``.md``, its file name, the title in its head, or an alias. Of
several the page with the shortest path, then the least, is the one that is reached, and the link is ambiguous.

Links are counted by page and target before anything is joined, and a target has one row on the other side, so no pair of
pages is made however often a target is named. Null lines hold nothing. An empty vault gives empty frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoweave.operators.pages import INDEX, block, lines, union

LINK = r"\[\[([^\[\]\n]+)\]\]"
REPORT = f"{INDEX}/Link Report.md"


def key(name: Column) -> Column:
    """What a name and a link to it have in common."""
    return F.lower(F.trim(F.translate(name, "[]|#^\\", "")))


def targets(page_lines: DataFrame, written: bool = False) -> DataFrame:
    """(path, target, n): what each page links to, and how often; ``written`` gives a row for each way the link is written."""
    found = page_lines.select("path", F.explode(F.regexp_extract_all("line", F.lit(LINK), F.lit(1))).alias("x"))
    named = found.select("path", "x", key(F.regexp_replace(F.regexp_replace("x", r"(?s)[|#].*", ""), r"\.md\s*$", "")).alias("target"))
    ways = ["x"] if written else []
    return named.where("target <> ''").groupBy("path", "target", *ways).agg(F.count("*").alias("n")).drop("x")


def names(page_lines: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(target, found, pages): the page that a name reaches and how many answer to it; ``aliases``: (path, name)."""
    whole = F.regexp_replace("path", r"\.md$", "")
    paths = page_lines.select("path").distinct()
    title = F.regexp_extract("line", r'(?m)^title: "(.*)"$', 1)
    parts = [
        paths.select("path", key(whole).alias("target")),
        paths.select("path", key(F.element_at(F.split(whole, "/"), -1)).alias("target")),
        page_lines.where("section = 0 OR section = 1").select("path", key(title).alias("target")),
    ]
    if aliases is not None:
        parts.append(aliases.join(paths, "path", "left_semi").select("path", key(F.col("name")).alias("target")))
    every = union(*parts).where("target <> ''").distinct()
    return every.groupBy("target").agg(F.min_by("path", F.struct(F.length("path"), "path")).alias("found"), F.count("*").alias("pages"))


def check(page_lines: DataFrame, aliases: DataFrame | None = None, written: bool = False) -> DataFrame:
    """(path, target, n, found, pages): every link with the page it reaches, null and 0 for a broken one; ``written`` as in ``targets``."""
    return targets(page_lines, written).join(names(page_lines, aliases), "target", "left").select(
        "path", "target", "n", "found", F.coalesce("pages", F.lit(0)).cast("bigint").alias("pages")
    )


def page_quality(page_lines: DataFrame, checked: DataFrame) -> DataFrame:
    """(path, n_lines, links, broken, ambiguous, backlinks, orphan) of every page.

    ``backlinks`` counts the other pages that reach this one, however often each does; without any it is an orphan.
    """
    sizes = page_lines.groupBy("path").agg(F.count("line").alias("n_lines"))
    out = checked.groupBy("path").agg(
        F.sum("n").alias("links"), F.sum(F.when(F.col("pages") == 0, F.col("n")).otherwise(0)).alias("broken"),
        F.sum(F.when(F.col("pages") > 1, F.col("n")).otherwise(0)).alias("ambiguous"),
    )
    met = checked.where("found <> path").select("path", "found").distinct().groupBy(F.col("found").alias("path")).agg(F.count("*").alias("backlinks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = sizes.join(out, "path", "left").join(met, "path", "left")
    return joined.select("path", "n_lines", *map(zero, ("links", "broken", "ambiguous", "backlinks")), (F.coalesce("backlinks", F.lit(0)) == 0).alias("orphan"))


def totals(quality: DataFrame) -> DataFrame:
    """One row: pages_checked, links_checked, links_broken, links_ambiguous, orphans."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return quality.agg(F.count("*").alias("pages_checked"), total("links", "links_checked"), total("broken", "links_broken"), total("ambiguous", "links_ambiguous"), F.count_if("orphan").alias("orphans"))


def report_lines(checked: DataFrame, quality: DataFrame) -> DataFrame:
    """Lines of the report: totals, what broken targets are named by how many pages, ambiguous ones, orphans."""
    p = F.lit(REPORT)
    code = lambda c: F.concat(F.lit("- `"), c, F.lit("`"))
    found = totals(quality)
    said = F.concat(F.lit("# Link Report\n\nChecked "), F.col("links_checked").cast("string"), F.lit(" links on "), F.col("pages_checked").cast("string"), F.lit(" pages: "), F.col("links_broken").cast("string"), F.lit(" broken, "), F.col("links_ambiguous").cast("string"), F.lit(" ambiguous.\n"))
    by_target = checked.groupBy("target", "found", "pages").agg(F.sum("n").alias("n"))
    times = F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return union(
        lines(found, p, 0, said),
        block("## Broken Links", by_target.where("pages = 0"), p, 1, F.concat(code(F.col("target")), times), b=-F.col("n"), c=F.col("target")),
        block("## Ambiguous Links", by_target.where("pages > 1"), p, 4, F.concat(code(F.col("target")), times, F.lit(": "), F.col("pages").cast("string"), F.lit(" pages, the first is `"), "found", F.lit("`")), b=-F.col("n"), c=F.col("target")),
        block("## Orphans", quality.where("orphan"), p, 7, code(F.col("path")), c=F.col("path")),
    )
