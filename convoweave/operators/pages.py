"""Markdown pages as frames of lines: (path, section, a, b, c, line).

A page is never one value: its lines are ordered by section, then a (text), b (number), c (text), and the sink streams
them to the file, so a page may list any number of notes. ``assemble`` joins small pages to (path, content).

Frames: ``notes`` (conv_id, title, created_at, category, summary, source_url), ``messages`` (conv_id, turn, role, text), ``tags``
(conv_id, rank, tag), ``lists`` (conv_id, kind, place, item) with kinds decision and action, ``concepts`` (conv_id, place, raw),
``related`` (conv_id, rank, target, title, strength).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoweave.functions import rendering as R
from convoweave.operators.annotation import describe
from convoweave.operators.graph import topk

# Folders, headings and limits of the pages.
NOTES, MOCS, INDEX = "Conversations", "MOCs", "000 Index"
SUMMARY, DECISIONS, ACTIONS, TALK, RELATED, SEE_ALSO, TAGS = "## Summary", "## Decisions", "## Action Items", "## Conversation", "## Related Notes", "## See Also", "## Tags"
MOST_CONCEPTS, MOC_CONCEPTS, MOC_TAGS, QUARTER_CONCEPTS = 10, 15, 20, 15
LEAST_CATEGORY, LEAST_TOPIC, LEAST_MONTH, LEAST_QUARTER, TOPIC_DEGREE, TOPICS = 3, 3, 3, 6, 5, 20
BANDS = (("High Frequency (10+ mentions)", 10, None), ("Medium Frequency (5-9 mentions)", 5, None), ("Low Frequency (2-4 mentions)", 2, 50), ("Single Mentions", 1, 20))
DEFAULT_STRENGTH = 0.5
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
NO_RANGE = "N/A"


def lines(df: DataFrame, path: Column, section: int, line: Column, a: Column | None = None, b: Column | None = None, c: Column | None = None) -> DataFrame:
    null = F.lit(None)
    return df.select(
        path.alias("path"), F.lit(section).alias("section"), (null if a is None else a).cast("string").alias("a"), (null if b is None else b).cast("double").alias("b"),
        (null if c is None else c).cast("string").alias("c"), line.alias("line"),
    )


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def assemble(page_lines: DataFrame) -> DataFrame:
    """(path, content) of pages that are small enough to be values."""
    rows = F.array_sort(F.collect_list(F.struct("section", "a", "b", "c", "line")))
    return page_lines.groupBy("path").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("content"))


def block(heading: str, df: DataFrame, path: Column, section: int, line: Column, a: Column | None = None, b: Column | None = None, c: Column | None = None) -> DataFrame:
    """A heading between blank lines, the lines and a blank line, only on pages that have any of the lines."""
    head = df.select(path.alias("path")).distinct()
    return union(
        lines(head, F.col("path"), section, F.lit(heading + "\n")), lines(df, path, section + 1, line, a, b, c), lines(head, F.col("path"), section + 2, F.lit(""))
    )


def note_path(notes: DataFrame, layout: str = "category") -> Column:
    """Where a note goes; ``layout`` is category, flat, by-date (year and month) or by-topic (as category)."""
    name = F.concat(R.sanitize_filename(F.col("title")), F.lit(".md"))
    folder = {"flat": F.lit(""), "by-date": F.concat(F.date_format("created_at", "yyyy/MM"), F.lit("/"))}.get(layout, F.concat(F.col("category"), F.lit("/")))
    return F.concat(F.lit(f"{NOTES}/"), folder, name)


def note_owners(notes: DataFrame, layout: str = "category") -> DataFrame:
    """The notes with their paths; of equal paths the last note is the one that stays."""
    placed = notes.withColumn("path", note_path(notes, layout))
    last = placed.groupBy("path").agg(F.max("conv_id").alias("conv_id"))
    return placed.join(last, ["path", "conv_id"], "left_semi")


def frontmatter(notes: DataFrame, tags: DataFrame, lists: DataFrame, concepts: DataFrame, related: DataFrame) -> DataFrame:
    """Lines of the notes' YAML heads; ``notes`` have paths. Keys of empty lists are left out."""
    p = F.col("path")
    here = notes.select("conv_id", "path")
    of = lambda df: df.join(here, "conv_id")
    quoted = lambda x: F.concat(F.lit('  - "'), R.escape_yaml(x), F.lit('"'))

    def listed(key: str, section: int, df: DataFrame, line: Column, place: Column) -> DataFrame:
        return union(lines(df.select("path").distinct(), p, section, F.lit(f"{key}:")), lines(df, p, section + 1, line, b=place))

    few = topk(of(concepts), ["path"], [F.col("place"), F.col("raw")], MOST_CONCEPTS, "k")
    return union(
        lines(notes, p, 0, F.lit("---")),
        lines(notes, p, 1, F.concat(F.lit('title: "'), R.escape_yaml(F.col("title")), F.lit('"'))),
        lines(notes, p, 2, F.concat(F.lit("date: "), F.date_format("created_at", "yyyy-MM-dd"))),
        lines(notes, p, 3, F.concat(F.lit("created: "), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"))),
        lines(notes, p, 4, F.concat(F.lit("category: "), "category")),
        listed("tags", 5, of(tags), F.concat(F.lit("  - "), "tag"), F.col("rank")),
        listed("decisions", 7, of(lists.where("kind = 'decision'")), quoted(F.col("item")), F.col("place")),
        listed("action_items", 9, of(lists.where("kind = 'action'")), quoted(F.col("item")), F.col("place")),
        listed("related", 11, of(related), F.concat(F.lit('  - "'), F.col("target").cast("string"), F.lit('"')), F.col("rank")),
        lines(notes.where(F.coalesce("source_url", F.lit("")) != ""), p, 13, F.concat(F.lit('source_url: "'), "source_url", F.lit('"'))),
        listed("concepts", 14, few, F.concat(F.lit("  - "), "raw"), F.col("k")),
        lines(notes, p, 16, F.lit("---\n")),
    )


def note_body(notes: DataFrame, messages: DataFrame, tags: DataFrame, lists: DataFrame, concepts: DataFrame, related: DataFrame) -> DataFrame:
    """Lines of the notes below their heads; empty sections are left out, the conversation itself always has its heading."""
    p = F.col("path")
    of = lambda df: df.join(notes.select("conv_id", "path"), "conv_id")
    item = lambda kind: of(lists.where(F.col("kind") == kind))
    few = topk(of(concepts), ["path"], [F.col("place"), F.col("raw")], MOST_CONCEPTS, "k")
    link = F.concat(F.lit("- "), R.wikilink(F.col("title")), F.lit(" "), R.strength_label(F.coalesce("strength", F.lit(DEFAULT_STRENGTH))))
    every_tag = of(tags).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: F.concat(F.lit("#"), x["tag"])), " ").alias("line"))
    return union(
        lines(notes, p, 20, F.concat(F.lit("# "), "title", F.lit("\n"))),
        block(SUMMARY, notes.where(F.coalesce("summary", F.lit("")) != ""), p, 21, F.col("summary")),
        block(DECISIONS, item("decision"), p, 24, F.concat(F.lit("- "), "item"), b=F.col("place")),
        block(ACTIONS, item("action"), p, 27, F.concat(F.lit("- [ ] "), "item"), b=F.col("place")),
        lines(notes, p, 30, F.lit(TALK + "\n")),
        lines(of(messages), p, 31, F.concat(R.callout(F.col("role"), F.col("text")), F.lit("\n")), b=F.col("turn")),
        block(RELATED, of(related.drop("title")).join(notes.select(F.col("conv_id").alias("target"), "title"), "target"), p, 33, link, b=F.col("rank")),
        block(SEE_ALSO, few, p, 36, F.concat(F.lit("- [["), "raw", F.lit("]]")), b=F.col("k")),
        block(TAGS, every_tag, p, 39, F.col("line")),
    )


def note_lines(notes: DataFrame, messages: DataFrame, tags: DataFrame, lists: DataFrame, concepts: DataFrame, related: DataFrame, layout: str = "category") -> DataFrame:
    placed = note_owners(notes, layout)
    return frontmatter(placed, tags, lists, concepts, related).unionByName(note_body(placed, messages, tags, lists, concepts, related))


# Maps of content --------------------------------------------------------------------------------------------------


def members(notes: DataFrame, tags: DataFrame, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(moc, kind, conv_id): which notes each map of content holds.

    Categories and months of three notes or more, and the best connected concepts with three notes or more. ``edges``: every
    logged edge between nodes, for the degrees of concepts.
    """
    by_category = notes.select(F.concat("category", F.lit(" MOC")).alias("moc"), F.lit("category").alias("kind"), "conv_id", F.lit(LEAST_CATEGORY).alias("least"))
    by_month = notes.select(F.date_format("created_at", "MMMM yyyy").alias("moc"), F.lit("month").alias("kind"), "conv_id", F.lit(LEAST_MONTH).alias("least"))
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).where(F.col("node").startswith("concept:"))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree")).where(F.col("degree") >= TOPIC_DEGREE).orderBy(F.desc("degree"), "node").limit(TOPICS)
    topic = concepts.select(F.concat(F.lit("concept:"), F.trim(F.lower("raw"))).alias("node"), "conv_id").distinct().join(degree, "node")
    by_topic = topic.select(F.concat(F.substring("node", 9, 1_000_000), F.lit(" MOC")).alias("moc"), F.lit("topic").alias("kind"), "conv_id", F.lit(LEAST_TOPIC).alias("least"))
    every = union(by_category, by_month, by_topic)
    kept = every.groupBy("moc", "kind", "least").agg(F.count("*").alias("notes")).where("notes >= least")
    return every.drop("least").join(kept.select("moc", "kind"), ["moc", "kind"], "left_semi")


def key_concepts(held: DataFrame, tags: DataFrame, concepts: DataFrame, k: int = MOC_CONCEPTS) -> DataFrame:
    """(moc, kind, rank, term, n): the most frequent concepts and tags, raw, of each map; a topic is not its own concept."""
    terms = concepts.select("conv_id", F.col("raw").alias("term")).unionByName(tags.select("conv_id", F.col("tag").alias("term")))
    counted = held.join(terms, "conv_id").where((F.col("kind") != "topic") | (F.concat(F.trim(F.lower("term")), F.lit(" MOC")) != F.col("moc")))
    return topk(counted.groupBy("moc", "kind", "term").agg(F.count("*").alias("n")), ["moc", "kind"], [F.desc("n"), F.col("term")], k)


def moc_lines(notes: DataFrame, tags: DataFrame, concepts: DataFrame, held: DataFrame) -> DataFrame:
    """Lines of the category, topic and month maps of ``held``."""
    path = F.concat(F.lit(f"{MOCS}/"), R.sanitize_filename(F.col("moc")), F.lit(".md")).alias("path")
    top = key_concepts(held, tags, concepts).withColumn("path", path)
    full = held.withColumn("path", path).join(notes.select("conv_id", "title", "created_at", "category"), "conv_id")
    mocs = full.groupBy("path", "moc", "kind").agg(F.count("*").alias("n"), F.count_distinct("category").alias("categories"))
    standard, monthly = mocs.where("kind <> 'month'"), mocs.where("kind = 'month'")
    p, newest = F.col("path"), -F.unix_micros(F.col("created_at").cast("timestamp"))
    dated = F.concat(F.lit("- "), R.wikilink(F.col("title")), F.lit(" ("), F.date_format("created_at", "yyyy-MM-dd"), F.lit(")"))
    topical = full.where("kind <> 'month'")
    groups = topical.select("path", "category").distinct()
    used = topk(topical.join(tags.select("conv_id", "tag"), "conv_id").select("path", "tag").distinct(), ["path"], [F.col("tag")], MOC_TAGS)
    used = used.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("tag")), lambda x: F.concat(F.lit("#"), x)), " ").alias("line"))
    shares = full.where("kind = 'month'").groupBy("path", "category").agg(F.count("*").alias("n"))
    few = top.where(F.col("rank") <= MOST_CONCEPTS)
    concept_line = F.concat(F.lit("- [["), "term", F.lit("]]"))
    return union(
        lines(mocs, p, 0, F.concat(F.lit('---\ntitle: "'), R.escape_yaml(F.col("moc")), F.lit('"\ntype: moc\ncategory: '), "kind")),
        lines(few.select("path").distinct(), p, 1, F.lit("key_concepts:")),
        lines(few, p, 2, F.concat(F.lit("  - "), "term"), b=F.col("rank")),
        lines(mocs, p, 3, F.concat(F.lit("---\n\n# "), "moc", F.lit("\n\n"), describe(F.regexp_replace("moc", " MOC$", "")), F.lit("\n"))),
        lines(standard, p, 4, F.concat(F.lit("## Overview\n\nThis map of content organizes **"), F.col("n").cast("string"), F.lit("** related conversations.\n"))),
        lines(monthly, p, 4, F.concat(F.lit("## Statistics\n\n- **Total Conversations**: "), F.col("n").cast("string"), F.lit("\n- **Categories**: "), F.col("categories").cast("string"), F.lit("\n"))),
        block("## By Category", shares, p, 5, F.concat(F.lit("- **"), "category", F.lit("**: "), F.col("n").cast("string"), F.lit(" conversations")), b=-F.col("n"), c=F.col("category")),
        block("## Key Concepts", few, p, 8, concept_line, b=F.col("rank")),
        lines(standard, p, 11, F.lit("## Notes\n")),
        lines(groups, p, 12, F.concat(F.lit("### "), "category", F.lit("\n")), a=F.col("category"), b=F.lit(float("-inf"))),
        lines(topical, p, 12, dated, a=F.col("category"), b=newest, c=F.col("title")),
        lines(groups, p, 12, F.lit(""), a=F.col("category"), b=F.lit(float("inf"))),
        block("## Conversations", full.where("kind = 'month'"), p, 14, dated, b=-newest, c=F.col("title")),
        block("## Related Tags", used, p, 17, F.col("line")),
    )


def quarter_lines(notes: DataFrame, tags: DataFrame, concepts: DataFrame) -> DataFrame:
    """Lines of the maps of quarters with six notes or more: their months in order, five categories, concepts."""
    named = notes.withColumn("moc", F.concat(F.lit("Q"), F.quarter("created_at").cast("string"), F.lit(" "), F.year("created_at").cast("string")))
    kept = named.groupBy("moc").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_QUARTER)
    full = named.join(kept, "moc").withColumn("path", F.concat(F.lit(f"{MOCS}/"), "moc", F.lit(".md")))
    p = F.col("path")
    months = full.groupBy("path", F.date_format("created_at", "MMMM yyyy").alias("month")).agg(F.min(F.unix_micros(F.col("created_at").cast("timestamp"))).alias("first"))
    areas = topk(full.groupBy("path", "category").agg(F.count("*").alias("n")), ["path"], [F.desc("n"), F.col("category")], 5)
    top = key_concepts(full.select("moc", F.lit("quarter").alias("kind"), "conv_id"), tags, concepts, QUARTER_CONCEPTS).withColumn("path", F.concat(F.lit(f"{MOCS}/"), "moc", F.lit(".md")))
    heads = full.select("path", "moc", "n").distinct()
    return union(
        lines(heads, p, 0, F.concat(F.lit('---\ntitle: "'), "moc", F.lit('"\ntype: moc\ncategory: quarter\nsub_mocs:'))),
        lines(months, p, 1, F.concat(F.lit('  - "'), "month", F.lit('"')), b=F.col("first")),
        lines(heads, p, 2, F.concat(F.lit("---\n\n# "), "moc", F.lit("\n\n"), F.col("n").cast("string"), F.lit(" conversations.\n"))),
        block("## Monthly Reviews", months, p, 3, F.concat(F.lit("- [["), "month", F.lit("]]")), b=F.col("first")),
        block("## Focus Areas", areas, p, 6, F.concat(F.lit("- [["), "category", F.lit(" MOC|"), "category", F.lit("]]")), b=F.col("rank")),
        block("## Key Concepts", top, p, 9, F.concat(F.lit("- [["), "term", F.lit("]]")), b=F.col("rank")),
    )


def master_lines(notes: DataFrame, held: DataFrame, top: DataFrame) -> DataFrame:
    """Lines of the map of maps: totals, maps by kind, the concepts that most maps list."""
    p = F.lit(f"{INDEX}/Master MOC.md")
    mocs = held.select("kind", "moc").distinct()
    totals = notes.agg(F.count("*").alias("notes")).withColumn("x", F.lit(1)).join(mocs.agg(F.count("*").alias("mocs"), F.count_distinct("kind").alias("kinds")).withColumn("x", F.lit(1)), "x")
    listed = top.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(20)
    text = F.concat(F.lit("# Vault Index\n\n## Quick Stats\n\n- **Total Conversations**: "), F.col("notes").cast("string"), F.lit("\n- **Maps of Content**: "), F.col("mocs").cast("string"), F.lit("\n- **Categories**: "), F.col("kinds").cast("string"), F.lit("\n\n## Browse by Category\n"))
    return union(
        lines(totals, p, 0, text),
        lines(mocs.select("kind").distinct(), p, 1, F.concat(F.lit("### "), "kind", F.lit("\n")), a=F.col("kind"), b=F.lit(0)),
        lines(mocs, p, 1, F.concat(F.lit("- [["), "moc", F.lit("]]")), a=F.col("kind"), b=F.lit(1), c=F.col("moc")),
        lines(mocs.select("kind").distinct(), p, 1, F.lit(""), a=F.col("kind"), b=F.lit(2)),
        block("## Top Concepts", listed, p, 2, F.concat(F.lit("- [["), "term", F.lit("]]")), b=-F.col("n"), c=F.col("term")),
    )


# Index pages ------------------------------------------------------------------------------------------------------


def date_range(notes: DataFrame) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return notes.agg(F.coalesce(F.concat(day(F.min("created_at")), F.lit(" to "), day(F.max("created_at"))), F.lit(NO_RANGE)).alias("date_range"))


def band_lines(counts: DataFrame, path: Column, first: int) -> DataFrame:
    """Topics (term, n) by bands of frequency; long bands are cut and say how many are left out."""
    parts = []
    for k, (title, least, shown) in enumerate(BANDS):
        own = counts.where((F.col("n") >= least) & (F.col("n") < (BANDS[k - 1][1] if k else float("inf"))))
        line = F.concat(F.lit("- [["), "term", F.lit("]]"), *([F.lit(" ("), F.col("n").cast("string"), F.lit(")")] if least > 1 else []))
        at = first + 5 * k
        some = own if shown is None else own.orderBy(F.desc("n"), "term").limit(shown)
        total = own.agg(F.count("*").alias("total")).where("total > 0")
        parts.append(lines(total, path, at, F.lit(f"### {title}\n")))
        if least == 1:
            parts.append(lines(total, path, at + 1, F.concat(F.lit("*"), F.col("total").cast("string"), F.lit(" topics mentioned only once*\n"))))
        parts.append(lines(some, path, at + 2, line, b=-F.col("n"), c=F.col("term")))
        if shown is not None:
            parts.append(lines(total.where(F.col("total") > shown), path, at + 3, F.concat(F.lit("- *... and "), (F.col("total") - shown).cast("string"), F.lit(" more*"))))
        parts.append(lines(total, path, at + 4, F.lit("")))
    return union(*parts)


def topics_lines(tags: DataFrame, concepts: DataFrame) -> DataFrame:
    p = F.lit(f"{INDEX}/Topics MOC.md")
    terms = concepts.select(F.col("raw").alias("term")).unionByName(tags.select(F.col("tag").alias("term")))
    counts = terms.groupBy("term").agg(F.count("*").alias("n"))
    used = tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(30)
    head = tags.sparkSession.range(1)
    return union(
        lines(head, p, 0, F.lit("# Topics MOC\n\nAll topics and concepts extracted from conversations, organized by frequency.\n\n## Topics by Frequency\n")),
        band_lines(counts, p, 1),
        lines(head, p, 30, F.lit("## Tag Usage\n")),
        lines(used, p, 31, F.concat(F.lit("- #"), "tag", F.lit(" ("), F.col("n").cast("string"), F.lit(")")), b=-F.col("n"), c=F.col("tag")),
    )


def timeline_lines(notes: DataFrame) -> DataFrame:
    """Years and months downwards, each month with its number of notes, notes from the newest on."""
    p, year, month = F.lit(f"{INDEX}/Timeline.md"), F.year("created_at"), F.month("created_at")
    at = notes.select("title", "created_at", year.alias("year"), (10_000 - year).cast("string").alias("y"), (100 - month).alias("m"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).cast("string").alias("t"))
    key = F.concat("y", F.lpad(F.col("m").cast("string"), 3, "0"))
    months = at.groupBy("y", "m", "year").agg(F.count("*").alias("n"), F.min("created_at").alias("first"))
    newest = F.date_diff(F.lit("9999-12-31"), F.col("created_at")) + F.lit(1.0) - F.date_format("created_at", "HH").cast("double") / 24 - F.date_format("created_at", "mm").cast("double") / 1440 - F.date_format("created_at", "ss").cast("double") / 86400
    return union(
        lines(notes.sparkSession.range(1), p, 0, F.lit("# Timeline\n\nChronological view of all conversations.\n")),
        lines(at.select("y", "year").distinct(), p, 1, F.concat(F.lit("## "), F.col("year").cast("string"), F.lit("\n")), a=F.col("y")),
        lines(months, p, 1, F.concat(F.lit("### "), F.date_format("first", "MMMM"), F.lit(" ("), F.col("n").cast("string"), F.lit(" conversations)\n")), a=key, b=F.lit(-1)),
        lines(at, p, 1, F.concat(F.lit("- "), F.date_format("created_at", "yyyy-MM-dd"), F.lit(": "), R.wikilink(F.col("title"))), a=key, b=newest, c=F.col("title")),
        lines(months, p, 1, F.lit(""), a=key, b=F.lit(1e9)),
    )


def picture(center: Column, labels: Column) -> Column:
    """A cluster as text: up to three labels above the centre and three below, each cut to 15 characters."""
    row = lambda part: F.array_join(F.transform(part, lambda x: F.rpad(F.left(x, F.lit(15)), 18, " ")), "")
    above, below = F.slice(labels, 1, 3), F.slice(labels, 4, 3)
    tie = lambda part, mark: F.when(F.size(part) > 0, F.array_join(F.array_repeat(F.rpad(F.lit("      " + mark), 18, " "), F.size(part)), ""))
    return F.concat_ws("\n", F.when(F.size(above) > 0, row(above)), tie(above, "|"), F.concat(F.lit("["), center, F.lit("]")), tie(below, "|"), F.when(F.size(below) > 0, row(below)))


def cluster_lines(notes: DataFrame, concepts: DataFrame, nodes: DataFrame, communities: DataFrame | None) -> DataFrame:
    """Communities (id, community) with twenty nodes each and what is left out; without them, categories stand in."""
    p, head = F.lit(f"{INDEX}/Clusters.md"), "# Knowledge Clusters\n\nHow topics and conversations cluster together.\n\n## Cluster Overview\n"
    start = notes.sparkSession.range(1)
    if communities is not None:
        full = communities.join(nodes, communities["id"] == nodes["node_id"])
        sizes = full.groupBy("community").agg(F.count("*").alias("n"))
        shown = topk(full, ["community"], [F.col("node_id")], 20)
        return union(
            lines(start, p, 0, F.lit(head)),
            lines(sizes, p, 1, F.concat(F.lit("### Cluster: "), F.col("community").cast("string"), F.lit("\n")), a=F.col("community"), b=F.lit(0)),
            lines(shown, p, 1, F.concat(F.lit("- [["), "label", F.lit("]] ("), "node_type", F.lit(")")), a=F.col("community"), b=F.col("rank")),
            lines(sizes.where("n > 20"), p, 1, F.concat(F.lit("- *... and "), (F.col("n") - 20).cast("string"), F.lit(" more*")), a=F.col("community"), b=F.lit(21)),
            lines(sizes, p, 1, F.lit(""), a=F.col("community"), b=F.lit(22)),
        )
    sizes = notes.groupBy("category").agg(F.count("*").alias("n"))
    counted = concepts.join(notes.select("conv_id", "category"), "conv_id").groupBy("category", "raw").agg(F.count("*").alias("c"))
    top = topk(counted, ["category"], [F.desc("c"), F.col("raw")], 10)
    labels = top.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "raw"))), lambda x: x["raw"]).alias("labels"))
    full = sizes.join(labels, "category", "left").withColumn("a", F.concat(F.lpad((1_000_000_000 - F.col("n")).cast("string"), 10, "0"), "category"))
    top = top.join(full.select("category", "a"), "category")
    none = F.array().cast("array<string>")
    return union(
        lines(start, p, 0, F.lit(head + "\n*Clusters generated from category groupings*\n")),
        lines(full, p, 1, F.concat(F.lit("### "), "category", F.lit(" Cluster\n\n**"), F.col("n").cast("string"), F.lit(" conversations**\n\n```\n"), picture(F.col("category"), F.coalesce("labels", none)), F.lit("\n```\n\n**Top concepts:**")), a=F.col("a"), b=F.lit(0)),
        lines(top, p, 1, F.concat(F.lit("- [["), "raw", F.lit("]] ("), F.col("c").cast("string"), F.lit(")")), a=F.col("a"), b=F.col("rank")),
        lines(full, p, 1, F.lit(""), a=F.col("a"), b=F.lit(11)),
    )


def weekday_counts(df: DataFrame, at: str) -> DataFrame:
    """(weekday, n) for all seven days from Monday, those without rows too."""
    met = df.groupBy(F.weekday(at).alias("weekday")).agg(F.count("*").alias("met"))
    return df.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday")).join(met, "weekday", "left").select("weekday", F.coalesce("met", F.lit(0)).alias("n"))


def with_bar(df: DataFrame, width: int) -> DataFrame:
    """Adds ``bar``, its length the share of ``n`` in the largest ``n``."""
    most = df.agg(F.greatest(F.max("n"), F.lit(1)).alias("most")).withColumn("one", F.lit(1))
    return df.withColumn("one", F.lit(1)).join(F.broadcast(most), "one").withColumn("bar", R.bar(F.col("n"), F.col("most"), width)).drop("one", "most")


def statistics_lines(notes: DataFrame, messages: DataFrame, tags: DataFrame, concepts: DataFrame, nodes: DataFrame, n_edges: DataFrame, n_mocs: int, top_nodes: DataFrame) -> DataFrame:
    """``n_edges``: one row (n), the number of logged edges."""
    p, start = F.lit(f"{INDEX}/Statistics.md"), notes.sparkSession.range(1)
    text = lambda c: F.col(c).cast("string")
    row = lambda df, name, value, place: lines(df, p, 1, F.concat(F.lit(f"- **{name}**: "), value), b=F.lit(place))
    n_notes, n_messages = notes.agg(F.count("*").alias("n")), messages.agg(F.count("*").alias("n"))
    average = n_notes.select(F.col("n").alias("k"), F.lit(1).alias("x")).join(n_messages.withColumn("x", F.lit(1)), "x")
    categories = with_bar(notes.groupBy("category").agg(F.count("*").alias("n")), 30)
    months = notes.groupBy(F.date_trunc("month", "created_at").alias("month")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "month").limit(10)
    days = with_bar(weekday_counts(notes, "created_at"), 20)
    names = F.array(*[F.lit(x) for x in WEEKDAYS])
    used = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(20)
    by_count = lambda df, section, line, c: lines(df, p, section, line, b=-F.col("n"), c=F.col(c))
    heading = lambda section, t: lines(start, p, section, F.lit(t))
    return union(
        heading(0, "# Vault Statistics\n\nStatistics and analysis of the knowledge base.\n\n## Overview\n"),
        row(n_notes, "Total Conversations", text("n"), 0), row(n_messages, "Total Messages", text("n"), 1),
        row(average, "Average Messages per Conversation", F.format_string("%.1f", F.coalesce(F.try_divide("n", "k"), F.lit(0.0))), 2),
        row(date_range(notes), "Date Range", F.col("date_range"), 3), row(start, "Maps of Content", F.lit(str(n_mocs)), 4),
        row(nodes.agg(F.count("*").alias("n")), "Graph Nodes", text("n"), 5), row(n_edges, "Graph Edges", text("n"), 6),
        heading(2, "\n## Category Distribution\n"), by_count(categories, 3, F.concat(F.lit("- **"), "category", F.lit("**: "), text("n"), F.lit(" "), "bar"), "category"),
        heading(4, "\n## Most Active Periods\n\n### Top Months\n"), lines(months, p, 5, F.concat(F.lit("- **"), F.date_format("month", "MMMM yyyy"), F.lit("**: "), text("n"), F.lit(" conversations")), b=-F.col("n"), c=F.date_format("month", "yyyy-MM")),
        heading(6, "\n### Activity by Day of Week\n"), lines(days, p, 7, F.concat(F.lit("- **"), F.get(names, F.col("weekday")), F.lit("**: "), text("n"), F.lit(" "), "bar"), b=F.col("weekday")),
        heading(8, "\n## Top Concepts\n"), by_count(used(concepts, "raw"), 9, F.concat(F.lit("- **"), "raw", F.lit("**: "), text("n"), F.lit(" mentions")), "raw"),
        heading(10, "\n## Top Tags\n"), by_count(used(tags, "tag"), 11, F.concat(F.lit("- #"), "tag", F.lit(": "), text("n")), "tag"),
        heading(12, "\n## Knowledge Graph Statistics\n\n### Node Types\n"), by_count(nodes.groupBy("node_type").agg(F.count("*").alias("n")), 13, F.concat(F.lit("- **"), "node_type", F.lit("**: "), text("n")), "node_type"),
        heading(14, "\n### Most Connected Nodes\n"), lines(top_nodes, p, 15, F.concat(F.lit("- **"), "label", F.lit("** ("), "node_type", F.lit("): "), text("degree"), F.lit(" connections")), b=-F.col("degree"), c=F.col("node_id")),
    )


def readme_lines(notes: DataFrame, nodes: DataFrame, n_mocs: int, top_concepts: DataFrame) -> DataFrame:
    p, start = F.lit(f"{INDEX}/README.md"), notes.sparkSession.range(1)
    stat = lambda df, name, place: lines(df, p, 1, F.concat(F.lit(f"- **{name}**: "), F.col("v").cast("string")), b=F.lit(place))
    categories = notes.groupBy("category").agg(F.count("*").alias("n"))
    recent = notes.orderBy(F.desc("created_at"), "conv_id").limit(10)
    heading = lambda section, t: lines(start, p, section, F.lit(t))
    return union(
        heading(0, "# Vault Index\n\n## Quick Stats\n"),
        stat(notes.agg(F.count("*").alias("v")), "Total Conversations", 0), stat(start.select(F.lit(n_mocs).alias("v")), "Maps of Content", 1),
        stat(notes.agg(F.count_distinct("category").alias("v")), "Categories", 2), stat(nodes.where("node_type = 'concept'").agg(F.count("*").alias("v")), "Concepts Extracted", 3),
        stat(date_range(notes).withColumnRenamed("date_range", "v"), "Date Range", 4),
        heading(2, "\n## Navigation\n\n### By Category\n"),
        lines(categories, p, 3, F.concat(F.lit("- [["), "category", F.lit(" MOC|"), "category", F.lit("]] ("), F.col("n").cast("string"), F.lit(" conversations)")), b=-F.col("n"), c=F.col("category")),
        heading(4, "\n### Index Files\n\n- [[Topics MOC]]\n- [[Timeline]]\n- [[Clusters]]\n- [[Statistics]]\n\n## Recent Conversations\n"),
        lines(recent, p, 5, F.concat(F.lit("- "), R.wikilink(F.col("title")), F.lit(" ("), F.date_format("created_at", "yyyy-MM-dd"), F.lit(")")), b=-F.unix_micros(F.col("created_at").cast("timestamp")).cast("double"), c=F.col("conv_id")),
        heading(6, "\n## Top Concepts\n"),
        lines(top_concepts, p, 7, F.concat(F.lit("- [["), "label", F.lit("]] ("), F.col("degree").cast("string"), F.lit(" connections)")), b=-F.col("degree"), c=F.col("node_id")),
    )


def open_tasks_lines(notes: DataFrame, lists: DataFrame) -> DataFrame:
    """All action items in one page, by note."""
    p = F.lit(f"{INDEX}/Open Tasks.md")
    items = lists.where("kind = 'action'").join(notes.select("conv_id", "title"), "conv_id")
    return union(
        lines(notes.sparkSession.range(1), p, 0, F.lit("# Open Tasks\n")),
        lines(items, p, 1, F.concat(F.lit("- [ ] "), "item", F.lit(" ("), R.wikilink(F.col("title")), F.lit(")")), a=F.lpad(F.col("conv_id").cast("string"), 20, "0"), b=F.col("place"), c=F.col("item")),
    )


def people_lines(notes: DataFrame, people: DataFrame) -> DataFrame:
    """A page of the people mentioned, each with the notes that mention them."""
    p = F.lit(f"{MOCS}/People MOC.md")
    met = people.select("conv_id", "raw").distinct().join(notes.select("conv_id", "title"), "conv_id")
    counts = people.groupBy("raw").agg(F.count("*").alias("n"))
    return union(
        lines(notes.sparkSession.range(1), p, 0, F.lit("# People MOC\n")),
        lines(counts, p, 1, F.concat(F.lit("## "), "raw", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n")), a=F.col("raw"), b=F.lit(-1)),
        lines(met, p, 1, F.concat(F.lit("- "), R.wikilink(F.col("title"))), a=F.col("raw"), b=F.lit(0), c=F.col("title")),
    )


def output_counts(page_lines: DataFrame) -> DataFrame:
    """(notes_created, mocs_created, total_links): files by folder and the links in their lines."""
    links = F.regexp_count("line", F.lit(r"\[\[.*?\]\]"))
    files = page_lines.groupBy("path").agg(F.sum(links).alias("links"))
    note = F.col("path").startswith(f"{NOTES}/")
    return files.agg(F.count_if(note).alias("notes_created"), F.count_if(~note).alias("mocs_created"), F.coalesce(F.sum("links"), F.lit(0)).alias("total_links"))
