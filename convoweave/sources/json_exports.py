"""JSON exports read natively: no Python worker, and no file is one string, however large.

A file is read in pieces that end at a closing brace, so Spark splits it like any text. What a piece does to the state of the
reader, whether a string is open and how deep the brackets are, is computed for each piece by itself and summed up along the file
in two steps (inside blocks, then over the blocks' totals). That tells which pieces make one element of the list of conversations;
elements are parsed as VARIANT each on its own. So lists of any layout, pretty or on one line, and JSON lines are read by many tasks.

Roots: a list, an object that begins with a ``conversations`` list, JSON lines (.jsonl, .ndjson), or one object, which is put
together and parsed whole: a conversation, or an object with ``conversations`` or ``data`` somewhere in it. Elements that are no
objects are skipped but counted. A file that is not valid gives one row with ``error`` set and no conversation, an
empty file none; objects that repeat a key are not valid. Times are ISO dates and times (without a zone: UTC) or epoch numbers, seconds or, beyond 1e12,
milliseconds; others are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoweave.functions.cleaning import bound, normalize_role
from convoweave.shared import stage
from convoweave.sources.exports import ID_KEYS, JSON_FILES, MESSAGE_KEYS, MESSAGE_TIME_KEYS, ROLE_KEYS, TIME_KEYS, TITLE_KEYS, URL_KEYS

LIST_ROOT, CONVERSATIONS_ROOT = r"\A\uFEFF?\s*\[", r"\A\uFEFF?\s*\{\s*\"conversations\"\s*:\s*\["
AT = ("file", "block", "id")


def pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, id, value): the text up to each closing brace, without it; ordered by block, then id. Staged."""
    read = spark.read.option("lineSep", "}").option("pathGlobFilter", JSON_FILES).text(path)
    return stage(read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value"), "json-pieces")


def running(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the pieces of the file before this one."""
    own = df.withColumn("own", value)
    totals = own.groupBy("file", "block").agg(F.sum("own").alias("total"))
    blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", "block", F.coalesce(F.sum("total").over(blocks), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    before = own.withColumn("before", F.coalesce(F.sum("own").over(inside), F.lit(0)))
    return before.join(offsets, ["file", "block"]).withColumn(name, F.col("before") + F.col("offset")).drop("own", "before", "offset")


def depth(text: Column) -> Column:
    """struct(change, low): of the depth of brackets along ``text``, the piece's own closing brace not counted."""
    step = lambda s, c: bound(s["change"] + F.when(c.isin("{", "["), 1).otherwise(-1), lambda x: F.struct(x.alias("change"), F.least(s["low"], x).alias("low")))
    brackets = F.split(F.regexp_replace(text, r"[^\[\]{}]", ""), "")
    return F.aggregate(F.filter(brackets, lambda c: c != ""), F.struct(F.lit(0).alias("change"), F.lit(0).alias("low")), step)


def chunks(read: DataFrame) -> DataFrame:
    """(file, root, chunk, kind, text): elements of lists, what follows the last one (kind end), and whole objects."""
    first = read.groupBy("file").agg(F.min_by("value", F.struct("block", "id")).alias("head"), F.min(F.struct("block", "id")).alias("start"))
    lines = F.lower("file").rlike(r"\.(jsonl|ndjson)\z")
    root = F.when(lines, "lines").when(F.col("head").rlike(LIST_ROOT), "list").when(F.col("head").rlike(CONVERSATIONS_ROOT), "conversations").otherwise("object")
    files = first.select("file", root.alias("root"), "start")
    begun = read.join(files, "file")
    at_start = F.struct("block", "id") == F.col("start")
    text = F.when(at_start & F.col("root").isin("list", "conversations"), F.regexp_replace(F.regexp_replace("value", CONVERSATIONS_ROOT, ""), LIST_ROOT, "")).otherwise(F.col("value"))
    begun = stage(begun.select(*AT, "root", text.alias("value")), "json-begun")

    quotes = F.split(F.regexp_replace("value", r"\\.", ""), '"')  # without escapes, every quote opens or closes
    part = lambda odd: F.array_join(F.filter(quotes, lambda _, i: i % 2 == odd), " ")
    facts = begun.where("root <> 'object'").select(*AT, "root", (F.size(quotes) - 1).alias("quotes"), depth(part(0)).alias("out"), depth(part(1)).alias("in_"))
    facts = running(facts, F.col("quotes"), "quoted")
    opened = F.col("quoted") % 2 == 1
    ends_inside = (F.col("quoted") + F.col("quotes")) % 2 == 1
    facts = facts.select(*AT, "root", F.when(opened, F.col("in_")).otherwise(F.col("out")).alias("d"), F.when(ends_inside, 0).otherwise(-1).alias("brace"))
    facts = stage(running(facts, F.col("d.change") + F.col("brace"), "depth"), "json-depths")
    closed = facts.where((F.col("depth") + F.col("d.low") < 0) & (F.col("root") != "lines")).groupBy("file").agg(F.min(F.struct("block", "id")).alias("closed"))
    known = facts.join(closed, "file", "left")
    after = F.coalesce(F.struct("block", "id") >= F.col("closed"), F.lit(False))
    ends = ~after & (F.col("brace") == -1) & (F.col("depth") + F.col("d.change") == 1)
    numbered = running(known.withColumn("ends", ends), F.col("ends").cast("int"), "chunk")

    told = begun.where("root <> 'object'").join(numbered.select(*AT, "chunk", "ends", F.col("closed").isNotNull().alias("whole")), list(AT))
    told = told.unionByName(begun.where("root = 'object'").select(*AT, "root", "value", F.lit(0).cast("bigint").alias("chunk"), F.lit(False).alias("ends"), F.lit(True).alias("whole")))
    pieced = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "value"))), lambda x: x["value"]), "}")
    made = told.groupBy("file", "root", "chunk").agg(pieced.alias("text"), F.max("ends").alias("ended"), F.max("whole").alias("whole"))
    kind = F.when(F.col("root") == "object", "object").when(F.col("ended"), "element").otherwise("end")
    return made.select("file", "root", "chunk", kind.alias("kind"), F.when(F.col("ended"), F.concat("text", F.lit("}"))).otherwise(F.col("text")).alias("text"), "whole")


def _get(x: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(x, path, kind)


def elements(found: DataFrame) -> DataFrame:
    """(file, chunk, items): the variants of each chunk, null if it is not valid. Objects are looked into for their list."""
    bare = F.regexp_replace("text", r"\A[\s,]+", "")
    listed = _get(F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]"))), "$", "array<variant>")
    none = F.array().cast("array<variant>")
    rest = lambda suffix: _get(F.try_parse_json(F.concat(F.lit('{"x":['), bare, F.lit(suffix))), "$.x", "array<variant>")
    closing = F.when(F.col("root") == "lines", F.when(F.trim(bare) == "", none)).when(F.col("root") == "list", rest("}")).otherwise(F.coalesce(rest(""), rest("}")))
    single = F.coalesce(F.try_parse_json("text"), F.try_parse_json(F.concat("text", F.lit("}"))))

    def inner(v: Column) -> Column:
        held = [_get(v, f"$.{k}") for k in ("conversations", "data")]
        body = F.when(held[0].isNotNull(), held[0]).when(held[1].isNotNull(), held[1]).otherwise(v)
        return bound(body, lambda b: F.when(_kind(v) == "OBJECT", F.coalesce(_get(b, "$", "array<variant>"), F.array(b))))

    cut_short = ~F.col("whole") & (F.col("root") != "lines")
    items = F.when(cut_short, F.lit(None)).when(F.col("kind") == "object", bound(single, inner)).when(F.col("kind") == "element", listed).otherwise(closing)
    return found.select("file", "chunk", items.alias("items"))


def _kind(x: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(x), r"\A[A-Z]+", 0)


def truthy(x: Column) -> Column:
    """Whether a variant has a value that counts: not null, empty, zero or false."""

    def held(v: Column) -> Column:
        kind = _kind(v)
        return F.coalesce(
            F.when(v.isNull() | (kind == "VOID"), F.lit(False)).when(kind == "STRING", _get(v, "$", "string") != "")
            .when(kind.isin("ARRAY", "OBJECT"), ~F.to_json(v).isin("[]", "{}")).when(kind == "BOOLEAN", _get(v, "$", "boolean")).otherwise(_get(v, "$", "double") != 0), F.lit(False))

    return bound(x, held)


def first_of(x: Column, keys: tuple[str, ...]) -> Column:
    """The value of the first key that has one."""
    return F.coalesce(*[bound(_get(x, f"$.{k}"), lambda v: F.when(truthy(v), v)) for k in keys])


def time_of(x: Column) -> Column:
    iso = r"\A\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d([.]\d{1,6})?)?(Z|[+-]\d\d:?\d\d)?)?\z"

    def read(v: Column) -> Column:
        text, number = _get(v, "$", "string"), _get(v, "$", "double")
        dated = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00"))).otherwise(F.regexp_replace(text, r"\A(.{16})(?!:)", "$1:00"))
        zoned = F.when(dated.rlike(r"(Z|[+-]\d\d:?\d\d)\z") , dated).otherwise(F.concat(dated, F.lit("Z")))
        micros = F.round(F.when(number > 1e12, number * 1e3).otherwise(number * 1e6)).try_cast("bigint")
        return F.when(_kind(v) == "STRING", F.when(text.rlike(iso), F.try_to_timestamp(zoned))).otherwise(F.timestamp_micros(micros))

    return bound(x, read)


def content_of(m: Column) -> Column:
    def read(body: Column) -> Column:
        kind = _kind(body)
        block = lambda e: F.when(_kind(e) == "STRING", _get(e, "$", "string")).when(_kind(_get(e, "$.text")) == "STRING", _get(e, "$.text", "string"))
        listed = F.filter(F.transform(_get(body, "$", "array<variant>"), block), lambda t: t.isNotNull())
        return F.when(kind == "STRING", _get(body, "$", "string")).when(kind == "ARRAY", F.array_join(listed, "\n")).when(kind == "OBJECT", _get(first_of(body, ("text", "value")), "$", "string"))

    return F.coalesce(bound(first_of(m, ("text", "content")), read), F.lit(""))


def message_of(m: Column) -> Column:
    role = F.lower(F.coalesce(_get(first_of(m, ROLE_KEYS), "$", "string"), F.lit("unknown")))
    return F.struct(normalize_role(role).alias("role"), content_of(m).alias("content"), time_of(first_of(m, MESSAGE_TIME_KEYS)).alias("timestamp"))


def conversations(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations of (file, root, chunk, kind, text, whole) and, apart, (file, error) of the files that are not valid."""
    parsed = stage(elements(found), "json-elements")
    bad = parsed.where("items is null").groupBy("file").agg(F.concat(F.lit("not valid JSON in element "), F.min("chunk").cast("string")).alias("error"))
    good = parsed.join(bad.select("file"), "file", "left_anti")
    # An element's chunk holds one object, after what is skipped: places count all elements, positions the objects.
    extra = good.where(F.size("items") > 1).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("chunk", (F.size("items") - 1).alias("more")))).alias("extra"))
    shifted = F.coalesce(F.aggregate(F.filter("extra", lambda e: e["chunk"] < F.col("chunk")), F.lit(0).cast("bigint"), lambda a, e: a + e["more"]), F.lit(0))
    held = F.filter(F.transform("items", lambda x, i: F.struct(i.alias("i"), x.alias("item"))), lambda e: _kind(e["item"]) == "OBJECT")
    objects = good.join(extra, "file", "left").select("file", "chunk", shifted.alias("shift"), F.posexplode(held).alias("j", "e")).select(
        "file", (F.col("chunk") + F.col("j")).alias("pos"), (F.col("chunk") + F.col("shift") + F.col("e.i")).alias("place"), F.col("e.item").alias("item")
    )
    messages = F.transform(F.filter(F.coalesce(_get(first_of(F.col("item"), MESSAGE_KEYS), "$", "array<variant>"), F.array().cast("array<variant>")), lambda m: _kind(m) == "OBJECT"), message_of)
    text = lambda keys: _get(first_of(F.col("item"), keys), "$", "string")
    out = objects.select(
        "file", F.col("pos").cast("int").alias("pos"),
        F.coalesce(text(ID_KEYS), F.substring(F.sha2(F.concat("file", F.lit("#"), F.col("pos").cast("string")), 256), 1, 32)).alias("conv_id"),
        F.coalesce(text(TITLE_KEYS), F.concat(F.lit("Conversation "), (F.col("place") + 1).cast("string"))).alias("title"), time_of(first_of(F.col("item"), TIME_KEYS)).alias("created_at"),
        text(URL_KEYS).alias("source_url"), F.filter(messages, lambda m: m["content"] != "").alias("messages"), F.lit(None).cast("string").alias("error"),
    )
    return out, bad


def read_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each conversation of the JSON files at ``path``, and one with ``error`` for each file that is not valid."""
    out, bad = conversations(chunks(pieces(spark, path)))
    names = [c for c in out.columns if c not in ("file", "pos", "error")]
    failed = bad.select("file", F.lit(0).alias("pos"), *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in names], "error")
    return out.unionByName(failed)
