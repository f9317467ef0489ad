"""Annotation: prompts out, responses in, and a rule-based tagger that needs no model.

An annotator is any callable from a prompt to a response. It is made once in each task by a factory, so clients with
connections need not travel. Frames: ``conv`` (conv_id, title), ``messages`` (conv_id, turn, role, text).
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from convoweave.operators.graph import topk

Annotator = Callable[[str], str]

# Limits of prompts, defaults of responses, and the texts that stand in for a response.
SHORT, ENDS, DIGEST_CUT, PROMPT_CUT, BATCH, MOST_TAGS = 6, 3, 500, 2000, 5, 7
NO_CATEGORY, NO_CONFIDENCE, MIN_CONFIDENCE = "uncategorized", 0.5, 0.6
ATTEMPTS = 5
DESCRIPTION = "A collection of notes and insights about {}."
UNREADABLE = "Summary could not be read from the response."
TAG_TYPE = "struct<tags:array<string>,category:string,confidence:map<string,double>>"
LISTS = ("key_decisions", "insights", "action_items", "concepts", "people_mentioned")
EXTRACT_TYPE = "struct<" + ",".join(f"{x}:array<string>" for x in LISTS) + ",summary:string>"
#: A taxonomy is configuration; it is broadcast up to this many words.
BROADCAST_WORDS = 200_000


class RateLimited(Exception):
    """What an annotator raises when it is called too often."""


def cut(text: Column, longest: int, tail: str) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.left(text, F.lit(longest)), F.lit(tail))).otherwise(text)


def digest(conv: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv_id, digest): the title and the messages; of more than six the first and last three and a mark between them."""
    w = Window.partitionBy("conv_id")
    m = messages.withColumn("k", F.row_number().over(w.orderBy("turn"))).withColumn("n", F.count("*").over(w))
    told = m.where((F.col("n") <= SHORT) | (F.col("k") <= ENDS) | (F.col("k") > F.col("n") - ENDS))
    lines = told.select("conv_id", F.col("k").alias("at"), F.concat("role", F.lit(": "), cut(F.col("text"), DIGEST_CUT, "...")).alias("line"))
    left_out = m.where((F.col("n") > SHORT) & (F.col("k") == ENDS)).select(
        "conv_id", F.lit(ENDS + 0.5).alias("at"), F.concat(F.lit("[... "), F.col("n") - 2 * ENDS, F.lit(" more messages ...]")).alias("line")
    )
    head = conv.select("conv_id", F.lit(0.0).alias("at"), F.concat(F.lit("Title: "), "title").alias("line"))
    every = head.unionByName(lines.withColumn("at", F.col("at").cast("double"))).unionByName(left_out)
    sorted_lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return every.groupBy("conv_id").agg(F.array_join(sorted_lines, "\n").alias("digest"))


def tag_prompts(digests: DataFrame, taxonomy_text: str, size: int = BATCH) -> DataFrame:
    """(batch, conv_ids, prompt): conversations of one partition in batches, so batching needs no global order."""
    place = F.monotonically_increasing_id()
    listed = digests.select("conv_id", "digest", place.alias("place")).withColumn("batch", F.col("place") - F.pmod("place", F.lit(size)))
    rows = F.array_sort(F.collect_list(F.struct("place", "conv_id", "digest")))
    batches = listed.groupBy("batch").agg(rows.alias("rows"))
    parts = F.transform("rows", lambda x, i: F.concat(F.lit("## Conversation "), (i + 1).cast("string"), F.lit("\n"), x["digest"]))
    ask = F.concat(F.lit(f"Tag each conversation from this taxonomy:\n{taxonomy_text}\n\n"), F.array_join(parts, "\n\n"), F.lit("\n\nAnswer with a JSON array of "), F.size("rows").cast("string"), F.lit(" objects with tags, category and confidence."))
    return batches.select("batch", F.transform("rows", lambda x: x["conv_id"]).alias("conv_ids"), ask.alias("prompt"))


def extraction_prompt(conv: DataFrame, messages: DataFrame, tags: DataFrame) -> DataFrame:
    """(conv_id, prompt) from conv (conv_id, title, created_at, category), messages and tags (conv_id, rk, tag)."""
    said = F.concat(F.when(F.col("role") == "human", "Human").otherwise("Assistant"), F.lit(": "), cut(F.col("text"), PROMPT_CUT, "... [truncated]"))
    body = messages.select("conv_id", F.struct("turn", said.alias("x")).alias("m")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["x"]), "\n\n").alias("body"))
    listed = tags.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "tag"))), lambda x: x["tag"]), ", ").alias("tags"))
    head = F.concat(F.lit("Title: "), "title", F.lit("\nDate: "), F.date_format("created_at", "yyyy-MM-dd"), F.lit("\nCategory: "), "category", F.lit("\nTags: "), F.coalesce("tags", F.lit("")))
    return conv.join(body, "conv_id").join(listed, "conv_id", "left").select("conv_id", F.concat(head, F.lit("\n\n"), "body").alias("prompt"))


def call_with_retry(call: Annotator, prompt: str, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> str:
    """The response; a rate limit doubles the pause each time, any other error pauses a second, the last one is raised."""
    for k in range(attempts):
        try:
            return call(prompt)
        except Exception as e:
            if k == attempts - 1:
                raise
            wait(2**k + random.random() if isinstance(e, RateLimited) else 1.0)
    raise ValueError("no attempt was allowed")


def annotate(prompts: DataFrame, make: Callable[[], Annotator], at_once: int | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """All columns of ``prompts`` with response and error; a prompt that fails for good has an error and does not end the job.

    ``at_once`` is the number of tasks, so of calls in flight.
    """
    schema = T.StructType([*prompts.schema, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for b in batches:
            answers = []
            for prompt in b["prompt"]:
                try:
                    answers.append((call_with_retry(call, prompt, attempts), None))
                except Exception as e:
                    answers.append((None, f"{type(e).__name__}: {e}"[:100]))
            yield b.assign(response=[a for a, _ in answers], error=[e for _, e in answers])

    return (prompts.repartition(at_once) if at_once else prompts).mapInPandas(run, schema)


def parse_tags(response: Column, expected: Column) -> Column:
    """array<struct<tags, category, confidence>> of ``expected`` elements, from a JSON array somewhere in the response.

    A single object counts as an array of one; what is missing or unreadable gets the defaults; at most seven tags.
    """
    text = F.trim(F.coalesce(response, F.lit("")))
    one = F.from_json(text, TAG_TYPE)
    listed = F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), f"array<{TAG_TYPE}>")
    found = F.when(text.startswith("{") & text.endswith("}"), F.array(one)).otherwise(listed)

    def whole(x: Column) -> Column:
        tags = F.slice(F.filter(F.coalesce(x["tags"], F.array().cast("array<string>")), lambda t: t.isNotNull()), 1, MOST_TAGS)
        sure = F.coalesce(x["confidence"], F.create_map().cast("map<string,double>"))
        return F.struct(
            tags.alias("tags"), F.coalesce(x["category"], F.lit(NO_CATEGORY)).alias("category"),
            F.map_from_entries(F.transform(F.array_distinct(tags), lambda t: F.struct(t, F.coalesce(F.try_element_at(sure, t), F.lit(NO_CONFIDENCE))))).alias("confidence"),
        )

    places = F.when(expected > 0, F.sequence(F.lit(0), expected.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: whole(F.get(found, i)))


def tagged(answers: DataFrame) -> DataFrame:
    """(conv_id, tags, category, confidence) from answered batches (conv_ids, response), by position."""
    parsed = answers.select(F.arrays_zip("conv_ids", parse_tags(F.col("response"), F.size("conv_ids")).alias("found")).alias("rows"))
    return parsed.select(F.explode("rows").alias("x")).select(F.col("x.conv_ids").alias("conv_id"), "x.found.*")


def confident(confidence: Column, least: float = MIN_CONFIDENCE) -> Column:
    """The tags of a confidence map that are sure enough, in order."""
    return F.array_sort(F.map_keys(F.map_filter(confidence, lambda _, v: v >= least)))


def parse_extraction(response: Column) -> Column:
    """struct of the five lists and the summary; fences around the JSON are taken off; empty lists for what can't be read."""
    text = F.regexp_replace(F.trim(F.coalesce(response, F.lit(""))), r"(?s)\A```[^\n]*\n|\n?```\s*\z", "")
    found = F.from_json(text, EXTRACT_TYPE)
    readable = F.trim(text).startswith("{") & F.try_parse_json(text).isNotNull()
    lists = [F.coalesce(F.when(readable, found[x]), F.array().cast("array<string>")).alias(x) for x in LISTS]
    return F.struct(*lists, F.when(readable, F.coalesce(found["summary"], F.lit(""))).otherwise(UNREADABLE).alias("summary"))


def extraction_totals(extracted: DataFrame) -> DataFrame:
    """One row: the number of elements of each list."""
    return extracted.agg(*[F.coalesce(F.sum(F.size(x)), F.lit(0)).cast("bigint").alias(x) for x in LISTS])


def describe(topic: Column) -> Column:
    before, after = DESCRIPTION.split("{}")
    return F.concat(F.lit(before), topic, F.lit(after))


def rule_tags(words: DataFrame, taxonomy: DataFrame, most: int = MOST_TAGS) -> DataFrame:
    """(conv_id, tag, n, confidence, rank, category) from words (conv_id, word, n) and taxonomy (category, tag, word).

    A tag counts all its words; confidence is its share of the conversation's most frequent tag, the category that with
    the most words. Conversations without any word of the taxonomy have no row.
    """
    listed = taxonomy.select("category", "tag", "word").distinct()
    met = words.join(F.broadcast(listed) if listed.count() <= BROADCAST_WORDS else listed, "word")
    per_tag = met.groupBy("conv_id", "tag").agg(F.sum("n").alias("n"))
    best = topk(met.groupBy("conv_id", "category").agg(F.sum("n").alias("c")), ["conv_id"], [F.desc("c"), F.col("category")], 1)
    most_of = per_tag.groupBy("conv_id").agg(F.max("n").alias("most"))
    ranked = topk(per_tag, ["conv_id"], [F.desc("n"), F.col("tag")], most).join(most_of, "conv_id")
    return ranked.join(best.select("conv_id", "category"), "conv_id").select("conv_id", "tag", "n", F.round(F.col("n") / F.col("most"), 6).alias("confidence"), "rank", "category")


# What the rule-based extractor takes for terms; settings may give other patterns.
PATTERNS = {"concept": r"\p{L}{9,}", "person": r"\p{Lu}\p{L}{7,}"}
SHORT_LINE = 40


def occurrences(messages: DataFrame, pattern: str) -> DataFrame:
    """(conv_id, place, raw): every match in the messages (conv_id, turn, text), in order."""
    found = messages.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("i", "raw"))
    return found.select("conv_id", (F.col("turn") * 100_000 + F.col("i") + 1).cast("bigint").alias("place"), "raw")


def short_lines(messages: DataFrame, longest: int = SHORT_LINE) -> DataFrame:
    """(conv_id, kind, place, item): short lines of people are taken for action items, those of assistants for decisions."""
    kind = F.when(F.col("role") == "human", "action").otherwise("decision")
    found = messages.select("conv_id", "turn", kind.alias("kind"), F.posexplode(F.split("text", "\n")).alias("i", "item"))
    return found.where(F.length("item").between(1, longest)).select("conv_id", "kind", (F.col("turn") * 100_000 + F.col("i") + 1).cast("bigint").alias("place"), "item")


def frequent_words(messages: DataFrame, most: int = MOST_TAGS) -> DataFrame:
    """(conv_id, tag, n, rank, confidence): the most frequent words of five letters or more, for want of a taxonomy."""
    words = messages.select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{5,}"), F.lit(0))).alias("tag")).groupBy("conv_id", "tag").agg(F.count("*").alias("n"))
    return topk(words, ["conv_id"], [F.desc("n"), F.col("tag")], most).withColumn("confidence", F.round(F.col("n") / F.max("n").over(Window.partitionBy("conv_id")), 6))


def human_summary(messages: DataFrame) -> DataFrame:
    """(conv_id, summary): what people said, for want of a model's summary."""
    said = F.collect_list(F.when(F.col("role") == "human", F.struct("turn", "text")))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(said), lambda x: x["text"]), " ").alias("summary"))
