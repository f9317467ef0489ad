"""Quality rules: Jensen-Shannon distance of a document's histograms to its language's references.

Two histograms are compared: the shares of eight character classes, and the shares of the language's
``COMMON`` most frequent words (plus one share for all other words). The references are the same
shares summed over every document of the language. Every value of ``lang`` has references of its own, and
so have the documents without one. The references are pre-aggregated; they are broadcast
up to ``BROADCAST_LANGUAGES`` languages and joined by shuffle beyond.

A distance is the square root of the base-2 Jensen-Shannon divergence, from 0 to 1. Documents of fewer
than ``MIN_CHARS`` characters are not judged by classes, those of fewer than ``MIN_WORDS`` words not by
words: their distance is null. Null and empty texts have no words and fail the base rule. Rows that repeat
an id, or have none, are judged each by its own text; an empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoweave.llm.text import let, window_hashes, words
from convoweave.shared import stage

COMMON = 40
MIN_CHARS = 200
MIN_WORDS = 50
MAX_CLASS_DISTANCE = 0.2
MAX_WORD_DISTANCE = 0.45
WINDOW = 8
#: At most ``COMMON`` words of about 50 bytes each for a language: 4 MB.
BROADCAST_LANGUAGES = 2_000

#: Stripped one after the other from the joined words; what is left over is "beyond", characters beyond ASCII.
CLASSES = {
    "lower": r"[a-z]+",
    "upper": r"[A-Z]+",
    "digit": r"[0-9]+",
    "punct": r"[.,;:!?'\"()\-]+",
    "symbol": r"[#*$%&|<>]+",
    "ascii": r"[\x00-\x7F]+",
}
CLASS_NAMES = (*CLASSES, "beyond", "space")


def repeated_words(hashes: Column) -> Column:
    """Words lying in a window of ``WINDOW`` words that occurs twice or more, windows being told apart by 64-bit hashes.

    Only texts with a repeated hash go further: windows sorted by hash meet their equals as neighbours.
    """

    def starts(s):
        pairs = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))

    def covered(p):
        steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, x: total + x)

    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(by_hash, starts), covered)
    ).otherwise(F.lit(0).cast("bigint"))


def features(docs: DataFrame) -> DataFrame:
    """Per row: a row number, doc_id, ref (the language), the base counts, the size of each character class, the words in lower case."""
    df = (
        docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("w", words(F.col("text")))
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("hashes", window_hashes(F.col("w"), WINDOW))
        .withColumn("left_0", F.array_join("w", ""))
    )
    for k, pattern in enumerate(CLASSES.values()):
        df = df.withColumn(f"left_{k + 1}", F.regexp_replace(f"left_{k}", pattern, ""))
    lengths = [F.length(f"left_{k}") for k in range(len(CLASSES) + 1)]
    sizes = [a - b for a, b in zip(lengths, [*lengths[1:], F.lit(0)], strict=True)]
    sizes.append(F.length("text") - lengths[0])
    return df.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("ref"),
        F.size("w").cast("bigint").alias("n_words"),
        lengths[0].cast("bigint").alias("word_chars"),
        sizes[4].cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("hashes")).alias("n_repeat_words"),
        *(x.cast("bigint").alias(f"c_{n}") for x, n in zip(sizes, CLASS_NAMES, strict=True)),
        words(F.lower("text")).alias("words"),
    )


def divergence_term(p: Column, q: Column) -> Column:
    """A cell's part of the base-2 Jensen-Shannon divergence."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def distance(divergence: Column) -> Column:
    return F.round(F.sqrt(F.greatest(divergence, F.lit(0.0))), 6)


def judge(docs: DataFrame) -> DataFrame:
    """The base counts, both distances (null where too short to tell) and the verdict of every row."""
    feats = stage(features(docs), "quality-features")
    totals = feats.groupBy("ref").agg(F.sum("n_words").alias("ref_words"), *(F.sum(f"c_{n}").alias(f"r_{n}") for n in CLASS_NAMES))
    totals = stage(totals, "quality-languages")
    hint = F.broadcast if totals.count() <= BROADCAST_LANGUAGES else (lambda df: df)

    exploded = feats.select("row", "ref", F.explode("words").alias("word"))
    counts = exploded.groupBy("ref", "word").agg(F.count("*").alias("ref_count"))
    rank = F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("ref_count"), "word"))
    common = counts.withColumn("k", rank).where(F.col("k") <= COMMON)
    common = stage(common.join(hint(totals.select("ref", "ref_words")), "ref").select("ref", "word", "k", (F.col("ref_count") / F.col("ref_words")).alias("q")), "quality-common")
    # One row per document and common word.
    hits = exploded.join(hint(common), ["ref", "word"]).groupBy("row", "k", "q").agg(F.count("*").alias("n"))
    per_doc = hits.groupBy("row").agg(F.collect_list(F.struct("k", "n", "q")).alias("cells"))
    rest = common.groupBy("ref").agg(F.sum(F.round("q", 12)).alias("q_all"))

    df = feats.drop("words").join(hint(totals), "ref").join(hint(rest), "ref", "left").join(per_doc, "row", "left")
    chars, ref_chars = (reduce(lambda a, b: a + b, [F.col(f"{x}_{n}") for n in CLASS_NAMES]) for x in "cr")
    class_js = reduce(lambda a, b: a + b, [divergence_term(F.col(f"c_{n}") / chars, F.col(f"r_{n}") / ref_chars) for n in CLASS_NAMES])
    total = F.col("n_words")
    # Cells that the document lacks give q/2 each; the sum starts from that for all cells.
    cells = F.sort_array(F.coalesce("cells", F.array().cast("array<struct<k:int,n:bigint,q:double>>")))
    seen = F.aggregate(cells, F.lit(0.0), lambda s, c: s + divergence_term(c["n"] / total, c["q"]) - c["q"] / 2)
    p_rest = 1 - F.aggregate(cells, F.lit(0).cast("bigint"), lambda s, c: s + c["n"]) / total
    word_js = seen + F.coalesce("q_all", F.lit(0.0)) / 2 + divergence_term(F.greatest(p_rest, F.lit(0.0)), F.greatest(1 - F.coalesce("q_all", F.lit(0.0)), F.lit(0.0)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.when(chars >= MIN_CHARS, distance(class_js)).alias("class_distance"),
        F.when(F.col("n_words") >= MIN_WORDS, distance(word_js)).alias("word_distance"),
    )
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return df.withColumn("kept", ~F.col("base_failed") & ~far)


def query(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range(8) r(k) GROUP BY doc_id),
f AS (SELECT doc_id, coalesce('=' || lang, '') AS ref, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
        len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(cov.n, 0) AS n_repeat_words,
        len(regexp_replace(text, '[^a-z]', '', 'g')) AS c0, len(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS c1,
        len(regexp_replace(text, '[^A-Z]', '', 'g')) AS c2, len(regexp_replace(text, '[^0-9]', '', 'g')) AS c3,
        len(regexp_replace(text, '[^.,;:!?''"()\-]', '', 'g')) AS c4, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS c5,
        len(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS ascii, len(text) AS chars
      FROM w LEFT JOIN cov USING (doc_id)),
cells AS (SELECT doc_id, ref, unnest([c0, c1, c2, c3, c4, c5, ascii - c0 - c1 - c2 - c3 - c4 - c5, chars - ascii]) AS n,
                 unnest(range(8)) AS k, chars FROM f),
cref AS (SELECT ref, k, sum(n) / sum(sum(n)) OVER (PARTITION BY ref) AS q FROM cells GROUP BY ref, k),
cjs AS (SELECT doc_id, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) / 2 ELSE 0 END) AS js
        FROM (SELECT doc_id, q, n / chars AS p FROM cells JOIN cref USING (ref, k) WHERE chars >= {MIN_CHARS}) GROUP BY doc_id),
lw AS (SELECT doc_id, coalesce('=' || lang, '') AS ref, unnest(list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS word FROM d),
wc AS (SELECT ref, word, count(*) AS n FROM lw GROUP BY ref, word
       QUALIFY row_number() OVER (PARTITION BY ref ORDER BY count(*) DESC, word) <= {COMMON}),
common AS (SELECT ref, word, n / t AS q FROM wc JOIN (SELECT ref, sum(n_words) AS t FROM f GROUP BY ref) USING (ref)),
pq AS (SELECT f.doc_id, q, coalesce(h.n, 0) / n_words AS p FROM f JOIN common USING (ref)
       LEFT JOIN (SELECT doc_id, word, count(*) AS n FROM lw GROUP BY ALL) h ON h.doc_id = f.doc_id AND h.word = common.word WHERE n_words >= {MIN_WORDS}),
pq2 AS (SELECT * FROM pq UNION ALL SELECT doc_id, greatest(1 - sum(q), 0), greatest(1 - sum(p), 0) FROM pq GROUP BY doc_id),
wjs AS (SELECT doc_id, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) / 2 ELSE 0 END) AS js FROM pq2 GROUP BY doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(round(sqrt(greatest(cjs.js, 0)), 6), 0) <= {MAX_CLASS_DISTANCE}
         AND coalesce(round(sqrt(greatest(wjs.js, 0)), 6), 0) <= {MAX_WORD_DISTANCE} AS kept
FROM b LEFT JOIN cjs USING (doc_id) LEFT JOIN wjs USING (doc_id)
"""
