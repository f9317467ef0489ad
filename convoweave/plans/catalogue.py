"""The registered queries over conversations and the other tables, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoweave.functions import cleaning as C
from convoweave.functions import rendering as R
from convoweave.operators import graph as G
from convoweave.operators import linking as L
from convoweave.operators import tiles
from convoweave.operators.components import connected_components
from convoweave.operators.pages import weekday_counts, with_bar
from convoweave.operators.tiles import Rule
from convoweave.shared import stage
from convoweave.sources import validation as V

CATEGORIES = ("technical", "business", "learning", "creative", "personal")
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def register(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Derived frames ---------------------------------------------------------------------------------------------------


def conv(spark, d) -> DataFrame:
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.substring(F.translate(F.min_by("text", "turn"), "\n", " "), 1, 60).alias("title"), F.count("*").alias("n_messages")
    ).select(
        "conv_id", "title", (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), (F.col("conv_id") * 37).cast("int"))).alias("created_at"),
        F.element_at(names, (F.col("conv_id") % 5 + 1).cast("int")).alias("category"), "n_messages",
    )


def one_row(*parts: DataFrame) -> DataFrame:
    """Frames of one row each side by side, joined on a constant key."""
    out = parts[0].withColumn("one", F.lit(1))
    for p in parts[1:]:
        out = out.join(F.broadcast(p.withColumn("one", F.lit(1))), "one")
    return out.drop("one")


def word_counts(spark, d) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{5,}"), F.lit(0)))
    return table(spark, d, "conversations").select("conv_id", words.alias("tag")).groupBy("conv_id", "tag").agg(F.count("*").alias("n"))


def tags(spark, d) -> DataFrame:
    return G.topk(word_counts(spark, d), ["conv_id"], [F.desc("n"), F.col("tag")], 7, "rk")


def terms(spark, d) -> DataFrame:
    return tags(spark, d).select(F.col("conv_id").alias("id"), F.col("tag").alias("term"))


CONV = """conv AS (SELECT conv_id, substr(translate(min_by(text, turn), chr(10), ' '), 1, 60) AS title,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id * 37) AS created_at,
  list_extract(['technical','business','learning','creative','personal'], conv_id % 5 + 1) AS category, count(*) AS n_messages
  FROM conversations GROUP BY conv_id)"""
TAGS = r"""tags AS (SELECT conv_id, tag, n, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, tag) AS rk FROM
  (SELECT conv_id, tag, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '\p{L}{5,}')) AS tag FROM conversations) GROUP BY conv_id, tag)
  QUALIFY rk <= 7)"""
SHARED = """sizes AS (SELECT conv_id, count(*) AS n FROM tags GROUP BY conv_id),
shared AS (SELECT a.conv_id AS src, b.conv_id AS dst, count(*) AS shared FROM tags a JOIN tags b ON a.tag = b.tag AND a.conv_id < b.conv_id GROUP BY ALL),
weighted AS (SELECT src, dst, shared, shared / greatest(x.n, y.n) AS w FROM shared JOIN sizes x ON x.conv_id = src JOIN sizes y ON y.conv_id = dst)"""
TEMPORAL = """temporal AS (SELECT a.conv_id AS src, b.conv_id AS dst, abs(epoch_us(a.created_at) - epoch_us(b.created_at)) / 86400000000 AS days_apart
  FROM conv a JOIN conv b ON a.conv_id < b.conv_id AND abs(epoch_us(a.created_at) - epoch_us(b.created_at)) <= 7 * 86400000000)"""
LOG = f"""{SHARED}, {TEMPORAL}, stages AS (
  SELECT src, dst, 1 AS stage, 'shared_tags' AS relationship, round(1.5 * w, 6) AS added FROM weighted
  UNION ALL SELECT src, dst, 2, 'shared_concepts', round(w, 6) FROM weighted WHERE shared >= 2
  UNION ALL SELECT src, dst, 3, 'temporal_proximity', round(0.5 * greatest(0.1, 1 - days_apart / 7), 6) FROM temporal),
edges AS (SELECT src, dst, round(sum(added), 6) AS weight, max_by(relationship, stage) AS relationship FROM stages GROUP BY src, dst),
ways AS (SELECT src, dst, weight, relationship FROM edges UNION ALL SELECT dst, src, weight, relationship FROM edges)"""
BASE = f"WITH {CONV}, {TAGS}"
GRAPH = f"{BASE}, {LOG}"
TWO_HOP = "two AS (SELECT a.conv_id AS src, b.conv_id AS dst, round(sum(0.3::DOUBLE), 6) AS score, count(*) AS paths FROM tags a JOIN tags b ON a.tag = b.tag AND a.conv_id <> b.conv_id GROUP BY ALL)"
CAND = f"""{TWO_HOP}, cand AS (SELECT coalesce(w.src, two.src) AS src, coalesce(w.dst, two.dst) AS dst, round(coalesce(w.weight, 0) + coalesce(two.score, 0), 6) AS score,
  coalesce(relationship, 'indirect') AS relationship FROM ways w FULL JOIN two ON w.src = two.src AND w.dst = two.dst),
links AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM cand WHERE score >= 0.3 QUALIFY rank <= 10)"""


def shared_tags(spark, d) -> DataFrame:
    return tiles.overlaps(terms(spark, d), 1, G.TAG_FACTOR)


def shared_concepts(spark, d) -> DataFrame:
    return tiles.overlaps(terms(spark, d), 2)


def temporal(spark, d) -> DataFrame:
    near = G.band_join(conv(spark, d).select(F.col("conv_id").alias("id"), F.col("created_at").alias("ts")))
    return near.withColumn("weight", G.temporal_weight(F.col("days_apart")))


RULES = (Rule("shared_tags", "overlap", 0, 1, G.TAG_FACTOR), Rule("shared_concepts", "overlap", 0, 2), Rule("temporal_proximity", "near", least=G.WINDOW_DAYS, factor=G.TEMPORAL_FACTOR))


def began(spark, d) -> DataFrame:
    return conv(spark, d).select(F.col("conv_id").alias("id"), F.col("created_at").alias("ts"))


def pair_table(spark, d) -> DataFrame:
    return tiles.pair_table([terms(spark, d)], began(spark, d), RULES)


def log(spark, d) -> DataFrame:
    return tiles.log_of(pair_table(spark, d), RULES)


def edges(spark, d) -> DataFrame:
    return tiles.fold_of(pair_table(spark, d), RULES)


def alike(words: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, weight) as ``G.similarity_join`` gives, of (id, term), for thresholds so low that most pairs meet in their prefixes."""
    return tiles.pair_table([words], None, (Rule("semantic_similarity", "alike", 0, threshold),)).select("src", "dst", F.col("r1").alias("weight"))


def alike_documents(spark, d) -> DataFrame:
    """At the rule's own threshold."""
    return alike(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(C.word_set(F.col("text"))).alias("term")), G.SEMANTIC_MIN)


def term_edges(spark, d) -> DataFrame:
    return terms(spark, d).withColumn("weight", F.lit(1.0))


def links(spark, d) -> DataFrame:
    return L.related(tiles.best_related([terms(spark, d)], began(spark, d), RULES, term_edges(spark, d), L.INDIRECT, L.RELATED, L.MIN_SCORE))


# Cleaning ---------------------------------------------------------------------------------------------------------

query("normalize_role", "SELECT conv_id, turn, CASE WHEN lower(role) IN ('human','user','you','me') THEN 'human' WHEN lower(role) IN ('assistant','claude','ai','bot','system') THEN 'assistant' ELSE lower(role) END AS role FROM conversations")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", C.normalize_role(F.col("role")).alias("role")))
query("role_distribution", "SELECT role, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY role")(
    lambda s, d: table(s, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")))

_NOISE = "concat('<thinking>x', chr(10), 'y</thinking>', text, '  [INST] <artifact id=\"1\">gone</artifact>', chr(10), chr(10), chr(10), chr(10), '```python', chr(10), ' code ', chr(10), '```', chr(13), chr(10), '<response>', cast(turn AS {string}), '</response>  ', chr(1), ' ')"
_STEPS = {
    "clean_strip_artifacts": (C.strip_artifacts, r"regexp_replace({x}, '(?si)<(?:artifact|antArtifact)[^>]*>.*?</(?:artifact|antArtifact)>', '', 'g')"),
    "clean_strip_thinking": (C.strip_thinking, r"regexp_replace({x}, '(?si)<thinking>.*?</thinking>', '', 'g')"),
    "clean_code_fences": (C.normalize_fences, r"regexp_replace({x}, '(?s)```(?:[\w+-]*\n)?\s*(.*?)\s*```', '```' || chr(10) || '\1' || chr(10) || '```', 'g')"),
    "clean_markers": (C.strip_markers, r"regexp_replace({x}, '(?i)\[(?:INST|/INST|SYS|/SYS|CLAUDE|HUMAN)\]', '', 'g')"),
    "clean_xml_wrappers": (C.strip_wrappers, r"regexp_replace({x}, '(?i)</?(?:response|reply|answer|output|result)[^>]*>', '', 'g')"),
    "clean_whitespace": (C.normalize_whitespace, r"regexp_replace(list_transform([struct_pack(p := string_split_regex({x}, '(?s)```.*?```'), b := regexp_extract_all({x}, '(?s)```.*?```'))], lambda s: array_to_string(list_transform(range(1, len(s.p) + 1), lambda i: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s.p[i], '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\n[ \t]+', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), CASE WHEN i = 1 THEN '^[ \t]+' ELSE '\A\z\z' END, ''), CASE WHEN i = len(s.p) THEN '[ \t]+$' ELSE '\A\z\z' END, '') || coalesce(s.b[i], '')), ''))[1], '^\s+|\s+$', '', 'g')"),
    "clean_unicode": (lambda x: C.normalize_unicode(x), r"regexp_replace(regexp_replace(nfc_normalize({x}), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', '', 'g'), '\r\n?', chr(10), 'g')"),
}


def _clean_query(step):
    return lambda s, d: table(s, d, "conversations").select("conv_id", "turn", step(F.expr(_NOISE.format(string="STRING"))).alias("cleaned"))


_whole = _NOISE.format(string="VARCHAR")
for _name, (_step, _sql) in _STEPS.items():
    query(_name, f"SELECT conv_id, turn, {_sql.format(x=_NOISE.format(string='VARCHAR'))} AS cleaned FROM conversations")(_clean_query(_step))
    _whole = _sql.format(x=_whole)
query("clean_message", f"SELECT conv_id, turn, {_whole} AS cleaned FROM conversations")(_clean_query(C.clean_message))
query("clean_title", r"""SELECT conv_id, turn, CASE WHEN trim(regexp_replace(x, '\s+', ' ', 'g')) = '' THEN 'Untitled Conversation' ELSE trim(regexp_replace(x, '\s+', ' ', 'g')) END AS title
FROM (SELECT conv_id, turn, regexp_replace(nfc_normalize(CASE WHEN turn = 0 THEN '  ' || chr(10) ELSE ' ' || text || chr(9) || ' ' || chr(1) || chr(10) END), '[\x00-\x08\x0b-\x1f\x7f-\x{9f}]', '', 'g') AS x FROM conversations)""")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", C.clean_title(F.expr("CASE WHEN turn = 0 THEN concat('  ', chr(10)) ELSE concat(' ', text, chr(9), ' ', chr(1), chr(10)) END")).alias("title")))
query("drop_blank_messages", r"SELECT conv_id, turn, text FROM conversations WHERE turn % 3 <> 1 AND regexp_matches(text, '\S')")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", "text", F.expr("CASE WHEN turn % 3 = 1 THEN ' \n\t ' ELSE text END").alias("x")).where(C.not_blank(F.col("x"))).drop("x"))
query("validate_messages", "SELECT conv_id, turn, 'message has no role' AS error FROM conversations WHERE role = 'system' UNION ALL SELECT conv_id, turn, 'message has no content' FROM conversations WHERE role <> 'system' AND turn = 2")(
    lambda s, d: V.message_errors(table(s, d, "conversations").select("conv_id", "turn", F.expr("nullif(role, 'system')").alias("role"), F.expr("CASE WHEN turn <> 2 THEN text END").alias("text"))))

# Rendering --------------------------------------------------------------------------------------------------------

query("wikilink_format", f"WITH {CONV} SELECT conv_id, '[[' || trim(translate('#' || title || '|^', '[]|#^\\', '')) || ']]' AS link, CASE WHEN trim(translate(category, '[]|#^\\', '')) <> '' THEN '[[' || trim(translate(title, '[]|#^\\', '')) || '|' || category || ']]' END AS aliased FROM conv")(
    lambda s, d: conv(s, d).select("conv_id", R.wikilink(F.concat(F.lit("#"), "title", F.lit("|^"))).alias("link"), R.wikilink(F.col("title"), F.col("category")).alias("aliased")))
query("sanitize_filename", r"""WITH x AS (SELECT doc_id, trim(translate(text || '?.', '<>:"/\|?*', '---------'), '. ') AS t FROM documents),
y AS (SELECT doc_id, CASE WHEN length(t) > 200 THEN coalesce(nullif(regexp_extract(left(t, 200), '(?s)^(.*) [^ ]*$', 1), ''), left(t, 200)) ELSE t END AS t FROM x)
SELECT doc_id, CASE WHEN t = '' THEN 'Untitled' ELSE t END AS filename FROM y""")(
    lambda s, d: table(s, d, "documents").select("doc_id", R.sanitize_filename(F.concat("text", F.lit("?."))).alias("filename")))
query("escape_yaml", r"""SELECT doc_id, replace(replace(replace(replace('a\"b' || text || chr(13), '\', '\\'), '"', '\"'), chr(10), ' '), chr(13), '') AS yaml FROM documents""")(
    lambda s, d: table(s, d, "documents").select("doc_id", R.escape_yaml(F.concat(F.lit('a\\"b'), "text", F.lit("\r"))).alias("yaml")))
query("callout_render", """SELECT conv_id, turn, CASE WHEN role = 'user' THEN '> [!question]+ Human' ELSE '> [!info]+ Assistant' END || chr(10) ||
array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x = '' THEN '>' ELSE '> ' || x END), chr(10)) AS block FROM conversations""")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", R.callout(C.normalize_role(F.col("role")), F.col("text")).alias("block")))
query("link_strength_label", f"{GRAPH} SELECT src, dst, CASE WHEN weight >= 0.8 THEN 'strong' WHEN weight >= 0.5 THEN 'moderate' ELSE 'weak' END AS label FROM edges")(
    lambda s, d: edges(s, d).select("src", "dst", R.strength_label(F.col("weight")).alias("label")))
query("duration_label", """SELECT event_id, CASE WHEN v < 60 THEN printf('%.1fs', v) WHEN v < 3600 THEN (floor(floor(v) / 60))::BIGINT || 'm ' || (floor(v) % 60)::BIGINT || 's'
ELSE (floor(floor(v) / 3600))::BIGINT || 'h ' || (floor((floor(v) % 3600) / 60))::BIGINT || 'm' END AS label FROM (SELECT event_id, (event_id % 9000) * 1.0::DOUBLE AS v FROM events)""")(
    lambda s, d: table(s, d, "events").select("event_id", R.duration_label((F.col("event_id") % 9000) * F.lit(1.0)).alias("label")))
query("date_labels", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%B %Y') AS month_name, year(o_orderdate) || ' Q' || quarter(o_orderdate) AS quarter, dayname(o_orderdate) AS weekday FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.date_format("o_orderdate", "MMMM yyyy").alias("month_name"),
                                              F.concat(F.year("o_orderdate"), F.lit(" Q"), F.quarter("o_orderdate")).alias("quarter"), F.date_format("o_orderdate", "EEEE").alias("weekday")))

# Annotation -------------------------------------------------------------------------------------------------------


def numbered(spark, d) -> DataFrame:
    w = Window.partitionBy("conv_id")
    return table(spark, d, "conversations").withColumn("k", F.row_number().over(w.orderBy("turn"))).withColumn("n", F.count("*").over(w))


_CUT = "CASE WHEN length(text) > {n} THEN left(text, {n}) || '{tail}' ELSE text END"
query("tagger_digest", f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
parts AS (SELECT conv_id, k * 10 AS pos, role || ': ' || {_CUT.format(n=500, tail='...')} AS part FROM m WHERE n <= 6 OR k <= 3 OR k > n - 3
UNION ALL SELECT conv_id, 35, '[' || (n - 6) || ' messages omitted]' FROM m WHERE n > 6 AND k = 1)
SELECT conv_id, string_agg(part, chr(10) ORDER BY pos) AS digest FROM parts GROUP BY conv_id""")(
    lambda s, d: (lambda m: m.where("n <= 6 OR k <= 3 OR k > n - 3").select("conv_id", (F.col("k") * 10).alias("pos"), F.concat("role", F.lit(": "), F.expr("CASE WHEN length(text) > 500 THEN concat(left(text, 500), '...') ELSE text END")).alias("part"))
    .unionByName(m.where("n > 6 AND k = 1").select("conv_id", F.lit(35).alias("pos"), F.concat(F.lit("["), F.col("n") - 6, F.lit(" messages omitted]")).alias("part")))
    .groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "\n").alias("digest")))(numbered(s, d)))
query("extraction_prompt", f"""WITH {CONV}, {TAGS}, t AS (SELECT conv_id, string_agg(tag, ', ' ORDER BY rk) AS tags FROM tags GROUP BY conv_id),
m AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Human' ELSE 'Assistant' END || ': ' || {_CUT.format(n=2000, tail='... [truncated]')}, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id)
SELECT conv_id, 'Title: ' || title || chr(10) || 'Date: ' || strftime(created_at, '%Y-%m-%d') || chr(10) || 'Category: ' || category || chr(10) || 'Tags: ' || coalesce(tags, '') || chr(10) || chr(10) || body AS prompt FROM conv JOIN m USING (conv_id) LEFT JOIN t USING (conv_id)""")(
    lambda s, d: conv(s, d).join(table(s, d, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("role") == "user", "Human").otherwise("Assistant"), F.lit(": "), F.expr("CASE WHEN length(text) > 2000 THEN concat(left(text, 2000), '... [truncated]') ELSE text END")).alias("part"))
    .groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n\n").alias("body")), "conv_id")
    .join(tags(s, d).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "tag"))), lambda x: x["tag"]), ", ").alias("tags")), "conv_id", "left")
    .select("conv_id", F.concat(F.lit("Title: "), "title", F.lit("\nDate: "), F.date_format("created_at", "yyyy-MM-dd"), F.lit("\nCategory: "), "category", F.lit("\nTags: "), F.coalesce("tags", F.lit("")), F.lit("\n\n"), "body").alias("prompt")))
query("rule_tags", f"WITH {TAGS} SELECT conv_id, tag, n, rk, round(n / max(n) OVER (PARTITION BY conv_id), 6) AS confidence FROM tags")(
    lambda s, d: tags(s, d).withColumn("confidence", F.round(F.col("n") / F.max("n").over(Window.partitionBy("conv_id")), 6)))
query("cap_tags", f"WITH {TAGS} SELECT conv_id, count(*) AS n_tags, string_agg(tag, ',' ORDER BY rk) AS tags FROM tags GROUP BY conv_id")(
    lambda s, d: tags(s, d).groupBy("conv_id").agg(F.count("*").alias("n_tags"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "tag"))), lambda x: x["tag"]), ",").alias("tags")))

# Graph ------------------------------------------------------------------------------------------------------------

query("conversation_nodes", f"WITH {CONV} SELECT 'conv:' || conv_id AS node_id, title AS label, category, n_messages, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created FROM conv")(
    lambda s, d: conv(s, d).select(F.concat(F.lit("conv:"), "conv_id").alias("node_id"), F.col("title").alias("label"), "category", "n_messages", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created")))
query("term_nodes", f"WITH {TAGS} SELECT 'concept:' || tag AS node_id, min(conv_id) AS first_conv, count(*) AS occurrence_count FROM tags GROUP BY tag")(
    lambda s, d: tags(s, d).groupBy("tag").agg(F.min("conv_id").alias("first_conv"), F.count("*").alias("occurrence_count")).select(F.concat(F.lit("concept:"), "tag").alias("node_id"), "first_conv", "occurrence_count"))
query("discusses_edges", f"WITH {TAGS} SELECT conv_id, tag AS term, n::DOUBLE AS weight FROM tags")(
    lambda s, d: tags(s, d).select("conv_id", F.col("tag").alias("term"), F.col("n").cast("double").alias("weight")))
query("shared_tags_edges", f"{BASE}, {SHARED} SELECT src, dst, shared, round(1.5 * w, 6) AS weight FROM weighted")(shared_tags)
query("shared_concepts_edges", f"{BASE}, {SHARED} SELECT src, dst, shared, round(w, 6) AS weight FROM weighted WHERE shared >= 2")(shared_concepts)
query("temporal_edges", f"WITH {CONV}, {TEMPORAL} SELECT src, dst, days_apart, round(0.5 * greatest(0.1, 1 - days_apart / 7), 6) AS weight FROM temporal")(temporal)
query("semantic_edges", r"""WITH w AS (SELECT DISTINCT conv_id AS id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS word FROM conversations WHERE role = 'user'),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id), p AS (SELECT a.id AS src, b.id AS dst, count(*) AS k FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY ALL)
SELECT src, dst, round(k / (x.n + y.n - k), 6) AS weight FROM p JOIN n x ON x.id = src JOIN n y ON y.id = dst WHERE k / (x.n + y.n - k) >= 0.1""")(
    lambda s, d: alike(table(s, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("id"), F.explode(C.word_set(F.col("text"))).alias("term")), 0.1))
query("semantic_edges_docs", r"""WITH w AS (SELECT DISTINCT doc_id AS id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS word FROM documents),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id), p AS (SELECT a.id AS src, b.id AS dst, count(*) AS k FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY ALL)
SELECT src, dst, round(k / (x.n + y.n - k), 6) AS weight FROM p JOIN n x ON x.id = src JOIN n y ON y.id = dst WHERE k / (x.n + y.n - k) >= 0.3""")(lambda s, d: alike_documents(s, d))
query("semantic_edges_docs_min", None)(lambda s, d: alike_documents(s, d))
query("edge_log_running_weight", f"{GRAPH} SELECT src, dst, stage, relationship, added, round(sum(added) OVER (PARTITION BY src, dst ORDER BY stage), 6) AS weight FROM stages")(log)
query("edges_collapsed", f"{GRAPH} SELECT * FROM edges")(edges)
query("top_neighbors", f"{GRAPH} SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM ways QUALIFY rank <= 10")(
    lambda s, d: G.topk(G.both_ways(edges(s, d), "weight"), ["src"], [F.desc("weight"), F.col("dst")], 10))
query("strong_connections", f"{GRAPH} SELECT src, dst, weight, relationship FROM ways WHERE weight >= 0.5")(
    lambda s, d: G.both_ways(edges(s, d), "weight", "relationship").where("weight >= 0.5"))
query("node_type_counts", f"WITH {CONV}, {TAGS} SELECT 'conversation' AS node_type, count(*) AS n FROM conv UNION ALL SELECT 'concept', count(DISTINCT tag) FROM tags")(
    lambda s, d: conv(s, d).agg(F.count("*").alias("n")).select(F.lit("conversation").alias("node_type"), "n").unionByName(tags(s, d).agg(F.count_distinct("tag").alias("n")).select(F.lit("concept").alias("node_type"), "n")))
query("log_degree", f"{GRAPH} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM stages UNION ALL SELECT dst FROM stages) GROUP BY node")(lambda s, d: G.log_degree(log(s, d)))
query("graph_summary", f"{GRAPH} SELECT (SELECT count(*) FROM conv) AS nodes, (SELECT count(*) FROM stages) AS logged_edges, count(*) AS edges, round(sum(weight), 4) AS total_weight FROM edges")(
    lambda s, d: (lambda e: one_row(e.agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 4).alias("total_weight"), F.sum("logged").alias("logged_edges")), conv(s, d).agg(F.count("*").alias("nodes"))))(
        log(s, d).groupBy("src", "dst").agg(F.round(F.sum("added"), 6).alias("weight"), F.count("*").alias("logged"))))

_ROUNDS = 5
_rank_sql = f"{GRAPH}, tot AS (SELECT src, sum(weight) AS t FROM ways GROUP BY src), lk AS (SELECT src, dst, weight / t AS share FROM ways JOIN tot USING (src)), nn AS (SELECT count(*) AS n FROM conv), r0 AS (SELECT conv_id AS id, 1.0::DOUBLE / n AS rank FROM conv, nn)"
for _k in range(1, _ROUNDS + 1):
    _rank_sql += f", l{_k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{_k - 1} LEFT JOIN tot ON src = id WHERE t IS NULL), g{_k} AS (SELECT dst, sum(rank * share) AS got FROM r{_k - 1} JOIN lk ON src = id GROUP BY dst), r{_k} AS (SELECT r.id, 0.15 / n + 0.85 * (coalesce(got, 0) + lost / n) AS rank FROM r{_k - 1} r LEFT JOIN g{_k} ON dst = id, l{_k}, nn)"
query("pagerank_k5", f"{_rank_sql} SELECT id, round(rank, 6) AS rank FROM r{_ROUNDS}")(
    lambda s, d: G.pagerank(conv(s, d).select(F.col("conv_id").alias("id")), stage(edges(s, d), "rank-edges"), _ROUNDS, tolerance=None).select("id", F.round("rank", 6).alias("rank")))
query("pagerank", None)(lambda s, d: G.pagerank(conv(s, d).select(F.col("conv_id").alias("id")), stage(edges(s, d), "rank-edges")))
query("connected_components", f"""WITH RECURSIVE {CONV}, {TAGS}, {SHARED}, e AS (SELECT src AS a, dst AS b FROM weighted WHERE shared >= 2 UNION SELECT dst, src FROM weighted WHERE shared >= 2),
reach AS (SELECT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a) SELECT a AS v, min(b) AS root FROM reach GROUP BY a""")(
    lambda s, d: connected_components(tiles.forest(terms(s, d), 2).select(F.col("src").alias("a"), F.col("dst").alias("b"))))

# Links ------------------------------------------------------------------------------------------------------------

query("link_direct", f"{GRAPH} SELECT src, dst, weight AS score, relationship FROM ways")(lambda s, d: L.direct(edges(s, d)))
query("link_indirect", f"{BASE}, {TWO_HOP} SELECT * FROM two")(lambda s, d: tiles.indirect(term_edges(s, d), L.INDIRECT))
query("link_topk", f"{GRAPH}, {CAND} SELECT * FROM links")(links)
query("concept_links", f"""WITH {TAGS}, occ AS (SELECT tag, count(*) AS c FROM tags GROUP BY tag) SELECT conv_id, tag, round(n * (1 + 0.1::DOUBLE * c), 6) AS score,
row_number() OVER (PARTITION BY conv_id ORDER BY round(n * (1 + 0.1::DOUBLE * c), 6) DESC, tag) AS rank FROM tags JOIN occ USING (tag) QUALIFY rank <= 15""")(
    lambda s, d: (lambda t: G.topk(t.join(t.groupBy("tag").agg(F.count("*").alias("c")), "tag").select("conv_id", "tag", F.round(F.col("n") * (1 + L.BOOST * F.col("c")), 6).alias("score")), ["conv_id"], [F.desc("score"), F.col("tag")], L.CONCEPTS))(tags(s, d)))
query("prev_next", f"WITH {CONV} SELECT conv_id, lag(title) OVER w AS previous_title, lead(title) OVER w AS next_title FROM conv WINDOW w AS (PARTITION BY category ORDER BY created_at, conv_id)")(
    lambda s, d: L.in_sequence(conv(s, d), ["category"]))
query("backlinks", f"""{GRAPH}, {CAND}, owners AS (SELECT title, min(conv_id) AS owner FROM conv GROUP BY title),
named AS (SELECT DISTINCT o.owner, l.src, c2.title AS st FROM links l JOIN conv c ON c.conv_id = l.dst JOIN owners o ON o.title = c.title JOIN conv c2 ON c2.conv_id = l.src)
SELECT owner AS conv_id, string_agg(st, ' / ' ORDER BY src) AS backlinks FROM named GROUP BY owner""")(lambda s, d: L.backlinks(links(s, d), conv(s, d)))
query("link_stats", f"{GRAPH}, {CAND} SELECT count(*) AS total_links, count(DISTINCT src) AS linked, round(count(*) / count(DISTINCT src), 6) AS average, round(max(score), 6) AS best FROM links")(
    lambda s, d: links(s, d).agg(F.count("*").alias("total_links"), F.count_distinct("src").alias("linked"), F.round(F.count("*") / F.count_distinct("src"), 6).alias("average"), F.round(F.max("score"), 6).alias("best")))
query("broken_links", f"{GRAPH}, {CAND} SELECT src, dst FROM links WHERE dst NOT IN (SELECT conv_id FROM conv WHERE n_messages >= 3)")(
    lambda s, d: links(s, d).select("src", "dst").join(conv(s, d).where("n_messages >= 3").select(F.col("conv_id").alias("dst")), "dst", "left_anti"))

# Rollups ----------------------------------------------------------------------------------------------------------

query("category_moc", f"WITH {CONV} SELECT category, count(*) AS notes, sum(n_messages)::BIGINT AS messages, min(created_at) AS first_at, max(created_at) AS last_at FROM conv GROUP BY category HAVING count(*) >= 3")(
    lambda s, d: conv(s, d).groupBy("category").agg(F.count("*").alias("notes"), F.sum("n_messages").alias("messages"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")).where("notes >= 3"))
query("concept_ranking", f"WITH {CONV}, {TAGS} SELECT category, tag, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, tag) AS rank FROM tags JOIN conv USING (conv_id) GROUP BY category, tag QUALIFY rank <= 50")(
    lambda s, d: G.topk(tags(s, d).select("conv_id", "tag").join(conv(s, d).select("conv_id", "category"), "conv_id").groupBy("category", "tag").agg(F.count("*").alias("n")), ["category"], [F.desc("n"), F.col("tag")], 50))
query("topic_moc", f"WITH {TAGS} SELECT tag AS topic, count(*) AS degree, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS notes FROM tags GROUP BY tag HAVING count(*) >= 3 ORDER BY degree DESC, topic LIMIT 20")(
    lambda s, d: tags(s, d).groupBy(F.col("tag").alias("topic")).agg(F.count("*").alias("degree"), F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("notes")).where("degree >= 3").orderBy(F.desc("degree"), "topic").limit(20))
query("monthly_moc", f"WITH {CONV} SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS notes, string_agg(DISTINCT category, ', ' ORDER BY category) AS categories FROM conv GROUP BY 1 HAVING count(*) >= 3")(
    lambda s, d: conv(s, d).groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("notes"), F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories")).where("notes >= 3"))
query("quarterly_moc", "SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, count(*) AS notes, round(sum(o_totalprice), 2) AS total, string_agg(DISTINCT strftime(o_orderdate, '%Y-%m'), ',' ORDER BY strftime(o_orderdate, '%Y-%m')) AS months FROM orders GROUP BY ALL HAVING count(*) >= 6")(
    lambda s, d: table(s, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.count("*").alias("notes"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.array_join(F.array_sort(F.collect_set(F.date_format("o_orderdate", "yyyy-MM"))), ",").alias("months")).where("notes >= 6"))
query("master_moc", f"WITH {CONV}, {TAGS}, r AS (SELECT category, tag, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, tag) AS k FROM tags JOIN conv USING (conv_id) GROUP BY category, tag QUALIFY k <= 15) SELECT tag, count(*) AS mocs FROM r GROUP BY tag ORDER BY mocs DESC, tag LIMIT 20")(
    lambda s, d: G.topk(tags(s, d).select("conv_id", "tag").join(conv(s, d).select("conv_id", "category"), "conv_id").groupBy("category", "tag").agg(F.count("*").alias("n")), ["category"], [F.desc("n"), F.col("tag")], 15).groupBy("tag").agg(F.count("*").alias("mocs")).orderBy(F.desc("mocs"), "tag").limit(20))
query("recent_conversations", f"WITH {CONV} SELECT conv_id, title, created_at FROM conv ORDER BY created_at DESC, conv_id LIMIT 10")(
    lambda s, d: conv(s, d).select("conv_id", "title", "created_at").orderBy(F.desc("created_at"), "conv_id").limit(10))
query("topic_bands", f"WITH {TAGS}, c AS (SELECT tag, count(*) AS n FROM tags GROUP BY tag) SELECT CASE WHEN n >= 10 THEN 'core' WHEN n >= 5 THEN 'frequent' WHEN n >= 2 THEN 'occasional' ELSE 'single' END AS band, count(*) AS topics, sum(n)::BIGINT AS uses FROM c GROUP BY 1")(
    lambda s, d: tags(s, d).groupBy("tag").agg(F.count("*").alias("n")).groupBy(F.when(F.col("n") >= 10, "core").when(F.col("n") >= 5, "frequent").when(F.col("n") >= 2, "occasional").otherwise("single").alias("band")).agg(F.count("*").alias("topics"), F.sum("n").alias("uses")))
query("tag_usage", f"WITH {TAGS} SELECT tag, count(*) AS n FROM tags GROUP BY tag ORDER BY n DESC, tag LIMIT 30")(
    lambda s, d: tags(s, d).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(30))
query("timeline", "SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY ROLLUP (year(o_orderdate), month(o_orderdate))")(
    lambda s, d: table(s, d, "orders").rollup(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n")))
query("overview_stats", f"WITH {CONV} SELECT count(*) AS conversations, sum(n_messages)::BIGINT AS messages, round(avg(n_messages), 1) AS average, strftime(min(created_at), '%Y-%m-%d') || ' to ' || strftime(max(created_at), '%Y-%m-%d') AS date_range FROM conv")(
    lambda s, d: conv(s, d).agg(F.count("*").alias("conversations"), F.sum("n_messages").alias("messages"), F.round(F.avg("n_messages"), 1).alias("average"), F.concat(F.date_format(F.min("created_at"), "yyyy-MM-dd"), F.lit(" to "), F.date_format(F.max("created_at"), "yyyy-MM-dd")).alias("date_range")))
query("top_months", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, month LIMIT 10")(
    lambda s, d: table(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "month").limit(10))
query("weekday_activity", "SELECT weekday::INT AS weekday, n, repeat('#', floor(n / max(n) OVER () * 20)::INT) AS bar FROM (SELECT r.k AS weekday, (SELECT count(*) FROM events WHERE isodow(ts) - 1 = r.k) AS n FROM range(7) r(k))")(
    lambda s, d: with_bar(weekday_counts(table(s, d, "events"), "ts"), 20))
query("distinct_counts", f"WITH {CONV}, {TAGS} SELECT (SELECT count(DISTINCT category) FROM conv) AS categories, (SELECT count(DISTINCT tag) FROM tags) AS concepts, (SELECT category FROM conv GROUP BY category ORDER BY count(*) DESC, category LIMIT 1) AS most_active_category")(
    lambda s, d: one_row(
        conv(s, d).groupBy("category").agg(F.count("*").alias("n")).agg(F.count("*").alias("categories"), F.min_by("category", F.struct(-F.col("n"), "category")).alias("most_active_category")),
        tags(s, d).agg(F.count_distinct("tag").alias("concepts"))))

# Vault statistics and declarative listings ------------------------------------------------------------------------

query("text_stats", r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words, len(regexp_extract_all(text, '#([\w/]+)')) AS tags, len(regexp_extract_all(text, '\[\[(.*?)\]\]')) AS links FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.size(F.array_remove(F.split("text", r"\s+"), "")).cast("bigint").alias("words"), F.regexp_count("text", F.lit(r"#([\w/]+)")).cast("bigint").alias("tags"), F.regexp_count("text", F.lit(r"\[\[(.*?)\]\]")).cast("bigint").alias("links")))
query("top_hashtags", r"SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text || ' #' || source || '/' || lang || ' #' || lang, '#([\w/]+)', 1)) AS tag FROM documents) GROUP BY tag ORDER BY n DESC, tag LIMIT 10")(
    lambda s, d: table(s, d, "documents").select(F.explode(F.regexp_extract_all(F.concat("text", F.lit(" #"), "source", F.lit("/"), "lang", F.lit(" #"), "lang"), F.lit(r"#([\w/]+)"), F.lit(1))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10))
query("dv_recent", "SELECT event_id, ts FROM events WHERE event_type LIKE 'p%' ORDER BY ts DESC, event_id LIMIT 10")(
    lambda s, d: table(s, d, "events").where(F.col("event_type").startswith("p")).select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(10))
query("dv_folder_counts", "SELECT event_type AS folder, count(*) AS n FROM events GROUP BY 1")(lambda s, d: table(s, d, "events").groupBy(F.col("event_type").alias("folder")).agg(F.count("*").alias("n")))
query("dv_month_range", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'")(
    lambda s, d: table(s, d, "orders").where("o_orderdate >= timestamp_ntz'1996-01-01' AND o_orderdate < timestamp_ntz'1996-02-01'").select("o_orderkey", "o_orderdate"))
query("dv_last7_outlinks", f"{GRAPH}, {CAND} SELECT conv_id, count(dst) AS outlinks FROM conv LEFT JOIN links ON src = conv_id WHERE created_at >= (SELECT max(created_at) - INTERVAL 7 DAY FROM conv) GROUP BY conv_id")(
    lambda s, d: (lambda c: c.withColumn("one", F.lit(1)).join(F.broadcast(c.agg((F.max("created_at") - F.expr("INTERVAL '7' DAY")).alias("since")).withColumn("one", F.lit(1))), "one").where("created_at >= since").join(links(s, d).select(F.col("src").alias("conv_id"), "dst"), "conv_id", "left").groupBy("conv_id").agg(F.count("dst").alias("outlinks")))(conv(s, d)))
query("dv_month_group", "SELECT strftime(ts, '%Y-%m') AS month, max(ts) AS newest, count(*) AS n, row_number() OVER (ORDER BY max(ts) DESC) AS place FROM events GROUP BY 1")(
    lambda s, d: table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.max("ts").alias("newest"), F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("newest")))))

# Notes ------------------------------------------------------------------------------------------------------------

query("render_frontmatter", f"""WITH {CONV}, {TAGS}, t AS (SELECT conv_id, string_agg('  - ' || tag, chr(10) ORDER BY rk) AS lines FROM tags GROUP BY conv_id)
SELECT conv_id, '---' || chr(10) || 'title: "' || replace(replace(title, '\\', '\\\\'), '"', '\\"') || '"' || chr(10) || 'date: ' || strftime(created_at, '%Y-%m-%d') || chr(10) || 'created: ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || chr(10) || 'category: ' || category || CASE WHEN lines IS NOT NULL THEN chr(10) || 'tags:' || chr(10) || lines ELSE '' END || chr(10) || '---' AS frontmatter FROM conv LEFT JOIN t USING (conv_id)""")(
    lambda s, d: conv(s, d).join(tags(s, d).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "tag"))), lambda x: F.concat(F.lit("  - "), x["tag"])), "\n").alias("lines")), "conv_id", "left")
    .select("conv_id", F.concat_ws("\n", F.lit("---"), F.concat(F.lit('title: "'), R.escape_yaml(F.col("title")), F.lit('"')), F.concat(F.lit("date: "), F.date_format("created_at", "yyyy-MM-dd")), F.concat(F.lit("created: "), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")), F.concat(F.lit("category: "), "category"), F.when(F.col("lines").isNotNull(), F.concat(F.lit("tags:\n"), "lines")), F.lit("---")).alias("frontmatter")))
query("render_related", f"""{GRAPH}, {CAND} SELECT src AS conv_id, string_agg('- [[' || trim(translate(title, '[]|#^\\', '')) || ']] (' || CASE WHEN score >= 0.8 THEN 'strong' WHEN score >= 0.5 THEN 'moderate' ELSE 'weak' END || ')', chr(10) ORDER BY rank) AS section FROM links JOIN conv ON conv_id = dst GROUP BY src""")(
    lambda s, d: links(s, d).join(conv(s, d).select(F.col("conv_id").alias("dst"), "title"), "dst").groupBy(F.col("src").alias("conv_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), R.wikilink(F.col("title")), F.lit(" ("), R.strength_label(F.col("score")), F.lit(")")).alias("line")))), lambda x: x["line"]), "\n").alias("section")))

# Promised features ------------------------------------------------------------------------------------------------

query("dedup_exact", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")(lambda s, d: table(s, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h"))
query("min_messages", f"WITH {CONV} SELECT conv_id, n_messages FROM conv WHERE n_messages >= 3")(lambda s, d: conv(s, d).where("n_messages >= 3").select("conv_id", "n_messages"))
query("chunk_messages", "SELECT conv_id, floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 3)::BIGINT AS chunk, turn FROM conversations")(lambda s, d: numbered(s, d).select("conv_id", F.floor((F.col("k") - 1) / 3).alias("chunk"), "turn"))
query("code_blocks", r"""SELECT conv_id, turn, regexp_extract(b, '```([\w+-]+)', 1) AS language FROM (SELECT conv_id, turn, unnest(regexp_extract_all('```python' || chr(10) || text || chr(10) || '``` and ```sql' || chr(10) || 'x' || chr(10) || '```', '(?s)```[\w+-]+\n.*?```')) AS b FROM conversations)""")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(F.concat(F.lit("```python\n"), "text", F.lit("\n``` and ```sql\nx\n```")), F.lit(r"(?s)```[\w+-]+\n.*?```"), F.lit(0))).alias("b")).select("conv_id", "turn", F.regexp_extract("b", r"```([\w+-]+)", 1).alias("language")))
query("incremental_new", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02')")(
    lambda s, d: (lambda e: e.select("user_id").distinct().join(e.where("ts < timestamp_ntz'2024-01-02'").select("user_id"), "user_id", "left_anti"))(table(s, d, "events")))
query("weekly_summary", "SELECT date_trunc('week', ts)::TIMESTAMP AS week, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")(
    lambda s, d: table(s, d, "events").groupBy(F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))
query("taxonomy_rollup", "SELECT p_brand AS brand, p_type AS type, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_type)")(
    lambda s, d: table(s, d, "part").rollup(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).agg(F.count("*").alias("n")))
query("html_title", r"SELECT page_id, trim(coalesce(nullif(regexp_extract(html, '(?si)<h1[^>]*>(.*?)</h1>', 1), ''), regexp_extract(html, '(?si)<title[^>]*>(.*?)</title>', 1))) AS title FROM pages")(
    lambda s, d: table(s, d, "pages").select("page_id", F.trim(F.coalesce(F.nullif(F.regexp_extract("html", r"(?si)<h1[^>]*>(.*?)</h1>", 1), F.lit("")), F.regexp_extract("html", r"(?si)<title[^>]*>(.*?)</title>", 1))).alias("title")))
