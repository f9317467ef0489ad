"""Queries of the knowledge graph, annotation and pages over enriched conversations, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoweave import runner
from convoweave.functions import cleaning as C
from convoweave.functions import rendering as R
from convoweave.operators import annotation as A
from convoweave.operators import graph as G
from convoweave.operators import hierarchy as H
from convoweave.operators import knowledge as K
from convoweave.operators import link_check as LC
from convoweave.operators import linking as L
from convoweave.operators import pages as P
from convoweave.operators import summaries as S
from convoweave.operators import tiles
from convoweave.operators.communities import first_turn_simple, louvain, modularity
from convoweave.operators.duplicates import exact_duplicates, near_duplicates
from convoweave.plans import catalogue as B
from convoweave.plans.catalogue import query
from convoweave.sinks import graph_files
from convoweave.shared import stage
from convoweave.sources import exports, validation

# Derived frames ---------------------------------------------------------------------------------------------------


def messages(s, d) -> DataFrame:
    return B.table(s, d, "conversations").select("conv_id", "turn", C.normalize_role(F.col("role")).alias("role"), "text")


def notes(s, d) -> DataFrame:
    return B.conv(s, d).join(A.human_summary(messages(s, d)), "conv_id").withColumn("source_url", F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("https://chat/"), "conv_id")))


def tags(s, d) -> DataFrame:
    return A.frequent_words(messages(s, d))


def concepts(s, d) -> DataFrame:
    return A.occurrences(messages(s, d), A.PATTERNS["concept"])


def people(s, d) -> DataFrame:
    return A.occurrences(messages(s, d), A.PATTERNS["person"])


def lists(s, d) -> DataFrame:
    return A.short_lines(messages(s, d))


def nodes(s, d) -> DataFrame:
    return stage(K.nodes(notes(s, d), tags(s, d), concepts(s, d), people(s, d)), "graph-nodes")


def parts(s, d) -> tuple[DataFrame, ...]:
    return notes(s, d), tags(s, d), concepts(s, d), people(s, d), C.word_set


def pair_table(s, d) -> DataFrame:
    """Read by several branches of what follows, so it is made once; log and simple graph are views of it."""
    return stage(K.pair_table(*parts(s, d)), "pair-table")


def term_links(s, d) -> DataFrame:
    return stage(K.term_links(tags(s, d), concepts(s, d), people(s, d)), "term-links")


def graph(s, d) -> tuple[DataFrame, DataFrame]:
    """All logged edges and the simple graph, of one pair table."""
    table, links = pair_table(s, d), term_links(s, d)
    return K.all_edges(K.log_of(table), links), K.simple_edges(K.fold_of(table), links)


def degrees(s, d) -> DataFrame:
    """(node, degree) over every logged edge, without a table of pairs."""
    return stage(K.all_degrees(K.pair_degrees(*parts(s, d)), term_links(s, d)), "degrees")


def shown_nodes(s, d, least: float, most: int) -> DataFrame:
    """The best connected conversations and concepts over edges of ``least`` or more between them."""
    heavy = term_links(s, d).where((F.col("relationship") == "discusses") & (F.col("weight") >= least))
    return K.shown_of(nodes(s, d).where("node_type IN ('conversation', 'concept')"), K.all_degrees(K.pair_degrees(*parts(s, d), least), heavy), most)


def term_edges(s, d) -> DataFrame:
    t, c, p = tags(s, d), concepts(s, d), people(s, d)
    return P.union(K.term_edges("concept", "discusses", c), K.tag_edges(t), K.term_edges("person", "mentions", p)).withColumn("weight", F.round("weight", 6))


def simple_edges(s, d) -> DataFrame:
    return graph(s, d)[1]


def simple_parts(s, d) -> tuple[DataFrame, DataFrame]:
    """The simple graph between conversations and to terms, without the table of what each rule adds."""
    folded = stage(K.fold_of(K.pair_table(*parts(s, d))).select("src", "dst", "weight"), "simple-pairs")
    return K.simple_parts(folded, term_links(s, d))


def rule_edges(s, d) -> DataFrame:
    """The simple graph of the three rules on tags and time, written once, one way."""
    return stage(B.edges(s, d).select("src", "dst", "weight"), "rule-edges")


def node_ids(s, d) -> DataFrame:
    return nodes(s, d).select(F.col("node_id").alias("id"))


def term_pairs(s, d) -> DataFrame:
    return K.term_pairs(tags(s, d), concepts(s, d))


def related(s, d) -> DataFrame:
    return stage(K.related(*parts(s, d)), "related")


def linked(s, d) -> DataFrame:
    titles = notes(s, d).select(F.col("conv_id").alias("dst"), "title")
    return related(s, d).join(titles, "dst").select(F.col("src").alias("conv_id"), "rank", F.col("dst").alias("target"), "title", F.col("score").alias("strength"))


def held(s, d) -> DataFrame:
    return stage(P.members(notes(s, d), tags(s, d), concepts(s, d), term_links(s, d)), "map-members")  # only those edges reach concepts


ROLE = "CASE WHEN lower(role) IN ('human','user','you','me') THEN 'human' WHEN lower(role) IN ('assistant','claude','ai','bot','system') THEN 'assistant' ELSE lower(role) END"


def _found(name: str, pattern: str) -> str:
    return rf"""{name} AS (SELECT conv_id, turn * 100000 + i AS place, l[i] AS raw FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM
  (SELECT conv_id, turn, regexp_extract_all(text, '{pattern}') AS l FROM conversations)))"""


MESSAGES = f"messages AS (SELECT conv_id, turn, {ROLE} AS role, text FROM conversations)"
NOTES = f"""{B.CONV}, {MESSAGES}, sums AS (SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'human'), '') AS summary FROM messages GROUP BY conv_id),
notes AS (SELECT conv.*, summary, CASE WHEN conv_id % 2 = 0 THEN 'https://chat/' || conv_id END AS source_url FROM conv JOIN sums USING (conv_id))"""
CONF = "sure AS (SELECT conv_id, tag, n, rk AS rank, round(n / max(n) OVER (PARTITION BY conv_id), 6) AS confidence FROM tags)"
CONCEPTS, PEOPLE = _found("concepts", r"\p{L}{9,}"), _found("people", r"\p{Lu}\p{L}{7,}")
LISTS = f"""lists AS (SELECT conv_id, kind, turn * 100000 + i AS place, l[i] AS item FROM (SELECT conv_id, turn, kind, l, unnest(range(1, len(l) + 1)) AS i FROM
  (SELECT conv_id, turn, CASE WHEN role = 'human' THEN 'action' ELSE 'decision' END AS kind, string_split(text, chr(10)) AS l FROM messages)) WHERE length(l[i]) BETWEEN 1 AND {A.SHORT_LINE})"""
ALL = f"{NOTES}, {B.TAGS}, {CONF}, {CONCEPTS}, {PEOPLE}, {LISTS}"


def _nodes(kind: str, table: str, raw: str, place: str) -> str:
    return f"""SELECT '{kind}:' || t AS node_id, '{kind}' AS node_type, min_by(raw, conv_id * 100000000000 + place) AS label, count(*) AS n
FROM (SELECT conv_id, {place} AS place, {raw} AS raw, trim(lower({raw})) AS t FROM {table}) GROUP BY t"""


NODES = f"""nodes AS (SELECT 'conv:' || conv_id AS node_id, 'conversation' AS node_type, title AS label, n_messages AS n FROM notes
UNION ALL {_nodes('concept', 'concepts', 'raw', 'place')} UNION ALL {_nodes('tag', 'tags', 'tag', '0')} UNION ALL {_nodes('person', 'people', 'raw', 'place')})"""
TERMS = """terms AS (SELECT 'conv:' || conv_id AS src, 'concept:' || trim(lower(raw)) AS dst, 'discusses' AS relationship, count(*)::DOUBLE AS weight FROM concepts GROUP BY ALL
UNION ALL SELECT 'conv:' || conv_id, 'tag:' || trim(lower(tag)), 'tagged_with', sum(confidence) FROM sure GROUP BY ALL
UNION ALL SELECT 'conv:' || conv_id, 'person:' || trim(lower(raw)), 'mentions', count(*)::DOUBLE FROM people GROUP BY ALL)"""


def _overlap(name: str, table: str, column: str, least: int, factor: str) -> str:
    return f"""{name}_t AS (SELECT DISTINCT conv_id, trim(lower({column})) AS t FROM {table}), {name}_n AS (SELECT conv_id, count(*) AS n FROM {name}_t GROUP BY conv_id),
{name} AS (SELECT src, dst, shared, round({factor}::DOUBLE * shared / greatest(x.n, y.n), 6) AS weight FROM (SELECT a.conv_id AS src, b.conv_id AS dst, count(*) AS shared FROM {name}_t a JOIN {name}_t b ON a.t = b.t AND a.conv_id < b.conv_id GROUP BY ALL HAVING count(*) >= {least})
JOIN {name}_n x ON x.conv_id = src JOIN {name}_n y ON y.conv_id = dst)"""


PAIRS = f"""{_overlap('by_tag', 'tags', 'tag', 1, '1.5')}, {_overlap('by_concept', 'concepts', 'raw', 2, '1.0')}, {_overlap('by_person', 'people', 'raw', 1, '1.0')}, {B.TEMPORAL},
sw AS (SELECT DISTINCT conv_id AS id, unnest(list_filter(string_split_regex(lower(summary), '\\s+'), lambda x: x <> '')) AS word FROM notes), sn AS (SELECT id, count(*) AS n FROM sw GROUP BY id),
alike AS (SELECT src, dst, round(k / (x.n + y.n - k), 6) AS weight FROM (SELECT a.id AS src, b.id AS dst, count(*) AS k FROM sw a JOIN sw b ON a.word = b.word AND a.id < b.id GROUP BY ALL) JOIN sn x ON x.id = src JOIN sn y ON y.id = dst WHERE k / (x.n + y.n - k) >= 0.3),
rules AS (SELECT src, dst, 1 AS stage, 'shared_tags' AS relationship, weight AS added FROM by_tag UNION ALL SELECT src, dst, 2, 'shared_concepts', weight FROM by_concept
UNION ALL SELECT src, dst, 3, 'temporal_proximity', round(0.5 * greatest(0.1, 1 - days_apart / 7), 6) FROM temporal UNION ALL SELECT src, dst, 4, 'shared_people', weight FROM by_person UNION ALL SELECT src, dst, 5, 'semantic_similarity', weight FROM alike),
pairlog AS (SELECT src, dst, stage, relationship, added, round(sum(added) OVER (PARTITION BY src, dst ORDER BY stage), 6) AS weight FROM rules),
folded AS (SELECT src, dst, round(sum(added), 6) AS weight, max_by(relationship, stage) AS relationship FROM rules GROUP BY src, dst)"""
EDGES = f"""{PAIRS}, {TERMS}, edges AS (SELECT 'conv:' || src AS src, 'conv:' || dst AS dst, relationship, weight FROM pairlog UNION ALL SELECT * FROM terms),
degree AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node)"""
HOPS = """ends AS (SELECT conv_id AS id, 'concept:' || trim(lower(raw)) AS term, count(*)::DOUBLE AS w FROM concepts GROUP BY ALL UNION ALL SELECT conv_id, 'tag:' || tag, confidence FROM sure),
hop AS (SELECT a.id AS src, b.id AS dst, round(sum(0.3::DOUBLE * a.w * b.w), 6) AS more, count(*) AS paths, string_agg(a.term, ',' ORDER BY a.term) AS shared FROM ends a JOIN ends b ON a.term = b.term AND a.id <> b.id GROUP BY ALL),
way AS (SELECT src, dst, weight, relationship FROM folded UNION ALL SELECT dst, src, weight, relationship FROM folded),
candidates AS (SELECT coalesce(w.src, h.src) AS src, coalesce(w.dst, h.dst) AS dst, round(coalesce(weight, 0) + coalesce(more, 0), 6) AS score, coalesce(relationship, 'indirect') AS relationship FROM way w FULL JOIN hop h ON w.src = h.src AND w.dst = h.dst),
related AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM candidates WHERE score >= 0.3 QUALIFY rank <= 10)"""
GRAPH = f"WITH {ALL}, {NODES}, {EDGES}"

# Graph ------------------------------------------------------------------------------------------------------------

query("concept_nodes", f"WITH {CONCEPTS} {_nodes('concept', 'concepts', 'raw', 'place')}")(lambda s, d: K.term_nodes("concept", concepts(s, d)))
query("person_nodes", f"WITH {PEOPLE} {_nodes('person', 'people', 'raw', 'place')}")(lambda s, d: K.term_nodes("person", people(s, d)))
query("tag_nodes", f"WITH {B.TAGS} {_nodes('tag', 'tags', 'tag', '0')}")(lambda s, d: K.tag_nodes(tags(s, d)))
query("term_edges", f"WITH {ALL}, {TERMS} SELECT src, dst, relationship, round(weight, 6) AS weight FROM terms")(term_edges)
query("shared_people_edges", f"WITH {PEOPLE}, {_overlap('by_person', 'people', 'raw', 1, '1.0')} SELECT src, dst, shared, weight FROM by_person")(
    lambda s, d: G.overlap_join(people(s, d).select(F.col("conv_id").alias("id"), K.normal(F.col("raw")).alias("term")), 1))
query("all_rules_log", f"{GRAPH} SELECT src, dst, stage, relationship, added, weight FROM pairlog")(lambda s, d: K.log_of(K.pair_table(*parts(s, d))))
query("all_rules_edges", f"{GRAPH} SELECT * FROM folded")(lambda s, d: K.fold_of(K.pair_table(*parts(s, d))))
query("all_node_counts", f"WITH {ALL}, {NODES} SELECT node_type, count(*) AS n, sum(n)::BIGINT AS occurrences FROM nodes GROUP BY node_type")(
    lambda s, d: nodes(s, d).groupBy("node_type").agg(F.count("*").alias("n"), F.sum("n").alias("occurrences")))
query("most_connected_nodes", f"{GRAPH} SELECT node_id, node_type, label, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degree ON node = node_id ORDER BY degree DESC, node_id LIMIT 15")(
    lambda s, d: K.best_connected(K.with_degrees(nodes(s, d), degrees(s, d)), 15))
query("most_connected_concepts", f"{GRAPH} SELECT node_id, node_type, label, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degree ON node = node_id WHERE node_type = 'concept' ORDER BY degree DESC, node_id LIMIT 15")(
    lambda s, d: K.top_nodes(nodes(s, d), term_links(s, d), 15, "concept"))
query("graph_totals", f"""{GRAPH} SELECT 'nodes' AS what, count(*)::DOUBLE AS value FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'nodes of ' || node_type, count(*) FROM nodes GROUP BY node_type
UNION ALL SELECT * FROM (SELECT 'top ' || node, degree FROM degree ORDER BY degree DESC, node LIMIT 5)""")(
    lambda s, d: (lambda e: K.summary_of(nodes(s, d), K.n_edges(e), e.select(F.col("node").alias("node_id"), F.col("degree").alias("rank"))))(degrees(s, d)))
query("shown_nodes", f"""{GRAPH}, wanted AS (SELECT * FROM nodes WHERE node_type IN ('conversation', 'concept')), heavy AS (SELECT * FROM edges WHERE weight >= 1 AND src IN (SELECT node_id FROM wanted) AND dst IN (SELECT node_id FROM wanted)),
k AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM heavy UNION ALL SELECT dst FROM heavy) GROUP BY node)
SELECT node_id, node_type, label, n FROM wanted JOIN k ON node = node_id ORDER BY degree DESC, node_id LIMIT 40""")(
    lambda s, d: shown_nodes(s, d, 1.0, 40))
query("graph_export", None)(lambda s, d: (lambda n, g: graph_files.graph_lines(n, g[0], louvain(n.select(F.col("node_id").alias("id")), g[1])))(nodes(s, d), graph(s, d)))

_links = "lk0 AS (SELECT src, dst, weight FROM ways), own AS (SELECT src, src AS dst, max(weight) AS weight FROM lk0 GROUP BY src), lk AS (SELECT * FROM lk0 UNION ALL SELECT * FROM own), c0 AS (SELECT conv_id AS id, conv_id AS community FROM conv)"
for _k in range(1, 5):
    _links += f""", v{_k} AS (SELECT src, community, round(sum(weight), 6) AS votes FROM lk JOIN c{_k - 1} ON id = dst GROUP BY src, community), b{_k} AS (SELECT src, community AS new FROM v{_k} QUALIFY row_number() OVER (PARTITION BY src ORDER BY votes DESC, community) = 1),
c{_k} AS (SELECT id, coalesce(new, community) AS community FROM c{_k - 1} LEFT JOIN b{_k} ON src = id)"""
query("communities_k4", f"{B.GRAPH}, {_links} SELECT id, community FROM c4")(
    lambda s, d: K.communities_simple(B.conv(s, d).select(F.col("conv_id").alias("id")), rule_edges(s, d), 4, settle=False))
query("communities", None)(lambda s, d: K.communities_simple(B.conv(s, d).select(F.col("conv_id").alias("id")), rule_edges(s, d)))
query("importance", None)(lambda s, d: (lambda e: K.importance(node_ids(s, d), e[0], links=e[1]))(simple_parts(s, d)))

# Ranks and communities of the simple graph of all five rules and all nodes.
SIMPLE = """simple AS (SELECT 'conv:' || src AS src, 'conv:' || dst AS dst, weight FROM folded UNION ALL SELECT src, dst, round(weight, 6) FROM terms),
ends2 AS (SELECT src, dst, weight FROM simple UNION ALL SELECT dst, src, weight FROM simple)"""
_ROUNDS = 5
_rank = """out2 AS (SELECT src, sum(weight) AS t FROM ends2 GROUP BY src), share2 AS (SELECT e.src, dst, weight / t AS share FROM ends2 e JOIN out2 o ON o.src = e.src),
nn2 AS (SELECT count(*) AS total FROM nodes), p0 AS (SELECT node_id AS id, 1.0::DOUBLE / total AS rank FROM nodes, nn2)"""
for _k in range(1, _ROUNDS + 1):
    _rank += f""", lost{_k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM p{_k - 1} LEFT JOIN out2 ON src = id WHERE t IS NULL),
got{_k} AS (SELECT dst, sum(rank * share) AS got FROM p{_k - 1} JOIN share2 ON src = id GROUP BY dst),
p{_k} AS (SELECT p.id, 0.15 / total + 0.85 * (coalesce(got, 0) + lost / total) AS rank FROM p{_k - 1} p LEFT JOIN got{_k} ON dst = id, lost{_k}, nn2)"""
RANKED = f"{GRAPH}, {SIMPLE}, {_rank}, importance AS (SELECT id, round(rank, 8) AS rank FROM p{_ROUNDS})"


def importance(s, d) -> DataFrame:
    return importance_of(nodes(s, d), *simple_parts(s, d))


def importance_of(found: DataFrame, pairs: DataFrame, links: DataFrame | None = None) -> DataFrame:
    return G.pagerank(found.select(F.col("node_id").alias("id")), pairs, _ROUNDS, tolerance=None, links=links).select("id", F.round("rank", 8).alias("rank"))


query("importance_k5", f"{RANKED} SELECT id, rank FROM importance")(importance)
_spread = "h0 AS (SELECT src, src AS dst, max(weight) AS weight FROM ends2 GROUP BY src), h AS (SELECT * FROM ends2 UNION ALL SELECT * FROM h0), s0 AS (SELECT node_id AS id, node_id AS community FROM nodes)"
for _k in range(1, 5):
    _spread += f""", w{_k} AS (SELECT src, community, round(sum(weight), 6) AS votes FROM h JOIN s{_k - 1} ON id = dst GROUP BY src, community), z{_k} AS (SELECT src, community AS new FROM w{_k} QUALIFY row_number() OVER (PARTITION BY src ORDER BY votes DESC, community) = 1),
s{_k} AS (SELECT id, coalesce(new, community) AS community FROM s{_k - 1} LEFT JOIN z{_k} ON src = id)"""
query("communities_all_k4", f"{GRAPH}, {SIMPLE}, {_spread} SELECT id, community FROM s4")(lambda s, d: K.communities_simple(node_ids(s, d), simple_edges(s, d), 4, settle=False))
_whole = "li AS (SELECT src, dst, sum(round(weight * 1000000)::BIGINT)::HUGEINT AS w FROM ends2 GROUP BY src, dst), ki AS (SELECT src AS id, sum(w) AS k FROM li GROUP BY src), mm AS (SELECT sum(k)::HUGEINT AS m FROM ki)"
query("modularity_k4", f"""{GRAPH}, {SIMPLE}, {_spread}, {_whole}, byc AS (SELECT a.community, sum(k)::DOUBLE AS t FROM s4 a JOIN ki ON ki.id = a.id GROUP BY a.community)
SELECT round((SELECT sum(w)::DOUBLE FROM li JOIN s4 a ON a.id = src JOIN s4 b ON b.id = dst WHERE a.community = b.community) / m::DOUBLE - (SELECT sum(t * t) FROM byc) / m::DOUBLE / m::DOUBLE, 8) AS modularity FROM mm""")(
    lambda s, d: (lambda i, e: modularity(i, e, K.communities_simple(i, e, 4, settle=False), simple=True).select(F.round("modularity", 8).alias("modularity")))(node_ids(s, d), simple_edges(s, d)))
query("louvain_first_turn", f"""{GRAPH}, {SIMPLE}, {_whole}, sc AS (SELECT src, dst, m * w - a.k::HUGEINT * b.k::HUGEINT AS score FROM li JOIN ki a ON a.id = src JOIN ki b ON b.id = dst, mm),
best AS (SELECT src, dst FROM sc QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) = 1 AND score > 0 AND dst < src)
SELECT node_id AS id, dst AS target FROM nodes LEFT JOIN best ON src = node_id""")(lambda s, d: first_turn_simple(node_ids(s, d), simple_edges(s, d)))
query("louvain", None)(lambda s, d: louvain(node_ids(s, d), simple_edges(s, d)))
query("louvain_conversations", None)(lambda s, d: louvain(B.conv(s, d).select(F.col("conv_id").alias("id")), K.fold_of(pair_table(s, d)), simple=True))
query("graph_totals_ranked", f"""{RANKED} SELECT 'nodes' AS what, count(*)::DOUBLE AS value FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'nodes of ' || node_type, count(*) FROM nodes GROUP BY node_type
UNION ALL SELECT * FROM (SELECT 'top ' || id, round(rank, 6) FROM importance ORDER BY rank DESC, id LIMIT 5)""")(
    lambda s, d: (lambda n, t, k: K.summary(n, K.all_edges(K.log_of(t), k), importance_of(n, *K.simple_parts(K.fold_of(t), k)).withColumnRenamed("id", "node_id")))(nodes(s, d), pair_table(s, d), term_links(s, d)))

# Links ------------------------------------------------------------------------------------------------------------

query("related_all_rules", f"{GRAPH}, {HOPS} SELECT * FROM related")(lambda s, d: K.related(*parts(s, d)))
query("related_topk", f"{GRAPH}, {HOPS} SELECT * FROM related")(lambda s, d: K.related(*parts(s, d)))
query("shared_elements", f"{GRAPH}, {HOPS} SELECT src, dst, more AS score, paths, shared FROM hop")(
    lambda s, d: tiles.shared_terms(term_pairs(s, d), L.INDIRECT))
query("link_metadata", f"{GRAPH}, {HOPS} SELECT src AS conv_id, string_agg(title || '=' || score::VARCHAR, ';' ORDER BY title) AS scores FROM (SELECT src, title, max_by(score, rank) AS score FROM related JOIN conv ON conv_id = dst GROUP BY ALL) GROUP BY src")(
    lambda s, d: L.metadata(linked(s, d)).select("conv_id", F.array_join(F.transform(F.array_sort(F.map_entries("link_scores")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ";").alias("scores")))
query("link_leaders", f"""{GRAPH}, {HOPS}, n AS (SELECT conv_id, (SELECT count(*) FROM related WHERE src = conv_id) AS related, (SELECT count(*) FROM related WHERE dst = conv_id) AS backlinks FROM conv)
SELECT conv_id, related, backlinks FROM n ORDER BY related + backlinks DESC, conv_id LIMIT 5""")(lambda s, d: L.leaders(B.conv(s, d), related(s, d)))
query("concept_links_importance", f"""{GRAPH} SELECT conv_id, t AS term, score, rank FROM (SELECT conv_id, t, round(coalesce(degree, 0) * (1 + 0.1::DOUBLE * n), 6) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY round(coalesce(degree, 0) * (1 + 0.1::DOUBLE * n), 6) DESC, t) AS rank
FROM (SELECT DISTINCT conv_id, trim(lower(raw)) AS t FROM concepts) JOIN nodes ON node_id = 'concept:' || t LEFT JOIN degree ON node = node_id) WHERE rank <= 15""")(
    lambda s, d: L.concept_links(concepts(s, d).select("conv_id", K.normal(F.col("raw")).alias("term")).distinct(), K.node_degrees(nodes(s, d), term_links(s, d), "concept").select(F.substring("node_id", 9, 1_000_000).alias("term"), F.col("degree").alias("importance"), "n")))

query("concept_links_ranked", f"""{RANKED} SELECT conv_id, t AS term, score, rank FROM (SELECT conv_id, t, round(1000 * i.rank * (1 + 0.1::DOUBLE * n), 6) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY round(1000 * i.rank * (1 + 0.1::DOUBLE * n), 6) DESC, t) AS rank
FROM (SELECT DISTINCT conv_id, trim(lower(raw)) AS t FROM concepts) JOIN nodes ON node_id = 'concept:' || t JOIN importance i ON i.id = node_id) WHERE rank <= 15""")(
    lambda s, d: L.concept_links(concepts(s, d).select("conv_id", K.normal(F.col("raw")).alias("term")).distinct(), (lambda n: n.join(importance_of(n, *simple_parts(s, d)).withColumnRenamed("id", "node_id"), "node_id"))(nodes(s, d)).where("node_type = 'concept'").select(F.substring("node_id", 9, 1_000_000).alias("term"), (1000 * F.col("rank")).alias("importance"), "n")))

# Near duplicates --------------------------------------------------------------------------------------------------

_greedy = """dn AS (SELECT id, count(*) AS n FROM dw GROUP BY id), ids AS (SELECT DISTINCT id FROM everyone),
dl AS (SELECT src, dst, round(k / (x.n + y.n - k), 6) AS w FROM (SELECT a.id AS src, b.id AS dst, count(*) AS k FROM dw a JOIN dw b ON a.word = b.word AND a.id < b.id GROUP BY ALL) JOIN dn x ON x.id = src JOIN dn y ON y.id = dst WHERE k / (x.n + y.n - k) >= 0.85),
o0 AS (SELECT id FROM ids)"""
for _k in range(1, 7):
    _greedy += f""", d{_k} AS (SELECT src, dst, w FROM dl WHERE src IN (SELECT id FROM o{_k - 1}) AND dst IN (SELECT id FROM o{_k - 1})), k{_k} AS (SELECT id FROM o{_k - 1} WHERE id NOT IN (SELECT dst FROM d{_k})),
g{_k} AS (SELECT dst AS id, min(src) AS keep_id, min_by(w, src) AS w FROM d{_k} WHERE src IN (SELECT id FROM k{_k}) GROUP BY dst), o{_k} AS (SELECT id FROM o{_k - 1} WHERE id NOT IN (SELECT id FROM k{_k}) AND id NOT IN (SELECT id FROM g{_k}))"""
_greedy += " SELECT id, id AS keep_id, 1.0::DOUBLE AS similarity, true AS kept FROM (" + " UNION ALL ".join(f"SELECT id FROM k{k}" for k in range(1, 7)) + ") UNION ALL SELECT id, keep_id, w, false FROM (" + " UNION ALL ".join(f"SELECT * FROM g{k}" for k in range(1, 7)) + ")"
_dw = "everyone AS (SELECT {id} AS id FROM {t}), dw AS (SELECT DISTINCT {id} AS id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS word FROM {t})"


def conversation_words(s, d) -> DataFrame:
    return messages(s, d).select(F.col("conv_id").alias("id"), F.explode_outer(C.words(F.col("text"))).alias("word"))


def document_words(s, d) -> DataFrame:
    return B.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.explode_outer(C.words(F.col("text"))).alias("word"))


for _name, _words, _id, _t in (("conversations", conversation_words, "conv_id", "conversations"), ("documents", document_words, "doc_id", "documents")):
    query(f"near_duplicate_{_name}", f"WITH {_dw.format(id=_id, t=_t)}, {_greedy}")(
        lambda s, d, i=_id, t=_t: near_duplicates(B.table(s, d, t).select(F.col(i).alias("id"), C.words(F.col("text")).alias("words"))))
    query(f"near_duplicate_{_name}_exact", f"WITH {_dw.format(id=_id, t=_t)}, {_greedy}")(lambda s, d, f=_words: exact_duplicates(f(s, d)))

# Summaries --------------------------------------------------------------------------------------------------------


def period_sentences(s, d, pattern: str) -> DataFrame:
    """Sentences of all messages by the month or week their conversation began in."""
    when = F.date_format("created_at", "yyyy-MM") if pattern == "month" else F.date_format(F.date_trunc("week", "created_at"), "yyyy-MM-dd")
    return S.sentences(messages(s, d).join(B.conv(s, d).select("conv_id", when.alias("period")), "conv_id"), "period")


def topic_sentences(s, d) -> DataFrame:
    """Sentences by the topics, the tags, of their conversation."""
    return S.sentences(messages(s, d)).join(tags(s, d).select("conv_id", F.col("tag").alias("topic")), "conv_id")


_sent = """ms AS (SELECT strftime(created_at, '%Y-%m') AS period, conv_id, turn, regexp_extract_all(text, '[^.!?\n]+[.!?]*') AS l FROM conversations JOIN conv USING (conv_id)),
st AS (SELECT period, conv_id, turn, i - 1 AS place, trim(l[i]) AS sentence, list_filter(string_split_regex(lower(trim(l[i])), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM ms)),
ds AS (SELECT period, list_sort(list_distinct(w)) AS bag, min({'c': conv_id, 't': turn, 'p': place, 's': sentence}) AS x, count(*) AS times FROM st WHERE len(w) >= 4 GROUP BY ALL),
dz AS (SELECT *, row_number() OVER () AS id, count(*) OVER (PARTITION BY period) AS n, sum(times) OVER (PARTITION BY period) AS total FROM ds),
fw AS (SELECT period, id, n, unnest(bag) AS word FROM dz), iw AS (SELECT *, ln(1 + n::DOUBLE / count(*) OVER (PARTITION BY period, word)) AS idf FROM fw),
bw AS MATERIALIZED (SELECT period, id, word, idf / sqrt(sum(idf * idf) OVER (PARTITION BY id)) AS b FROM iw),
deg AS (SELECT id, sum(b * (s - b)) AS degree FROM (SELECT *, sum(b) OVER (PARTITION BY period, word) AS s FROM bw) GROUP BY id),
q0 AS (SELECT z.*, CASE WHEN degree > 1e-9 THEN degree END AS degree, times::DOUBLE / total AS start, times::DOUBLE / total AS rank FROM dz z JOIN deg USING (id))"""
for _k in range(1, 4):
    _sent += f""", v{_k}s AS (SELECT w.period, w.id, word, b, b * rank / degree AS g FROM bw w JOIN q{_k - 1} q ON q.id = w.id WHERE degree IS NOT NULL),
t{_k}s AS (SELECT id, sum(b * (s - g)) AS got FROM (SELECT *, sum(g) OVER (PARTITION BY period, word) AS s FROM v{_k}s) GROUP BY id), q{_k} AS (SELECT q.* EXCLUDE (rank), (0.15 + 0.85 * sum(CASE WHEN degree IS NULL THEN rank ELSE 0 END) OVER (PARTITION BY period)) * start + 0.85 * coalesce(got, 0) AS rank FROM q{_k - 1} q LEFT JOIN t{_k}s t ON t.id = q.id)"""
query("sentence_ranks_k3", f"WITH {B.CONV}, {_sent} SELECT period, x.c AS conv_id, x.t AS turn, x.p::INT AS place, x.s AS sentence, round(rank, 8) AS rank FROM q3")(
    lambda s, d: S.ranked(period_sentences(s, d, "month"), "period", 3).select("period", "conv_id", "turn", "place", "sentence", F.round("rank", 8).alias("rank")))
query("monthly_digests", None)(lambda s, d: S.summaries(period_sentences(s, d, "month"), "period"))
query("weekly_digests", None)(lambda s, d: S.summaries(period_sentences(s, d, "week"), "period"))
query("topic_digests", None)(lambda s, d: S.summaries(topic_sentences(s, d), "topic"))

# Annotation -------------------------------------------------------------------------------------------------------

query("digest_with_title", f"""WITH {B.CONV}, {MESSAGES}, m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM messages),
p AS (SELECT conv_id, 0.0 AS place, 'Title: ' || title AS line FROM conv UNION ALL SELECT conv_id, k, role || ': ' || CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END FROM m WHERE n <= 6 OR k <= 3 OR k > n - 3
UNION ALL SELECT conv_id, 3.5, '[... ' || (n - 6) || ' more messages ...]' FROM m WHERE n > 6 AND k = 3) SELECT conv_id, string_agg(line, chr(10) ORDER BY place) AS digest FROM p GROUP BY conv_id""")(
    lambda s, d: A.digest(B.conv(s, d), messages(s, d)))
query("tag_prompts", None)(lambda s, d: A.tag_prompts(A.digest(B.conv(s, d), messages(s, d)), "\n".join(f"- {c}" for c in B.CATEGORIES)))
query("parsed_tags", f"""WITH {B.TAGS}, {CONF} SELECT conv_id, string_agg(tag, ',' ORDER BY rank) AS tags, 'found' AS category, sum(CASE WHEN rank % 2 = 0 THEN 0.5 ELSE confidence END) AS sure FROM sure GROUP BY conv_id""")(
    lambda s, d: A.tagged(tags(s, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rank", "tag", "confidence"))).alias("t")).select(
        F.array("conv_id").alias("conv_ids"),
        F.concat(F.lit("Sure:\n"), F.to_json(F.array(F.struct(F.transform("t", lambda x: x["tag"]).alias("tags"), F.lit("found").alias("category"), F.map_from_entries(F.transform(F.filter("t", lambda x: x["rank"] % 2 == 1), lambda x: F.struct(x["tag"], x["confidence"]))).alias("confidence")))), F.lit(" there.")).alias("response")))
    .select("conv_id", F.array_join("tags", ",").alias("tags"), "category", F.aggregate(F.map_values("confidence"), F.lit(0.0), lambda a, x: a + x).alias("sure")))
query("confident_tags", f"WITH {B.TAGS}, {CONF} SELECT conv_id, coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (confidence >= 0.6), '') AS tags FROM sure GROUP BY conv_id")(
    lambda s, d: tags(s, d).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "confidence"))).alias("c")).select("conv_id", F.array_join(A.confident(F.col("c")), ",").alias("tags")))
query("extraction_totals", f"WITH {ALL} SELECT (SELECT count(*) FROM lists WHERE kind = 'decision') AS key_decisions, 0::BIGINT AS insights, (SELECT count(*) FROM lists WHERE kind = 'action') AS action_items, (SELECT count(*) FROM concepts) AS concepts, (SELECT count(*) FROM people) AS people_mentioned")(
    lambda s, d: A.extraction_totals(P.union(*[df.groupBy("conv_id").agg(*[F.collect_list(F.col(c) if x == name else F.lit(None).cast("string")).alias(x) for x in A.LISTS])
    for name, c, df in (("key_decisions", "item", lists(s, d).where("kind = 'decision'")), ("action_items", "item", lists(s, d).where("kind = 'action'")), ("concepts", "raw", concepts(s, d)), ("people_mentioned", "raw", people(s, d)))])))
query("moc_descriptions", f"WITH {B.CONV} SELECT DISTINCT category, 'A collection of notes and insights about ' || category || '.' AS description FROM conv")(
    lambda s, d: B.conv(s, d).select("category").distinct().withColumn("description", A.describe(F.col("category"))))
query("taxonomy_tags", f"""WITH w AS (SELECT conv_id, word, count(*) AS n FROM (SELECT conv_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS word FROM conversations) GROUP BY ALL),
t AS (SELECT DISTINCT n_name || ' ' || length(word) AS category, left(word, 4) AS tag, word FROM w JOIN nation ON n_nationkey = length(word) WHERE length(word) >= 5), m AS (SELECT * FROM w JOIN t USING (word)),
p AS (SELECT conv_id, tag, sum(n)::BIGINT AS n FROM m GROUP BY ALL), c AS (SELECT conv_id, category FROM m GROUP BY conv_id, category QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY sum(n) DESC, category) = 1)
SELECT conv_id, tag, n, round(n / max(n) OVER (PARTITION BY conv_id), 6) AS confidence, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, tag) AS rank, category FROM p JOIN c USING (conv_id) QUALIFY rank <= 7""")(
    lambda s, d: (lambda w: A.rule_tags(w, w.select("word").distinct().where("length(word) >= 5").join(B.table(s, d, "nation"), F.col("n_nationkey") == F.length("word")).select(F.concat("n_name", F.lit(" "), F.length("word")).alias("category"), F.left("word", F.lit(4)).alias("tag"), "word")))(
        messages(s, d).select("conv_id", F.explode(C.words(F.col("text"))).alias("word")).groupBy("conv_id", "word").agg(F.count("*").alias("n"))))

# Pages ------------------------------------------------------------------------------------------------------------

_safe = "trim(translate(title, '<>:\"/\\|?*', '---------'), '. ')"
OWNERS = f"placed AS (SELECT *, 'Conversations/' || category || '/' || CASE WHEN {_safe} = '' THEN 'Untitled' ELSE {_safe} END || '.md' AS path FROM notes), owners AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY path ORDER BY conv_id DESC) = 1)"
_yaml = "replace(replace(replace(replace({}, '\\', '\\\\'), '\"', '\\\"'), chr(10), ' '), chr(13), '')"
_wiki = "'[[' || trim(translate({}, '[]|#^\\', '')) || ']]'"


def _listed(section: int, key: str, source: str, line: str, place: str) -> str:
    return f"SELECT DISTINCT path, {section} AS section, NULL::DOUBLE AS b, '{key}:' AS line FROM {source} UNION ALL SELECT path, {section + 1}, {place}, {line} FROM {source}"


def _block(section: int, heading: str, source: str, line: str, place: str) -> str:
    return f"SELECT DISTINCT path, {section} AS section, NULL::DOUBLE AS b, '{heading}' || chr(10) AS line FROM {source} UNION ALL SELECT path, {section + 1}, {place}, {line} FROM {source} UNION ALL SELECT DISTINCT path, {section + 2}, NULL, '' FROM {source}"


_of = "(SELECT o.path, x.* FROM {} x JOIN owners o USING (conv_id))"
_few = "(SELECT path, raw, row_number() OVER (PARTITION BY path ORDER BY place, raw) AS k FROM concepts JOIN owners USING (conv_id) QUALIFY k <= 10)"
_tagline = "(SELECT path, string_agg('#' || tag, ' ' ORDER BY rank) AS line FROM sure JOIN owners USING (conv_id) GROUP BY path)"
_rel = "(SELECT o.path, r.rank, r.dst AS target, r.score, t.title FROM related r JOIN owners o ON o.conv_id = r.src JOIN owners t ON t.conv_id = r.dst)"
_talk = "CASE WHEN role = 'human' THEN '> [!question]+ Human' ELSE '> [!info]+ Assistant' END || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x = '' THEN '>' ELSE '> ' || x END), chr(10)) || chr(10)"
NOTE_LINES = " UNION ALL ".join([
    "SELECT path, 0 AS section, NULL::DOUBLE AS b, '---' AS line FROM owners",
    f"SELECT path, 1, NULL, 'title: \"' || {_yaml.format('title')} || '\"' FROM owners", "SELECT path, 2, NULL, 'date: ' || strftime(created_at, '%Y-%m-%d') FROM owners",
    "SELECT path, 3, NULL, 'created: ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') FROM owners", "SELECT path, 4, NULL, 'category: ' || category FROM owners",
    _listed(5, "tags", _of.format("sure"), "'  - ' || tag", "rank"),
    _listed(7, "decisions", _of.format("(SELECT * FROM lists WHERE kind = 'decision')"), f"'  - \"' || {_yaml.format('item')} || '\"'", "place"),
    _listed(9, "action_items", _of.format("(SELECT * FROM lists WHERE kind = 'action')"), f"'  - \"' || {_yaml.format('item')} || '\"'", "place"),
    _listed(11, "related", "(SELECT o.path, r.rank, r.dst AS target FROM related r JOIN owners o ON o.conv_id = r.src)", "'  - \"' || target || '\"'", "rank"),
    "SELECT path, 13, NULL, 'source_url: \"' || source_url || '\"' FROM owners WHERE source_url IS NOT NULL",
    _listed(14, "concepts", _few, "'  - ' || raw", "k"), "SELECT path, 16, NULL, '---' || chr(10) FROM owners", "SELECT path, 20, NULL, '# ' || title || chr(10) FROM owners",
    _block(21, "## Summary", "(SELECT * FROM owners WHERE summary <> '')", "summary", "NULL"),
    _block(24, "## Decisions", _of.format("(SELECT * FROM lists WHERE kind = 'decision')"), "'- ' || item", "place"), _block(27, "## Action Items", _of.format("(SELECT * FROM lists WHERE kind = 'action')"), "'- [ ] ' || item", "place"),
    "SELECT path, 30, NULL, '## Conversation' || chr(10) FROM owners", f"SELECT path, 31, turn, {_talk} FROM {_of.format('messages')}",
    _block(33, "## Related Notes", _rel, f"'- ' || {_wiki.format('title')} || ' ' || CASE WHEN score >= 0.8 THEN 'strong' WHEN score >= 0.5 THEN 'moderate' ELSE 'weak' END", "rank"),
    _block(36, "## See Also", _few, "'- [[' || raw || ']]'", "k"), _block(39, "## Tags", _tagline, "line", "NULL"),
])


def note_lines(s, d) -> DataFrame:
    made = {name: stage(f(s, d), name) for name, f in (("notes", notes), ("tags", tags), ("concepts", concepts))}
    return P.note_lines(made["notes"], messages(s, d), made["tags"], lists(s, d), made["concepts"], linked(s, d))


def index_pages(notes, messages, tags, concepts, nodes, ends) -> DataFrame:
    """``ends``: (node, degree) over every logged edge."""
    degrees = stage(K.with_degrees(nodes, ends).drop("n"), "node-degrees")
    top = lambda df: df.orderBy(F.desc("degree"), "node_id").limit(15)
    return P.assemble(P.union(P.topics_lines(tags, concepts), P.timeline_lines(notes), P.cluster_lines(notes, concepts, nodes, None), P.readme_lines(notes, nodes, 0, top(degrees.where("node_type = 'concept'"))),
        P.statistics_lines(notes, messages, tags, concepts, nodes, K.n_edges(ends), 0, top(degrees))))


query("note_lines", f"{GRAPH}, {HOPS}, {OWNERS} {NOTE_LINES}")(lambda s, d: note_lines(s, d).select("path", "section", "b", "line"))
query("note_pages", None)(lambda s, d: P.assemble(note_lines(s, d)))
query("output_counts", f"{GRAPH}, {HOPS}, {OWNERS}, l AS ({NOTE_LINES}) SELECT count(DISTINCT path) AS notes_created, 0::BIGINT AS mocs_created, sum(len(regexp_extract_all(line, '\\[\\[.*?\\]\\]')))::BIGINT AS total_links FROM l")(
    lambda s, d: P.output_counts(note_lines(s, d)))
query("note_paths_by_date", f"WITH {NOTES} SELECT conv_id, 'Conversations/' || strftime(created_at, '%Y/%m') || '/' || CASE WHEN {_safe} = '' THEN 'Untitled' ELSE {_safe} END || '.md' AS path FROM notes")(
    lambda s, d: notes(s, d).select("conv_id", P.note_path(notes(s, d), "by-date").alias("path")))
HELD = f"""top AS (SELECT node FROM degree WHERE node LIKE 'concept:%' AND degree >= 5 ORDER BY degree DESC, node LIMIT 20),
every AS (SELECT category || ' MOC' AS moc, 'category' AS kind, conv_id FROM notes UNION ALL SELECT strftime(created_at, '%B %Y'), 'month', conv_id FROM notes
UNION ALL SELECT DISTINCT substr(node, 9) || ' MOC', 'topic', conv_id FROM concepts JOIN top ON node = 'concept:' || trim(lower(raw))),
held AS (SELECT * FROM every QUALIFY count(*) OVER (PARTITION BY moc, kind) >= 3),
ranked AS (SELECT moc, kind, term, count(*) AS n, row_number() OVER (PARTITION BY moc, kind ORDER BY count(*) DESC, term) AS rank FROM held JOIN (SELECT conv_id, raw AS term FROM concepts UNION ALL SELECT conv_id, tag FROM tags) USING (conv_id)
WHERE kind <> 'topic' OR trim(lower(term)) || ' MOC' <> moc GROUP BY moc, kind, term QUALIFY rank <= 15)"""
query("moc_members", f"{GRAPH}, {HELD} SELECT * FROM held")(held)
query("moc_key_concepts", f"{GRAPH}, {HELD} SELECT moc, kind, rank, term, n FROM ranked")(lambda s, d: P.key_concepts(held(s, d), tags(s, d), concepts(s, d)).select("moc", "kind", "rank", "term", "n"))
query("moc_pages", None)(lambda s, d: P.assemble(P.union(P.moc_lines(notes(s, d), tags(s, d), concepts(s, d), held(s, d)), P.quarter_lines(notes(s, d), tags(s, d), concepts(s, d)))))
query("index_pages", None)(lambda s, d: index_pages(notes(s, d), messages(s, d), *(stage(f(s, d), "index-terms") for f in (tags, concepts)), nodes(s, d), degrees(s, d)))
query("topic_band_lines", f"""WITH {B.TAGS}, {CONCEPTS}, t AS (SELECT term, count(*) AS n FROM (SELECT raw AS term FROM concepts UNION ALL SELECT tag FROM tags) GROUP BY term), b AS (SELECT *, CASE WHEN n >= 10 THEN 0 WHEN n >= 5 THEN 1 WHEN n >= 2 THEN 2 ELSE 3 END AS k FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, term) AS i, count(*) OVER (PARTITION BY k) AS total FROM b)
SELECT DISTINCT 5 * k AS section, '### ' || ['High Frequency (10+ mentions)', 'Medium Frequency (5-9 mentions)', 'Low Frequency (2-4 mentions)', 'Single Mentions'][k + 1] || chr(10) AS line FROM r
UNION ALL SELECT DISTINCT 16, '*' || total || ' topics mentioned only once*' || chr(10) FROM r WHERE k = 3
UNION ALL SELECT 5 * k + 2, '- [[' || term || ']]' || CASE WHEN k < 3 THEN ' (' || n || ')' ELSE '' END FROM r WHERE k < 2 OR (k = 2 AND i <= 50) OR (k = 3 AND i <= 20)
UNION ALL SELECT DISTINCT 5 * k + 3, '- *... and ' || (total - CASE WHEN k = 2 THEN 50 ELSE 20 END) || ' more*' FROM r WHERE (k = 2 AND total > 50) OR (k = 3 AND total > 20)
UNION ALL SELECT DISTINCT 5 * k + 4, '' FROM r""")(
    lambda s, d: P.band_lines(concepts(s, d).select(F.col("raw").alias("term")).unionByName(tags(s, d).select(F.col("tag").alias("term"))).groupBy("term").agg(F.count("*").alias("n")), F.lit("x"), 0).select("section", "line"))
query("timeline_lines", f"""WITH {B.CONV} SELECT '## ' || y || chr(10) AS line FROM (SELECT DISTINCT year(created_at) AS y FROM conv) UNION ALL SELECT '### ' || strftime(min(created_at), '%B') || ' (' || count(*) || ' conversations)' || chr(10) FROM conv GROUP BY year(created_at), month(created_at)
UNION ALL SELECT '- ' || strftime(created_at, '%Y-%m-%d') || ': ' || {_wiki.format('title')} FROM conv UNION ALL SELECT '' FROM (SELECT DISTINCT year(created_at), month(created_at) FROM conv)""")(
    lambda s, d: P.timeline_lines(B.conv(s, d)).where("section = 1").select("line"))
query("category_bars", f"WITH {B.CONV}, c AS (SELECT category, count(*) AS n FROM conv GROUP BY category) SELECT category, n, repeat('#', floor(n / max(n) OVER () * 30)::INT) AS bar FROM c")(
    lambda s, d: P.with_bar(B.conv(s, d).groupBy("category").agg(F.count("*").alias("n")), 30))
query("open_tasks", f"WITH {NOTES}, {LISTS} SELECT '- [ ] ' || item || ' (' || {_wiki.format('title')} || ')' AS line FROM lists JOIN conv USING (conv_id) WHERE kind = 'action'")(
    lambda s, d: P.open_tasks_lines(notes(s, d), lists(s, d)).where("section = 1").select("line"))
query("people_pages", f"""WITH {B.CONV}, {PEOPLE} SELECT raw AS a, '## ' || raw || ' (' || count(*) || ')' || chr(10) AS line FROM people GROUP BY raw UNION ALL SELECT raw, '- ' || {_wiki.format('title')} FROM (SELECT DISTINCT conv_id, raw FROM people) JOIN conv USING (conv_id)""")(
    lambda s, d: P.people_lines(notes(s, d), people(s, d)).where("section = 1").select("a", "line"))

# Validation, selection and listings -------------------------------------------------------------------------------

_spoilt = "CASE WHEN turn <> 2 THEN text END"
query("valid_conversations", f"""SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND (x.role = 'system' OR x.turn = 2))""")(
    lambda s, d: validation.valid_conversations(B.table(s, d, "conversations").select("conv_id", "turn", F.expr("nullif(role, 'system')").alias("role"), F.expr(_spoilt).alias("text"))).select("conv_id", "turn"))
query("younger", f"WITH {B.CONV} SELECT conv_id, created_at FROM conv WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY")(
    lambda s, d: runner.younger(B.conv(s, d).select("conv_id", "created_at"), 20, F.expr("timestamp_ntz'2024-01-31 00:00:00'")))
query("human_messages", "SELECT conv_id, turn FROM conversations WHERE role = 'user'")(lambda s, d: runner.with_roles(messages(s, d), ("human",)).select("conv_id", "turn"))
query("html_messages", None)(lambda s, d: exports.parsed(B.table(s, d, "pages").select(F.concat(F.lit("page-"), "page_id", F.lit(".html")).alias("file"), F.col("html").alias("text"))).select("file", "pos", "conv_id", "title", F.size("messages").alias("n_messages"), "error"))
query("parse_time", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN date_trunc('millisecond', ts) ELSE date_trunc('second', ts) END AS ts FROM events")(
    lambda s, d: B.table(s, d, "events").select("event_id", C.parse_time(F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(F.col("event_id") % 3 == 1, F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).otherwise(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))).cast("timestamp_ntz").alias("ts")))
query("dv_weeks_back", "SELECT event_id, ts FROM events WHERE ts >= date_trunc('week', TIMESTAMP '2024-02-20 00:00:00') - INTERVAL 30 DAY ORDER BY ts DESC, event_id LIMIT 20")(
    lambda s, d: B.table(s, d, "events").where(F.col("ts") >= F.date_trunc("week", F.expr("timestamp_ntz'2024-02-20 00:00:00'")).cast("timestamp_ntz") - F.expr("INTERVAL '30' DAY")).select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(20))
query("chunked", "SELECT conv_id, turn, floor(turn / 2)::BIGINT AS chunk FROM conversations")(lambda s, d: runner.chunks(messages(s, d), 2).select("conv_id", "turn", "chunk"))
query("weekday_bars", f"WITH {B.CONV}, c AS (SELECT k::INT AS weekday, (SELECT count(*) FROM conv WHERE isodow(created_at) - 1 = k) AS n FROM range(7) r(k)) SELECT weekday, n, repeat('#', floor(n / max(n) OVER () * 20)::INT) AS bar FROM c")(
    lambda s, d: P.with_bar(P.weekday_counts(B.conv(s, d), "created_at"), 20))
query("size_labels", "SELECT doc_id, CASE WHEN 1000 * n_chars < 1048576 THEN printf('%.1f KB', 1000 * n_chars / 1024) ELSE printf('%.1f MB', 1000 * n_chars / 1048576) END AS label FROM documents")(
    lambda s, d: B.table(s, d, "documents").select("doc_id", R.size(1000 * F.col("n_chars")).alias("label")))

# Link check -------------------------------------------------------------------------------------------------------

_key = "lower(trim(translate({}, '[]|#^\\', '')))"
_stem = "regexp_replace(path, '\\.md$', '')"
CHECKED = f"""l AS ({NOTE_LINES}), found_links AS (SELECT path, unnest(regexp_extract_all(line, '\\[\\[([^\\[\\]\\n]+)\\]\\]', 1)) AS x FROM l),
aimed AS (SELECT path, {_key.format("regexp_replace(regexp_replace(x, '(?s)[|#].*', ''), '\\.md\\s*$', '')")} AS target, count(*) AS n FROM found_links GROUP BY ALL HAVING target <> ''),
answers AS (SELECT path, {_key.format(_stem)} AS target FROM l UNION SELECT path, {_key.format(f"string_split({_stem}, '/')[-1]")} FROM l
UNION SELECT path, {_key.format("regexp_extract(line, '(?m)^title: \"(.*)\"$', 1)")} FROM l WHERE section <= 1),
answered AS (SELECT target, min_by(path, (length(path), path)) AS found, count(*) AS pages FROM answers WHERE target <> '' GROUP BY target),
checked AS (SELECT path, target, n, found, coalesce(pages, 0) AS pages FROM aimed LEFT JOIN answered USING (target))"""


def vault_lines(s, d) -> DataFrame:
    return stage(note_lines(s, d), "vault-lines")


query("link_check", f"{GRAPH}, {HOPS}, {OWNERS}, {CHECKED} SELECT * FROM checked")(lambda s, d: LC.check(vault_lines(s, d), written=True))  # the twin's HAVING groups by the written link too
query("page_quality", f"""{GRAPH}, {HOPS}, {OWNERS}, {CHECKED}, met AS (SELECT found AS path, count(DISTINCT path) AS backlinks FROM checked WHERE found <> path GROUP BY found),
o AS (SELECT path, sum(n)::BIGINT AS links, coalesce(sum(n) FILTER (pages = 0), 0)::BIGINT AS broken, coalesce(sum(n) FILTER (pages > 1), 0)::BIGINT AS ambiguous FROM checked GROUP BY path)
SELECT path, count(line) AS n_lines, coalesce(any_value(links), 0) AS links, coalesce(any_value(broken), 0) AS broken, coalesce(any_value(ambiguous), 0) AS ambiguous,
coalesce(any_value(backlinks), 0) AS backlinks, any_value(backlinks) IS NULL AS orphan FROM l LEFT JOIN o USING (path) LEFT JOIN met USING (path) GROUP BY path""")(
    lambda s, d: (lambda rows: LC.page_quality(rows, stage(LC.check(rows), "checked-links")))(vault_lines(s, d)))

# Tag hierarchy ----------------------------------------------------------------------------------------------------


def word_tree(tags: DataFrame) -> DataFrame:
    """Words below their first three letters, those below the first: a tree that grows with the tags."""
    three, one = F.left("tag", F.lit(3)), F.left("tag", F.lit(1))
    return tags.select(F.col("tag").alias("node"), three.alias("parent")).unionByName(tags.select(three.alias("node"), one.alias("parent"))).distinct()


TREE = f"""{B.TAGS}, tree AS (SELECT tag AS node, left(tag, 3) AS parent FROM tags UNION SELECT left(tag, 3), left(tag, 1) FROM tags),
above AS (SELECT node, node AS ancestor, 0 AS depth FROM (SELECT node FROM tree UNION SELECT parent FROM tree) UNION SELECT above.node, tree.parent, depth + 1 FROM above JOIN tree ON tree.node = above.ancestor),
rolled AS (SELECT ancestor AS tag, count(DISTINCT conv_id) FILTER (depth = 0) AS own, count(DISTINCT conv_id) AS total FROM tags JOIN above ON above.node = tags.tag GROUP BY ancestor),
ways AS (SELECT node AS tag, string_agg(ancestor, '/' ORDER BY depth DESC) AS path FROM above GROUP BY node)"""
query("tag_rollup", f"WITH RECURSIVE {TREE} SELECT tag, own, total, path FROM rolled JOIN ways USING (tag)")(
    lambda s, d: (lambda t: H.rollup(t, H.closure(word_tree(t))).join(H.paths(word_tree(t)), "tag"))(stage(tags(s, d), "tags")))
query("tag_map_lines", f"""WITH RECURSIVE {TREE}, {B.CONV}, c AS (SELECT *, 'MOCs/' || replace(path, '/', ' - ') || ' Tags.md' AS page FROM rolled JOIN ways USING (tag) WHERE total >= 3),
nested AS (SELECT m.page, a.depth, b.path AS way, b.total AS n FROM above a JOIN c m ON m.tag = a.ancestor JOIN c b ON b.tag = a.node WHERE a.depth BETWEEN 1 AND 2),
own AS (SELECT c.page, title FROM tags JOIN c USING (tag) JOIN conv USING (conv_id))
SELECT page AS path, '# #' || path || chr(10) || chr(10) || total || ' conversations, ' || own || ' with the tag itself.' || chr(10) AS line FROM c
UNION ALL SELECT DISTINCT page, '## Maps Below' || chr(10) FROM nested UNION ALL SELECT page, repeat('  ', depth - 1) || '- [[' || replace(way, '/', ' - ') || ' Tags]] (' || n || ')' FROM nested UNION ALL SELECT DISTINCT page, '' FROM nested
UNION ALL SELECT DISTINCT page, '## Notes' || chr(10) FROM own UNION ALL SELECT page, '- ' || {_wiki.format('title')} FROM own UNION ALL SELECT DISTINCT page, '' FROM own""")(
    lambda s, d: (lambda t: H.map_lines(B.conv(s, d), t, word_tree(t)).select("path", "line"))(stage(tags(s, d), "tags")))
