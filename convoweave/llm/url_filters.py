"""URL filters: host/path rules first, then pattern rules found through their rarest literal token.

Host: what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased;
path: what follows up to ``?``, ``#`` or the end. A null url, or one without ``://``, has an empty host
and an empty path; no rule fits it and it is allowed.

A host/path rule fits its host and every subdomain if the url's path starts with the rule's path; the
longest rule (host and path together) wins, equal lengths by code point order. A url without such a rule
is judged by the pattern rules: a regular expression over the lower-cased url plus the literal tokens
(whole runs of a-z and 0-9) that any match must contain; rules may share a name. Every pattern is indexed by whichever of its tokens
is rarest in the urls at hand, so a url's tokens fetch its few candidate patterns and only those run.
Repeated rows give repeated results; extra columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoweave.shared import stage


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    name: str
    regex: str
    tokens: tuple[str, ...]


HOST_RULES = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)

PATTERN_RULES = (
    PatternRule("pill shops", r"://[^/?#]*\bcheap-pills\b", ("cheap", "pills")),
    PatternRule("link farms", r"://[^/?#]*\bspam-farm\b", ("spam", "farm")),
    PatternRule("casinos", r"://[^/?#]*\b(?:online|best|free)-casino\b", ("casino",)),
    PatternRule("adult hosts", r"://[^/?#]*\badult-(?:video|chat|dating)\b", ("adult",)),
    PatternRule("redirectors", r"[?&]goto=https?", ("goto",)),
    PatternRule("redirectors", r"[?&]redirect=https?", ("redirect",)),
    PatternRule("feed copies", r"[?&]utm_source=feed\b", ("utm", "source", "feed")),
    PatternRule("session ids", r"[?&](?:phpsessid|jsessionid)=[0-9a-z]+", ()),
)

#: Rules are configuration, not data; their index is broadcast below this many rows and joined by shuffle beyond.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules: tuple[HostRule, ...]) -> Column:
    """The winning rule as struct<rule, verdict>, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(url), "[^a-z0-9]+"), ""))


def rule_table(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """The rules as literals of the plan, so no Python is needed to read them."""
    kind = "struct<rule_name:string,regex:string,token:string>"
    listed = F.array(*[F.struct(*map(F.lit, row)).cast(kind) for row in rows]).cast(f"array<{kind}>")
    return spark.range(1).select(F.inline(listed))


def rule_index(urls: DataFrame, rules: tuple[PatternRule, ...]) -> DataFrame:
    """One row per pattern with tokens: (token, regex, rule_name), token being its rarest among ``urls``."""
    listed = rule_table(urls.sparkSession, [(r.name, r.regex, t) for r in rules for t in r.tokens])
    known = F.broadcast(listed.select("token").distinct()) if len(rules) <= BROADCAST_RULES else listed.select("token").distinct()
    seen = urls.select(F.explode(tokens(F.col("url"))).alias("token")).join(known, "token").groupBy("token").count()
    return (
        listed.join(seen, "token", "left")
        .groupBy("rule_name", "regex")
        .agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    )


def pattern_blocked(urls: DataFrame, rules: tuple[PatternRule, ...]) -> DataFrame:
    """Distinct urls that a pattern rule blocks, with the first rule's name by code point: (url, pattern)."""
    index = rule_index(urls, rules)
    index = F.broadcast(index) if len(rules) <= BROADCAST_RULES else index
    by_token = (
        urls.select("url", F.explode(tokens(F.col("url"))).alias("token"))
        .join(index, "token")
        .where(F.regexp_like(F.lower("url"), F.col("regex")))
        .select("url", "rule_name")
    )
    found = by_token
    for r in rules:
        if not r.tokens:
            found = found.unionByName(
                urls.where(F.lower("url").rlike(r.regex)).select("url", F.lit(r.name).alias("rule_name"))
            )
    return found.groupBy("url").agg(F.min("rule_name").alias("pattern"))


def filter_urls(
    pages: DataFrame,
    host_rules: tuple[HostRule, ...] = HOST_RULES,
    pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES,
) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern (the pattern rule that blocked, else null) for every row."""
    parts = (
        pages.select("page_id", "url")
        .withColumn("host", host_of(F.col("url")))
        .withColumn("path", path_of(F.col("url")))
        .withColumn("found", host_rule(F.col("host"), F.col("path"), host_rules))
    )
    open_urls = stage(parts.where(F.col("found").isNull() & (F.col("host") != "")).select("url").distinct(), "open-urls")
    blocked = pattern_blocked(open_urls, pattern_rules)
    return parts.join(blocked, "url", "left").select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "pattern",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = r"""
WITH parts AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                          ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
ruled AS (
  SELECT *, (SELECT max_by(struct_pack(rule := h || p, verdict := v), length(h || p)) FROM rules
             WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS found
  FROM parts),
judged AS (
  SELECT *, CASE WHEN found IS NOT NULL OR host = '' THEN NULL
    WHEN regexp_matches(lower(url), '://[^/?#]*\badult-(?:video|chat|dating)\b') THEN 'adult hosts'
    WHEN regexp_matches(lower(url), '://[^/?#]*\b(?:online|best|free)-casino\b') THEN 'casinos'
    WHEN regexp_matches(lower(url), '[?&]utm_source=feed\b') THEN 'feed copies'
    WHEN regexp_matches(lower(url), '://[^/?#]*\bspam-farm\b') THEN 'link farms'
    WHEN regexp_matches(lower(url), '://[^/?#]*\bcheap-pills\b') THEN 'pill shops'
    WHEN regexp_matches(lower(url), '[?&](?:goto|redirect)=https?') THEN 'redirectors'
    WHEN regexp_matches(lower(url), '[?&](?:phpsessid|jsessionid)=[0-9a-z]+') THEN 'session ids' END AS pattern
  FROM ruled)
SELECT page_id, host, path, found.rule AS rule,
       coalesce(found.verdict, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, pattern
FROM judged
"""
