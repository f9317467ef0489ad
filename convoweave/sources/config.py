"""Settings and taxonomies from JSON, TOML or (where the library is there) YAML files."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Settings:
    """What a run can be told; what a file leaves out keeps its default."""

    min_messages: int = 3
    max_age_days: int = 0
    chunk_messages: int = 50
    include_assistant: bool = True
    near_duplicates: float = 0.85
    min_confidence: float = 0.6
    max_tags: int = 7
    layout: str = "category"
    min_edge_weight: float = 0.3
    max_nodes: int = 1000
    include_orphans: bool = False
    link_threshold: float = 0.3
    link_concepts: bool = True
    node_types: tuple[str, ...] = ("conversation", "concept", "tag", "person")
    patterns: dict[str, str] = field(default_factory=dict)


def read_file(path: str) -> Any:
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ModuleNotFoundError as e:
            raise ValueError("this Python has no YAML library: give the settings as JSON or TOML") from e
        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f)
    with open(path, "rb") as f:
        return tomllib.load(f) if path.endswith(".toml") else json.load(f)


def settings(path: str | None = None) -> Settings:
    """Settings of a file; unknown keys are an error, sections may be nested and only order the keys."""
    given: dict[str, Any] = {}

    def gather(part: dict[str, Any]) -> None:
        for k, v in part.items():
            if isinstance(v, dict) and k != "patterns":
                gather(v)
            else:
                given[k] = tuple(v) if isinstance(v, list) else v

    gather((read_file(path) or {}) if path else {})
    unknown = set(given) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Settings(**given)


def taxonomy_rows(root: Any) -> list[tuple[str, str, str]]:
    """(category, tag, word) of {category: {tag: [words]}}, {category: [tags]} or {category: tag}; a tag counts as a word of its own."""
    out: list[tuple[str, str, str]] = []
    for category, tags in (root or {}).items():
        listed = tags if isinstance(tags, dict) else {t: [] for t in (tags if isinstance(tags, list) else [tags])}
        for tag, words in listed.items():
            own = words if isinstance(words, list) else [words] if words else []
            out += [(str(category), str(tag), str(w).lower()) for w in [tag, *own]]
    return sorted(set(out))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(taxonomy_rows(read_file(path)), "category string, tag string, word string")


def taxonomy_text(root: Any) -> str:
    """The taxonomy as it stands in prompts: a line for each category."""
    tags: dict[str, list[str]] = {}
    for category, tag, _ in taxonomy_rows(root):
        if tag not in tags.setdefault(category, []):
            tags[category].append(tag)
    return "\n".join(f"- {c}: {', '.join(t)}" for c, t in tags.items())
