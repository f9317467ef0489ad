"""Conversation exports: JSON files of varying shape and HTML pages, one row for each conversation.

JSON files are read natively by ``json_exports``; the parser here takes texts that come as rows or in streams, and HTML, whole
and in parallel. Directories and globs are fine. Ids that are missing become a hash of file and
ordinal, times that cannot be read become null. Elements that are no objects are skipped; a file that is neither JSON
nor HTML gives one row with ``error`` set.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import datetime, timezone
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoweave.functions.cleaning import ASSISTANT_ROLES, HUMAN_ROLES

SCHEMA = (
    "file string, pos int, conv_id string, title string, created_at timestamp, source_url string, "
    "messages array<struct<role:string,content:string,timestamp:timestamp>>, error string"
)
# The keys under which exports keep each field, first one with a value wins.
ID_KEYS = ("uuid", "id", "conversation_id")
TITLE_KEYS = ("name", "title", "subject")
TIME_KEYS = ("created_at", "create_time", "timestamp", "date")
URL_KEYS = ("url", "source_url")
MESSAGE_KEYS = ("chat_messages", "messages", "conversation")
ROLE_KEYS = ("sender", "role", "author")
MESSAGE_TIME_KEYS = ("created_at", "timestamp", "time")
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}


def first(data: dict, keys: tuple[str, ...]):
    return next((data[k] for k in keys if data.get(k)), None)


def role_of(value) -> str:
    low = str(value).lower()
    return "human" if low in HUMAN_ROLES else "assistant" if low in ASSISTANT_ROLES else low


def time_of(value) -> datetime | None:
    try:
        if isinstance(value, (int, float)):
            return datetime.fromtimestamp(value / 1000 if value > 1e12 else value, timezone.utc)
        found = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
        return found if found.tzinfo else found.replace(tzinfo=timezone.utc)
    except (ValueError, OverflowError, OSError):
        return None


def content_of(message: dict) -> str:
    body = first(message, ("text", "content"))
    if isinstance(body, str):
        return body
    if isinstance(body, list):
        return "\n".join(x if isinstance(x, str) else x["text"] for x in body if isinstance(x, str) or isinstance(x, dict) and isinstance(x.get("text"), str))
    if isinstance(body, dict):
        return str(first(body, ("text", "value")) or "")
    return ""


def from_json(text: str) -> list[dict]:
    root = json.loads(text)
    if isinstance(root, dict):
        inner = next((root[k] for k in ("conversations", "data") if k in root), root)
        root = inner if isinstance(inner, list) else [inner]
    if not isinstance(root, list):
        raise ValueError("the root is neither a list nor an object")
    out = []
    for k, item in enumerate(root):
        if not isinstance(item, dict):
            continue
        listed = first(item, MESSAGE_KEYS)
        messages = []
        for m in listed if isinstance(listed, list) else []:
            if isinstance(m, dict) and (content := content_of(m)):
                messages.append({"role": role_of(first(m, ROLE_KEYS) or "unknown"), "content": content, "timestamp": time_of(first(m, MESSAGE_TIME_KEYS))})
        ident = first(item, ID_KEYS)
        out.append({"conv_id": None if ident is None else str(ident), "title": str(first(item, TITLE_KEYS) or f"Conversation {k + 1}"), "created_at": time_of(first(item, TIME_KEYS)), "source_url": None if (url := first(item, URL_KEYS)) is None else str(url), "messages": messages})
    return out


class Tree(HTMLParser):
    """A page as nested [tag, attributes, children, text pieces]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        if tag == "p" and self.open[-1][0] == "p":
            self.open.pop()
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1][2].append(data)


def walk(node) -> Iterator[list]:
    """All nodes below, in order; with a stack, as pages may be nested deeper than calls can be."""
    stack = [x for x in reversed(node[2]) if isinstance(x, list)]
    while stack:
        x = stack.pop()
        yield x
        stack += [y for y in reversed(x[2]) if isinstance(y, list)]


def text_of(node) -> str:
    parts: list[str] = []
    stack = list(reversed(node[2]))
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += reversed(x[2])
        elif x.strip():
            parts.append(x.strip())
    return "\n".join(parts)


def classes(node) -> list[str]:
    return (node[1].get("class") or "").lower().split()


def from_html(text: str, file: str) -> list[dict]:
    tree = Tree()
    tree.feed(text)
    every = list(walk(tree.root))
    boxes = next((b for b in ([n for n in every if n[0] == t and "conversation" in classes(n)] for t in ("div", "article", "section")) if b), None)
    boxes = boxes or [n for n in every if n[0] == "div" and "data-conversation" in n[1]] or [tree.root]
    out = []
    for box in boxes:
        inner = list(walk(box))
        found = next((m for m in (
            [n for n in inner if n[0] == "div" and "message" in classes(n)], [n for n in inner if n[0] == "div" and "chat-message" in classes(n)],
            [n for n in inner if any("message" in c for c in classes(n))], [n for n in inner if n[0] == "p"]) if m), [])
        messages = []
        for n in found:
            content = text_of(n)
            if not content:
                continue
            name = " ".join(classes(n)).lower()
            role = "human" if "human" in name or "user" in name else "assistant" if "assistant" in name or "claude" in name else n[1].get("data-role")
            at = next((x[1]["datetime"] for x in walk(n) if x[0] == "time" and x[1].get("datetime")), None)
            messages.append({"role": role_of(role) if role else ("human", "assistant")[len(messages) % 2], "content": content, "timestamp": time_of(at) if at else None})
        if not messages:
            continue
        title = next((t for tag in ("h1", "h2", "title") for n in inner if n[0] == tag and (t := text_of(n))), None) or next((t for n in inner if "title" in classes(n) and (t := text_of(n))), None)
        when = next((n[1]["datetime"] for n in inner if (n[0] == "time" or "timestamp" in classes(n)) and n[1].get("datetime")), None)
        out.append({"conv_id": box[1].get("data-id") or box[1].get("id"), "title": title or f"Conversation {len(out) + 1}", "created_at": time_of(when) if when else None, "source_url": file, "messages": messages})
    return out


def parse(file: str, text: str) -> list[dict]:
    start = text.lstrip()[:20].lower()
    try:
        if file.endswith(".json") or start[:1] in ("{", "["):
            rows = from_json(text)
        elif file.endswith((".html", ".htm")) or start.startswith(("<!doctype", "<html")):
            rows = from_html(text, file)
        else:
            raise ValueError("neither JSON nor HTML")
    except (ValueError, RecursionError, TypeError, AttributeError, OverflowError) as e:  # whatever is odd in a file is told in its row
        return [{"file": file, "pos": 0, "error": str(e)}]
    for k, r in enumerate(rows):
        r |= {"file": file, "pos": k, "conv_id": r["conv_id"] or hashlib.sha256(f"{file}#{k}".encode()).hexdigest()[:32], "error": None}
    return rows


def parsed(files: DataFrame) -> DataFrame:
    """Conversations of (file, text) rows, batch or streaming."""
    names = [x.split()[0] for x in ("file", "pos", "conv_id", "title", "created_at", "source_url", "messages", "error")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, text in zip(b["file"], b["text"], strict=True):
                yield pd.DataFrame([{n: r.get(n) for n in names} for r in parse(file, text or "")], columns=names).astype({"created_at": "datetime64[us, UTC]"})

    return files.mapInPandas(run, SCHEMA)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of a file, a folder or a pattern."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


JSON_FILES, JSON_NAMES = "*.{json,jsonl,ndjson,JSON}", r"(?i)[.](json|jsonl|ndjson)\z"


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Conversations of a file, a folder or a pattern: JSON files by name are read natively, in pieces, the others whole."""
    from convoweave.sources.json_exports import read_json

    others = read_files(spark, path).where(~F.col("file").rlike(JSON_NAMES))  # a filter on names keeps the files from being read
    return read_json(spark, path).unionByName(parsed(others))
