"""Validation of export files and conversations: error rows, so a bad input can be shown and left out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keys that validation looks at; they are fewer than the parser takes.
ROLES, CONTENTS = ("role", "sender", "type"), ("content", "text", "message")
NO_ROLE, NO_CONTENT, NO_MESSAGES = "message has no role", "message has no content", "conversation has no messages"


def message_error(role: Column, content: Column) -> Column:
    """What is wrong with a message, or null: a role must not be empty, content must not be null."""
    return F.when(F.coalesce(role, F.lit("")) == "", NO_ROLE).when(content.isNull(), NO_CONTENT)


def message_errors(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, error) of the bad rows of (conv_id, turn, role, text)."""
    return messages.select("conv_id", "turn", message_error(F.col("role"), F.col("text")).alias("error")).where("error IS NOT NULL")


def valid_conversations(messages: DataFrame) -> DataFrame:
    """The messages of conversations without a bad one."""
    return messages.join(message_errors(messages).select("conv_id"), "conv_id", "left_anti")


def conversation_errors(item: object, at: str) -> list[str]:
    if not isinstance(item, dict):
        return [f"{at}: not an object"]
    listed = item["messages"] if "messages" in item else item.get("chat_messages")
    if not isinstance(listed, list) or not listed:
        return [f"{at}: {NO_MESSAGES}"]
    out = []
    for k, m in enumerate(listed):
        if not isinstance(m, dict):
            out.append(f"{at}, message {k}: not an object")
            continue
        if not any(m.get(x) for x in ROLES):
            out.append(f"{at}, message {k}: {NO_ROLE}")
        if all(m.get(x) is None for x in CONTENTS):
            out.append(f"{at}, message {k}: {NO_CONTENT}")
    return out


def file_errors(text: str) -> tuple[int, list[str]]:
    """(number of conversations, errors) of a JSON export."""
    try:
        root = json.loads(text)
    except (ValueError, RecursionError) as e:
        return 0, [f"not JSON: {e}"]
    if isinstance(root, dict) and "conversations" in root:
        root = root["conversations"]
    elif isinstance(root, dict) and "messages" in root:
        root = [root]
    if not isinstance(root, list):
        return 0, ["neither a list nor an object with conversations or messages"]
    if not root:
        return 0, ["no conversations"]
    return len(root), [e for k, item in enumerate(root) for e in conversation_errors(item, f"conversation {k}")]


def validated(files: DataFrame) -> DataFrame:
    """(file, conversations, valid, errors) of (file, text) rows; a file is valid if it has conversations and no errors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [file_errors(t or "") for t in b["text"]]
            yield pd.DataFrame({"file": b["file"], "conversations": [n for n, _ in found], "valid": [not e for _, e in found], "errors": [e for _, e in found]})

    return files.select("file", "text").mapInPandas(run, "file string, conversations long, valid boolean, errors array<string>")
