"""Sources, sinks and streaming on literal files."""

import json

from convoweave.sinks.vault import write_notes
from convoweave.sources.exports import from_html, from_json, read_exports
from convoweave.sources.vault import vault_files, vault_stats, vault_tags
from convoweave.streaming.incremental import ingest

EXPORT = {
    "conversations": [
        {"uuid": "", "id": 7, "title": "T", "create_time": 1700000000, "messages": [{"role": "User", "content": ["a", {"type": "text", "text": "b"}]}, {"role": "bot", "text": ""}]},
        "skip",
        {"chat_messages": [{"sender": "me", "content": {"value": "v"}, "timestamp": "bad"}]},
    ]
}


def test_json():
    a, b = from_json(json.dumps(EXPORT))
    assert (a["conv_id"], a["title"], a["messages"]) == ("7", "T", [{"role": "human", "content": "a\nb", "timestamp": None}])
    assert (b["conv_id"], b["title"], b["messages"][0]["content"], b["messages"][0]["timestamp"]) == (None, "Conversation 3", "v", None)
    assert from_json('{"messages": []}')[0]["messages"] == []


def test_html():
    page = '<div class="conversation" data-id="x"><h1>T</h1><time datetime="2024-01-02T00:00:00Z"></time><div class="message user">hi<br>you</div><div class="message"> </div><div class="message" data-role="assistant">ok</div></div><div class="conversation"></div>'
    (c,) = from_html(page, "f")
    assert (c["conv_id"], c["title"], [(m["role"], m["content"]) for m in c["messages"]]) == ("x", "T", [("human", "hi\nyou"), ("assistant", "ok")])
    (p,) = from_html("<p>a</p><p>b</p>", "f")
    assert [m["role"] for m in p["messages"]] == ["human", "assistant"]


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(EXPORT))
    (tmp_path / "in/b.html").write_text("<html><p>x</p></html>")
    (tmp_path / "in/c.json").write_text("{broken")
    rows = read_exports(spark, str(tmp_path / "in")).collect()
    assert len(rows) == 4 and sum(r["error"] is not None for r in rows) == 1
    for want in (3, 3):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == want


def test_vault(spark, tmp_path):
    notes = spark.createDataFrame([("a/x.md", "#t/u [[y]] word", 0), ("a/x.md", "#t/u #v [[y]] [[z]]", 1), ("MOC b.md", "#t/u", 2)], "path string, content string, pos int")
    assert write_notes(notes, f"file://{tmp_path}/v") == 2
    files = vault_files(spark, f"file://{tmp_path}/v")
    s = vault_stats(files).first()
    assert (s["files"], s["notes"], s["mocs"], s["tags"], s["links"]) == (2, 2, 1, 3, 2)
    assert [tuple(r) for r in vault_tags(files).collect()] == [("t/u", 2), ("v", 1)]
