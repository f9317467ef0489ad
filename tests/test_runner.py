"""From exports to a vault and back, with resume; validation; graph files."""

import json
import os
from xml.etree import ElementTree

from pyspark.sql import functions as F

from convoweave import __main__ as cli
from convoweave import runner
from convoweave.operators import knowledge as K
from convoweave.sinks import graph_files, vault
from convoweave.sources import exports, validation
from convoweave.sources.config import Settings


def export(folder):
    talk = lambda k, n: [{"sender": ("human", "assistant")[j % 2], "text": f"Kubernetes deployment question {k} step {j}\nCheck Prometheus soon." if j % 2 == 0 else f"Use configuration management {k}.\n```py\nx = {j}\n```"} for j in range(n)]
    rows = [{"uuid": f"c{k}", "name": f"Talk {k % 4}: a/b", "created_at": f"2024-0{1 + k // 3}-1{k % 3}T10:00:00Z", "chat_messages": talk(k, 4 if k else 1), "url": 17} for k in range(8)]
    os.makedirs(folder)
    with open(f"{folder}/a.json", "w") as f:
        json.dump({"conversations": [*rows, "odd", rows[1]]}, f)
    with open(f"{folder}/bad.json", "w") as f:
        f.write("{nothing")


def test_run_resume_and_stats(spark, tmp_path, capsys):
    export(f"{tmp_path}/in")
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    assert runner.run(spark, source, out, dry_run=True)["conversations"] == 7
    found = runner.run(spark, source, out, Settings(min_messages=2, near_duplicates=0))
    assert found["unreadable"] == 1 and found["conversations"] == 7
    notes = sorted(os.listdir(f"{tmp_path}/out/Conversations/uncategorized"))
    assert [n for n in notes if n.endswith(".md") and n[0] != "."] == [f"Talk {k}- a-b.md" for k in range(4)]
    assert found["notes_created"] == 4
    with open(f"{tmp_path}/out/Conversations/uncategorized/Talk 1- a-b.md") as f:
        text = f.read()
    assert text.startswith('---\ntitle: "Talk 1: a/b"\ndate: 2024-') and 'source_url: "17"' in text
    order = [text.index(x) for x in ("# Talk 1", "## Summary", "## Decisions", "## Action Items", "## Conversation", "> [!question]+ Human", "## Related Notes", "## See Also", "## Tags")]
    assert order == sorted(order) and "- [ ] Check Prometheus soon." in text
    index = set(os.listdir(f"{tmp_path}/out/000 Index"))
    assert {"README.md", "Topics MOC.md", "Timeline.md", "Clusters.md", "Statistics.md", "Master MOC.md", "Open Tasks.md"} <= index
    with open(f"{tmp_path}/out/000 Index/Statistics.md") as f:
        assert "- **Total Conversations**: 7" in f.read()
    with open(f"{tmp_path}/out/000 Index/Link Report.md") as f:
        report = f.read()
    assert f"Checked {found['links_checked']} links" in report and "## Broken Links" in report and "- `" in report
    assert 0 < found["links_broken"] < found["links_checked"] == found["total_links"] and found["pages_checked"] == found["pages"]
    shown = spark.read.parquet(f"{tmp_path}/out/graph-shown/edges")
    assert 0 < shown.count() <= spark.read.parquet(f"{tmp_path}/out/graph/edges").where("weight >= 0.3").count() and shown.where("weight < 0.3").count() == 0
    assert not os.path.exists(f"{tmp_path}/out/.stages")
    assert spark.read.parquet(f"{tmp_path}/out/graph/nodes").where("node_type = 'conversation'").count() == 7
    stats = runner.stats(spark, f"file://{tmp_path}/out")
    assert stats["notes"] == stats["suffixes"][".md"] and stats["links"] > 0 and stats["top_tags"]
    assert cli.main(["stats", f"{tmp_path}/out", "--json"]) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["notes"] == stats["notes"]


def test_near_copies_go(spark, tmp_path):
    export(f"{tmp_path}/in")
    s = Settings(min_messages=2)
    conv = runner.chosen(exports.read_exports(spark, f"file://{tmp_path}/in"), s)
    twins = {r["id"]: r["keep_id"] for r in runner.without_copies(runner.cleaned_messages(conv, s), s.near_duplicates).collect()}
    assert twins == {f"c{k}": "c1" for k in range(1, 8)}  # they differ in one number
    apart = {r["id"]: r["kept"] for r in runner.without_copies(runner.cleaned_messages(conv, s), 0.99).collect()}
    assert {k for k, kept in apart.items() if kept} == {"c1", "c4", "c5", "c6", "c7"}  # 1 to 3 are numbers that all have


def test_stages_resume(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    first = runner.Stages(spark, f"file://{tmp_path}/s", False, "k")
    assert first("x", make).count() == 3
    assert runner.Stages(spark, f"file://{tmp_path}/s", True, "k")("x", make).count() == 3 and len(made) == 1
    assert runner.Stages(spark, f"file://{tmp_path}/s", True, "other")("x", make).count() == 3 and len(made) == 2
    runner.Stages(spark, f"file://{tmp_path}/s", False, "k")("x", make)
    assert len(made) == 3


def test_validation(spark, tmp_path, capsys):
    good = {"messages": [{"role": "user", "content": ""}]}
    cases = {
        json.dumps([good]): (1, []), json.dumps({"conversations": [good, good]}): (2, []), json.dumps(good): (1, []), "{": (0, None), "3": (0, None), "[]": (0, None), "{}": (0, None),
        json.dumps([{"messages": []}]): (1, ["conversation 0: conversation has no messages"]), json.dumps(["x"]): (1, ["conversation 0: not an object"]),
        json.dumps([{"chat_messages": [{"text": "a"}, {"sender": "x"}, 5]}]): (1, ["conversation 0, message 0: message has no role", "conversation 0, message 1: message has no content", "conversation 0, message 2: not an object"]),
    }
    for text, (n, errors) in cases.items():
        found = validation.file_errors(text)
        assert found[0] == n and (found[1] == errors if errors is not None else len(found[1]) == 1)
    export(f"{tmp_path}/in")
    assert cli.main(["validate", f"{tmp_path}/in"]) == 1
    assert "bad.json: not JSON" in capsys.readouterr().out


def test_odd_exports_do_not_end_the_job(spark):
    deep = "<html>" + "<div>" * 5000 + "<p>hello</p>" + "</div>" * 5000
    timed = '<div class="Message Human"><time datetime="2024-01-02T03:04:05Z"></time>hi</div>'
    files = [("a.json", '[{"id": 5, "url": 9, "messages": [{"role": "user", "text": {"value": 3}}]}]'), ("b.html", deep), ("c.json", "[" * 100_000), ("d.html", timed), ("e.txt", "plain"), ("f.json", None)]
    rows = {r["file"]: r for r in exports.parsed(spark.createDataFrame(files, "file string, text string")).collect()}
    assert rows["a.json"]["source_url"] == "9" and rows["a.json"]["messages"][0]["content"] == "3"
    assert rows["b.html"]["messages"][0]["content"] == "hello" and rows["d.html"]["messages"][0]["timestamp"].year == 2024
    assert rows["c.json"]["error"] and rows["e.txt"]["error"] and rows["f.json"]["error"]


def test_graph_files(spark):
    nodes = spark.createDataFrame([("conv:1", "conversation", "A & <b>", 1), ("conv:2", "conversation", "B", 1), ("tag:x", "tag", "x", 2), ("tag:y", "tag", "y", 1)], "node_id string, node_type string, label string, n long")
    edges = spark.createDataFrame([("conv:1", "tag:x", "tagged_with", 1.0), ("conv:2", "tag:x", "tagged_with", 0.4), ("conv:1", "conv:2", "shared_tags", 0.1)], "src string, dst string, relationship string, weight double")
    groups = K.communities(nodes.select(F.col("node_id").alias("id")), edges)
    found = json.loads(graph_files.graph_json(nodes, edges, groups))
    assert found["stats"] == {"nodes": 4, "edges": 3, "communities": 2, "node_types": {"conversation": 2, "tag": 2}}
    shown = ElementTree.fromstring(graph_files.graphml(nodes, edges, orphans=False))
    assert len([x for x in shown.iter() if x.tag.endswith("node")]) == 3 and len([x for x in shown.iter() if x.tag.endswith("edge")]) == 2
    few, kept = K.filtered(nodes, edges, 0.3, 2, kinds=("conversation", "tag"))
    assert {r["node_id"] for r in few.collect()} == {"tag:x", "conv:1"} and kept.count() == 1
    assert K.filtered(nodes, edges, orphans=True)[0].count() == 4


def test_importance_falls_back_to_degrees(spark):
    nodes = spark.createDataFrame([(k,) for k in range(5)], "id long")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    assert {r["id"]: r["rank"] for r in K.importance(nodes, edges, 1).collect()} == {0: 0.25, 1: 0.5, 2: 0.5, 3: 0.25, 4: 0.0}
    assert abs(sum(r["rank"] for r in K.importance(nodes, edges).collect()) - 1) < 1e-6


def test_long_pages_stream_in_order(spark, tmp_path):
    lines = spark.range(30_000).select(F.lit("x/long.md").alias("path"), F.lit(1).alias("section"), F.lit(None).cast("string").alias("a"), F.col("id").cast("double").alias("b"), F.lit(None).cast("string").alias("c"), F.col("id").cast("string").alias("line")).repartition(7)
    assert [tuple(r)[:2] for r in vault.write_pages(lines, f"file://{tmp_path}/v").collect()] == [("x/long.md", 30_000)]
    with open(f"{tmp_path}/v/x/long.md") as f:
        assert f.read().split() == [str(k) for k in range(30_000)]
