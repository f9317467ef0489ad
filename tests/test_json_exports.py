"""Native JSON exports against the plain parser, in any layout, across blocks, and when files are broken."""

import json
import random

import pytest
from pyspark.sql import functions as F

from convoweave.sources import exports
from convoweave.sources import json_exports as J


def sample(seed, n):
    r = random.Random(seed)
    text = lambda: r.choice(["plain", "a } b { c", 'quote " and \\ back', "[x] ]", "line\nbreak", "é😀", "\\", '\\"}', "", "}"])
    content = lambda: r.choice([text(), [text(), {"type": "text", "text": text()}, {"image": 1}, 5], {"value": text()}, {"text": text()}, {"text": "", "value": text()}, None, 0, []])
    message = lambda: {r.choice(["sender", "role", "author"]): r.choice(["Human", "me", "bot", "other", "", None]), r.choice(["text", "content"]): content(), r.choice(["created_at", "timestamp", "time"]): r.choice(["2024-05-06T07:08:09Z", "2024-05-06", "bad", 1700000000, 1700000000123, "2024-05-06 07:08", "2024-05-06T07:08:09.123456+02:00", None])}
    out = []
    for k in range(n):
        item = {r.choice(["uuid", "id", "conversation_id"]): r.choice([f"c{k}", k, "", None]), r.choice(["name", "title", "subject"]): r.choice([text(), ""]), r.choice(["created_at", "date"]): r.choice(["2024-01-02T03:04:05Z", 1.5e9, "x"]), "url": r.choice([None, "http://x", 17]), "deep": {"a": [[1, {"b": "}"}], []]}}
        item[r.choice(["chat_messages", "messages", "conversation"])] = r.choice([[message() for _ in range(r.randrange(5))] + ["odd", 3], [], "none"])
        out += r.choice([[item], [item], [item, "odd", 5, [1, "]"], None]])
    return out


def write(folder):
    folder.mkdir()
    made = {
        "a.json": json.dumps(sample(1, 60)), "b.json": json.dumps(sample(2, 40), indent=2), "c.json": json.dumps({"conversations": sample(3, 30), "meta": {"a": {"b": 1}}}, ensure_ascii=False),
        "d.json": json.dumps({"meta": 1, "conversations": sample(4, 9)}, indent=1), "e.json": json.dumps({"data": sample(5, 9)}), "f.json": json.dumps({"uuid": "one", "messages": [{"role": "me", "text": "hi}"}]}),
        "g.json": "[]", "h.json": " [ 1, \"x\" ] ", "i.json": json.dumps({"conversations": []}), "j.json": "\n" + json.dumps(sample(6, 5)) + "\n\n", "k.json": json.dumps({"conversations": ["odd", {"id": 1}], "z": [1]}),
    }
    broken = {"x1.json": "{nothing", "x2.json": "[{\"a\": 1}", "x3.json": "[{\"a\": 1}, {\"b\" 2}]", "x4.json": "3", "x5.json": "[{\"id\": 1}] trailing", "x6.json": "", "x7.json": "[{\"id\": \"unclosed}]"}
    for name, text in (made | broken).items():
        (folder / name).write_text(text, encoding="utf-8")
    return made, broken


def key(row):
    file, rest = row["file"].rsplit("/", 1)[1], row
    return file, rest["pos"], rest["conv_id"] if file not in () else None, rest["title"], rest["created_at"], rest["source_url"], repr([tuple(m) for m in rest["messages"] or []])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("json") / "in"
    return path, *write(path)


@pytest.mark.parametrize("block", ["64m", "1500b"])
def test_same_rows_as_the_plain_parser(spark, folder, block):
    path, made, broken = folder
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = J.read_json(spark, str(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [r for r in exports.parsed(exports.read_files(spark, str(path))).collect() if r["file"].rsplit("/", 1)[1] in made]
    assert sorted(map(key, (r for r in got if r["error"] is None))) == sorted(map(key, want))
    assert {r["file"].rsplit("/", 1)[1] for r in got if r["error"]} == set(broken) - {"x6.json"}


def test_lines(spark, tmp_path):
    items = [x for x in sample(9, 40) if isinstance(x, dict)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, items)) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, items[:3])))
    (tmp_path / "c.json").write_text(json.dumps(items))
    rows = J.read_json(spark, str(tmp_path)).where("error is null").collect()
    of = lambda name: [(r["pos"], r["title"], r["created_at"], repr(r["messages"])) for r in sorted(rows, key=lambda r: r["pos"]) if r["file"].endswith(name)]
    assert of("a.jsonl") == of("c.json") and of("b.jsonl") == of("c.json")[:3]


def test_no_python_worker(spark, folder):
    plan = J.read_json(spark, str(folder[0]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInPandas" not in plan and "Arrow" not in plan


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.json").write_text(json.dumps(sample(11, 400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000b")
    try:
        read = J.pieces(spark, str(tmp_path))
        assert read.select("block").distinct().count() > 5
        assert J.chunks(read).agg(F.max("chunk")).first()[0] > 300
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
