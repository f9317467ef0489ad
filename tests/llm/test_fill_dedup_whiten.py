"""Fill-in-the-middle, exact duplicates and whitening against plain Python, with nulls, repeats, clashes and empty tables."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from convoweave.llm import exact_dedup, fill_in_middle, whitening

SCHEMA = "doc_id long, text string, n string, form string, _fim int, row string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def lines(seed, n, end="\n"):
    r = random.Random(seed)
    return "".join("".join(r.choice("abc \té😀") for _ in range(r.randrange(6))) + "\n" for _ in range(n)) + end


@pytest.fixture(scope="module")
def rows():
    texts = ["", None, "one", "\n", "\n\n\n", "a\r\nb c\n d", "has <P> mark\nx\n", "<S", "P>\n<\nM>\n", "é😀\n" * 3, lines(1, 4000), "x" * 200_000]
    texts += [lines(k, k % 9, "tail" * (k % 2)) for k in range(2, 60)]
    out = [(k, t, "n", "f", 1, "r") for k, t in enumerate(texts)] + [(None, "no id\nat all\n", "n", "f", 1, "r"), (None, None, "n", "f", 1, "r")]
    return out + [(10, lines(1, 4000), "other", "f", 1, "r")] + [(3, "another text\nof the same id\n", "n", "f", 1, "r")] + [(7, "copy\nof a row\n", "n", "f", 1, "r")] * 40


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def cut(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, x = len(units), sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 100), (0, 0)])
def test_fill_in_middle(docs, rows, rate, spm):
    made = fill_in_middle.fill_in_middle(docs, rate, spm)
    assert made.columns[:-1] == docs.columns and made.columns[-1] == "__fim"
    back = made.withColumn("back", fill_in_middle.restore(F.col("__fim.output"), F.col("__fim.form")))
    got = [(r["doc_id"], r["text"], r["n"], tuple(r["__fim"]), r["back"]) for r in back.collect()]
    want = [(i, t, n, cut(i, t, rate, spm), t or "") for i, t, n, *_ in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_other_units(spark):
    docs = spark.createDataFrame([(k, "ab cd  ef" * k) for k in range(20)], "doc_id long, text string")
    made = fill_in_middle.fill_in_middle(docs, pattern=r"\S+\s*")
    assert all(fim["n"] == len(re.findall(r"\S+\s*", t)) for _, t, fim in made.collect())
    assert made.select(fill_in_middle.restore(F.col("_fim.output"), F.col("_fim.form")) == F.col("text")).distinct().collect() == [(True,)]


def test_units_are_not_dealt_twice(docs):
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    plan = fill_in_middle.offsets(docs, key)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert plan.count("Exchange hashpartitioning") <= 2  # one for each side, the second being the first's reuse


def bare(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.fixture(scope="module")
def copies():
    out = [(k, t) for k, t in enumerate(["a b", "ab", " a b ", "a\vb\f", "a b", "", None, " \n", "é", "é", "x" * 300_000, "x" * 150_000 + " " + "x" * 150_000])]
    out += [(100 + k, "one hot group " + " " * (k % 3)) for k in range(300)] + [(None, "ab"), (None, "only here"), (None, "only here")] + [(50, "same row")] * 30
    return [(i, t, "n", "f", 1, "r") for i, t in out]


def kept(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[bare(t)].append((-len(t or ""), i is None, i or 0, i))
    return {b: (min(g)[3], len(g)) for b, g in groups.items()}


@pytest.mark.parametrize("bits", [128, 3])
def test_exact_dedup(spark, copies, bits):
    """Also with a hash of three bits, where nearly all groups collide and only the bytes tell texts apart."""
    docs = spark.createDataFrame(copies, SCHEMA).repartition(6)
    hashed = exact_dedup.hash128 if bits == 128 else lambda x: F.unhex(F.hex(F.crc32(x.cast("binary")) % 8))
    got = exact_dedup.grouped(docs, hashed).collect()
    want = kept(copies)
    digests = {sha(b): v for b, v in want.items()}
    assert len(got) == len(copies)
    assert all((r["keep_id"], r["group_size"]) == digests[r["digest"]] for r in got)
    stay = [r for r in got if r["kept"]]
    assert sorted(r["digest"] for r in stay) == sorted(digests) and all(r["doc_id"] == r["keep_id"] for r in stay)


def test_one_of_each_stays(spark, copies):
    docs = spark.createDataFrame(copies, SCHEMA).repartition(6)
    out = exact_dedup.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(repr((bare(r["text"]), r["doc_id"])) for r in out.collect()) == sorted(repr((b, i)) for b, (i, _) in kept(copies).items())


def test_twins(spark, rows, copies, tmp_path):
    for name, data, module in (("a", rows, fill_in_middle), ("b", copies, exact_dedup), ("c", [], fill_in_middle), ("d", [], exact_dedup)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(data, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        duck = duckdb.connect()
        duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        got, want = module.query(spark, folder), duck.sql(module.SQL)
        assert got.columns == want.columns
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


VECTORS = "vec_id long, embedding array<float>, n int, whitened string"


def table(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "w") for i, v in vectors]
    return spark.createDataFrame(rows, VECTORS).repartition(parts)


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening(spark, parts):
    r = np.random.default_rng(5)
    good = (r.normal(size=(400, 20)) @ r.normal(size=(20, 20)) + np.arange(20)).astype(np.float32)
    hot = [(1000 + k, good[0]) for k in range(200)] + [(5, good[5]), (None, good[7])]
    bad = [(2000, None), (2001, [None] * 20), (2002, [float("nan")] * 20), (2003, [float("inf")] + [0.0] * 19), (2004, [1.0] * 3), (2005, []), (2006, [3e38] * 20)]
    rows = [(k, v) for k, v in enumerate(good)] + hot
    got = whitening.whiten(table(spark, rows + bad, parts)).collect()
    assert sorted(repr(r["vec_id"]) for r in got) == sorted(repr(i) for i, _ in rows)
    x = np.floor(64 * good.astype(float)).astype(np.int64) + 1_000_000
    once = np.unique(x, axis=0)
    n, sums = len(once), once.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(once.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    of = {i: x[k] for k, (i, _) in enumerate(rows[:400])} | {1000 + k: x[0] for k in range(200)} | {None: x[7]}
    signs = None
    for row in got:
        v = of[row["vec_id"]]
        assert row["n"] == n and row["deviation"] == int(((n * v.astype(object) - sums) ** 2).sum())
        want = (v - sums / n) @ axes[:, :16] / np.sqrt(values[:16])
        signs = np.sign(want * row["whitened"]) if signs is None else signs
        assert np.allclose(want * signs, row["whitened"], atol=1e-8)
        assert np.allclose(row["explained"], values[:16] / values.sum()) and row["identity_error"] < 1e-9


def test_merged_statistics_do_not_depend_on_the_cut():
    x = np.random.default_rng(1).integers(0, 1000, (90, 4))
    whole = whitening.statistics_of(x)
    for ends in ([30, 60], [1, 2], [89], [5, 6, 50, 51]):
        parts = [whitening.statistics_of(p) for p in np.split(x, ends)]
        tree = None
        for p in parts[::-1]:
            tree = whitening.merged(p, tree)
        assert tree[0] == 90 and (tree[1] == whole[1]).all() and np.allclose(tree[2], whole[2]) and np.allclose(tree[3], whole[3])


def test_flat_and_empty_tables(spark, tmp_path):
    assert whitening.whiten(table(spark, [])).count() == 0
    same = whitening.whiten(table(spark, [(k, [1.5, -2.0, 0.25]) for k in range(9)])).collect()
    assert len(same) == 9 and {(r["n"], r["deviation"], tuple(r["whitened"]), r["identity_error"]) for r in same} == {(1, 0, (None,) * 3, 0.0)}
    line = whitening.whiten(table(spark, [(k, [k, 2 * k, 0]) for k in range(9)])).collect()  # one component has variance
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] and r["identity_error"] < 1e-9 for r in line)
    table(spark, [(k, [k, -k * k]) for k in range(9)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = whitening.query(spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 18


def test_deviations_beyond_64_bits():
    x, sums = np.array([[3_000_000], [1_000_000]]), np.array([4_000_000])
    assert whitening.deviations(x, 2, sums).tolist() == [4 * 10**12, 4 * 10**12]
    with pytest.raises(OverflowError):
        whitening.deviations(np.array([[1 << 40]]), 1 << 20, np.array([0]))
