"""The training-data operators on small fixtures with nulls, empty and long texts, copies, ties and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from convoweave.llm import decontamination, mixing, ngram_join, quality_neighbours, quality_rules, repeats, sharding, toxicity, training_order, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, h string"
WORDS = [f"w{k}" for k in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 300)
    near = base.split()
    near[150] = "changed"
    shared = prose(2, 80)
    out = [base, base, " ".join(near), prose(3, 60) + " " + shared, prose(4, 90) + " " + shared, "", None, "one", "two words", "Two WORDS", prose(5, 3000), "a b c d e f g h " * 6]
    return out + [prose(10 + k, 40) for k in range(20)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, ("en", "de", None)[k % 3], ("s1", "s2", None)[k % 3], 0, "x", "y") for k, t in enumerate(texts)]
    rows += [(None, prose(99, 30), "en", "s1", 0, "x", "y"), (3, texts[3], "en", "s1", 0, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_rules(docs, empty, texts):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        w = words(t)
        wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(8)}
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert not got[11]["kept"]
    assert quality_rules.judge(empty).count() == 0


@pytest.mark.parametrize("broadcast", [2_000, 10])
def test_quality_rules_have_a_reference_for_every_language(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(quality_rules, "BROADCAST_LANGUAGES", broadcast, raising=False)
    rows = []
    for k in range(75):  # the rarer languages are written in other scripts
        t = prose(5000 + k, 60) if k < 66 else " ".join(chr(0x400 + 40 * (k - 66) + x % 40) * (1 + x // 40) for x in range(90))
        rows += [(10 * k + j, t + f" w{j}", f"l{k:02d}" if k < 74 else None) for j in range(3 if k < 64 else 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = quality_rules.query(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(quality_rules.SQL).fetchall())
    assert got.where("kept").count() == len(rows)


def test_quality_rules_count_words_of_any_length_and_any_name_of_a_language(spark, tmp_path):
    """A long word that is common makes texts without it far; the language ``*`` is not that of rows without one."""
    own = lambda k, w: " ".join([w] * 3 + prose(6000 + k, 4).split()[:3])
    rows = [(k, " ".join(own(20 * k + j, "extraordinarily") for j in range(12)), "*") for k in range(30)]
    rows += [(100 + k, " ".join(own(9000 + 20 * k + j, "unbeaufsichtigt") for j in range(12)), None) for k in range(30)]
    rows += [(200, rows[30][1], "*"), (201, rows[30][1], ""), (None, rows[0][1], "="), (None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = quality_rules.judge(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by_id[200]["word_distance"] > 0.5 > max(by_id[k]["word_distance"] for k in [*range(30), *range(100, 130)])
    assert by_id[201]["word_distance"] < 0.5
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE doc_id IS NOT NULL")
    ids = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id IS NOT NULL")
    mine = quality_rules.judge(ids).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted(map(tuple, mine.collect())) == sorted(duck.sql(quality_rules.SQL).fetchall())


def expected_components(texts, n=3, percent=90):
    sets = []
    for t in texts:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return [(len(s), r) for s, r in zip(sets, root)]


def test_ngram_join(docs, empty, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(docs).collect()}
    for k, want in enumerate(expected_components(texts)):
        assert got[k] == want
    assert ngram_join.join_components(empty).count() == 0


def test_ngram_join_finds_every_link(spark):
    r = random.Random(5)
    base = [prose(1000 + k, r.choice([4, 12, 40, 130, 500])) for k in range(12)]
    texts = []
    for t in base:
        for _ in range(7):
            w = t.split()
            for _ in range(r.randrange(0, max(2, len(w) // 40))):
                w[r.randrange(len(w))] = r.choice(WORDS)
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.join_components(df).collect()}
    assert [got[k] for k in range(len(texts))] == expected_components(texts)


def test_mixing(docs, empty, texts):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts) + 2
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    by_source = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source.setdefault((r["source_size"], r["target"]), []).append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(t for _, t in by_source) - 1.5 * total) < 1e-6 * total
    for (size, target), part in by_source.items():
        assert target <= 2 * size and sum(r["size"] for r in part) == size
        assert abs(sum(r["taken"] for r in part) - target) <= max(r["size"] for r in part)
    assert mixing.resample(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0


def test_sharding(docs, empty, texts):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == len(texts) + 2
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows}
    for k, t in enumerate(texts):
        assert sizes[k] == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sharding.shard(empty).count() == 0


def test_histogram_is_exact(spark):
    key = lambda k: (k % 7 - 3, k // 2, k)
    rows = spark.createDataFrame([(*key(k), k + 1) for k in range(100)], "h long, id long, place long, size long")
    probes = [(-2, 10, 0), (0, sharding.NO_ID, 0), (0, 22, 45), (3, 1 << 40, 0)]
    size, n = sharding.histogram(rows, probes)
    for p, a, b in zip(probes, size, n):
        low = [k for k in range(100) if key(k) < p]
        assert (a, b) == (sum(k + 1 for k in low), len(low))


def test_keys_between():
    low, high = sharding.LOWEST, sharding.HIGHEST
    for a, b in ((low, high), ((5, 3, 9), (6, sharding.NO_ID, 0)), ((5, 3, 9), (5, 4, 0)), ((5, 3, 9), (5, 3, 40)), ((5, sharding.MOST, 1), (6, sharding.NO_ID, 0)), ((5, sharding.NO_ID, 0), (5, 80, 0))):
        found = sharding.between(a, b, 8)
        assert found and found == sorted(set(found)) and all(a < x < b for x in found)
    assert sharding.between((5, 3, 9), (5, 3, 10), 8) == []
    inside = sharding.between((5, sharding.NO_ID, 0), (6, sharding.NO_ID, 0), 8, sharding.Bounds(100, 900, 50))
    assert len(inside) == 8 and all(k[0] == 5 and 100 <= k[1] <= 900 for k in inside)


def test_repeats(docs, empty, texts, spark):
    rows = repeats.remove_repeats(docs).collect()
    data = [(t or "").encode() for t in texts] + [prose(99, 30).encode(), texts[3].encode()]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    want = []
    for b in data:
        cut = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                cut[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, c in zip(b, cut) if not c)
        want.append((len(b), sum(cut), len(re.findall(b"\1+", bytes(cut))), hashlib.sha256(kept).hexdigest()))
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == sorted(want)
    assert repeats.remove_repeats(empty).count() == 0


def test_url_filters(spark):
    urls = {
        1: ("http://WWW.Example.com/en/1?x=1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        2: ("https://m.example.com/en/2#t", "m.example.com", "/en/2", "example.com/en/", "block"),
        3: ("http://a.net/es/", "a.net", "/es/", "net/es/", "block"),
        4: ("http://cheap-pills.example.org/x", "cheap-pills.example.org", "/x", None, "block"),
        5: (None, "", "", None, "allow"),
        6: ("no scheme", "", "", None, "allow"),
        7: ("http://x.com", "x.com", "", None, "allow"),
        8: ("http://www.example.com/fr/x", "www.example.com", "/fr/x", "com/", "allow"),
        9: ("http://a.www.example.com/es/", "a.www.example.com", "/es/", "com/", "allow"),
        10: ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        11: ("http://example.com/en/x", "example.com", "/en/x", "example.com/en/", "block"),
        12: ("http://notexample.com/en/x", "notexample.com", "/en/x", "com/", "allow"),
        13: ("", "", "", None, "allow"),
    }
    df = spark.createDataFrame([(k, v[0], "z") for k, v in urls.items()], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in url_filters.filter_urls(df).collect()}
    assert got == {k: v[1:] for k, v in urls.items()}
    twice = df.unionByName(df)
    assert url_filters.filter_urls(twice).count() == 2 * len(urls) and url_filters.filter_urls(df.where("false")).count() == 0


def test_url_filters_equal_their_sql(spark, tmp_path):
    hosts = ["WWW.Example.com", "m.www.example.com", "example.com", "a.example.com", "x.com", "a.net", "net", "org", "cheap-pills.org", "best-casino.net", ""]
    tails = ["", "/", "/en", "/en/", "/en/a?b=/es/", "/es/#x", "/fr/y", "/EN/", "?goto=https://a", "?redirect=http", "?utm_source=feed"]
    urls = [f"{s}{h}{t}" for s in ("http://", "a://b://", "x") for h in hosts for t in tails] + [None, ""]
    spark.createDataFrame([*enumerate(urls), (0, urls[0]), (None, urls[5])], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    columns = "page_id, host, path, rule, verdict, pattern"
    got = url_filters.query(spark, str(tmp_path)).select(*columns.split(", ")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, duck.sql(f"SELECT {columns} FROM ({url_filters.SQL})").fetchall()))


def test_url_patterns_equal_a_full_scan(spark):
    hosts = ["a.net", "cheap-pills.net", "x.cheap-pills.org", "cheap-pillsx.org", "spam-farm.net", "best-casino.org", "free-casinos.org", "adult-chat.net", "adults-chat.net"]
    tails = ["", "/", "/x?goto=http", "/?redirect=http://b.org/x", "/?a=1&goto=https://b.org", "/?redirect=httpsfoo", "/?xgoto=http://b", "/?GOTO=HTTP://b", "/?redirect=ftp://b", "?utm_source=feed", "?utm_source=feeds", "?phpsessid=1a"]
    urls = [f"{scheme}://{h}{t}" for scheme in ("http", "https") for h in hosts for t in tails]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [(r.name, r.regex) for r in url_filters.PATTERN_RULES]
    want = {k: min((name for name, regex in rules if re.search(regex, u.lower())), default=None) for k, u in enumerate(urls)}
    got = {r["page_id"]: r["pattern"] for r in url_filters.filter_urls(df, ()).collect()}
    assert got == want
    assert got[urls.index("http://a.net/?redirect=http://b.org/x")] == "redirectors"


def test_decontamination(spark, docs, empty):
    item = prose(77, 30)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, prose(78, 25))], "item_id long, text string")
    dirty = spark.createDataFrame([(500, prose(6, 4000) + " " + item.upper() + ". " + prose(7, 50)), (501, " ".join(item.split()[:15]))], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(dirty)
    assert [(r["doc_id"], r["item_id"], r["containment"]) for r in decontamination.contamination(both, bench).collect()] == [(500, 1, 1.0)]
    assert decontamination.decontaminate(both, bench).count() == both.count() - 1
    assert decontamination.contamination(empty, bench).count() == 0


def labelled(spark, mark):
    rows, labels = [], []
    for k in range(160):
        bad = k % 2 == 0
        t = prose(3000 + k, 40)
        rows.append((k, mark(t, k) if bad else t))
        labels.append((k, 0 if bad else 1, 1 if bad else 0))
    rows += [(900, None), (901, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_classifier(spark):
    docs, labels = labelled(spark, lambda t, k: " ".join(w.upper() + "!!" for w in t.split()))
    rows = {r["doc_id"]: r for r in quality_neighbours.score_quality(docs, labels).collect()}
    assert all(rows[k]["predicted"] == k % 2 for k in range(160)) and len(rows) == 162
    assert 0 <= rows[900]["score"] <= 1 and rows[900]["score"] == rows[901]["score"]
    assert rows[5]["held_out"] == (zlib.crc32(b"5") % 5 == 0)
    assert quality_neighbours.score_quality(docs, labels.where("false")).where("score <> 0.5").count() == 0


def test_toxicity(spark):
    docs, labels = labelled(spark, lambda t, k: t[:60] + f" nastyword{k % 7} " + t[60:])
    rows = {r["doc_id"]: r for r in toxicity.tag(docs, labels).collect()}
    assert sum(rows[k]["predicted"] == 1 - k % 2 for k in range(160)) >= 158
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    spans = [text[k][s["start"] : s["end"]] for k in range(0, 160, 2) for s in rows[k]["spans"]]
    assert any(s.startswith("nastyword") for s in spans) and rows[900]["score"] == 0
    scores = [rows[k]["score"] for k in range(160)]
    assert min(scores) > 0 and len(set(scores)) > 150  # faint marginals count, so clean texts are ranked too
    assert toxicity.tag(docs.limit(0), labels).count() == 0


def test_toxicity_of_repeats_nulls_long_texts_and_clashing_names(spark):
    docs, labels = labelled(spark, lambda t, k: t[:60] + f" nastyword{k % 7} " + t[60:])
    long_clean, bad = prose(77, 60_000), prose(78, 30) + " nastyword1 nastyword2 " + prose(79, 30)
    more = [(1000, bad), (1000, bad), (1000, "fine words"), (None, bad), (None, None), (1001, ""), (1002, long_clean), (1003, long_clean + " " + bad)]
    odd = spark.createDataFrame([(i, t, 7.0, "x", 1) for i, t in more], "doc_id long, text string, score double, spans string, predicted int")
    both = docs.select("doc_id", "text").unionByName(odd, allowMissingColumns=True)
    got = [r for r in toxicity.tag(both, labels).collect() if r["doc_id"] is None or r["doc_id"] >= 1000]
    assert sorted((r["doc_id"] or -1, r["predicted"]) for r in got) == sorted([(1000, 1), (1000, 1), (1000, 0), (-1, 1), (-1, 0), (1001, 0), (1002, 0), (1003, 1)])
    assert [r["score"] for r in got if r["doc_id"] == 1001] == [0.0]


def test_quality_classifier_of_repeats_nulls_long_texts_and_clashing_names(spark):
    docs, labels = labelled(spark, lambda t, k: " ".join(w.upper() + "!!" for w in t.split()))
    good, bad = prose(78, 40), " ".join(w.upper() + "!!" for w in prose(79, 40).split())
    more = [(1000, good), (1000, good), (1000, bad), (None, good), (None, None), (1001, ""), (1002, prose(77, 60_000))]
    odd = spark.createDataFrame([(i, t, 7.0, "x") for i, t in more], "doc_id long, text string, score double, held_out string")
    both = docs.select("doc_id", "text").unionByName(odd, allowMissingColumns=True)
    got = quality_neighbours.score_quality(both, labels).where("doc_id IS NULL OR doc_id >= 1000").collect()
    told = sorted(("" if r["text"] is None else r["text"], r["predicted"]) for r in got if r["text"])
    assert told == sorted((t, int(t != bad)) for _, t in more if t) and len(got) == len(more)
    assert len({r["score"] for r in got if not r["text"]}) == 1
    assert quality_neighbours.score_quality(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("strength", [0.0, 0.8, 2.5])
def test_cut_sequences_have_the_marginals_of_whole_ones(strength):
    r = np.random.default_rng(1)
    lengths = np.array([0, 5000, 1, 0, 131, 2048, 700])
    e = r.normal(size=lengths.sum()) * 3
    a = np.exp([[strength, -strength], [-strength, strength]])
    f, b = toxicity.forward_backward(e, lengths, a)
    cut = toxicity.marginals(e, lengths, a, 64)
    assert np.allclose(cut, toxicity.sigmoid(f + b), rtol=1e-9, atol=1e-12)


def test_forward_backward_is_exact():
    r = np.random.default_rng(0)
    e, a = r.normal(size=5), np.exp(r.normal(size=(2, 2)))
    f, b = toxicity.forward_backward(e, np.array([5]), a)
    import itertools

    total, marked = 0.0, np.zeros(5)
    for tags in itertools.product((0, 1), repeat=5):
        w = np.exp(sum(x * t for x, t in zip(e, tags))) * np.prod([a[i, j] for i, j in zip(tags, tags[1:])])
        total += w
        marked += w * np.array(tags)
    assert np.allclose(marked / total, toxicity.sigmoid(f + b))


def check_shards(rows, folder, texts_by_id):
    """Every document stands in the shards, byte for byte, and what is left of each sequence is padding."""
    encoding = training_order.load(training_order.vocabulary(training_order.TOKENIZER)).encoding
    data = {}
    for r in rows:
        if r["shard"] not in data:
            with open(f"{folder}/shard-{r['shard']:06d}.bin", "rb") as f:
                data[r["shard"]] = bytearray(f.read())
    found = {}
    for r in sorted(rows, key=lambda r: r["doc_offset"]):
        x = data[r["shard"]][r["byte_offset"] : r["byte_offset"] + 2 * r["n_tokens"]]
        assert zlib.crc32(x) == r["ids_crc32"]
        ids = found.setdefault(r["doc_id"], [])
        assert len(ids) == r["doc_offset"]
        ids.extend(np.frombuffer(x, np.uint16).tolist())
    for r in rows:
        data[r["shard"]][r["byte_offset"] : r["byte_offset"] + 2 * r["n_tokens"]] = np.full(r["n_tokens"], training_order.PAD, np.uint16).tobytes()
    assert all((np.frombuffer(x, np.uint16) == training_order.PAD).all() for x in data.values())
    assert found == {k: encoding.encode_ordinary(t) for k, t in texts_by_id.items() if t}
    slots = sorted({r["slot"] for r in rows})
    assert slots == list(range(len(slots)))
    assert [r["slot"] for r in sorted(rows, key=lambda r: (r["shard"], r["byte_offset"]))] == sorted(r["slot"] for r in rows)
    by_place = sorted({(int(training_order.feistel(np.array([r["sequence"]]), training_order.DOMAIN)[0]), r["slot"]) for r in rows})
    assert [s for _, s in by_place] == slots


@pytest.mark.parametrize("gathered", [16_384, 3])
def test_training_order(spark, docs, texts, tmp_path, monkeypatch, gathered):
    monkeypatch.setattr(training_order, "GATHERED", gathered)
    target = f"file://{tmp_path}/shards"
    known = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    many = known.unionByName(spark.createDataFrame([(1000 + k, prose(400 + k, 300), "", "", 0, "", "") for k in range(60)], SCHEMA))
    out = training_order.materialise(many, target, shard_bytes=20_000)
    rows = out.collect()
    assert len({r["shard"] for r in rows}) > 3
    check_shards(rows, f"{tmp_path}/shards", dict(enumerate(texts)) | {1000 + k: prose(400 + k, 300) for k in range(60)})
    counts = training_order.shard_counts(out)
    whole = list(training_order.read_slots(target, counts, 0, sum(counts)))
    assert len(whole) == sum(counts) == 1 + max(r["slot"] for r in rows)
    middle = counts[0] + counts[1] // 2  # within a shard, over the end of it
    rest = list(training_order.read_slots(target, counts, middle, counts[1]))
    assert len(rest) == counts[1] and all((x == y).all() for x, y in zip(rest, whole[middle:]))
    assert sorted(map(tuple, training_order.materialise(many, f"{target}2", shard_bytes=20_000).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_training_order_of_repeats_nulls_and_nothing(spark, docs, empty, tmp_path):
    assert training_order.materialise(empty, f"file://{tmp_path}/none").count() == 0
    rows = [(None, "a b"), (None, "a b"), (7, "a b"), (7, "a b"), (8, None), (9, "")]
    out = training_order.materialise(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/few").collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["7", "7", "None", "None"] and len({r["ids_crc32"] for r in out}) == 1


def test_tokenize_and_feistel():
    pieces = training_order.load(training_order.vocabulary(training_order.TOKENIZER))
    for t in (" a", "a ", "a  b", "a \n b", "a\nb c", " ", "a \u00a0b", "it's 12 o'clock", "\u00e9t\u00e9 \U0001f600 x"):
        assert training_order.tokenize(t, pieces) == np.array(pieces.encoding.encode_ordinary(t), np.uint16).tobytes()
    for n in (1, 2, 5, 1000):
        slots = training_order.feistel(np.arange(n), n)
        assert sorted(slots) == list(range(n)) and (training_order.feistel(slots, n, inverse=True) == np.arange(n)).all()
