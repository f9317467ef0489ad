"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact verification.

A document's set holds the hashes (64 bits) of its distinct runs of ``n`` words, A-Z lower-cased; fewer words are one
run, no words an empty set. Two documents link when ``100 * |A & B| >= percent * |A | B|``. Equal sets form one class
first, however many copies there are, and the join runs between classes:

1. Linked sets differ in at most ``(|A| + |B|) * (100 - percent) // (100 + percent)`` shingles. For each band of sizes the range
   of hashes is cut into more parts than that, so linked sets agree in a part: a tile is the content of one part within one
   band (sets that may have a smaller partner in the band below are in its tiles too). Parts hold several shingles, so
   common phrases and shared passages bring nothing together, only what is alike in most. Empty parts are no tiles; ``SPARE`` parts
   make up for as many empty ones, and sets with more of them also meet on a prefix of their shingles in the order of hashes.
2. A tile is owned by the class that comes first in it in the order of a hash of the classes' numbers (the same order in
   all tiles). Tiles with nearly the same members mostly have the same owner, so the many tiles that two near copies
   share become a few groups, without a row for any pair. Owners are classes too: in ``ROUNDS`` rounds a group joins that
   of the first owner that its own owner has a tile of, which leaves families of near copies one or two groups.
3. The members of a group, one row each with its text, meet in a task, which hashes them again: a text is half as large as its shingles. A group of over ``BLOCK_SHINGLES`` shingles is
   dealt to blocks by a hash, and each pair of blocks is a task of its own, so a task's memory is bounded. Inside, bitmaps
   of hashed shingles are held against each other: bits that one has and the other lacks are distinct missing
   shingles, so their counts bound the overlap from above. Pairs that pass are verified by exact intersection of the
   sorted shingle arrays. Where two classes meet in several groups, only the least of these decides on the pair.
4. A task tells the links of each member, and a forest of edges that connects what its links connect: never more rows
   than it got. No link escapes the bounds and the check, so components and numbers of links are those of all links.

Rows: (doc_id, n_shingles, component_id, n_copies, n_links); component_id is the least doc_id reachable, n_copies the rows
with an equal set, n_links the other rows that the row links with. Null and empty texts link with nothing and keep their
own id. Rows that repeat an id, or have none, are rows of their own: inside the module a row is known by its id and a
hash of id and text. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoweave.llm.samples import blocks
from convoweave.llm.shingles import distinct_sorted, mix, shingle_hashes
from convoweave.llm.text import WORD, free_names, row_key
from convoweave.operators.components import connected_components
from convoweave.shared import discard, stage

SHINGLE, PERCENT = 3, 90
ROUNDS = 2
BLOCK_CHARS = 400_000
#: Shingles of a block of a group; a task holds two blocks, 8 bytes a shingle.
BLOCK_SHINGLES = 2_000_000
#: Shingles that are looked up at once.
LOOKED_UP = 1_000_000
#: Sets that have more empty parts than their band has spare ones: at most this share of the band's smallest sets.
SPARE = 0.02
#: Numbers of sets that a task remembers, so that copies among its documents make tiles once.
REMEMBERED = 500_000
#: Small tables are broadcast up to this many values, else joined by shuffle.
BROADCAST_VALUES = 5_000_000


def size_bands(percent: int, largest: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each band of sizes: its largest size, its number of parts (0: only equal sets link), and its spare parts."""
    tops, parts, spare, low, top = [], [], [], 1, 1
    while low <= largest:
        apart = (top + 100 * top // percent) * (100 - percent) // (100 + percent)
        more = 0
        while apart and empty_excess((apart + 1 + more) * math.exp(-low / (apart + 1 + more)), more) > SPARE and more < apart:
            more += 1 + more // 16
        tops.append(top)
        parts.append(apart + 1 + more if apart else 0)
        spare.append(more)
        low, top = top + 1, max(top + 1, 100 * top // percent, int(top * 1.41421))
    return np.array(tops, np.int64), np.array(parts, np.uint64), np.array(spare, np.int64)


def empty_excess(mean: float, most: int) -> float:
    """Chance that a Poisson number of this mean is over ``most``."""
    if mean > 30:
        return 0.5 * math.erfc((most - mean) / math.sqrt(2 * mean))
    return 1 - math.exp(-mean) * sum(mean**k / math.factorial(k) for k in range(min(most, 150) + 1))


def set_ids(sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Two sums of hashes for each set; equal for equal sets."""
    ends = np.cumsum(sizes)
    ids = np.zeros((len(sizes), 2), np.uint64)
    for k, salt in enumerate((1, 0x5851F42D4C957F2D)):
        sums = np.r_[np.uint64(0), np.cumsum(mix(h * np.uint64(salt) + np.uint64(salt)))]
        ids[:, k] = sums[ends] - sums[ends - sizes]
    return ids


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, key, n, member, rest of every row; (member, rest) are equal for equal sets."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in blocks(batches, 5_000, BLOCK_CHARS):
            doc, h = distinct_sorted(*shingle_hashes(b["text"].tolist(), n))
            sizes = np.bincount(doc, minlength=len(b))
            ids = set_ids(sizes, h)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "key": b["key"].to_numpy(), "n": sizes, "member": ids[:, 0].astype(np.int64), "rest": ids[:, 1].astype(np.int64)})

    return docs.select("doc_id", "text", row_key().alias("key")).mapInPandas(sets, "doc_id long, key long, n long, member long, rest long")


def tile_keys(sizes: np.ndarray, doc: np.ndarray, h: np.ndarray, percent: int, bands: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(set number, tile) of all tiles of sets given by (doc, h), sorted."""
    tops, parts, spare = bands
    own = np.searchsorted(tops, sizes)
    below = np.where((own > 0) & (percent * sizes <= 100 * tops[own - 1]), own - 1, -1)
    content, starts, out = mix(h + np.uint64(0x632BE59BD9B4E019)), np.cumsum(sizes) - sizes, []
    for band in (own, below):
        used = (sizes > 0) & (band >= 0) & (parts[band] > 0)
        at = used[doc]
        d, x = doc[at], h[at]
        if not len(d):
            continue
        part = ((x >> np.uint64(32)) * parts[band[d]]) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (part[1:] != part[:-1])])
        name = mix(band[d[first]].astype(np.uint64) << np.uint64(40) | part[first])
        out.append((d[first], mix(np.add.reduceat(content[at], first) + name)))
        empty = parts[band].astype(np.int64) - np.bincount(d[first], minlength=len(sizes))
        sparse = used & (empty > spare[band])
        head = sparse[doc] & (np.arange(len(h)) - starts[doc] <= sizes[doc] - -(-percent * sizes[doc] // 100))
        out.append((doc[head], mix(h[head] + mix((band[doc[head]] + 1_000).astype(np.uint64) << np.uint64(40)))))
    return (np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def group_members(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """owner, member: the groups of sets that share tiles; a set is known by the first half of its id."""
    bands = size_bands(percent)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in blocks(batches, 5_000, BLOCK_CHARS):
            doc, h = distinct_sorted(*shingle_hashes(b["text"].tolist(), n))
            sizes = np.bincount(doc, minlength=len(b))
            ids = set_ids(sizes, h)[:, 0]
            new = np.zeros(len(b), bool)
            for k in np.flatnonzero(sizes):
                new[k] = int(ids[k]) not in seen
                seen.add(int(ids[k]))
            if len(seen) > REMEMBERED:
                seen.clear()
            held, tile = tile_keys(np.where(new, sizes, 0), doc[new[doc]], h[new[doc]], percent, bands)
            yield pd.DataFrame({"tile": tile.astype(np.int64), "member": ids[held].astype(np.int64)})

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, owner, first = None, None, False  # of the row before; first: it begins its tile
        for batch in batches:
            if not len(batch):
                continue
            t, v = batch["tile"].to_numpy(), batch["member"].to_numpy()
            same = np.r_[tile is not None and t[0] == tile, t[1:] == t[:-1]]
            begin = np.maximum.accumulate(np.where(same, -1, np.arange(len(t))))
            owners = np.where(begin < 0, -1 if owner is None else owner, v[begin])
            begins = np.flatnonzero(same[1:] & ~same[:-1])
            told_o, told_v = np.r_[owners[same], owners[begins]], np.r_[v[same], v[begins]]
            if same[0] and first:
                told_o, told_v = np.r_[told_o, owner], np.r_[told_v, owner]
            if len(told_o):
                yield pd.DataFrame({"owner": told_o, "member": told_v})
            tile, owner, first = t[-1], owners[-1], not same[-1]

    tiles = docs.select("text").mapInPandas(keys, "tile long, member long")
    dealt = tiles.repartition("tile").sortWithinPartitions("tile", F.xxhash64("member"), "member")
    return dealt.mapInPandas(own, "owner long, member long").distinct()


def merged_groups(members: DataFrame) -> DataFrame:
    """The same members with fewer owners: each group joins that of the first owner of its own owner."""
    place = F.struct(F.xxhash64("owner"), "owner")
    first = members.groupBy(F.col("member").alias("owner")).agg(F.min(place).alias("first")).select("owner", F.col("first.owner").alias("first"))
    return members.join(first, "owner").select(F.col("first").alias("owner"), "member").distinct()


def small(df: DataFrame, values: Column) -> DataFrame:
    """Broadcast if its rows hold few ``values`` in all."""
    return F.broadcast(df) if (df.agg(F.sum(values)).first()[0] or 0) <= BROADCAST_VALUES else df


def deals(members: DataFrame, sets: DataFrame) -> DataFrame:
    """vid, n_copies, owner, low, high, block, earlier, id, key, n_rows: the tasks that a class goes to; staged.

    (low, high) are the pair of blocks held against each other, ``block`` is the class's own, ``earlier`` are the
    owners of its groups below ``owner``; (id, key) is the class's document, which ``n_rows`` rows repeat.
    """
    left = stage(members.join(sets.select("member", "vid", "n", "n_copies"), "member").drop("member"), "join-members")
    groups = left.groupBy("owner").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
    groups = groups.select("owner", F.ceil(F.col("shingles") / BLOCK_SHINGLES).alias("blocks"))
    kept = stage(left.join(groups, "owner"), "join-groups")
    discard(left)
    owners = kept.groupBy("vid").agg(F.collect_list("owner").alias("owners"))
    block = F.pmod(F.xxhash64("vid"), F.col("blocks"))
    tasks = kept.join(owners, "vid").select(
        "vid", "n_copies", "owner", block.alias("block"), F.filter("owners", lambda x: x < F.col("owner")).alias("earlier"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    )
    dealt = tasks.select("vid", "n_copies", "owner", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "earlier")
    of_class = sets.select("vid", F.col("doc.doc_id").alias("id"), F.col("doc.key").alias("key"), "n_rows")
    dealt = stage(dealt.join(of_class, "vid"), "join-deals")
    discard(kept)
    return dealt


def dealt_texts(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """``tasks`` with the text of each class, that of its one document; of rows that repeat both id and text only one is taken."""
    texts = docs.select("doc_id", "text", row_key().alias("key"))

    def of(wanted: DataFrame) -> DataFrame:
        return texts.join(small(wanted, F.size("earlier") + 9), "key").where(F.col("doc_id").eqNullSafe(F.col("id"))).select("vid", "n_copies", "owner", "low", "high", "block", "earlier", "text")

    rows, repeated = of(tasks.where("n_rows = 1")), tasks.where("n_rows > 1")
    if repeated.head(1):
        rows = rows.unionByName(of(repeated).groupBy("vid", "owner", "low", "high").agg(*[F.first(c).alias(c) for c in ("n_copies", "block", "earlier", "text")]))
    return rows


def bitmaps(sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A row of bits for each set, 4 to 8 for each shingle of the largest."""
    width = 64 << max(0, int(4 * sizes.max() - 1).bit_length() - 6)
    bits = np.zeros((len(sizes), width // 8), np.uint8)
    at = (h & np.uint64(width - 1)).astype(np.int64)
    np.bitwise_or.at(bits, (np.repeat(np.arange(len(sizes)), sizes), at >> 3), np.uint8(1) << (at & 7).astype(np.uint8))
    return bits.view(np.uint64)


def shared_counts(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted array with others."""
    out, start = np.zeros(len(others), np.int64), 0
    ends = np.cumsum([len(x) for x in others])
    while start < len(others):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + LOOKED_UP, side="right")))
        part = others[start:stop]
        all_of = np.concatenate(part)
        at = np.searchsorted(one, all_of)
        at[at == len(one)] = 0
        out[start:stop] = np.add.reduceat((one[at] == all_of).astype(np.int64), np.r_[0, np.cumsum([len(x) for x in part])[:-1]])
        start = stop
    return out


def resolve(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of a task's members (a, links) and edges (a, b) that connect what the links connect."""
    arrays = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
    sizes = np.array([len(x) for x in arrays], np.int64)
    order = np.argsort(sizes, kind="stable")
    arrays, sizes = [arrays[k] for k in order], sizes[order]
    vid, copies, block = (group[c].to_numpy()[order] for c in ("vid", "n_copies", "block"))
    across = group["low"].iloc[0] != group["high"].iloc[0]
    earlier = [group["earlier"].iloc[k] for k in order]
    listed = {o: k for k, o in enumerate(sorted({o for x in earlier for o in x}))}
    met_before = np.zeros((len(arrays), len(listed)), bool)
    for k, x in enumerate(earlier):
        met_before[k, [listed[o] for o in x]] = True
    bits, reach = bitmaps(sizes, np.concatenate(arrays)), np.searchsorted(percent * sizes, 100 * sizes, side="right")
    component, links, edges = np.arange(len(arrays)), np.zeros(len(arrays), np.int64), []
    for k in range(len(arrays) - 1):
        later = np.arange(k + 1, reach[k])
        if across:
            later = later[block[later] != block[k]]
        if met_before[k].any():
            later = later[~met_before[np.ix_(later, met_before[k])].any(1)]
        if not len(later):
            continue
        most = np.minimum(sizes[k] - np.bitwise_count(bits[k] & ~bits[later]).sum(1, np.int64), sizes[later] - np.bitwise_count(bits[later] & ~bits[k]).sum(1, np.int64))
        later = later[100 * most >= percent * (sizes[k] + sizes[later] - most)]
        if not len(later):
            continue
        shared = shared_counts(arrays[k], [arrays[j] for j in later])
        linked = later[100 * shared >= percent * (sizes[k] + sizes[later] - shared)]
        if not len(linked):
            continue
        links[k] += copies[linked].sum()
        links[linked] += copies[k]
        roots, one_of = np.unique(component[linked], return_index=True)
        new = roots != component[k]
        edges += [(vid[k], vid[j]) for j in linked[one_of[new]]]
        component[np.isin(component, roots[new])] = component[k]
    told = np.flatnonzero(links)
    a, b = zip(*edges) if edges else ((), ())
    nothing = [None] * len(told)
    return pd.DataFrame({"a": np.r_[vid[told], np.array(a, np.int64)].astype(np.int64), "b": pd.array(nothing + list(b), "Int64"), "links": pd.array([*links[told].tolist(), *[None] * len(a)], "Int64")})


def class_links(docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, null, links) for every class with links to others, and edges (a, b, null) that connect them."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, name = [], None
        for batch in blocks(batches, 2_000, BLOCK_CHARS):
            doc, h = distinct_sorted(*shingle_hashes(batch["text"].tolist(), n))
            ends = np.cumsum(np.bincount(doc, minlength=len(batch)))
            batch = batch.drop(columns="text").assign(shingles=[h[i:j].tobytes() for i, j in zip(np.r_[0, ends[:-1]], ends, strict=True)])
            names = batch[["owner", "low", "high"]].to_numpy()
            starts = np.r_[0, np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1]
            for i, j in zip(starts, [*starts[1:], len(batch)], strict=True):
                if name != tuple(names[i]):
                    if sum(map(len, kept)) > 1:
                        yield resolve(pd.concat(kept), percent)
                    kept, name = [], tuple(names[i])
                kept.append(batch.iloc[i:j])
        if sum(map(len, kept)) > 1:
            yield resolve(pd.concat(kept), percent)

    members = stage(group_members(docs, n, percent), "join-tiles")
    for _ in range(ROUNDS):
        members, before = stage(merged_groups(members), "join-merged"), members
        discard(before)
    tasks = deals(members, sets)
    discard(members)
    dealt = dealt_texts(docs, tasks).repartition("owner", "low", "high").sortWithinPartitions("owner", "low", "high")
    links = stage(dealt.mapInPandas(search, "a long, b long, links long"), "join-links")
    discard(tasks)
    return links


def row_components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """row, n_shingles, component (its least row), n_copies, n_links of every row; a row is (no_id, doc_id, key), so null ids come last."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    rows = stage(document_sets(docs, n).select(row.alias("row"), F.col("n").alias("n_shingles"), "member", "rest"), "join-rows")
    each = rows.where("n_shingles > 0").groupBy("member", "rest", F.col("n_shingles").alias("n"), "row").agg(F.count("*").alias("n_rows"))
    classes = each.groupBy("member", "rest", "n").agg(F.min("row").alias("doc"), F.sum("n_rows").alias("n_copies"), F.min_by("n_rows", "row").alias("n_rows"))
    sets = stage(classes.withColumn("vid", F.monotonically_increasing_id()), "join-classes")
    found = class_links(docs, sets, n, percent)
    comps = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("v", "vid")
    links = found.where("b is null").groupBy(F.col("a").alias("vid")).agg(F.sum("links").alias("links"))

    of_set = sets.select("vid", "member", "rest", "n", "doc", "n_copies").join(comps, "vid", "left").join(links, "vid", "left")
    of_set = of_set.select("member", "rest", F.col("n").alias("n_shingles"), "doc", "n_copies", F.coalesce("root", "vid").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    least = of_set.groupBy("comp").agg(F.min("doc").alias("component"))
    named = of_set.join(least, "comp").select("member", "rest", "n_shingles", "component", "n_copies", "n_links")
    linked = rows.where("n_shingles > 0").join(named, ["member", "rest", "n_shingles"]).select("row", "n_shingles", "component", "n_copies", "n_links")
    alone = rows.where("n_shingles = 0").select("row", "n_shingles", F.col("row").alias("component"), F.lit(1).cast("bigint").alias("n_copies"), F.lit(0).cast("bigint").alias("n_links"))
    return linked.unionByName(alone)


def join_components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies, n_links of every row."""
    return row_components(docs, n, percent).select(F.col("row.doc_id").alias("doc_id"), "n_shingles", F.col("component.doc_id").alias("component_id"), "n_copies", "n_links")


def keep_one(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component: that of the least id, of a null id only if there is no other.

    Rows are told apart by id and text, so rows that repeat an id, or have none, stay unless they are copies; of rows
    that are equal in both, the least by all columns as JSON stays. Rows without words are copies of nothing and all stay. All columns of ``docs`` are
    kept, whatever their names; an empty table gives an empty one.
    """
    key, id_, least_key, one, times = free_names(docs, "key", "id", "least", "one", "times")
    stay = row_components(docs, n, percent).where("n_shingles > 0 and row = component")
    least = stage(stay.groupBy(F.col("row.doc_id").alias(id_), F.col("row.key").alias(least_key)).agg(F.count("*").alias(times)), "join-least")
    has_words = F.coalesce("text", F.lit("")).rlike(WORD)
    worded = docs.where(has_words).withColumn(key, row_key())

    def of(those: DataFrame) -> DataFrame:
        return worded.join(small(those, F.lit(2)), (F.col(key) == F.col(least_key)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi")

    kept, repeated = of(least.where(F.col(times) == 1)).select(*docs.columns), least.where(F.col(times) > 1)
    if repeated.head(1):  # only these are brought together
        whole = F.struct(*docs.columns)
        others = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))
        first = of(repeated).groupBy("doc_id", key).agg(F.min_by(whole, others).alias(one)).select(f"{one}.*")
        kept = kept.unionByName(first.select(*docs.columns))
    return kept.unionByName(docs.where(~has_words))


def query(spark, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "n_copies", "n_links")


SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT a, b, c = x.n AND c = y.n AS same FROM shared JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT reach.a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, 1 + (SELECT count(*) FROM links WHERE a = d.r AND same) AS n_copies, (SELECT count(*) FROM links WHERE a = d.r) AS n_links
FROM d LEFT JOIN n USING (r) JOIN least USING (r)
"""
