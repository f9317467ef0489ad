"""Extractive summaries of groups of messages: a week's, a month's, a topic's.

Sentences of a group form a graph: two sentences are as similar as their word sets, words weighed by rarity in the group
(cosine). Sentences are ranked by a random walk over that graph. The graph's edges are never made: a step goes from sentences to
their words and from words back to sentences, less what returns to the sentence itself, which is the same sum, so a step costs a
number for each word of a sentence and not one for each pair of sentences that share a word. Sentences are exchanged once; groups
of up to ``BLOCK`` words walk inside a task, larger ones in blocks that exchange sums by word. Words are known by 64-bit hashes.

The summary takes sentences by rank, skips those that share half of their words or more with one taken, and those that would
exceed the budget of words, and gives them in the order of the conversations. Sentences with equal word sets are one from the
start, the first of them. For each group the best ``CANDIDATES`` sentences are considered, so no task sees a whole group.

Frames: ``sentences`` (group, conv_id, turn, place, sentence). Messages without words have no sentences; a group without any has no summary.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoweave.functions.cleaning import words
from convoweave.operators.graph import topk
from convoweave.shared import discard, stage

# The longest summary.
MOST_WORDS = 500
SHARE, ROUNDS, ALPHA, CANDIDATES, LEAST_WORDS = 0.5, 10, 0.85, 400, 4
SENTENCE = r"[^.!?\n]+[.!?]*"
ORDER = ("conv_id", "turn", "place")
#: Words of sentences that a task holds: of a group or a block of it; of small groups together. A sentence of no more degree shares no word.
BLOCK, BUCKET, LONE = 4_000_000, 500_000, 1e-9


def sentences(messages: DataFrame, *group: str) -> DataFrame:
    """(*group, conv_id, turn, place, sentence) of (*group, conv_id, turn, text); short ones of under four words are left out."""
    found = messages.select(*group, "conv_id", "turn", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SENTENCE), F.lit(0))).alias("place", "sentence"))
    return found.withColumn("sentence", F.trim("sentence")).where(F.size(words(F.col("sentence"))) >= LEAST_WORDS)


def distinct_sentences(found: DataFrame, group: str) -> DataFrame:
    """(group, conv_id, turn, place, sentence, set, times): the first sentence of each word set of a group, and how often it comes."""
    sets = found.withColumn("set", _set())
    first = F.min(F.struct(*ORDER, "sentence")).alias("x")
    return sets.groupBy(group, "set").agg(first, F.count("*").alias("times")).select(group, "x.*", "set", "times")


def ranked(found: DataFrame, group: str, rounds: int = ROUNDS, alpha: float = ALPHA) -> DataFrame:
    """(group, conv_id, turn, place, sentence, set, rank) of distinct sentences; ranks of a group sum up to 1.

    Equal sentences weigh as often as they come when the walk starts anew.
    """
    return _ranked(found, group, rounds, alpha).select(group, *ORDER, "sentence", _set().alias("set"), "rank")


def _set() -> Column:
    return F.array_sort(F.array_distinct(words(F.col("sentence"))))


def _ranked(found: DataFrame, group: str, rounds: int, alpha: float) -> DataFrame:
    """``ranked`` without the sets: small groups walk whole, several in a task, large ones block by block."""
    sets = distinct_sentences(found, group).where(F.col(group).isNotNull())
    base = stage(sets.select(group, *ORDER, "sentence", "times", F.size("set").alias("n_words")).withColumn("row", F.monotonically_increasing_id()), "sentences")
    sizes = base.groupBy(group).agg(F.count("*").alias("n"), F.sum("times").alias("all"), F.sum("n_words").alias("entries"))
    sizes = stage(sizes.withColumn("blocks", F.ceil(F.greatest("entries", F.lit(1)) / BLOCK).cast("int")), "sentence-groups")
    small, large = sizes.agg(F.sum(F.when(F.col("blocks") == 1, F.col("entries"))), F.max("blocks")).first()
    rows = base.select(group, "row", "times", F.transform(_set(), lambda w: F.xxhash64(F.col(group), w)).alias("words")).join(sizes.drop("entries"), group)
    bucket = F.pmod(F.xxhash64(group), F.lit((small or 0) // BUCKET + 1)).alias("bucket")
    ranks = rows.where("blocks = 1").select(bucket, group, "row", "times", "words").groupBy("bucket").applyInArrow(_walker(group, rounds, alpha), "row bigint, rank double")
    if (large or 0) > 1:
        ranks = ranks.unionByName(_in_blocks(rows.where("blocks > 1"), group, rounds, alpha))
    return base.join(ranks, "row").select(group, *ORDER, "sentence", "rank")


class Words:
    """The words of some sentences as a sparse matrix: entry e is word ``at[e]`` of sentence ``row[e]``."""

    def __init__(self, at: np.ndarray, sizes: np.ndarray, n_words: int):
        self.at, self.n, self.n_words = at, len(sizes), n_words
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)

    def weigh(self, idf: np.ndarray) -> None:
        """``idf`` of each word; sentences get length 1."""
        w = idf[self.at]
        self.b = w / np.sqrt(np.bincount(self.row, w * w, self.n))[self.row]

    def sums(self, give: np.ndarray) -> np.ndarray:
        """What the words get when sentences give."""
        return np.bincount(self.at, self.b * give[self.row], self.n_words)

    def back(self, sums: np.ndarray, give: np.ndarray) -> np.ndarray:
        """What sentences get from the words, but for what they gave themselves."""
        return np.bincount(self.row, self.b * (sums[self.at] - self.b * give[self.row]), self.n)


def _gives(rank: np.ndarray, degree: np.ndarray) -> np.ndarray:
    return np.divide(rank, degree, out=np.zeros(len(rank)), where=degree > LONE)


def _next(start: np.ndarray, lost: np.ndarray | float, got: np.ndarray, degree: np.ndarray, alpha: float) -> np.ndarray:
    return (1 - alpha + alpha * lost) * start + alpha * np.where(degree > LONE, got, 0.0)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def _listed(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and each one's length."""
    whole = column.combine_chunks()
    whole = whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)
    return whole.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(whole).to_numpy(zero_copy_only=False)


def _walker(group: str, rounds: int, alpha: float) -> Callable[[pa.Table], pa.Table]:
    """The whole walk over some groups; a word's hash contains its group."""

    def walk(table: pa.Table) -> pa.Table:
        of = _numbers(pc.rank(table[group].combine_chunks(), tiebreaker="dense")).astype(np.int64) - 1
        hashes, sizes = _listed(table["words"])
        found, at = np.unique(hashes, return_inverse=True)
        m, times = Words(at.astype(np.int32), sizes, len(found)), _numbers(table["times"])
        first = np.zeros(len(found), np.int64)
        first[m.at] = of[m.row]
        m.weigh(np.log(1 + np.bincount(of)[first] / np.bincount(m.at, minlength=len(found))))
        one = np.ones(m.n)
        degree, start = m.back(m.sums(one), one), times / np.bincount(of, times)[of]
        rank = start
        for _ in range(rounds):
            give, lost = _gives(rank, degree), np.bincount(of, np.where(degree > LONE, 0.0, rank))[of]
            rank = _next(start, lost, m.back(m.sums(give), give), degree, alpha)
        return pa.table({"row": table["row"], "rank": pa.array(rank)})

    return walk


def _in_blocks(rows: DataFrame, group: str, rounds: int, alpha: float) -> DataFrame:
    """(row, rank) of groups in blocks: in a round blocks exchange a number for each of their words, none for each of a sentence.

    ``words`` are a block's hashes in order. First words are counted, then degrees made, then the rounds walked.
    """
    key, of_group = [group, "block"], f"{group} {rows.schema[group].dataType.simpleString()}, block int"
    one = lambda table, c: _listed(table[c])[0]

    def lists(table: pa.Table, **values: object) -> pa.Table:
        made = {c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) if isinstance(v, np.ndarray) else pa.array([v]) for c, v in values.items()}
        return pa.table({c: table[c].slice(0, 1) for c in key} | made)

    def pack(table: pa.Table) -> pa.Table:
        hashes, sizes = _listed(table["words"])
        found, at = np.unique(hashes, return_inverse=True)
        whole = {c: table[c][0].as_py() for c in ("n", "all")}
        return lists(table, **whole, words=found, at=at.astype(np.int32), sizes=sizes.astype(np.int32), row=_numbers(table["row"]), times=_numbers(table["times"]))

    def turn(k: int) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            m, sums = Words(one(table, "at"), one(table, "sizes"), len(one(table, "words"))), one(table, "sums")
            start = one(table, "times") / table["all"][0].as_py()
            idf = np.log(1 + table["n"][0].as_py() / sums) if k == 0 else one(table, "idf")
            m.weigh(idf)
            rank, degree, give = start, np.zeros(0), np.ones(m.n)
            if k == 1:
                degree = m.back(sums, give)
            elif k > 1:
                rank, degree = one(table, "rank"), one(table, "degree")
                rank = _next(start, table["lost"][0].as_py(), m.back(sums, _gives(rank, degree)), degree, alpha)
            if k:
                give = _gives(rank, degree)
            lost = float(rank[degree <= LONE].sum()) if k else 0.0
            return lists(table, words=one(table, "words"), part=m.sums(give), idf=idf, degree=degree, rank=rank, lost=lost)

        return run

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    packed = dealt.select(*key, "row", "times", "words", "n", "all").groupBy(*key).applyInArrow(
        pack, f"{of_group}, n bigint, all bigint, words array<bigint>, at array<int>, sizes array<int>, row array<bigint>, times array<bigint>"
    )
    packed = stage(packed, "sentence-blocks")
    counts = dealt.select(*key, F.explode("words").alias("word")).groupBy(*key, "word").agg(F.count("*").cast("double").alias("part"))
    state = None
    for k in range(rounds + 2):
        flat = counts if state is None else state.select(*key, F.explode(F.arrays_zip("words", "part")).alias("x")).select(*key, F.col("x.words").alias("word"), "x.part")
        every = flat.withColumn("sum", F.sum("part").over(Window.partitionBy(group, "word")))
        sums = every.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("word", "sum")))["sum"].alias("sums"))
        held = packed.join(sums, key)
        if state is not None:
            held = held.join(state.select(*key, "idf", "degree", "rank"), key).join(state.groupBy(group).agg(F.sum("lost").alias("lost")), group)
        new = held.groupBy(*key).applyInArrow(turn(k), f"{of_group}, words array<bigint>, part array<double>, idf array<double>, degree array<double>, rank array<double>, lost double")
        state, old = stage(new, "sentence-ranks"), state
        if old is not None:
            discard(old)
    return packed.join(state.select(*key, "rank"), key).select(F.explode(F.arrays_zip("row", "rank")).alias("x")).select("x.*")


def chosen(best: Column, most_words: int = MOST_WORDS, share: float = SHARE) -> Column:
    """The sentences taken of an array of (conv_id, turn, place, sentence, set, n), in the order they are offered."""

    def step(state: Column, x: Column) -> Column:
        alike = F.exists(state["taken"], lambda t: F.size(F.array_intersect(t["set"], x["set"])) >= share * F.size(F.array_union(t["set"], x["set"])))
        fits = (state["used"] + x["n"] <= most_words) & ~alike
        return F.struct(F.when(fits, F.concat(state["taken"], F.array(x))).otherwise(state["taken"]).alias("taken"), (state["used"] + F.when(fits, x["n"]).otherwise(0)).cast("int").alias("used"))

    none = F.filter(best, lambda _: F.lit(False))
    return F.aggregate(best, F.struct(none.alias("taken"), F.lit(0).alias("used")), step)["taken"]


def summaries(found: DataFrame, group: str, most_words: int = MOST_WORDS, candidates: int = CANDIDATES, rounds: int = ROUNDS) -> DataFrame:
    """(group, summary, n_sentences, n_words) of each group of sentences. Ranks that agree to nine digits tie and go by place."""
    order = [F.desc("score"), *(F.col(c) for c in ORDER)]
    scored = _ranked(found, group, rounds, ALPHA).withColumn("score", F.round("rank", 9)).withColumn("n", F.size(F.split("sentence", r"\s+")))
    top = topk(scored, [group], order, candidates, "nth").withColumn("set", _set())
    offered = F.transform(F.array_sort(F.collect_list(F.struct("nth", *ORDER, "sentence", "set", "n"))), lambda x: x.dropFields("nth"))
    taken = top.groupBy(group).agg(offered.alias("best")).select(group, F.array_sort(chosen(F.col("best"), most_words)).alias("taken"))
    return taken.select(group, F.array_join(F.transform("taken", lambda x: x["sentence"]), " ").alias("summary"), F.size("taken").alias("n_sentences"), F.aggregate("taken", F.lit(0), lambda a, x: a + x["n"]).alias("n_words"))


def digest_lines(made: DataFrame, lists: DataFrame, group: str, actions: bool = True, decisions: bool = True) -> DataFrame:
    """(group, section, place, line) of the summaries' pages; ``lists``: (group, conv_id, kind, place, item), kinds action and decision."""
    out = made.select(group, F.lit(0).alias("section"), F.lit(None).cast("struct<conv_id:bigint,place:bigint>").alias("place"), F.concat(F.lit("# "), F.col(group).cast("string"), F.lit("\n")).alias("line"))
    out = out.unionByName(made.select(group, F.lit(1).alias("section"), F.lit(None).cast("struct<conv_id:bigint,place:bigint>").alias("place"), F.concat("summary", F.lit("\n")).alias("line")))
    for section, kind, heading, mark, wanted in ((2, "decision", "## Key Decisions\n", "- ", decisions), (4, "action", "## Action Items\n", "- [ ] ", actions)):
        if wanted:
            held = lists.where(F.col("kind") == kind).join(made.select(group), group, "left_semi")
            head = held.select(group).distinct().select(group, F.lit(section).alias("section"), F.lit(None).cast("struct<conv_id:bigint,place:bigint>").alias("place"), F.lit(heading).alias("line"))
            out = out.unionByName(head).unionByName(held.select(group, F.lit(section + 1).alias("section"), F.struct("conv_id", "place").alias("place"), F.concat(F.lit(mark), "item").alias("line")))
    return out
