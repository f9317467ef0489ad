"""Training-order materialisation: token sequences in a keyed random order, in shards of fixed stride.

Documents are tokenised with a public byte-level vocabulary (its path is a parameter). The documents of an input partition
stand end to end, each followed by one ``PAD`` id, and are cut into sequences of ``SEQUENCE`` ids; only the last sequence of
a partition is padded. A sequence is known by ``partition * PART_SEQUENCES + its number in the partition``. A keyed Feistel
network over the next even power of two, walked along its cycle until it falls below ``DOMAIN``, permutes these numbers;
anybody with the key can evaluate or invert it, and it does not change when other partitions are added. The order of
the permuted numbers is the training order: a sequence's global slot is the number of sequences before it.

Shards are equal ranges of the permuted numbers. Each is written by one task as little-endian 16-bit ids, the sequence
of slot ``k`` in it at byte ``k * STRIDE``; the slots of a shard follow those of the shard before. So ids are exchanged
once (compressed, in blocks of a shard) and need no table of their own, and a reader resumes at any slot by seeking
(``read_slots``). A shard is written under another name and renamed when whole, so a repeated task does no harm.

Rows of the result, one for each stretch of a document in a sequence: doc_id, sequence, slot, shard, byte_offset (of the
stretch in the shard's file), doc_offset (ids of the document before it), n_tokens, ids_crc32. Null and empty texts have
no sequences. Rows that repeat an id are written each. Extra columns are ignored. An empty table gives no shard and no row.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoweave.llm.samples import blocks
from convoweave.shared import stage, staging_path

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that goes with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PAD = 50_256
SEQUENCE, KEY, ROUNDS = 512, 0x1F2E3D4C5B6A7988, 6
STRIDE = 2 * SEQUENCE
#: Sequences of a partition and partitions that the permuted numbers have room for.
PART_SEQUENCES, PARTS = 1 << 36, 10_000_000
DOMAIN = PART_SEQUENCES * PARTS
#: Bytes of text that a shard is made from; the task that writes it holds its ids.
SHARD_BYTES = 32 << 20
#: Sequences that a tokenising task gathers before it deals them to shards.
GATHERED = 16_384
CACHED_PIECES = 200_000


class UnevenBlanks(Exception):
    """A blank that does not just precede one word."""


class Pieces(dict):
    """' word' -> its ids as bytes. A single blank before a non-blank always starts a new piece, so pieces are independent.

    Two generations of ``CACHED_PIECES`` are kept: rare words leave, frequent ones come back from the older one.
    """

    def __init__(self, encoding):
        super().__init__()
        self.encoding = encoding
        self.older: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), np.uint16).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace():
            raise UnevenBlanks
        if len(self) >= CACHED_PIECES:
            self.older = dict(self)
            self.clear()
        out = self.older.get(piece)
        out = self[piece] = self.ids(" " + piece) if out is None else out
        return out


def vocabulary(path: str) -> bytes:
    """The vocabulary file, read on the driver: under 2 MB."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_stream(name) as f:
        return f.read()


def load(lines: bytes) -> Pieces:
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    return Pieces(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))


def tokenize(text: str, pieces: Pieces) -> bytes:
    first, *rest = text.split(" ")
    try:
        return pieces.ids(first) + b"".join(map(pieces.__getitem__, rest))
    except UnevenBlanks:
        return pieces.ids(text)


def feistel(index: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The slot of each index (or the index of each slot): a keyed permutation of 0 to n-1."""
    half = np.uint64(max(1, -(-int(max(n - 1, 1)).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)

    def turn(x: np.ndarray, r: int) -> np.ndarray:
        x = (x + np.uint64((key * (2 * r + 1)) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)) & mask

    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        left, right = out[todo] >> half, out[todo] & mask
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ turn(left, r), left
            else:
                left, right = right, left ^ turn(right, r)
        out[todo] = left << half | right
        todo[todo] = out[todo] >= n
    return out.astype(np.int64)


class Stream:
    """The ids of a partition's documents end to end, handed out as whole sequences."""

    def __init__(self, part: int, shards: int, key: int):
        self.first, self.width, self.key = part * PART_SEQUENCES, -(-DOMAIN // shards), key
        self.ids: list[bytes] = []
        self.docs: list[tuple[int, bool, int, int]] = []  # id, no id, begin, end, counted from the first id held
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None, self.size, self.size + len(ids) // 2))
        self.ids += [ids, np.uint16(PAD).tobytes()]
        self.size += len(ids) // 2 + 1

    def take(self, last: bool) -> pd.DataFrame:
        """A row for each shard that has any of the whole sequences; the rest waits, or is padded if it is the last."""
        data = b"".join(self.ids)
        if last and self.docs:
            data += np.uint16(PAD).tobytes() * (-self.size % SEQUENCE)
        n = len(data) // STRIDE
        doc, none, begin, end = (np.array(x, np.int64) for x in (zip(*self.docs) if self.docs else ((), (), (), ())))
        low, high = np.maximum(begin, 0), np.minimum(end, n * SEQUENCE)
        pieces = np.where(low < high, (high - 1) // SEQUENCE - low // SEQUENCE + 1, 0)
        of = np.repeat(np.arange(len(doc)), pieces)
        sequence = (low // SEQUENCE)[of] + np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, stop = np.maximum(low[of], sequence * SEQUENCE), np.minimum(high[of], (sequence + 1) * SEQUENCE)
        if last and len(of):
            n = int(sequence[-1]) + 1  # no sequence that holds nothing but padding
        names = [x.split()[0] for x in BLOCK.split(", ")]
        if not n:
            return pd.DataFrame([], columns=names)
        grid = np.frombuffer(data[: n * STRIDE], np.uint16).reshape(n, SEQUENCE)
        index = self.first + np.arange(n)
        place = feistel(index, DOMAIN, self.key)
        shard = place // self.width
        press, rows = zstandard.ZstdCompressor(level=1), []
        order, by_shard = np.argsort(shard, kind="stable"), np.argsort(shard[sequence], kind="stable")
        shards, cuts = np.unique(shard[order], return_index=True)
        piece_cuts = np.searchsorted(shard[sequence][by_shard], shards)
        counts = np.bincount(sequence, minlength=n)
        for k, own, p in zip(shards, np.split(order, cuts[1:]), np.split(by_shard, piece_cuts[1:]), strict=True):
            rows.append((
                k, index[own], place[own], press.compress(grid[own].tobytes()), counts[own], doc[of[p]], none[of[p]] > 0,
                (start - sequence * SEQUENCE)[p], (start - begin[of])[p], (stop - start)[p],
            ))
        self.first, self.size, self.ids = self.first + n, self.size - n * SEQUENCE, [data[n * STRIDE :]]
        self.docs = [(d, x, i - n * SEQUENCE, j - n * SEQUENCE) for d, x, i, j in self.docs if j > n * SEQUENCE]
        return pd.DataFrame(rows, columns=names)


BLOCK = "shard int, sequence array<long>, place array<long>, ids binary, pieces array<long>, doc array<long>, no_id array<boolean>, at array<long>, doc_offset array<long>, n_tokens array<long>"
MANIFEST = "doc_id long, sequence long, shard int, shard_slot long, byte_offset long, doc_offset long, n_tokens long, ids_crc32 long"


def write_shard(rows: pd.DataFrame, target: str) -> pd.DataFrame:
    """Writes the file of a shard from all its blocks; returns its stretches."""
    from pyarrow import fs

    shard, unpress = int(rows["shard"].iloc[0]), zstandard.ZstdDecompressor()
    grid = np.concatenate([np.frombuffer(unpress.decompress(x), np.uint16) for x in rows["ids"]]).reshape(-1, SEQUENCE)
    sequence, place, pieces, doc, none, at, doc_offset, n = (np.concatenate(list(rows[c])) for c in ("sequence", "place", "pieces", "doc", "no_id", "at", "doc_offset", "n_tokens"))
    order = np.argsort(place)
    slot = np.empty(len(order), np.int64)
    slot[order] = np.arange(len(order))
    system, folder = fs.FileSystem.from_uri(target)
    system.create_dir(folder, recursive=True)
    partial = f"{folder}/.shard-{shard:06d}-{TaskContext.get().taskAttemptId()}"
    with system.open_output_stream(partial) as out:
        out.write(grid[order].tobytes())
    system.move(partial, f"{folder}/shard-{shard:06d}.bin")
    of = np.repeat(np.arange(len(sequence)), pieces)
    data = grid.tobytes()
    starts = of * STRIDE + 2 * at
    crc = [zlib.crc32(data[i:j]) for i, j in zip(starts.tolist(), (starts + 2 * n).tolist(), strict=True)]
    doc_id = pd.arrays.IntegerArray(doc, none.astype(bool))
    return pd.DataFrame({"doc_id": doc_id, "sequence": sequence[of], "shard": shard, "shard_slot": slot[of], "byte_offset": slot[of] * STRIDE + 2 * at, "doc_offset": doc_offset, "n_tokens": n, "ids_crc32": crc})


def materialise(docs: DataFrame, target: str, tokenizer: str = TOKENIZER, key: int = KEY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards to the folder ``target`` (a URI all executors reach) and returns a row for each stretch."""
    lines = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, stream = load(lines.value), Stream(TaskContext.get().partitionId(), shards, key)
        for b in blocks(batches, 2_000, 2_000_000):
            for doc, text in zip(b["doc_id"].astype("Int64").to_numpy(object, na_value=None), b["text"], strict=True):
                if text:
                    stream.add(doc, tokenize(text, pieces))
            if stream.size >= GATHERED * SEQUENCE:
                yield stream.take(False)
        yield stream.take(True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame(columns=["shard"]), *batches])
        for _, own in rows.groupby("shard"):
            yield write_shard(own, target)

    dealt = docs.select("doc_id", "text").mapInPandas(encode, BLOCK).repartitionById(shards, "shard")
    written = stage(dealt.mapInPandas(write, MANIFEST), "shard-manifest")
    counts = written.groupBy("shard").agg((F.max("shard_slot") + 1).alias("n"))  # a row for each shard
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = F.broadcast(counts.select("shard", before.alias("first")))
    return written.join(firsts, "shard").select(
        "doc_id", "sequence", (F.col("first") + F.col("shard_slot")).alias("slot"), F.col("shard").cast("long").alias("shard"), "byte_offset", "doc_offset", "n_tokens", "ids_crc32"
    )


def shard_counts(manifest: DataFrame) -> list[int]:
    """Sequences of each shard from 0, a number for each: what a reader needs to find a slot."""
    rows = manifest.groupBy("shard").agg(F.count_distinct("slot").alias("n")).collect()
    known = {r["shard"]: r["n"] for r in rows}
    return [known.get(k, 0) for k in range(max(known, default=-1) + 1)]


def read_slots(target: str, counts: list[int], first: int, n: int) -> Iterator[np.ndarray]:
    """The sequences of ``n`` slots from ``first``, in order, shard after shard."""
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(target)
    for shard, size in enumerate(counts):
        if first < size and n > 0:
            with system.open_input_file(f"{folder}/shard-{shard:06d}.bin") as f:
                f.seek(first * STRIDE)
                some = min(n, size - first)
                yield from np.frombuffer(f.read(some * STRIDE), np.uint16).reshape(some, SEQUENCE)
            first, n = size, n - some
        first = max(0, first - size)


def query(spark, sf_dir: str) -> DataFrame:
    return materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"), staging_path(spark, "training-shards"))
