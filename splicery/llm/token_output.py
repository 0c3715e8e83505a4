"""Token ids in patched frame-of-reference files.

Texts are range-partitioned and sorted by key, so that files follow in key order. Each task encodes its
texts, PIECE characters at once, and cuts its ids into segments of SEGMENT ids or more, at document ends. A segment holds, in order:

    "SPF1", then as little-endian uint32: documents, ids, blocks
    length of each document, uint32
    start of each block in the block area, uint32 (the block index)
    the block area: for each block of 256 ids its minimum (uint32), width in bits (uint8), number of
    exceptions (uint16), the packed low bits, then the exceptions' positions (uint8) and high parts (uint32)

A block's width is that of the 90th percentile of its ids less the minimum; larger ids keep their low bits
in place and put the rest into the exception list. Segments are rows of a Parquet table in the shared folder,
with the keys of their documents beside them: any store that Spark writes to will do, and Spark's commit
protocol drops the files of a lost executor.

Encoding uses the tokenizers library. Its pre-tokeniser always cuts before a space between two non-spaces, so
each distinct word is encoded once per worker, many joined in one call; texts with longer runs of white space
are encoded directly.

Defined results: null counts as empty; each document gets the end id. Keys in ascending order, null keys
first; rows that repeat a key follow by text. An empty table gives no segments and no rows. Other columns are
not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splicery.llm.common import shared_dir

BLOCK_IDS = 256
PERCENTILE = 90
SEGMENT = 1 << 17
#: Characters that are encoded at once.
PIECE = 1 << 21
#: Words and characters of words known to a worker before it starts anew, and the length of one that is kept; texts with longer words are encoded directly.
WORDS_KEPT, CHARS_KEPT, LONG = 1_500_000, 1 << 25, 128
MAGIC = b"SPF1"


class Encoder:
    """Ids of texts, exactly as the library's own, from ids of distinct words. A text's first word has a NUL before it."""

    def __init__(self, path: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.end = Tokenizer.from_file(path), [] if end_id is None else [end_id]
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.clear()

    def clear(self) -> None:
        """Entry 0 stands for words that need their whole text, entry 1 for the end of a text."""
        self.known: dict[str, int] = {}
        self.chars = 0
        self.ids, self.start, self.used, self.entries = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), len(self.end), 2
        self.ids[: self.used] = self.end
        self.start[2] = self.used

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, new: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(2 * self.used + len(flat), np.uint32)))
        n, m = self.entries, self.entries + len(new)
        if m + 1 > len(self.start):
            self.start = np.concatenate((self.start[: n + 1], np.zeros(n + 2 * len(new) + 2, np.int64)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[n + 1 : m + 1] = self.used + np.cumsum(sizes)
        self.used, self.entries = self.used + len(flat), m
        self.known.update(zip(new, range(n, m), strict=True))

    def _each(self, new: list[str], texts: list[str]) -> None:
        if new:
            found = self._direct(texts)
            self._add(new, np.concatenate(found), np.array([len(x) for x in found]))

    def _learn(self, new: set[str]) -> None:
        self.chars += sum(map(len, new))
        heads = [w for w in new if w[:1] == "\0"]
        inner = [w for w in new if w and w[0] != "\0" and not w[0].isspace() and not w[-1].isspace()]
        # A text may begin with a space character, but none of its words may end in one.
        fit = [w for w in heads if not w[-1].isspace()]
        self._each(fit, [w[1:] for w in fit])
        self.known.update(dict.fromkeys(new.difference(fit, inner), 0))
        if inner:
            ids = self._direct([" " + " ".join(inner)])[0]
            cuts = np.flatnonzero(self.spaced[ids])
            if len(cuts) == len(inner):
                self._add(inner, ids, np.diff(cuts, append=len(ids)))
            else:
                self._each(inner, [f" {w}" for w in inner])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each), with the end id after each; null is empty."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.entries > WORDS_KEPT or self.chars > CHARS_KEPT:
            self.clear()
        texts = texts.cast(pa.large_string()).fill_null("")
        words, begin = _words(texts)
        direct = np.asarray(pc.match_substring(texts, "\0")) | (np.maximum.reduceat(np.asarray(pc.utf8_length(words)), begin[:-1]) > LONG)
        if direct.any():
            words, begin = _words(pc.if_else(pa.array(direct), "", texts))
        # Python meets each distinct word once.
        coded = words.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(known < 0)
        if len(missing):
            lost = [names[i] for i in missing.tolist()]
            self._learn(set(lost))
            known[missing] = np.fromiter(map(self.known.__getitem__, lost), np.int64, len(lost))
        k = np.insert(known[np.asarray(coded.indices)], begin[1:], 1)
        begin = begin + np.arange(len(begin))
        at, n = self.start[k], self.start[k + 1] - self.start[k]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(at - ends + n, n) + np.arange(ends[-1])]
        lengths = np.add.reduceat(n, begin[:-1])
        direct[np.searchsorted(begin, np.flatnonzero(k == 0), "right") - 1] = True
        whole = np.flatnonzero(direct)
        if len(whole):
            each = np.split(ids, np.cumsum(lengths)[:-1])
            for i, x in zip(whole.tolist(), self._direct(texts.take(pa.array(whole)).to_pylist()), strict=True):
                each[i] = np.concatenate((x, np.array(self.end, np.uint32)))
            ids, lengths = np.concatenate(each), np.array([len(x) for x in each])
        return ids, lengths


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts between spaces, a NUL before each text's first one, and where each text's begin and end."""
    split = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), texts, pa.scalar("", pa.large_string())), " ")
    return split.flatten(), np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(split)))))


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, end_id: int | None = None) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def pack(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(start of each block, block area) of the ids, patched frame of reference."""
    n = len(ids)
    blocks = -(-n // BLOCK_IDS)
    full = np.zeros(blocks * BLOCK_IDS, np.uint32)
    full[:n] = ids
    full[n:] = ids[-1] if n else 0
    full = full.reshape(blocks, BLOCK_IDS)
    low = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = full - low[:, None]
    at = np.partition(rest, BLOCK_IDS * PERCENTILE // 100, axis=1)[:, BLOCK_IDS * PERCENTILE // 100] if blocks else low
    width = np.frexp(at.astype(np.float64))[1].astype(np.int64)  # bits of the percentile
    words = {w: _packed(rest[width == w], w) for w in np.unique(width).tolist()}
    place = np.zeros(blocks, np.int64)
    for w in words:
        place[width == w] = np.arange((width == w).sum())
    high = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    row, col = np.nonzero(high)
    cuts, pos, over = np.searchsorted(row, np.arange(blocks + 1)).tolist(), col.astype(np.uint8).tobytes(), high[row, col].astype("<u4").tobytes()
    area, starts, size = [], np.zeros(blocks, np.uint32), 0
    for i, (m, w, j, x, y) in enumerate(zip(low.tolist(), width.tolist(), place.tolist(), cuts[:-1], cuts[1:], strict=True)):
        block = struct.pack("<IBH", m, w, y - x) + words[w][j].tobytes() + pos[x:y] + over[4 * x : 4 * y]
        starts[i] = size
        area.append(block)
        size += len(block)
    return starts, b"".join(area)


def _packed(values: np.ndarray, w: int) -> np.ndarray:
    """The low w bits of each row's BLOCK_IDS values, one after another, as little-endian 64-bit words."""
    out = np.zeros((BLOCK_IDS * w // 64, len(values)), np.uint64)
    v = np.ascontiguousarray((values & np.uint32((1 << w) - 1)).T).astype(np.uint64)
    for i in range(BLOCK_IDS if w else 0):
        word, shift = divmod(i * w, 64)
        out[word] |= v[i] << np.uint64(shift)
        if shift + w > 64:
            out[word + 1] |= v[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8")


def _unpacked(words: np.ndarray, w: int) -> np.ndarray:
    """The values of _packed()."""
    u = np.ascontiguousarray(words.T).astype(np.uint64)
    out = np.zeros((BLOCK_IDS, len(words)), np.uint64)
    for i in range(BLOCK_IDS if w else 0):
        word, shift = divmod(i * w, 64)
        out[i] = u[word] >> np.uint64(shift)
        if shift + w > 64:
            out[i] |= u[word + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << w) - 1)).astype(np.uint32).T


def unpack(area: bytes, starts: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block area."""
    out = np.zeros(len(starts) * BLOCK_IDS, np.uint32)
    heads = [struct.unpack_from("<IBH", area, s) for s in starts.tolist()]
    width = np.array([h[1] for h in heads], np.int64)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        size = BLOCK_IDS * w // 8
        raw = np.frombuffer(b"".join([area[s + 7 : s + 7 + size] for s in starts[own].tolist()]), "<u8").reshape(len(own), size // 8)
        out.reshape(-1, BLOCK_IDS)[own] = _unpacked(raw, w)
    for i, (low, w, k) in enumerate(heads):
        at = int(starts[i]) + 7 + BLOCK_IDS * w // 8
        if k:
            p = np.frombuffer(area, np.uint8, k, at).astype(np.int64)
            out[i * BLOCK_IDS + p] |= np.frombuffer(area, "<u4", k, at + k) << np.uint32(w)
        out[i * BLOCK_IDS : (i + 1) * BLOCK_IDS] += np.uint32(low)
    return out[:n]


def write_segment(lengths: list[int], ids: np.ndarray) -> bytes:
    starts, area = pack(ids)
    return MAGIC + struct.pack("<III", len(lengths), len(ids), len(starts)) + np.array(lengths, "<u4").tobytes() + starts.astype("<u4").tobytes() + area


def read_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(document lengths, ids) of a segment."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment")
    docs, n, blocks = struct.unpack_from("<III", payload, 4)
    lengths = np.frombuffer(payload, "<u4", docs, 16)
    starts = np.frombuffer(payload, "<u4", blocks, 16 + 4 * docs)
    return lengths, unpack(payload[16 + 4 * (docs + blocks) :], starts, n)


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = None, text: str = "text", key: str = "doc_id") -> None:
    """Encode every text and write its ids, in ascending key order, as segments under `out`."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, end_id), TaskContext.get().partitionId()
        keys, lengths, ids, count, before, seq = [], [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            payload = write_segment(lengths, np.concatenate(ids))
            cols = {"part": (part, pa.int32()), "seq": (seq, pa.int64()), "before": (before, pa.int64()), "n_ids": (count, pa.int64()), "keys": (keys, pa.list_(pa.int64())), "payload": (payload, pa.binary())}
            return pa.RecordBatch.from_pydict({k: pa.array([v], t) for k, (v, t) in cols.items()})

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            size = np.cumsum(np.asarray(pc.utf8_length(texts).fill_null(0)), dtype=np.int64)
            at = 0
            while at < len(names):
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PIECE)))
                flat, sizes = encode(texts.slice(at, end - at))
                keys += names[at:end]
                lengths += sizes.tolist()
                ids.append(flat)
                count += len(flat)
                at = end
                if count >= SEGMENT:
                    yield segment()
                    before, seq = before + count, seq + 1
                    keys, lengths, ids, count = [], [], [], 0
        if keys:
            yield segment()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    rows = rows.repartitionByRange("k").sortWithinPartitions("k", "t")
    rows.mapInArrow(segments, "part int, seq long, before long, n_ids long, keys array<long>, payload binary").write.option("compression", "none").parquet(out)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the files, and its ids if asked for."""
    table = spark.read.parquet(path)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each task that wrote: bounded by the number of partitions.
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    placed = table.join(F.broadcast(parts), "part").select("keys", "payload", (F.col("base") + F.col("before")).alias("start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                lengths, ids = read_segment(batch.column(1)[i].as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                each = np.split(ids, ends[:-1])
                cols = {
                    "key": batch.column(0)[i].values,
                    "start": pa.array(batch.column(2)[i].as_py() + ends - lengths, pa.int64()),
                    "n_tokens": pa.array(lengths.astype(np.int64)),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(cols | ({"ids": pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64()))} if with_ids else {}))

    return placed.mapInArrow(documents, "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_files(docs: DataFrame, tokenizer: str, end_id: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the ids to the shared folder and read them back."""
    spark = docs.sparkSession
    where = f"{shared_dir(spark)}/tokens"
    write_tokens(docs, where, tokenizer, end_id, text, key)
    return read_tokens(spark, where).withColumnRenamed("key", key)
