"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs, and pairs with one or two words left out.
Training takes a bounded sample of labelled keys (`max_rows`, chosen by hash of the key), one text for each: their
feature indices are extracted in parallel, and one task runs the sequential FTRL updates with per-coordinate rates over
the features that at least `min_docs` of those rows have. The task's memory is bounded: of a row with more than
MAX_FEATURES features those with the smallest hashes are learnt from, and rows beyond MAX_CELLS features in all, in hash
order of their keys, are left out of the sample. L1 leaves a few thousand weights, which are broadcast; every text is then
scored whole, in Arrow batches, without a shuffle.

Defined results: null, empty and wordless texts score as the intercept alone. Label rows with a null
key or label are skipped; of several for one key the largest label counts, and of several texts for one key
the one with the smallest hash is learnt from. Without any labelled row every score is 0.5. Repeated rows are scored alike. An empty table gives no rows. Extra columns pass
through; an input column named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicery.llm.common import carried
from splicery.llm.words import ALNUM, mixed, words

DIM_BITS = 22
MAX_ROWS = 12_000
MAX_FEATURES, MAX_CELLS = 1 << 15, 1 << 25
MIN_DOCS = 4
EPOCHS = 10
#: Chosen from a grid by training on rows with remainder 0 and judging on rows with remainder 2; remainder 1 took no part.
ALPHA, BETA, L1, L2 = 4.0, 1.0, 10.0, 0.0
POSITIVE_WEIGHT = 4.0
THRESHOLD = 0.7

_A, _B = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xAAAAAAAAAAAAAAAB)


def features(column: pa.Array, bits: int = DIM_BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, row, feature index) of blocks of rows; a feature may come several times."""
    cut = np.uint64(64 - bits)
    for first, last, row, h in words(column, ALNUM):
        rows, found = [row], [h >> cut]
        for gap in (1, 2, 3):
            same = row[gap:] == row[:-gap]
            pair = mixed(h[:-gap] * _A + h[gap:] * _B + np.uint64(gap > 1))  # one or two left out: one kind of skip-gram
            rows.append(row[gap:][same])
            found.append((pair >> cut)[same])
        yield first, last, np.concatenate(rows), np.concatenate(found).astype(np.int64)


def _fewest(x: np.ndarray) -> np.ndarray:
    """The features of a training row, those with the smallest hashes if there are more than MAX_FEATURES."""
    return x if len(x) <= MAX_FEATURES else np.sort(x[np.argpartition(mixed(x.astype(np.uint64)), MAX_FEATURES)[:MAX_FEATURES]])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, row, f in features(batch.column(2)):
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(1, last - first))
            x = [_fewest(np.unique(part)).astype(np.int32) for part in np.split(f[order], cuts)]
            own = batch.slice(first, last - first)
            yield pa.RecordBatch.from_pydict({"ord": own.column(0), "y": own.column(1), "x": pa.array(x, pa.list_(pa.int32()))})


def ftrl(examples: list[tuple[int, np.ndarray]], bits: int = DIM_BITS, epochs: int = EPOCHS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2, min_docs: int = MIN_DOCS, positive=POSITIVE_WEIGHT) -> tuple[np.ndarray, np.ndarray, float]:
    """(indices, weights, intercept) after `epochs` passes in the given order; the examples lose their rare features."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    weight = lambda zs, ns: (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2)  # noqa: E731  where |z| > l1, else 0
    zb = nb = 0.0
    docs = np.zeros(1 << bits, np.int32)
    for _, x in examples:
        docs[x] += 1
    for i, (y, x) in enumerate(examples):  # one by one: what an example no longer needs is freed at once
        examples[i] = y, x[docs[x] >= min_docs]
    del docs
    for _ in range(epochs):
        for y, x in examples:
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) > l1, weight(zx, nx), 0.0)
            wb = -zb / ((beta + nb**0.5) / alpha + l2)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -30, 30)))
            g = (p - y) * (positive if y else 1.0)
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / alpha * w
            n[x] = nx + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * wb
            nb += g * g
    at = np.flatnonzero(np.abs(z) > l1)
    return at, weight(z[at], n[at]), float(-zb / ((beta + nb**0.5) / alpha + l2))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, text: str = "text", key: str = "doc_id", label: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """(indices, weights, intercept) of a model fitted on at most about `max_rows` of the labelled rows."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    share = int(1_000_000 * min(1.0, max_rows / max(1, known.count())))
    some = known.withColumn("ord", F.xxhash64(F.lit(5), key)).filter(F.pmod("ord", F.lit(1_000_000)) < share)
    # At most about max_rows rows of 24 bytes. Repeats of a key are cut before they are counted as rows.
    rows = docs.select(key, text).join(F.broadcast(some), key).groupBy("ord", "y").agg(F.min_by(text, F.xxhash64(text)).alias("text"))
    found = rows.mapInArrow(_examples, "ord long, y int, x array<int>")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, cells = [], 0
        for b in batches:
            x = b.column(2)
            values, offs = x.values.to_numpy(), x.offsets.to_numpy()
            for y, i, j in zip(b.column(1).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                cells += j - i
                if cells <= MAX_CELLS:
                    examples.append((y, values[i:j].copy()))
        at, w, bias = ftrl(examples) if examples else (np.zeros(0, np.int64), np.zeros(0), 0.0)
        examples.clear()
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.append(at, -1), pa.int64()), "w": pa.array(np.append(w, bias), pa.float64())})

    one = found.repartition(1).sortWithinPartitions("ord", F.xxhash64("x"))
    got = one.mapInArrow(fit, "i long, w double").toPandas()
    at, w = got["i"].to_numpy(np.int64), got["w"].to_numpy(np.float64)
    return at[at >= 0], w[at >= 0], float(w[at < 0].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text") -> DataFrame:
    """docs with `score`, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, w, bias = shared.value
        table = np.zeros(1 << DIM_BITS, np.float32)
        table[at] = w
        for column in columns:
            total = np.full(len(column), bias)
            for first, last, row, f in features(column):
                hit = np.flatnonzero(table[f])
                pair = np.unique((row[hit].astype(np.int64) << DIM_BITS) | f[hit])
                total[first:last] += np.bincount(pair >> DIM_BITS, weights=table[pair & ((1 << DIM_BITS) - 1)], minlength=last - first)
            yield pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))

    return docs.select(*carried(docs, "score"), probability(F.col(text)).alias("score"))


def held_out(key):
    """Rows whose labels nobody learns from: crc32 of the key as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with held_out, score and predicted; the model learns from rows that are not held out."""
    model = train(docs, labels.filter(~held_out(F.col(key))), max_rows, text, key)
    out = score(docs.select(*carried(docs, "held_out", "predicted")), model, text)
    return out.withColumns({"held_out": held_out(F.col(key)), "predicted": (F.col("score") >= threshold).cast("int")})
