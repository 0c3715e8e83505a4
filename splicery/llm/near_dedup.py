"""MinHash near-deduplication on sets of word shingles.

One pass hashes the distinct 5-word shingles of each whole text and makes a one-permutation sketch:
128 bins, the smallest hash in each, empty bins filled by optimal densification (bin i takes the value
of the first non-empty bin in its own fixed random order). 32 bands of 4 bins are bucket keys; two
texts with Jaccard 0.75 miss every bucket with a chance of about 5e-6.

Texts with equal sets become one representative first. In each bucket the star's centre is the
representative that shares buckets with most others (of several the smallest): among edited copies of a
text the one with the fewest edits. Each representative is compared, on full sets, with the foremost of
its centres only: at most one pair a text. Linked texts form components. A bucket that then holds more than one
component is not settled by its star; it gets a round of stars with a centre of its own, and if it still
holds several components, all its members go to an exact pass. There, shingles seen in one
component only cannot link two, so they sort first; the others follow by rising frequency, and two
texts of different components with Jaccard >= t share one of the first n - ceil(t * n) + 1 shingles of
that order (prefix filtering), and the place of the first shared one bounds the other text's size. Pairs
from it are confirmed on full sets as well. Nothing is capped.

Components come from alternating large-star and small-star rounds; each round is a written table.

The graph's nodes are (id, text hash) of one row for each different set, so that rows which repeat a doc_id with
other texts keep the links of each text; the sets of one doc_id are then linked with each other.

Defined results: null, empty and wordless texts have an empty set and link with nothing. Rows that
repeat a doc_id have n_shingles of their own and one component, which all their texts' links extend; rows that agree in
their text, too, are alike. A row with a null doc_id is never linked: component_id null, kept true.
An empty table gives no rows. Only the key and text columns are read, under names of this module.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicery.llm.common import discard, shared_dir, stored
from splicery.llm.words import NOT_WHITE, mixed, words

SHINGLE = 5
NUM, DEN = 75, 100
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Rounds of further stars (a second one found 27 links among 37,920 pairs on the hot check table) before the exact pass.
ROUNDS = 1

_SALT = mixed(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_odd = _SALT | np.uint64(1)
#: Bin i looks for a value in bins _ORDER[i], in turn.
_ORDER = np.argsort(mixed(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(77)).reshape(BINS, BINS), axis=1, kind="stable")


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row the sorted hashes of its distinct k-word shingles (of all its words, if fewer)."""
    for first, last, row, h in words(column, NOT_WHITE):
        counts = np.bincount(row, minlength=last - first)
        s = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for i in range(k):
            s += h[i : len(h) - k + 1 + i] * _odd[i]
        s = mixed(s)
        at = 0
        for n in counts.tolist():
            if n >= k:
                a = np.sort(s[at : at + n - k + 1])
                yield a[np.concatenate(([True], a[1:] != a[:-1]))]
            elif n:
                yield mixed(np.sum(h[at : at + n] * _odd[100 : 100 + n], dtype=np.uint64, keepdims=True) + _SALT[n])
            else:
                yield np.zeros(0, np.uint64)
            at += n


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS bucket keys for each non-empty set."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    edges = np.arange(BINS, dtype=np.uint64) << shift
    values, full = np.zeros((len(sets), BINS), np.uint64), np.zeros((len(sets), BINS), bool)
    for i, a in enumerate(sets):
        at = np.minimum(np.searchsorted(a, edges), len(a) - 1)
        values[i] = a[at]
        full[i] = (a[at] >> shift) == (edges >> shift)
    for j in range(BINS):
        for i in np.flatnonzero(~full[:, j]):
            values[i, j] = values[i, _ORDER[j][full[i, _ORDER[j]].argmax()]]
    # A densified value is copied from a non-empty bin, which later fills leave alone.
    banded = values.reshape(len(sets), BANDS, ROWS)
    return mixed((banded * _odd[200 : 200 + ROWS]).sum(axis=2, dtype=np.uint64) + _SALT[300 : 300 + BANDS])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column(1)))
        full = [s for s in sets if len(s)]
        keys = iter(band_keys(full).view(np.int64)) if full else iter(())
        yield pa.RecordBatch.from_pydict(
            {
                "id": batch.column(0),
                "th": batch.column(2),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "s1": pa.array([int(mixed(s).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                "s2": pa.array([int(mixed(s ^ _SALT[7]).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                "bands": pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
            }
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.view(np.int64) for s in shingle_sets(batch.column(1))]
        ids = pa.StructArray.from_arrays([batch.column(0), batch.column(2)], ["i", "h"])
        # Few rows at a time: a set is larger than its text.
        for i in range(0, len(sets), 512):
            yield pa.RecordBatch.from_pydict({"id": ids.slice(i, 512), "set": pa.array(sets[i : i + 512], pa.list_(pa.int64()))})


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are at least NUM/DEN alike."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a"
    )
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    union = F.size("set_a") + F.size("set_b") - common
    return both.filter(DEN * common >= NUM * union).select("a", "b")


def components(links: DataFrame, where: str) -> DataFrame:
    """(id, label) of every linked node; label is the smallest id that it reaches."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges0", where)
    seen, k = None, 0
    while True:
        total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if total == seen or not total[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
        seen, k = total, k + 1
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written before they are joined: a plain shuffle on either side is one that AQE can split for a node of very many links.
        least = stored(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"least{k}", where)
        large = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, f"large{k}", where)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), f"lower{k}", where)
        small = large.join(least, "u")
        joined = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(joined.distinct(), f"edges{k}", where)


def _same_ids(sketched: DataFrame, classes: DataFrame, where: str) -> DataFrame:
    """Links (a, b) between the nodes of the different sets that one doc_id has."""
    own = sketched.filter("n > 0 and id is not null").select("id", "s1", "s2", "n")
    whole = F.struct("s1", "s2", "n")
    several = own.groupBy("id").agg(F.min(whole).alias("a"), F.max(whole).alias("b")).filter("a <> b").select("id")
    repeated = own.join(stored(several, "several_ids", where), "id", "left_semi").distinct()
    nodes = stored(repeated.join(classes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).select("id", "rep"), "id_nodes", where)
    hubs = stored(nodes.groupBy("id").agg(F.min("rep").alias("a")), "id_hubs", where)
    return nodes.join(hubs, "id").select("a", F.col("rep").alias("b")).filter("a <> b")


def _unsettled(shared: DataFrame, labels: DataFrame, where: str) -> DataFrame:
    """(bucket, id, comp) of the members of buckets that hold more than one component."""
    labelled = shared.select("bucket", F.col("rep").alias("id")).join(labels, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("comp"))
    several = labelled.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("bucket")
    return stored(labelled.join(stored(several, "several", where), "bucket", "left_semi"), "members", where)


def _within_bounds(prefixes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a prefix shingle, as far as sizes and places allow the similarity."""
    # The larger text looks for smaller ones, by classes of sizes 10 % apart that its bounds leave open.
    size_class = lambda n: F.floor(F.log(n.cast("double")) / math.log(1.1) + 1e-9).cast("int")
    least, most = F.ceil(F.col("n") * NUM / DEN).cast("int"), F.least("n", "most")
    larger = prefixes.filter(least <= most).select(
        "token", F.col("id").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"), F.col("most").alias("most_b"),
        F.explode(F.sequence(size_class(least), size_class(most))).alias("class"),
    )
    smaller = prefixes.select("token", "id", "comp", "n", "most", size_class(F.col("n")).alias("class"))
    fits = (F.col("n") <= F.col("most_b")) & (F.col("n_b") <= F.col("most")) & (F.col("n") * DEN >= F.col("n_b") * NUM)
    ordered = (F.col("n") < F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("id") < F.col("b")))
    return smaller.join(larger, ["token", "class"]).filter((F.col("comp") != F.col("comp_b")) & fits & ordered).select(F.col("id").alias("a"), "b")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    spark = docs.sparkSession
    kept = shared_dir(spark)
    where = f"{kept}/work"
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    sketched = stored(rows.mapInArrow(_sketches, "id long, th long, n long, s1 long, s2 long, bands array<long>"), "sketches", kept)
    classes = (
        sketched.filter("n > 0 and id is not null")
        .groupBy("s1", "s2", "n")
        .agg(F.min(F.struct("id", "th", "bands")).alias("top"))
        .select("s1", "s2", "n", F.struct(F.col("top.id").alias("i"), F.col("top.th").alias("h")).alias("rep"), "top.bands")
    )
    classes = stored(classes, "classes", kept)

    slots = classes.select("rep", F.explode("bands").alias("bucket"))
    crowded = slots.groupBy("bucket").agg(F.min("rep").alias("x"), F.max("rep").alias("y"), F.count(F.lit(1)).alias("members")).filter("x <> y").select("bucket", "members")
    # Aggregated sides are written before they are joined: a plain shuffle on either side is one that AQE can split for a hot key.
    shared = stored(slots.join(stored(crowded, "crowded", where), "bucket"), "shared", where)
    # The complements fall as the numbers rise: of several, the smallest is foremost.
    back = [F.bitwise_not(F.col(f"rep.{c}")).alias(c) for c in ("i", "h")]
    standing = shared.groupBy("rep").agg(F.sum("members").alias("company")).select("rep", F.struct("company", *back).alias("rank"))
    placed = stored(shared.select("rep", "bucket").join(stored(standing, "standing", where), "rep"), "placed", where)
    stars = stored(placed.groupBy("bucket").agg(F.max("rank").alias("top")), "stars", where)
    centre = F.struct(*[F.bitwise_not(F.col(f"top.{c}")).alias(c) for c in ("i", "h")])
    pairs = placed.join(stars, "bucket").groupBy("rep").agg(F.max("top").alias("top")).select(centre.alias("a"), F.col("rep").alias("b")).filter("a <> b")
    involved = shared.select(F.col("rep.i").alias("id"), F.col("rep.h").alias("th")).distinct()
    sets = stored(rows.join(involved, ["id", "th"], "left_semi").dropDuplicates(["id", "th"]).select("id", "text", "th").mapInArrow(_sets, "id struct<i: long, h: long>, set array<long>"), "sets", where)
    links = stored(_confirmed(pairs, sets).unionByName(_same_ids(sketched, classes, where)), "links", where)
    labels = components(links, f"{where}/first")

    # More stars over buckets that hold more than one component, a random centre for each bucket: at most BANDS pairs a text and round.
    for turn in range(ROUNDS):
        loose = _unsettled(shared, labels, f"{where}/round{turn}")
        order = F.struct(F.xxhash64(F.lit(turn), "bucket", "id"), F.col("id").alias("a"), F.col("comp").alias("comp_a"))
        centres = stored(loose.groupBy("bucket").agg(F.min(order).alias("top")).select("bucket", "top.a", "top.comp_a"), f"centres{turn}", where)
        pairs = loose.join(centres, "bucket").filter("comp <> comp_a").select("a", F.col("id").alias("b")).distinct()
        found = stored(_confirmed(pairs, sets), f"found{turn}", where)
        if found.isEmpty():
            break
        labels = components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(found), f"{where}/merged{turn}")

    # The exact pass over what is still unsettled.
    open_rows = stored(_unsettled(shared, labels, f"{where}/last").select("id", "comp").distinct(), "open", where)
    tokens = open_rows.join(sets, "id").select("id", "comp", F.size("set").alias("n"), F.explode("set").alias("token"))
    across = tokens.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("df")).filter("x <> y").select("token", "df")
    across = stored(across, "across", where)
    first = F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1  # so many in the order of single-component shingles, then rising frequency
    prefixes = (
        tokens.join(across, "token")
        .groupBy("id", "comp", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
        .withColumn("alone", F.col("n") - F.size("ranked"))
        .withColumn("left", (first - F.col("alone")).cast("int"))
        .filter("left > 0")
        .select("id", "comp", "n", "alone", F.posexplode(F.slice("ranked", F.lit(1), F.col("left"))).alias("at", "r"))
        .select("id", "comp", "n", F.col("r.token").alias("token"), (F.col("alone") + F.col("at")).alias("at"))
        # With this shingle as the first that two texts share, at most n - at are shared: so large can the other be.
        .withColumn("most", F.floor((F.col("n") - F.col("at")) * (NUM + DEN) / NUM).cast("int") - F.col("n"))
    )
    prefixes = stored(prefixes, "prefixes", where)
    more = _within_bounds(prefixes).distinct()
    late = stored(_confirmed(more, sets), "late", where)
    if late.isEmpty():
        found = labels
    else:
        tree = labels.select(F.col("id").alias("a"), F.col("label").alias("b"))
        found = components(tree.unionByName(late), f"{where}/second")
    found = stored(found, "labels", kept)
    discard(spark, where)  # the result reads sketches, classes and labels

    label = classes.select("s1", "s2", "n", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("s1", "s2", "n", F.coalesce("label", "rep").alias("component"))
    out = sketched.select("id", "n", "s1", "s2").join(label, ["s1", "s2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component.i")).otherwise(F.col("id")))
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
