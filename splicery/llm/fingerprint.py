"""Document fingerprints by order MinHash, with DataFrame functions only.

The k-mers of a text are runs of K words, numbered by occurrence: the second "a b c" is another k-mer than the
first. Each of M hash functions, an independent rehash of the numbered k-mers, selects the two smallest of its
ranking. The two are kept in text order, and the hash of the pair is one of the fingerprint's M parts. Two texts
agree in a part when they share both k-mers in the same order, so the share of equal parts falls with insertions,
deletions and moves alike. A text's parts are array expressions over its own row: nothing is exploded or shuffled.

Texts meet the next text, in descending key order, inside key ranges: sampled quantiles split the keys into
four times as many ranges as there are shuffle partitions; a key that fills more than one of them, or null, is split by
text hash. The first row of each range is also sent to the end of the range before it. Texts are shuffled once.

Defined results: null text counts as empty. Of rows with one key those with the smaller text hash come first,
and repeated rows each count. A null key sorts last. An empty text has no k-mers and the fingerprint "", which
is like "" only (1.0) and unlike any other (0.0). Fewer than K words are one k-mer. A single row is its own
next document. An empty table gives no rows. Only key and text are read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
M = 24
RUN = 64


def _with(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.transform(F.array(x), f)[0]


def numbered_kmers(text: Column, k: int = K) -> Column:
    """Struct (ids, at): the occurrence-numbered k-mers of a text and their places; `at` is null where they stand in text order."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.transform(F.split(trimmed, "[\\x20\\x09-\\x0D]+"), lambda w: F.xxhash64(w))
    plain = _with(words, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])))
    pair = lambda h, n, at: F.struct(F.xxhash64(h, n).alias("id"), at.alias("at"))

    def ranked(pairs: Column) -> Column:
        # Sorted by hash, a k-mer's number is its distance from the start of its run; the starts spread by doubling steps.
        starts = F.transform(pairs, lambda x, i: F.when((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"]), F.lit(0)).otherwise(i))
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(pairs))).cast("int"))
        spread = F.aggregate(steps, starts, lambda s, e: F.transform(s, lambda v, i: F.greatest(v, F.coalesce(F.get(s, i - F.pow(F.lit(2), e).cast("int")), F.lit(0)))))
        return F.zip_with(pairs, F.transform(spread, lambda s, i: i - s), lambda x, n: pair(x["h"], n, x["at"]))

    def numbered(h: Column, repeated: Column) -> Column:
        all_pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))
        few = F.size(repeated) <= 64
        pairs = F.when(few, F.filter(all_pairs, lambda x: F.array_contains(repeated, x["h"]))).otherwise(all_pairs)
        single = F.transform(F.filter(all_pairs, lambda x: ~F.array_contains(repeated, x["h"])), lambda x: pair(x["h"], F.lit(0), x["at"]))
        again = _with(F.sort_array(pairs), ranked)
        return F.when(few, F.concat(single, again)).otherwise(again)

    def repeats(h: Column) -> Column:
        return _with(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))))

    def number(h: Column) -> Column:
        fast = F.struct(F.transform(h, lambda x: F.xxhash64(x, F.lit(0))).alias("ids"), F.lit(None).cast("array<int>").alias("at"))
        slow = _with(_with(repeats(h), lambda r: numbered(h, r)), lambda v: F.struct(v["id"].alias("ids"), v["at"].alias("at")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), fast).otherwise(slow)

    return F.when(trimmed != "", _with(plain, number))


def parts_of(text: Column, k: int = K, m: int = M) -> Column:
    """The M parts of a text's fingerprint; null for a text without k-mers.

    The k-mers are ranked in runs of RUN: a function's smallest of each run, then again the run of the smallest of all, in which
    its second one may be.
    """

    def ranking(j: Column, ids: Column) -> Column:
        return F.transform(ids, lambda x: F.xxhash64(j, x))

    def part(v: Column, runs: Column, j: Column, least: Column) -> Column:
        index = lambda xs, x: F.array_position(xs, x).cast("int") - 1
        rest = lambda xs, x: F.array_min(F.array_remove(xs, x))
        place = lambda run, y, x: _with(run * RUN + index(y, x), lambda p: F.coalesce(F.get(v["at"], p), p))

        def pair(a: Column, b: Column, first: Column, second: Column) -> Column:
            return F.when(first < second, F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))

        def chosen(a: Column, run: Column, y: Column, b: Column) -> Column:
            there = F.when(F.array_contains(y, b), run).otherwise(index(least, b))
            both = _with(there, lambda r: pair(a, b, place(run, y, a), place(r, ranking(j, F.get(runs, r)), b)))
            # Of a single k-mer there is no second one: a zero stands in.
            return F.when(b.isNull(), F.xxhash64(a, F.lit(0))).otherwise(both).bitwiseAND(F.lit(0xFFFFFFFF))

        def in_run(a: Column, run: Column) -> Column:
            return _with(ranking(j, F.get(runs, run)), lambda y: _with(F.least(rest(least, a), rest(y, a)), lambda b: chosen(a, run, y, b)))

        return _with(F.array_min(least), lambda a: _with(index(least, a), lambda run: in_run(a, run)))

    def parts(v: Column, runs: Column) -> Column:
        least = lambda j: F.transform(runs, lambda ids: F.array_min(ranking(j, ids)))
        return F.transform(F.sequence(F.lit(1), F.lit(m)), lambda j: _with(least(j), lambda x: part(v, runs, j, x)))

    cut = lambda ids: F.transform(F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / RUN).cast("int")), lambda c: F.slice(ids, c * RUN + 1, F.lit(RUN)))
    return _with(numbered_kmers(text, k), lambda v: F.when(v.isNotNull(), _with(cut(v["ids"]), lambda runs: parts(v, runs))))


def _cuts_above(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are above the key: first over every block's last cut, then inside one block."""
    if not cuts:
        return F.lit(0)
    block = math.isqrt(len(cuts)) + 1
    longs = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    upto = lambda xs: F.size(F.filter(xs, lambda c: c <= key))
    whole = upto(longs(cuts[block - 1 :: block])) * block
    return F.lit(len(cuts)) - whole - upto(F.slice(longs(cuts), whole + 1, F.lit(block)))


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(range, place, key, text, next_text, guest) of every row; a guest row only ends its range and is the first of another."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    # Four ranges for each partition, so that partitions made of whole ranges come out even.
    n = 4 * parts
    found = Counter(int(c) for c in rows.select("key").dropna().approxQuantile("key", [i / n for i in range(1, n)], 1 / (10 * n)))
    # A key that is several cuts fills as many ranges: it gets a range of its own, cut into pieces along its text hashes.
    hot = {c: times for c, times in found.items() if times > 1}
    cuts = sorted({*found, *(c + 1 for c in hot if c < 2**63 - 1)})
    total, known = rows.agg(F.count(F.lit(1)), F.count("key")).first()
    # Ranges are numbered from the largest keys on; null keys form the last.
    pieces = [1] * (len(cuts) + 1) + [1 + n * (total - known) // max(1, total)]
    for c, times in hot.items():
        pieces[len(cuts) - bisect_right(cuts, c)] = times
    wide = max(pieces)
    whole = F.when(F.col("key").isNull(), F.lit(len(cuts) + 1)).otherwise(_cuts_above(F.col("key"), cuts))
    rows = rows.withColumn("whole", whole).withColumn("pieces", F.get(F.array(*[F.lit(x) for x in pieces]), F.col("whole")) if wide > 1 else F.lit(1))
    piece = F.least(F.floor((F.col("th") / F.lit(2.0**64) + 0.5) * F.col("pieces")), F.col("pieces") - 1)
    rows = rows.withColumn("range", F.col("whole").cast("long") * wide + piece).drop("whole", "pieces")
    # One row a range: at most some ten times as many as there are partitions.
    by_range, everything = Window.orderBy("range"), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = rows.groupBy("range").agg(F.min(F.struct(F.bitwise_not(F.col("key")).alias("down"), "th")).alias("top"))
    guests = heads.select(
        F.col("range").alias("head_range"), F.bitwise_not(F.col("top.down")).alias("head_key"), F.col("top.th").alias("head_th"),
        F.coalesce(F.lag("range").over(by_range), F.max("range").over(everything)).alias("host"),
    )
    met = rows.join(F.broadcast(guests), (F.col("range") == F.col("head_range")) & F.col("key").eqNullSafe(F.col("head_key")) & (F.col("th") == F.col("head_th")), "left")
    both = F.array(F.struct("range", F.lit(False).alias("guest")), F.struct(F.col("host").alias("range"), F.lit(True).alias("guest")))
    one = F.array(F.struct("range", F.lit(False).alias("guest")))
    placed = met.withColumn("seat", F.explode(F.when(F.col("host").isNotNull(), both).otherwise(one))).select("seat.range", "seat.guest", "key", "th", "text")
    order = Window.partitionBy("range").orderBy("guest", F.col("key").desc_nulls_last(), "th")
    return placed.repartitionByRange(parts, "range").select("range", "guest", "key", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts of two fingerprints (arrays; null for a text without k-mers)."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, F.lit(1)).otherwise(F.lit(0))), F.lit(0), lambda s, v: s + v)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).otherwise(F.coalesce(same / F.size(a), F.lit(0.0)))


def as_text(parts: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(parts, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), ""), F.lit(""))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, m: int = M) -> DataFrame:
    """One row a document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document.
    """
    rows = with_next(docs, text, key).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - third), F.left(F.coalesce("next_text", F.lit("")), third))
    own = F.col("own")
    made = rows.withColumn("edited", edited).select(
        "range", "place", "guest", "key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), parts_of(F.col("text"), k, m).alias("own"),
        F.when(~F.col("guest"), parts_of(F.col("edited"), k, m)).alias("other"),
    )
    after = Window.partitionBy("range").orderBy("place")
    out = made.withColumn("following", F.lead("own").over(after)).filter("not guest")
    return out.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", as_text(own).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(own, F.col("other")).alias("near_edited"), likeness(own, F.col("following")).alias("near_next"),
    )
