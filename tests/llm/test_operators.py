"""Each operator against a plain version, and on nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"
WHITE = re.compile(r"[\x20\x09-\x0D]")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i * 7919 % 1009}" for i in range(60_000))
EDGES = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "a b c d e f"), (5, "A B C D E F"), (5, "A B C D E F"), (None, "a b c d e f"), (None, None), (6, LONG), (7, LONG + " more"),
    (8, "Ein Straßenlärm é 日本 語  x\n\nline two line two line two\nline two line two line two"), (9, "one"), (10, "line two line two line two"), (11, "LINE TWO line two line two \nx"),
]


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def random_docs(seed, families=12, copies=12, singles=40):
    """Families of near copies whose mutual likeness lies around the bound, copies in other cases, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                w[rng.randrange(len(w))] = word()
            texts.append((" " * rng.randint(1, 2)).join(w))
        texts.append(" ".join(base).upper())
    common = [word() for _ in range(60)]
    texts += [" ".join(common + [word() for _ in range(rng.randint(5, 40))]) for _ in range(singles)]
    texts += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(singles)]
    rng.shuffle(texts)
    return list(enumerate(texts))


# -- exact dedup ------------------------------------------------------------------------------


def plain_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(WHITE.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        n = WHITE.sub("", t or "")
        g = sorted(groups[n])
        out.append((i, None if g[0][1] else g[0][2], len(g), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [1, 2, 2000])
def test_exact_duplicates(spark, hot):
    from splicery.llm.exact_dedup import exact_duplicates

    rows = EDGES + [(100 + i, "same  text" if i % 3 else "same text") for i in range(40)]
    got = exact_duplicates(table(spark, rows), hot=hot).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == plain_exact(rows)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in got})
    assert exact_duplicates(table(spark, [])).count() == 0


def test_exact_duplicates_keeps_other_columns(spark):
    from splicery.llm.exact_dedup import exact_duplicates

    out = exact_duplicates(spark.createDataFrame([(1, "a", "x", 5), (2, "a ", "y", 6)], "doc_id long, text string, kept string, group_size int"))
    assert {(r.doc_id, r.keep_id, r.kept) for r in out.collect()} == {(1, 2, False), (2, 2, True)}


# -- lines ------------------------------------------------------------------------------------


def plain_lines(rows, min_chars=20, min_docs=3):
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and i != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    from splicery.llm.line_dedup import dedup_lines

    rng = random.Random(3)
    pool = [f"  Passage number {i} of the common kind\t" for i in range(6)] + ["short", "ÀÉ passage number with accents"]
    rows = EDGES + [(200 + i, "\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(30)]
    got = dedup_lines(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=repr) == plain_lines(rows)
    assert dedup_lines(table(spark, [])).count() == 0
    assert dedup_lines(spark.createDataFrame([(1, "a", "q")], "doc_id long, text string, n_lines string")).first().n_lines == 1


# -- near copies ------------------------------------------------------------------------------


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def plain_near(rows):
    sets = sets_of(rows)
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    from splicery.llm.near_dedup import near_duplicates

    rows = random_docs(seed)
    got = near_duplicates(table(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_near(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_near_duplicates_with_repeated_ids(spark, parts):
    """A doc_id with several texts is one node that all its texts' links reach, however the rows are partitioned."""
    from splicery.llm.near_dedup import near_duplicates

    rng = random.Random(8)
    rows = random_docs(5, families=8, copies=6, singles=15)
    rows = [(i if rng.random() < 0.7 else rng.randrange(len(rows)), t) for i, t in rows]
    rows += [(3001, "aa bb cc dd ee ff gg hh"), (3002, "AA bb cc dd ee ff gg hh"), (3002, "q1 q2 q3 q4 q5 q6 q7"), (3003, "q1 q2  q3 q4 q5 q6 q7"), (3003, ""), (3002, "q1 q2 q3 q4 q5 q6 q7")]
    sets = [(i, s) for k, (i, _) in enumerate(rows) for s in [sets_of([(k, rows[k][1])])[k]]]
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        common = len(x & y)
        if common and 100 * common >= 75 * len(x | y):
            u, v = sorted((root(a), root(b)))
            label[v] = u
    got = near_duplicates(table(spark, rows).repartition(parts)).collect()
    want = [(i, len(s), root(i) if s else i, i == root(i) or not s) for i, s in sets]
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted(want)


def test_exact_pass_finds_every_link_alone(spark, monkeypatch):
    """With one star for all texts nearly every link is left to the exact pass."""
    from splicery.llm import near_dedup

    rows = random_docs(7, families=6, copies=10, singles=20)
    docs = table(spark, rows)

    def one_bucket(batches):
        for b in near_dedup._sketches(batches):
            cols = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            cols["bands"] = pa.array([None if n == 0 else [1] for n in cols["n"].to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(cols)

    original = near_dedup._sketches
    source = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: source(self, one_bucket if f is original else f, schema))
    got = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_near(rows)


def test_near_duplicates_edges(spark):
    from splicery.llm.near_dedup import near_duplicates

    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(table(spark, EDGES)).collect()}
    assert {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (None, None, True), (6, 6, True), (7, 6, False), (9, 9, True)} <= got
    assert near_duplicates(table(spark, [])).count() == 0
    assert near_duplicates(spark.createDataFrame([(1, "x", "a", "b")], "doc_id long, text string, id string, rep string")).count() == 1


# -- mixing -----------------------------------------------------------------------------------


def test_mixing(spark):
    from splicery.llm.mixing import mix, mixed_stream

    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["a", "b", "c", "d", "", None])) for i in range(400)]
    rows += [(500, None, "a"), (501, " x  y ", "tiny"), (501, " x  y ", "tiny"), (None, "q", "b")]
    docs = table(spark, rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    assert len(got) == len(rows)
    by, total = {}, 0
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
        total += r.size
    weights = dict(zip(sorted(by, key=lambda s: (s is None, s or "")), itertools.cycle([5, 2, 1])))
    size = {s: sum(r.size for r in rs) for s, rs in by.items()}
    want, open_ = dict.fromkeys(by, 0.0), set(by)
    while True:  # share, cap, share the excess again
        left = total - sum(3 * size[s] for s in by if s not in open_)
        for s in by:
            want[s] = left * weights[s] / sum(weights[x] for x in open_) if s in open_ else 3 * size[s]
        over = {s for s in open_ if want[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        open_ -= over
    for s, rs in by.items():
        assert rs[0].target == pytest.approx(want[s]) and rs[0].source_size == size[s]
        assert abs(sum(r.taken for r in rs) - want[s]) <= 1
        spots = [u.position for r in rs for u in r.occurrences]
        assert all(-1e-9 <= p <= 1 + 1e-9 for p in spots)
    again = {(r.doc_id, r.source, r.text): r.taken for r in mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.source, r.text): r.taken for r in got}
    stream = mixed_stream(mix(docs), ["doc_id", "text", "source"])
    words = stream.select(F.sum(F.size(F.expr("regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)")))).first()[0]
    assert words == sum(r.taken for r in got)
    assert mix(table(spark, [], "doc_id long, text string, source string")).count() == 0
    assert mix(table(spark, [(1, None, None)], "doc_id long, text string, source string")).first().taken == 0


def test_curriculum_moves_the_heavy_sources_forward(spark):
    from splicery.llm.mixing import mix

    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(600)]
    got = mix(table(spark, rows, "doc_id long, text string, source string")).collect()
    mean = lambda s: np.mean([u.position for r in got if r.source == s for u in r.occurrences])
    assert mean("a") < 0.47 and mean("b") > 0.5


def test_op9_comes_in_training_order(spark):
    from splicery.llm.queries import op9_mixing

    got = [r.first_position for r in op9_mixing(spark, "/root/testdata/sf0.001").collect()]
    used = [x for x in got if x is not None]
    assert used and used == sorted(used) and got[: len(used)] == used


def test_curriculum_follows_its_integrals(spark):
    """Of a source's words those placed before t are the integral of its schedule, up to a document; a flat schedule gives other positions."""
    from splicery.llm.mixing import SLOPES, mix

    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 9), "abc"[i % 3], "kept") for i in range(1500)]
    docs = table(spark, rows, "doc_id long, text string, source string, slope string")
    sloped, flat = ({r.doc_id: r for r in mix(docs, slopes=s).collect()} for s in (SLOPES, (0.0, 0.0, 0.0)))
    assert all(r.slope == "kept" for r in sloped.values())
    for s, slope in zip("abc", SLOPES):
        for t in (0.1, 0.25, 0.5, 0.8, 1.0):
            for got, a in ((sloped, slope), (flat, 0.0)):
                own = [r for r in got.values() if r.source == s]
                before = sum(u.words for r in own for u in r.occurrences if u.position < t)
                assert abs(before - own[0].target * (t + a * (t * t - t))) <= 10
        assert any(sloped[i].first_position != flat[i].first_position for i in sloped if sloped[i].source == s and sloped[i].taken)
    for r in sloped.values():
        spots = [u.position for u in r.occurrences]
        assert (r.first_position, r.last_position) == ((spots[0], spots[-1]) if spots else (None, None)) and spots == sorted(spots)


# -- toxicity ---------------------------------------------------------------------------------


def test_toxicity_learns_and_ignores_held_out_labels(spark):
    from splicery.llm.toxicity import toxicity

    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        w = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(5, 80))]
        if bad:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "Rotten", "nasty"]))
        rows.append((i, " ".join(w)))
        out = zlib.crc32(str(i).encode()) % 3 == 1
        labels.append((i, int(bad) if not out else int(not bad)))  # wrong labels where nobody may look
    docs, known = table(spark, rows), table(spark, labels, "doc_id long, toxic int")
    got = toxicity(docs, known).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    right = sum((r.predicted == 1) == (r.doc_id % 4 == 0) for r in held)
    assert right >= 0.97 * len(held)
    clean = [r for r in got if r.doc_id % 4]
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    edge = toxicity(spark.createDataFrame([(*r, 1) for r in EDGES], DOCS + ", score int"), known).collect()
    assert len(edge) == len(EDGES) and len({r.score for r in edge if r.text is None or not r.text.strip()}) == 1
    none = toxicity(docs.limit(3), table(spark, [(1, None), (None, 1)], "doc_id long, toxic int")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 0)}
    assert toxicity(table(spark, []), known).count() == 0


def plain_ftrl(examples, epochs, alpha, beta, l1, l2, positive):
    """FTRL-proximal over dicts, one coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        shrunk = 0.0 if i != "bias" and abs(zi) <= l1 else zi - (0.0 if i == "bias" else (1 if zi > 0 else -1) * l1)
        return -shrunk / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for y, x in examples:
            w = {i: weight(i) for i in [*x, "bias"]}
            g = (1 / (1 + np.exp(-sum(w.values()))) - y) * (positive if y else 1.0)
            for i, wi in w.items():
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * wi
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_ftrl_equals_a_plain_version():
    from splicery.llm.toxicity import ftrl

    rng = random.Random(12)
    rows = []
    for _ in range(200):
        y = int(rng.random() < 0.3)
        rows.append((y, sorted({*(rng.randint(0, 60) for _ in range(8)), *([61 + rng.randint(0, 2)] if y else [])})))
    for l1, l2 in ((1.0, 1.0), (3.0, 0.0)):
        at, w, bias = ftrl([(y, np.array(x)) for y, x in rows], bits=8, epochs=3, alpha=0.5, beta=1.0, l1=l1, l2=l2, min_docs=0, positive=2.0)
        want = plain_ftrl(rows, 3, 0.5, 1.0, l1, l2, 2.0)
        assert bias == pytest.approx(want.pop("bias"))
        got = dict(zip(at.tolist(), w.tolist(), strict=True))
        assert got == pytest.approx({i: x for i, x in want.items() if x}) and 0 < len(got) < 64


def test_toxicity_learns_from_one_text_a_key_and_bounds_its_task(spark):
    from splicery.llm import toxicity as t

    labels = table(spark, [(1, 1), (2, 0)], "doc_id long, toxic int")
    docs = table(spark, [(1, "vile words here")] * 400 + [(2, "kind words")] * 100 + [(2, "other words")])
    known = labels.groupBy("doc_id").agg(F.max("toxic").alias("y")).withColumn("ord", F.xxhash64(F.lit(5), "doc_id"))
    rows = docs.join(known, "doc_id").groupBy("ord", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    seen = rows.mapInArrow(t._examples, "ord long, y int, x array<int>").collect()
    assert len(seen) == 2
    x = np.arange(0, 300_000, 3)
    few = t._fewest(x)
    assert len(few) == t.MAX_FEATURES and set(few) <= set(x) and (np.diff(few) > 0).all() and (t._fewest(x[:10]) == x[:10]).all()
    one = t.train(docs, labels)
    same = t.train(docs.dropDuplicates(), labels)
    assert (one[0] == same[0]).all() and one[1] == pytest.approx(same[1]) and one[2] == pytest.approx(same[2])


# -- pages ------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>More</a></ul></nav>
<!-- ad --><div class="ad">Buy now.</div><article class=post><h1>The  title &amp; so on</h1><p><b>First words of it.<br><p>Second &lt;paragraph&gt; with a <a href=x>link</a> in it.</p><blockquote>A quote that is long enough.</blockquote>
<div class="share-bar">Share</div><ul><li>one item of a list.</li><li>two items.</li></ul></article><div id="comments"><p>I liked this article a lot, thank you all.</p></div><form><p>Your mail here, please.</p></form><footer>&copy; me</footer></body></html>"""


FIRST = "This is the first long sentence of the article, which has many words in it."
SECOND = "This is the second long sentence of the article, with words too."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><svg width='1'/><p>{}</p><object data='a' /><p>{}</p></article>", f"{FIRST} {SECOND}"),
        ("<article><p>{}</p><p><svg class=a/><title>no text</title></svg>{}</p></article>", f"{FIRST} {SECOND}"),
        ("<article><p>{} So <math><mi>x</mi><mo>=</mo><mn>1</mn><mspace/><annotation>x</annotation></math> and <math/>on.</p><p>{}</p></article>", f"{FIRST} So x=1 and on. {SECOND}"),
        ("<article><p>{} See <object data='a.png'>the figure</object>.</p><p>{}</p></article>", f"{FIRST} See the figure. {SECOND}"),
        ("<body><div class='layout with-sidebar'><article><p>{}</p><p>{}</p></article></div></body>", f"{FIRST} {SECOND}"),
        ("<main><div class='with-sidebar'><article><p>{}</p></article><div class='comments'><article><p>{}</p></article></div></div></main>", FIRST),
        ("<main><article><p>{}</p></article><section class='related'><article><p>{}</p></article></section></main>", FIRST),
        ("<div class='with-sidebar'><main><p>{}</p><div class='share'><p>{}</p></div></main></div>", FIRST),
        ("<div class='with-sidebar' hidden><article><p>{}</p><p>{}</p></article></div>", ""),
    ],
)
def test_html_extract_keeps_the_article_whole(page, want):
    from splicery.llm.html_extract import main_text

    assert main_text(page.format(FIRST, SECOND)) == want


def test_html_extract(spark):
    from splicery.llm.html_extract import extract_main_text, main_text, min_cut

    assert main_text(PAGE) == "The title & so on First words of it. Second <paragraph> with a link in it. A quote that is long enough. one item of a list. two items."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>open <b>never closed"), (5, "u", "</div></p>plain text that stands alone, with a full stop."), (6, "u", "<article><p>" + "x. " * 200_000), (6, "u", "<a"), (7, "u", "<" * 1000)]
    got = extract_main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.n_chars for r in got}[2] == 0 and max(r.n_chars for r in got) == 599_999
    assert extract_main_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 7)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6]
        cost = lambda keep: sum(max(0, -x) if k else max(0, x) for x, k in zip(odds, keep)) + sum(c for a, b, c in edges if keep[a] != keep[b])  # noqa: B023, E731
        best = min(cost(k) for k in itertools.product([False, True], repeat=n))
        assert cost(min_cut(odds, edges)) == pytest.approx(best)


def test_the_cut_decides_labels(spark):
    """Extraction against the cheapest of all labellings of a page's graph; and blocks whose own text says otherwise follow their section."""
    from splicery.llm import html_extract as h

    weights = h.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    rng = random.Random(4)
    texts = ["Be.", "One.", "Home", "A sentence of quite some words, long enough to look like an article.", "Another sentence, with more of the words that texts have, so it goes on.", "© a.b 2020"]
    for _ in range(25):
        parts = []
        for _ in range(rng.randint(1, 3)):
            tag = rng.choice(["article", "nav", "div", "section class=related", "div class=body"])
            inner = "".join(f"<{t}>{rng.choice(texts)}</{t}>" for t in rng.choices(["p", "li", "h2", "div"], k=rng.randint(1, 2)))
            parts.append(f"<{tag}>{inner}</{tag.split()[0]}>")
        blocks = h.blocks_of("<body>" + "".join(parts))
        own = [h.own_odds(b, weights) for b in blocks]
        odds, edges = h.graph_of(blocks, own)
        cost = lambda keep: sum(max(0, -x) if k else max(0, x) for x, k in zip(odds, keep)) + sum(c for a, b, c in edges if keep[a] != keep[b])  # noqa: B023, E731
        assert cost(h.min_cut(odds, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=len(odds)))))
    page = f"<body><nav><p>{texts[3]}</p></nav><div>{texts[4]}</div><article><h1>Be.</h1><p>{texts[3]}</p><p>One.</p><p>{texts[4]}</p></article>"
    blocks = h.blocks_of(page)
    own = [h.own_odds(b, weights) > 0 for b in blocks]
    kept = [b.text in h.main_text(page, weights) for b in blocks]
    assert own[:3] == [True, True, False] and h.main_text(page, weights) == f"Be. {texts[3]} One. {texts[4]}" and own != kept
    # Without any marked section the short paragraphs still follow those beside them.
    plain = re.sub("nav|article", "div", page.replace("nav>", "ul>").replace(f"<p>{texts[3]}</p></ul>", "<li><a href=x>Home</a><li><a href=y>More</a></ul>"))
    assert "One." in h.main_text(plain, weights) and "Home" not in h.main_text(plain, weights)
    assert (h.fit(spark.createDataFrame([("<p>x</p>",), (None,)], "html string")) == np.array(h.FALLBACK)).all()


# -- pieces -----------------------------------------------------------------------------------


def all_paths(m, word):
    out = []

    def go(i, ids, s):
        if i == len(word):
            out.append((s, ids))
        for j in range(i + 1, min(len(word), i + m.longest) + 1):
            if got := m.score.get(word[i:j]):
                go(j, (*ids, got[0]), s + got[1])
            elif j == i + 1:
                go(j, ids + m.bytes_of(word[i]), s + m.unknown)

    go(0, (), 0.0)
    return sorted(out, key=lambda x: -x[0])


def with_changes(m, text, changes):
    """Ids of a segmentation, from the best of each word and its changed words."""
    changed = dict(changes)
    return [i for k, w in enumerate(m.words_of(text)) for i in changed.get(k, m.search(m.lattice_of(w), 1)[0][1])]


@pytest.mark.parametrize("text", ["the", "thin ing", "abc d", "a\nb é", "日x", "  two", "x▁y", "end ", " ", "▁", "q q q"])
def test_n_best_equals_all_paths(text):
    from splicery.llm.pieces import pieces

    m = pieces(PIECES)
    whole = "".join(m.lattice_of(w) for w in m.words_of(text))
    ids, ranked = m.encode([text])[0]
    want = all_paths(m, whole)
    assert [s for s, _ in ranked] == pytest.approx([s for s, _ in want[:4]])
    assert [s for s, _ in m.search(whole, 4)] == pytest.approx([s for s, _ in want[:4]])
    seen = set()
    for s, changes in ranked:
        path = with_changes(m, text, changes)
        assert m.decode(path) == text and (round(s, 3), tuple(path)) in {(round(a, 3), b) for a, b in want}
        seen.add(tuple(path))
    assert len(seen) == len(ranked) and m.decode(ids.tolist()) == text


def test_long_words_without_spaces():
    """The pass over an automaton's matches against the edges themselves; and what a worker keeps is bounded by its code points."""
    from splicery.llm import pieces as p

    m = p.Pieces(PIECES)
    rng = random.Random(2)
    for _ in range(30):
        word = p.SPACE * rng.randint(1, 3) + "".join(rng.choice(["日", "本", "the", "ing", "é", "\U0001f600", "x", p._OWN, "q"]) for _ in range(rng.randint(1, 90)))
        best = [0.0]
        for end in range(1, len(word) + 1):
            best.append(max(best[start] + s for start, _, s in m.edges(word, end)))
        assert m.forward(word) == best
    text = "日本語の文章" * 20_000
    ids, _ = m.encode([text])[0]
    assert m.decode(ids.tolist()) == text
    m.chars = p.KEPT_CHARS + 1
    m.encode(["a"])
    assert len(m.known) == 1


def test_pieces_on_tables(spark):
    from splicery.llm.pieces import encode_pieces

    rows = EDGES + [(50, "x" * 300 + " " * 40 + "y ▁▁ z"), (51, "\x00\x01 \U0001f600")]
    got = encode_pieces(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", pieces int"), PIECES).collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_pieces == len(r.pieces) for r in got)
    assert all((r.n_pieces, r.n_best, r.best_score) == (0, 1, 0.0) for r in got if not r.text)
    assert all(r.last_score <= r.best_score for r in got)
    assert encode_pieces(table(spark, []), PIECES).count() == 0


# -- licenses ---------------------------------------------------------------------------------


def test_license_scan(spark):
    from splicery.llm.license_scan import BASE, parse_expression, scan_licenses

    assert parse_expression("MIT OR (Apache-2.0 AND GPL-2.0+ WITH Classpath-exception-2.0)") == (["mit", "apache-2.0", "gpl-2.0"], 1.0)
    assert parse_expression("MIT AND GPL-3.0-only OR CC-BY-NC-4.0") == (["mit", "gpl-3.0-only", "cc-by-nc-4.0"], 0.4)
    assert all(parse_expression(x) is None for x in ("MIT OR", "(MIT", "MIT)", "OR MIT", "MIT MIT", "()", ""))
    extra = [
        "Mit  License, mit-license", "GNU\nGeneral Public License; see the MIT\tLicense", "limit license", "cc by cc by-NC 4.0", "x\nSPDX-License-Identifier: (MIT OR Apache-2.0)\n", "SPDX-License-Identifier: nonsense and and MIT",
        "élan mit license é", LONG + " apache license", "Copyright. All rights reserved.", "mit license mit license",
    ]
    rows = EDGES + [(60 + i, t) for i, t in enumerate(extra)]
    got = scan_licenses(spark.createDataFrame([(*r, "s") for r in rows], DOCS + ", score string")).collect()
    assert len(got) == len(rows)
    for r in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text or ""))
        at = [(k, label) for phrase, label in BASE.items() for q in [phrase.split()] for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[64].labels == "apache-2.0,mit" and by[64].score == 1.0 and by[63].labels == "cc-by,cc-by-nc" and by[65].labels == "mit"
    assert scan_licenses(table(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("Under the MIT License or the GNU General Public License, version 3.", "gpl,mit", 1.0),
        ("Under the MIT License and the GNU General Public License.", "gpl,mit", 0.4),
        ("GNU General Public License, version 2 or later, with the Classpath Exception", "gpl", 0.4),
        ("GNU General Public License version 2 or any later version, or Apache License", "apache,gpl", 1.0),
        ("MIT License or Apache License and CC BY-NC 4.0", "apache,cc-by,cc-by-nc,mit", 1.0),
        ("MIT License. Some other text stands here. CC BY-NC 4.0", "cc-by,cc-by-nc,mit", 0.2),
        ("Classpath exception", "", 0.0),
        ("SPDX-License-Identifier: Zlib AND (ISC OR SSPL-1.0)", "isc,sspl-1.0,zlib", 1.0),
    ],
)
def test_notices_are_expressions(text, labels, score):
    from splicery.llm.license_scan import scan_text

    got = scan_text(text)
    assert (got[4], got[5]) == (labels, score)


def test_expressions_equal_a_plain_evaluation():
    from splicery.llm.license_scan import openness, parse_expression

    rng = random.Random(11)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(["MIT", "GPL-2.0", "CC-BY-NC-4.0", "MPL-2.0", "Thing"])
            return (f"{name} WITH X-exception" if rng.random() < 0.2 else name), openness(name.lower())
        op = rng.choice(["AND", "OR"])
        (a, x), (b, y) = made(depth - 1), made(depth - 1)
        return f"({a}) {op} ({b})", (min if op == "AND" else max)(x, y)

    for _ in range(200):
        text, value = made(4)
        assert parse_expression(text)[1] == value
    assert parse_expression("MIT OR GPL-2.0 AND CC-BY-NC-4.0")[1] == 1.0 and parse_expression("(MIT OR GPL-2.0) AND CC-BY-NC-4.0")[1] == 0.2


# -- fingerprints -----------------------------------------------------------------------------


def spark_hash(*xs):
    """xxhash64() of strings, longs and ints, seed 42, as a signed long."""
    seed = 42
    for x, width in xs:
        seed = xxhash.xxh64_intdigest(x.encode() if width == 0 else (x % (1 << 8 * width)).to_bytes(width, "little"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_parts(text, m=24):
    """Order MinHash by hand: numbered 3-word runs, and for each function the two smallest in text order."""
    w = [spark_hash((x, 0)) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not w:
        return None
    seen, ids = {}, []
    for i in range(max(1, len(w) - 2)):
        h = spark_hash(*[(x, 8) for x in w[i : i + 3]])
        ids.append(spark_hash((h, 8), (seen.setdefault(h, 0), 4)))
        seen[h] += 1
    parts = []
    for j in range(1, m + 1):
        ranked = sorted((spark_hash((j, 4), (x, 8)), at) for at, x in enumerate(ids))[:2]
        ranked.sort(key=lambda r: r[1])
        pair = [(y, 8) for y, _ in ranked]
        parts.append(spark_hash(*(pair if len(pair) == 2 else [*pair, (0, 4)])) & 0xFFFFFFFF)
    return parts


def test_parts_equal_a_plain_version(spark):
    from splicery.llm import fingerprint as f

    rng = random.Random(3)
    texts = ["a b c", "a b", "", " \n", "a b a b a b a b", " ".join(f"w{i % 70} x y" for i in range(300)), "a b c d e f g h a b c", "q " * 500, "é 日 x"]
    texts += [" ".join(f"w{rng.randint(0, top)}" for _ in range(rng.randint(3, 400))) for top in (2, 3, 9, 9, 400, 400)]
    for r in table(spark, list(enumerate(texts))).select("text", f.parts_of(F.col("text")).alias("parts")).collect():
        assert r.parts == plain_parts(r.text), r.text[:40]


@pytest.mark.parametrize("keys", ["distinct", "one", "null", "few"])
def test_next_text_with_hot_keys(spark, keys):
    """Every row meets the next one in descending key order, ties by text hash, whatever the share of one key or of nulls."""
    from splicery.llm.fingerprint import with_next

    rng = random.Random(5)
    name = {"distinct": lambda i: i, "one": lambda i: 7 if i % 3 else i, "null": lambda i: None if i % 3 == 0 else i, "few": lambda i: i % 4}[keys]
    rows = [(name(i), f"text {rng.randint(0, 10**9)}") for i in range(600)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), spark_hash((r[1], 0))))
    want = {(k, t): order[(i + 1) % len(order)][1] for i, (k, t) in enumerate(order)}
    found = with_next(table(spark, rows).repartition(5))
    got = found.filter("not guest").collect()
    assert len(got) == len(rows) and {(r.key, r.text): r.next_text for r in got} == want
    sizes = [r["count"] for r in found.groupBy("range").count().collect()]
    assert max(sizes) <= 200


def test_fingerprints(spark):
    from splicery.llm.fingerprint import fingerprints

    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(30, 200)))) for i in range(40)] + [(i, rows_text) for i, rows_text in [(90, "same text here now"), (91, "same text here now"), (92, "")]]
    got = {r.doc_id: r for r in fingerprints(table(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)]
        q = len(t) // 3
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - q] + nxt[1][:q]).encode()).hexdigest()
        parts = lambda s: [s[j : j + 8] for j in range(0, len(s), 8)]
        a, b = parts(got[i].fingerprint), parts(got[nxt[0]].fingerprint)
        assert got[i].near_next == pytest.approx(1.0 if not a and not b else sum(x == y for x, y in zip(a, b)) / 24)
    assert got[90].fingerprint == got[91].fingerprint and got[92].fingerprint == "" and got[92].near_edited == 1.0
    near = [got[i].near_edited for i in range(40)]
    assert np.mean(near) > 0.15 and max(got[i].near_next for i in range(1, 40)) < 0.1
    assert len(fingerprints(table(spark, EDGES)).collect()) == len(EDGES)
    assert fingerprints(table(spark, [])).count() == 0 and fingerprints(table(spark, [(1, "x y z")])).first().near_next == 1.0
    assert fingerprints(spark.createDataFrame([(1, "x", "r")], DOCS + ", range string")).count() == 1


def test_order_matters_to_a_fingerprint(spark):
    from splicery.llm.fingerprint import fingerprints

    words = [f"w{i}" for i in range(200)]
    blocks = [words[i : i + 20] for i in range(0, 200, 20)]
    moved = list(itertools.chain.from_iterable(blocks[::-1]))
    got = {r.doc_id: r.near_next for r in fingerprints(table(spark, [(3, " ".join(words)), (2, " ".join(moved)), (1, "z")])).collect()}
    assert got[3] < 0.7  # nearly all 3-word runs are shared, yet blocks in another order


# -- token files ------------------------------------------------------------------------------


def test_token_files(spark):
    from tokenizers import Tokenizer

    from splicery.llm.token_output import token_files

    model = Tokenizer.from_file(BPE)
    rows = EDGES + [(70 + i, t) for i, t in enumerate(["a  b", "it's <|endoftext|> x 's\n a", "a\xa0 b", "　x y", "x ", " lead", "a\0 \0b c", "y" * 500 + " z", "日本" * 300 + " a", "don't stop\r\nnow", "a \x1cb c"])]
    got = token_files(spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", start int").repartition(3), BPE, end_id=2).collect()
    assert len(got) == len(rows)
    start = 0
    for (i, t), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")), sorted(got, key=lambda r: r.start), strict=True):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files(table(spark, []), BPE, end_id=2).count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_segments_round_trip(n):
    from splicery.llm.token_output import read_segment, write_segment

    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 2**32, n, dtype=np.uint32), rng.integers(0, 50_000, n, dtype=np.uint32) >> rng.integers(0, 16, n, dtype=np.uint32), np.full(n, 7, np.uint32)):
        lengths, back = read_segment(write_segment([n], ids))
        assert lengths.tolist() == [n] and (back == ids).all()


# -- words ------------------------------------------------------------------------------------


def test_words_match_a_regular_expression():
    from splicery.llm import words as w

    texts = [t for _, t in EDGES if t is not None] + ["é", "a" * 5, " é a", "\x0b\x1cx"]
    for is_word, pattern in ((w.NOT_WHITE, r"[^\x20\x09-\x0D]+"), (w.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = {}
        for block in w.words(pa.array([*texts, None]), is_word):
            for r, h in zip(block.row.tolist(), block.hash.tolist(), strict=True):
                found.setdefault(block.first + r, []).append(h)
        names = {}
        for i, t in enumerate(texts):
            own = re.findall(pattern, lower(t))
            assert len(own) == len(found.get(i, []))
            for word, h in zip(own, found.get(i, []), strict=True):
                assert names.setdefault(word, h) == h
        assert len(set(names.values())) == len(names)


def test_a_long_text_is_scanned_in_windows(monkeypatch):
    from splicery.llm import words as w

    text = " ".join(f"word{i}" for i in range(5000))
    whole = next(w.words(pa.array([text]), w.NOT_WHITE)).hash
    monkeypatch.setattr(w, "BLOCK", 1000)
    assert (next(w.words(pa.array([text]), w.NOT_WHITE)).hash == whole).all()


def test_encoder_equals_the_library_on_odd_texts():
    import pyarrow as pa
    import public_tokenizers

    from splicery.llm.token_output import Encoder

    odd = ["", None, " ", "  a", "a  b", "a ", "\n", "a\n\nb c", "x\0y z", "\0", "é" * 300, "a " + "b" * 200 + " c", "日本語 テキスト", " \t x", "don't we'll", "\x1c a\x1cb", "a b", "a b"]
    encode = Encoder(public_tokenizers.path("byte_bpe_50k.json"), 2)
    for part in (odd, odd[::-1], []):  # the second time from known words
        ids, lengths = encode(pa.array(part, pa.string()))
        want = [[*encode.model.encode(t or "", add_special_tokens=False).ids, 2] for t in part]
        assert lengths.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]
