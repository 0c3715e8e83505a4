"""The pipeline's stages, each on what its predecessor kept, against plain versions."""

import hashlib
import re

import corpus_pipeline as cp
from splicery.llm.mixing import mix
from splicery.llm.toxicity import toxicity
from test_operators import plain_lines, plain_near

SMALL = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def plain_stream(rows):
    """Uses of documents in training order. In the order of MD5(doc_id), pass after pass, a source gives words up to its target; the use in
    which that ends is whole if at least half of it is inside."""
    by, uses = {}, []
    for r in rows:
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    for i, name in enumerate(names):
        own = sorted(by[name], key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest())
        slope, target, c = (-0.5, 0.25, 0.75)[i % 3], own[0].target, 0
        for r in own * 3:
            words = min(r.size, int(target + 0.5) - c)
            if words > 0 and 2 * words >= r.size:
                done = c / target
                uses.append((2 * done / ((1 - slope) + ((1 - slope) ** 2 + 4 * slope * done) ** 0.5), r.doc_id, r))
            c += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    return [r for _, _, r in sorted(uses, key=lambda u: u[:2])]


def test_stages(spark, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "pieces"] and cp.ORACLE_SQL is None
    docs, seen = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    first = docs
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs = spark.read.parquet(str(tmp_path / name))
        if name != "pieces":
            assert docs.columns == first.columns
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    clean = {r.doc_id for r in toxicity(first, labels).filter("predicted = 0").collect()}
    assert {i for i, _ in pairs(seen["toxicity"])} == clean
    assert sorted(pairs(seen["line_dedup"]), key=repr) == sorted(((i, t) for i, _, _, t in plain_lines(pairs(seen["toxicity"]))), key=repr)
    near = plain_near(pairs(seen["line_dedup"]))
    assert {i for i, _ in pairs(seen["near_dedup"])} == {i for i, (_, c) in near.items() if i == c}
    mixed = plain_stream(mix(seen["near_dedup"]).collect())
    assert sorted(pairs(seen["mixing"]), key=repr) == sorted(((r.doc_id, r.text) for r in mixed), key=repr)
    ordered = sorted(seen["pieces"].collect(), key=lambda r: r.training_order)
    assert [r.training_order for r in ordered] == list(range(len(mixed))) and [r.doc_id for r in ordered] == [r.doc_id for r in mixed]
    assert all(r.round_trip for r in seen["pieces"].collect())
    assert sorted(pairs(cp.run(spark, SMALL)), key=repr) == sorted(pairs(seen["pieces"]), key=repr)


def test_mixing_takes_documents_whole(spark):
    text = lambda n: "\n".join(f"w{i}" for i in range(n))
    rows = [(i, text(40 + i), "en", "abc"[i % 3], 0) for i in range(60)]
    out = cp.mix_sources(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SMALL).collect()
    texts = {r[0]: r[1] for r in rows}
    assert out and all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in out)
    size = {s: sum(40 + i for i in range(60) if "abc"[i % 3] == s) for s in "abc"}
    for s, weight in zip("abc", (5, 2, 1), strict=True):
        words = sum(len(r.text.split()) for r in out if r.source == s)
        assert abs(words - sum(size.values()) * weight / 8) <= 50


def test_an_empty_table_goes_through(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
