"""The timeline operators: a plain fold as model, example programs' offsets, one exact graph, edge cases, and the SQL of each query."""

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from splicery import queries as timeline
from splicery.functions import times, values
from splicery.operators import overlays, resolve, schedule, signal
from splicery.plans import filters
from splicery.sources import tables

SMALL = "/root/testdata/sf0.001"


def fold(items):
    """(action, start) of producing items: the schedule written as a loop."""
    out, total, segments, pending = [], 0.0, 0, None
    for kind, length in items:
        if kind == "transition":
            pending = length
            continue
        if kind == "clip" and pending is not None:
            if segments:
                out.append(("merge", max(total - pending, 0.0)))
                total += length - pending
            else:
                out.append(("drop", None))
            pending = None
            continue
        out.append(("push", total))
        segments += 1
        total += length
    return out


def test_schedule_equals_the_fold(spark):
    rng = random.Random(5)
    programs = {p: [(rng.choice(["clip", "clip", "transition", "gap", "freeze"]), rng.randint(1, 40) / 4) for _ in range(rng.randint(1, 12))] for p in range(150)}
    rows = [(p, i, k, n) for p, items in programs.items() for i, (k, n) in enumerate(items)]
    got = schedule.schedule(spark.createDataFrame(rows, "program_id int, item_no int, kind string, length_sec double")).orderBy("program_id", "item_no").collect()
    found = {p: [] for p in programs}
    for r in got:
        found[r.program_id].append((r.action, r.start_sec))
    assert found == {p: fold(items) for p, items in programs.items()}


def nodes(frame, name):
    """How many operators of that name the physical plan holds."""
    return sum(line.lstrip(" :+-*(0123456789)").startswith(f"{name} ") for line in frame._jdf.queryExecution().executedPlan().toString().splitlines())


def test_schedule_is_shuffled_once_and_sorted_twice(spark):
    for name in ("schedule_offsets", "program_totals"):
        made = timeline.QUERIES[name](spark, SMALL)
        assert (nodes(made, "Exchange"), nodes(made, "Sort")) == (1, 2)


def test_scheduled_assets_reads_its_lines_once(spark):
    made = timeline.QUERIES["scheduled_assets"](spark, SMALL)
    assert (nodes(made, "FileScan"), nodes(made, "SortMergeJoin") + nodes(made, "BroadcastHashJoin")) == (1, 0)


def test_filter_rows_shuffle_narrow_lines_once(spark):
    for name in ("filter_rows", "filter_graph_render"):
        made = timeline.QUERIES[name](spark, SMALL)
        assert [nodes(made, n) for n in ("Exchange", "FileScan", "SortMergeJoin", "BroadcastHashJoin")] == [1, 1, 0, 0]


def test_graphs_of_clips_are_joined_inside_their_rows(spark):
    clips = timeline._clips(spark, SMALL).withColumn("chromakey", F.when(F.col("item_no") % 2 == 0, F.lit("#12AB34")))
    clips = clips.withColumn("speed", F.when(F.col("item_no") % 3 == 0, F.lit(0.1)).otherwise(F.col("speed")))
    size = F.lit(1280), F.lit(720)
    whole, rows = filters.filter_graphs(clips, *size), filters.rendered(filters.filter_rows(clips, *size))
    assert sorted(whole.collect()) == sorted(rows.collect()) and nodes(timeline.QUERIES["filter_graph_render"](spark, SMALL), "Generate") == 0


def test_input_numbers_in_place_equal_the_joined_ones(spark):
    rng = random.Random(8)
    rows = [(p, i, rng.choice(["a", "b", "c", "d", None]), rng.choice([0, 1, 3, None])) for p in range(60) for i in range(rng.randint(1, 12))]
    uses = spark.createDataFrame(rows, "program_id int, item_no int, asset string, kind_rank int")
    joined = uses.join(resolve.input_numbers(uses.filter("kind_rank is not null")), ["program_id", "asset"], "left").select(*uses.columns, "input_no")
    assert sorted(resolve.with_input_numbers(uses).collect(), key=str) == sorted(joined.collect(), key=str)


def test_large_tables_are_dealt_into_pieces_of_their_size(spark, monkeypatch):
    parts = lambda: tables.by_program(spark, SMALL, "lineitem", "l_orderkey").rdd.getNumPartitions()
    whole = parts()
    monkeypatch.setattr(tables, "PIECE_BYTES", 1 << 12)
    assert whole < 8 and parts() == -(-Path(SMALL, "lineitem.parquet").stat().st_size // (1 << 12))


def test_many_shuffle_partitions_do_not_merge_the_pieces_of_a_table(spark, monkeypatch):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(tables, "PIECE_BYTES", 1 << 13)
    pieces = -(-Path(SMALL, "lineitem.parquet").stat().st_size // (1 << 13))
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert 4 < pieces < 200 and timeline.QUERIES["program_totals"](spark, SMALL).rdd.getNumPartitions() == pieces
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


@pytest.mark.parametrize(
    ("items", "offsets", "total"),
    [
        ([("clip", 10.0), ("transition", 1.0), ("clip", 20.0), ("transition", 1.5), ("clip", 8.0)], [9.0, 27.5], 35.5),
        ([("clip", 15.0), ("transition", 1.0), ("clip", 15.0)], [14.0], 29.0),
        ([("clip", 10.0), ("clip", 25.0)], [], 35.0),
        ([("transition", 1.0), ("clip", 10.0)], [], 0.0),
        ([("clip", 4.0), ("transition", 1.0), ("gap", 2.0), ("clip", 3.0), ("transition", 9.0)], [5.0], 8.0),
    ],
)
def test_schedule_of_examples(spark, items, offsets, total):
    rows = [(1, i, k, n) for i, (k, n) in enumerate(items)]
    out = schedule.schedule(spark.createDataFrame(rows, "program_id int, item_no int, kind string, length_sec double"))
    assert [r.offset_sec for r in out.filter("action = 'merge'").orderBy("item_no").collect()] == offsets
    assert schedule.totals(out).first().total_sec == total


def test_graph_of_a_minimal_program(spark):
    clip = spark.range(1).select(
        F.lit(1).alias("program_id"), F.lit(0).alias("item_no"), F.lit(0).alias("input_no"), F.lit(0.0).alias("from_sec"), F.lit(10.0).alias("to_sec"), F.lit(30).alias("fps"),
        *[F.lit(None).cast("double").alias(c) for c in "brightness contrast saturation rotate blur sharpen vignette grain opacity speed volume fade_in fade_out estimate_sec zoom pan_x pan_y duration_sec".split()],
        *[F.lit(None).cast("string").alias(c) for c in ("crop", "flip", "chromakey")], *[F.lit(None).cast("boolean").alias(c) for c in ("reverse", "stabilize", "normalize")],
    )
    graph = filters.rendered(filters.filter_rows(clip, F.lit(1280), F.lit(720))).first().graph
    assert graph == "[0:v]trim=start=0:end=10,setpts=PTS-STARTPTS[tv0];[tv0]scale=1280:720[sc1];[0:a]atrim=start=0:end=10,asetpts=PTS-STARTPTS[ta2]"
    zoomed = clip.withColumn("zoom", F.lit(2.0)).withColumn("pan_x", F.lit(0.5))
    rows = filters.filter_rows(zoomed, F.lit(640), F.lit(360)).filter("output like 'zp%'").first()
    assert rows.expr == (
        "zoompan=z='if(lt(on\\,90)\\,1+on/90*1\\,if(lt(on\\,210)\\,2\\,2-(on-210)/90*1))':x='iw/2-(iw/zoom/2)+iw*0.5*(1-1/zoom)/2':y='ih/2-(ih/zoom/2)':d=1:s=640x360:fps=30"
    )


def test_speeds_outside_one_filter_are_chained(spark):
    speeds = [0.25, 0.1, 250.0, 2.0, None, 100.0, 0.5, 0.0, 10000.0]
    none = "brightness contrast saturation rotate blur sharpen vignette grain opacity fade_in fade_out estimate_sec zoom pan_x pan_y duration_sec".split()
    rows = spark.createDataFrame(list(enumerate(speeds)), "item_no int, speed double").select(
        F.lit(1).alias("program_id"), "item_no", "speed", F.lit(0).alias("input_no"), F.lit(0.0).alias("from_sec"), F.lit(10.0).alias("to_sec"), F.lit(30).alias("fps"), F.lit(0.5).alias("volume"), F.lit(True).alias("reverse"),
        *[F.lit(None).cast("double").alias(c) for c in none], *[F.lit(None).cast("string").alias(c) for c in ("crop", "flip", "chromakey")], *[F.lit(None).cast("boolean").alias(c) for c in ("stabilize", "normalize")],
    )
    got = filters.filter_rows(rows, F.lit(1280), F.lit(720)).orderBy("seq").collect()
    tempo = [[r.expr.removeprefix("atempo=") for r in got if r.clip_no == i and r.expr.startswith("atempo")] for i in range(len(speeds))]
    assert tempo == [["0.5", "0.5"], ["0.5", "0.5", "0.5", "0.8"], ["100.0", "2.5"], ["2"], [], ["100"], ["0.5"], ["0"], ["100.0", "100"]]
    assert [r.seq for r in got] == list(range(len(got))) and all(r.output.lstrip("abcdefghijklmnopqrstuvwxyz") == str(r.seq) for r in got)
    first = [(r.input, r.expr, r.output) for r in got if r.clip_no == 0 and r.seq >= 4]
    assert first == [
        ("0:a", "atrim=start=0:end=10,asetpts=PTS-STARTPTS", "ta4"), ("ta4", "volume=0.5", "vol5"), ("vol5", "atempo=0.5", "at6"), ("at6", "atempo=0.5", "at7"), ("at7", "areverse", "arev8"),
    ]


def test_long_include_chains_are_followed_to_their_end(spark):
    n = 70
    chain = spark.range(n).select(F.concat(F.lit("f"), "id").alias("source"), F.concat(F.lit("f"), F.col("id") + 1).alias("target"))
    back = spark.createDataFrame([(f"f{n}", "f0"), ("f5", "lost")], "source string, target string")
    fragments = spark.range(n + 1).select(F.concat(F.lit("f"), "id").alias("fragment"))
    roots = spark.createDataFrame([("f0",), ("f60",)], "root string")
    got = [tuple(r) for r in resolve.merged_fragments(fragments, chain.unionByName(back), roots).collect()]
    assert len(got) == len(set(got)) and set(got) == {(r, f"f{i}") for r in ("f0", "f60") for i in range(n + 1)}


def test_gaps_are_filled_to_the_last_frame(spark, tmp_path):
    rows = [(1, 1, "a", "2024-01-01 00:00:00", 2.0), (2, 1, "b", "2024-02-01 00:00:00", 4.0)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.asset, r.frame): r.v for r in timeline.gap_fill(spark, str(tmp_path)).collect()}
    assert got == {(a, f): 0.0 for a in "ab" for f in range(745)} | {("a", 0): 2.0, ("b", 744): 4.0}
    assert signal.gap_filled(tables.frames(tables.signal(spark, SMALL), 24, "asset").limit(0), spark.createDataFrame([("a",)], "asset string"), 0, 720).count() == 720


def test_saturation_spreads_a_frame_around_its_mean(spark):
    rows = spark.createDataFrame([("a", 0, 4.0), ("a", 1, 2.0), ("b", 0, 1.0), ("b", 1, 2.0), ("c", 1, 5.0)], "asset string, frame long, v double")
    got = {(r.asset, r.frame): r.v for r in signal.graded(rows, 0.1, 0.8, 1.5).collect()}
    eq = {k: (v - 0.5) * 0.8 + 0.6 for k, v in {("a", 0): 1.0, ("a", 1): 0.5, ("b", 0): 0.5, ("b", 1): 1.0, ("c", 1): 1.0}.items()}
    for (asset, frame), v in eq.items():
        own = [x for (_, f), x in eq.items() if f == frame]
        mean = sum(own) / len(own)
        assert got[asset, frame] == pytest.approx(mean + (v - mean) * 1.5)
    assert len(got) == len(eq)
    grey = signal.graded(rows, saturation=0.0).filter("frame = 0").collect()
    assert grey[0].v == grey[1].v and len(grey) == 2


def test_output_args(spark):
    out = spark.createDataFrame([("x.mp4", 30, 1280, 720, "mp4", "h264", "high")], "path string, fps int, width int, height int, format string, codec string, quality string")
    args = filters.output_args(out, values.encoder_table(spark), values.quality_table(spark)).first().args
    assert args == ["-c:v", "libx264", "-preset", "slow", "-crf", "18", "-r", "30", "-s", "1280x720", "x.mp4"]
    bare = spark.range(1).select(filters.command_text(F.array(F.lit("a.mp4")), F.lit(None).cast("string"), F.array().cast("array<string>"), F.array(F.lit("o.mp4"))).alias("c")).first().c
    assert bare == "ffmpeg -y -i a.mp4 o.mp4"


def test_media_length_priority(spark):
    items = spark.createDataFrame(
        [(1, 1, "v", 10.0, 30.0, 5.0, None), (1, 2, "v", 10.0, 30.0, None, None), (1, 3, "v", 100.0, None, None, 2.0), (1, 4, "v", None, 30.0, None, None), (1, 5, "x", None, 9.0, None, 2.0)],
        "program_id int, item_no int, asset string, from_sec double, to_sec double, duration_sec double, speed double",
    )
    probe = spark.createDataFrame([("v", 120.0, False)], "asset string, probe_sec double, has_audio boolean")
    got = {r.item_no: (r.resolved_sec, r.estimate_sec, r.has_audio) for r in resolve.media_lengths(items, probe).collect()}
    assert got == {1: (5.0, 5.0, False), 2: (20.0, 20.0, False), 3: (10.0, 10.0, False), 4: (120.0, 120.0, False), 5: (None, 5.0, True)}


def test_rules_take_their_bounds(spark):
    rows = [("volume", 1.0), ("volume", 1.01), ("speed", 0.0), ("speed", 100.0), ("sharpen", 0.0), ("sharpen", 9e9), ("loop", 0.0), ("loop", 1.0), ("unknown", -5.0), ("zoom", 0.5), ("pan_x", -1.0), ("blur", None)]
    attrs = spark.createDataFrame(rows, "key string, value double")
    bad = resolve.rule_errors(attrs, values.range_rules(spark)).collect()
    assert sorted((r.key, r.value) for r in bad) == [("loop", 0.0), ("sharpen", 0.0), ("speed", 0.0), ("volume", 1.01), ("zoom", 0.5)]


def test_interval_join_is_closed_and_skips_empty_intervals(spark):
    s = spark.createDataFrame([(0, 0.9999), (1, 1.0), (2, 2.5), (3, 4.0), (4, 4.0001), (5, None)], "k int, t double")
    o = spark.createDataFrame([(1, 1.0, 4.0), (2, 4.0, 1.0), (3, -3.5, 1.0)], "o int, start_sec double, end_sec double")
    assert sorted((r.o, r.k) for r in overlays.interval_join(s, o).collect()) == [(1, 1), (1, 2), (1, 3), (3, 0), (3, 1)]


def test_cues_of_a_long_conversation_keep_all_frames(spark, tmp_path):
    turns = [(1, 1, 4990), (1, 2, 125), (1, 3, 0), (1, 4, 9000), (2, 1, None), (2, 2, 10)]
    rows = [(c, t, "user", None if n is None else "x" * n) for c, t, n in turns]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want, read = [], {}
    for c, t, n in turns:
        first = read.get(c, 0)
        last = read[c] = first + (n or 0)
        want += [(c, t, f) for f in range(1000) if first * 24 <= f * 500 <= last * 24]
    got = [tuple(r) for r in timeline.subtitle_cues(spark, str(tmp_path)).collect()]
    assert sorted(got) == want and max(f for _, _, f in want) > 240


def test_tempo_steps_multiply_to_the_factor(spark):
    rows = spark.createDataFrame([(x,) for x in (0.01, 0.1, 0.25, 0.49, 0.5, 1.0, 3.0, 100.0, 101.0, 12345.0)], "x double")
    for r in rows.select("x", signal.tempo_steps(F.col("x")).alias("steps")).collect():
        product = 1.0
        for s in r.steps:
            assert 0.5 <= s <= 100
            product *= s
        assert product == pytest.approx(r.x)


def test_literals(spark):
    row = spark.sql("SELECT 1").select(
        times.number_text(F.lit(10.0)).alias("a"), times.number_text(F.lit(1e7)).alias("b"), times.number_text(F.lit(0.25)).alias("c"), times.to_count(F.lit("int"), F.lit(2**32 + 3)).alias("d"),
        times.to_count(F.lit("int"), F.lit(-1)).alias("e"), times.smpte_seconds(F.lit("00:00:01:15"), F.lit(0)).alias("f"), times.to_number(F.lit("int"), F.lit(3), F.lit(None)).alias("g"),
    ).first()
    assert tuple(row) == ("10", "10000000", "0.25", 3, None, None, 3.0)


def test_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text('title,subtitle\nOne,"a, b"\nTwo,c\n')
    assert [tuple(r) for r in tables.read_params(spark, str(tmp_path / "p.csv")).collect()] == [("One", "a, b"), ("Two", "c")]
    (tmp_path / "s.srt").write_text("1\n00:00:01,500 --> 00:00:03,000\nHello\nthere\n\n2\n00:01:00,000 --> 00:01:02,250\nBye\n")
    cues = tables.read_cues(spark, str(tmp_path / "s.srt")).orderBy("start_sec").collect()
    assert [(r.start_sec, r.end_sec, r.content) for r in cues] == [(1.5, 3.0, "Hello\nthere"), (60.0, 62.25, "Bye")]


def test_streams(spark, tmp_path):
    from splicery.streaming import live

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("frame= 10 fps=24 time=00:00:01.00 speed=2.0x\nnoise\n")
    q = live.progress_stream(spark.readStream.schema("value string").text(str(source))).writeStream.format("memory").queryName("progress").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [tuple(r) for r in spark.table("progress").collect()] == [(10, 24.0, 1.0, 2.0)]

    events = tables.table(spark, SMALL, "events").select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = live.windowed_means(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), "1 day", "2 hours")
    q = stream.writeStream.format("memory").queryName("means").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("means").agg(F.sum("n")).first()[0] == events.count()


def test_trim_reaches_the_scan(spark):
    plan = timeline.trim_rebase(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan and "props" not in plan


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted((tuple(None if v is None or v != v else round(v, 6) if isinstance(v, float) else v for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(timeline.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = timeline.QUERIES[name](spark, SMALL).toPandas(), duck.sql(timeline.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    # Numbers of either engine as floats: 3 and 3.0 are the same value.
    same = lambda f: rows_of(f.apply(lambda c: c.astype(float) if c.dtype.kind in "iuf" or str(c.dtype).startswith("Int") else c))
    assert same(got) == same(want)


def test_every_query_has_sql():
    assert set(timeline.QUERIES) == set(timeline.ORACLE_SQL)


def test_entry_imports_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "splicery", tmp_path / "splicery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) == len(timeline.QUERIES)


def test_intermediate_tables_are_shared_and_taken_away(spark, tmp_path):
    from splicery.sources.shared import scratch, shared_dir, stored

    with scratch(spark):
        where = shared_dir(spark)
        out = stored(spark.range(3), "t", where)
        out.write.parquet(str(tmp_path / "kept"))
        assert Path(where).is_dir() and where.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert not Path(where).exists() and spark.read.parquet(str(tmp_path / "kept")).count() == 3


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace as N

    from splicery.sources.shared import shared_dir

    none = N(isDefined=lambda: False)
    context = lambda master: N(master=master, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(N(conf=N(get=lambda *_: None), sparkContext=context("spark://host:7077")))
    assert "splicery-" in shared_dir(N(conf=N(get=lambda *_: None), sparkContext=context("local[2]")))
