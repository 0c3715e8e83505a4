"""Queries over whole programs with every kind of item, and their DuckDB SQL.

An order is a program; its line items are clips of video and audio tracks, transitions, gaps, freezes, texts, images, pips and
subtitles with every effect. ATTRIBUTES are expressions that both engines read; the graph's SQL works on one row a filter and
numbers labels by running sums over rows, where the library works on arrays inside an item's row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splicery.functions import values
from splicery.operators import checks, resolve
from splicery.plans import filters, graph
from splicery.sources import tables


def num(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN floor({x})::BIGINT::VARCHAR ELSE {x}::VARCHAR END)"


def schedule_sql(lengths: str) -> str:
    """The fold over items (program_id, item_no, kind, asset, from_sec, to_sec, speed, length_sec) as windows."""
    return f"""(WITH s1 AS (SELECT *, coalesce(sum((kind = 'clip')::INT) OVER (PARTITION BY program_id ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM {lengths}),
 s2 AS (SELECT *, CASE WHEN kind = 'clip' THEN last_value(CASE WHEN kind = 'transition' THEN length_sec END IGNORE NULLS) OVER (PARTITION BY program_id, grp ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS pending FROM s1),
 s3 AS (SELECT *, min(CASE WHEN kind IN ('gap', 'freeze') OR (kind = 'clip' AND pending IS NULL) THEN item_no END) OVER (PARTITION BY program_id) AS f FROM s2),
 s4 AS (SELECT *, CASE WHEN kind = 'clip' AND pending IS NOT NULL THEN CASE WHEN f IS NULL OR item_no < f THEN 'drop' ELSE 'merge' END ELSE 'push' END AS action FROM s3 WHERE kind <> 'transition'),
 s5 AS (SELECT *, coalesce(sum(CASE action WHEN 'push' THEN length_sec WHEN 'merge' THEN length_sec - pending ELSE 0 END) OVER (PARTITION BY program_id ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS so_far,
  sum((action = 'push')::INT) OVER (PARTITION BY program_id ORDER BY item_no)::BIGINT - 1 AS seg FROM s4)
 SELECT program_id, item_no, kind, asset, from_sec, to_sec, speed, length_sec, pending, action, CASE WHEN action = 'merge' THEN greatest(so_far - pending, 0.0) END AS offset_sec,
  CASE action WHEN 'push' THEN so_far WHEN 'merge' THEN greatest(so_far - pending, 0.0) END AS start_sec, CASE WHEN action <> 'drop' THEN seg END AS segment_no FROM s5)"""


_d = lambda x: f"CAST({x} AS DOUBLE)"
_on = lambda m, r, kinds, x: f"CASE WHEN kind IN ({kinds}) AND p % {m} = {r} THEN {x} END"
_C = "'clip'"
#: Attributes of an item from its kind and p, a number of its line.
ATTRIBUTES = {
    "from_sec": _d(f"CASE WHEN kind IN ('clip', 'pip') AND p % 3 <> 0 THEN (p % 9) / 2.0 END"),
    "to_sec": _d(f"CASE WHEN kind IN ('clip', 'pip') AND p % 4 <> 0 THEN 6 + (p % 13) / 2.0 END"),
    "duration_sec": _d("CASE WHEN kind = 'clip' THEN CASE WHEN p % 5 = 0 THEN 3 + (p % 6) / 2.0 END WHEN kind = 'subtitle' THEN NULL WHEN p % 4 <> 0 THEN 1 + (p % 5) / 4.0 END"),
    "at_sec": _d("CASE WHEN kind IN ('freeze', 'text', 'image', 'pip') AND p % 3 <> 1 THEN (p % 8) / 4.0 END"),
    "speed": _d(_on(7, 1, _C, "0.25")[:-3] + " WHEN kind = 'clip' AND p % 7 = 2 THEN 2.0 END"),
    "volume": _d(_on(5, 1, _C, "0.5")),
    "fade_in": _d(_on(6, 1, "'clip', 'text'", "0.5")),
    "fade_out": _d(_on(6, 2, "'clip', 'text'", "1.5")[:-3] + " WHEN kind = 'text' AND p % 6 = 1 THEN 0.25 END"),
    "rotate": _d(_on(11, 3, _C, "90.0")),
    "brightness": _d(_on(9, 1, _C, "0.5")),
    "contrast": _d(_on(9, 2, _C, "1.25")),
    "saturation": _d(_on(9, 3, _C, "0.75")[:-3] + " WHEN kind = 'clip' AND p % 9 = 1 THEN 1.5 END"),
    "blur": _d(_on(8, 1, _C, "12.0")),
    "sharpen": _d(_on(8, 2, _C, "1.5")),
    "vignette": _d(_on(8, 3, _C, "1.0")),
    "grain": _d(_on(8, 4, _C, "0.25")),
    "opacity": _d(_on(10, 1, "'clip', 'image'", "0.75")[:-3] + " WHEN kind IN ('clip', 'image') AND p % 10 = 2 THEN 1.0 END"),
    "zoom": _d(_on(12, 5, _C, "2.5")),
    "pan_x": _d(_on(24, 5, _C, "0.5")),
    "pan_y": _d(_on(36, 5, _C, "-0.25")),
    "scale": _d("CASE WHEN kind = 'pip' AND p % 2 = 0 THEN 0.5 WHEN kind = 'image' AND p % 3 = 0 THEN 0.5 END"),
    "loop_count": "CAST(" + _on(13, 4, _C, "3") + " AS INT)",
    "size": "CAST(" + _on(2, 0, "'text'", "64") + " AS INT)",
    "background_padding": "CAST(" + _on(4, 1, "'text'", "4") + " AS INT)",
    "crop": _on(14, 6, _C, "'640x480+10+20'"),
    "flip": _on(14, 7, _C, "'both'"),
    "chromakey": _on(15, 2, _C, "'#12AB34'")[:-3] + " WHEN kind = 'clip' AND p % 15 = 4 THEN 'blue' END",
    "transition": _on(2, 0, "'transition'", "'wipe-left'"),
    "content": "CASE WHEN kind = 'text' THEN 'It''s on' END",
    "font": _on(3, 0, "'text'", "'/f/a.ttf'"),
    "position": _on(2, 1, "'text', 'image', 'pip'", "'left'"),
    "background": _on(4, 1, "'text'", "'red'")[:-3] + " WHEN kind = 'text' AND p % 4 = 2 THEN 'blue' END",
    "path": "CASE WHEN kind = 'subtitle' THEN 'it''s.srt' END",
    "has_audio": _on(6, 5, _C, "false"),
    "reverse": _on(16, 8, _C, "true"),
    "stabilize": _on(17, 9, _C, "true"),
    "normalize": _on(18, 7, _C, "true"),
}
_KINDS = "transition transition gap freeze text image pip subtitle audio".split()
KIND = "CASE r " + " ".join(f"WHEN {i} THEN '{'clip' if k == 'audio' else k}'" for i, k in enumerate(_KINDS)) + " ELSE 'clip' END"
TRACK = "CASE WHEN r = 8 THEN 'audio' WHEN r = 4 THEN 'text' WHEN r IN (5, 6, 7) THEN 'overlay' ELSE 'video' END"
LINES = "l_orderkey AS program_id, 'a' || CAST(l_suppkey % 5 AS VARCHAR(9)) AS asset, l_partkey AS p, (l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 16 AS r"
ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as items of programs, with every attribute."""
    lines = tables.by_program(spark, sf_dir, "lineitem", "l_orderkey")
    order = Window.partitionBy("program_id").orderBy(*ORDER.split(", "))
    made = lines.withColumn("item_no", F.row_number().over(order)).selectExpr("program_id", LINES.replace("VARCHAR(9)", "STRING").split(", ")[1], "l_partkey AS p", "(l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 16 AS r", "item_no")
    return made.withColumns({"kind": F.expr(KIND), "track_kind": F.expr(TRACK)}).withColumns({k: F.expr(e) for k, e in ATTRIBUTES.items()})


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders")
    fit = F.when(F.col("o_orderkey") % 3 == 0, "letterbox").otherwise("fill")
    return orders.select(F.col("o_orderkey").alias("program_id"), F.lit(1280).alias("width"), F.lit(720).alias("height"), F.lit(30).alias("fps"), fit.alias("fit"))


ITEMS = f"(SELECT *, {', '.join(f'{e} AS {k}' for k, e in ATTRIBUTES.items())} FROM (SELECT *, {KIND} AS kind, {TRACK} AS track_kind FROM (SELECT {LINES}, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER})::INT AS item_no FROM lineitem)))"
_DEFAULTED = f"""(SELECT * REPLACE (
  CASE WHEN kind IN ('freeze', 'text', 'image', 'pip') THEN coalesce(at_sec, 0.0) ELSE at_sec END AS at_sec,
  CASE kind WHEN 'clip' THEN duration_sec WHEN 'gap' THEN coalesce(duration_sec, 1.0) WHEN 'transition' THEN coalesce(duration_sec, 1.0) WHEN 'freeze' THEN coalesce(duration_sec, 3.0) WHEN 'subtitle' THEN duration_sec ELSE coalesce(duration_sec, 5.0) END AS duration_sec,
  CASE WHEN kind = 'transition' THEN coalesce(transition, 'fade') END AS transition, CASE WHEN kind = 'text' THEN coalesce(font, 'Arial') END AS font, CASE WHEN kind = 'text' THEN coalesce(size, 24) END AS size,
  CASE kind WHEN 'text' THEN coalesce(position, 'center') WHEN 'image' THEN coalesce(position, 'top-right') WHEN 'pip' THEN coalesce(position, 'bottom-right') END AS position,
  CASE WHEN kind = 'pip' THEN coalesce(scale, 0.25) ELSE scale END AS scale), CASE WHEN kind = 'text' THEN 'FFFFFF' END AS color FROM {ITEMS})"""


def _cut(name: str) -> str:
    return f"'{name}' || CASE WHEN from_sec IS NULL AND to_sec IS NULL THEN '' ELSE '=' || concat_ws(':', 'start=' || {num('from_sec')}, 'end=' || {num('to_sec')}) END || ',{'a' if name == 'atrim' else ''}setpts=PTS-STARTPTS'"


_BETWEEN = f"':enable=''between(t,' || {num('at_sec')} || ',' || {num('(at_sec + duration_sec)')} || ')'''"
_RAW = "coalesce(duration_sec, to_sec - from_sec, 10.0)"
_F, _UP, _BACK = f"floor({_RAW} * 30)", f"floor(floor({_RAW} * 30) * 0.30)", f"floor(floor({_RAW} * 30) * 0.70)"
_t = lambda x: f"({x})::BIGINT::VARCHAR"
_pan = lambda s, c: f"'{s}/2-({s}/zoom/2)' || CASE WHEN coalesce({c}, 0.0) = 0 THEN '' ELSE '+{s}*' || {num(c)} || '*(1-1/zoom)/2' END"
_ZOOM = (
    f"'zoompan=z=''if(lt(on\\,' || {_t(_UP)} || ')\\,1+on/' || {_t(_UP)} || '*' || {num('(zoom - 1)')} || '\\,if(lt(on\\,' || {_t(_BACK)} || ')\\,' || {num('zoom')} || '\\,' || {num('zoom')} || '-(on-' || {_t(_BACK)} || ')/' || {_t(f'{_F} - {_BACK}')} || '*' || {num('(zoom - 1)')} "
    f"|| '))'':x=''' || {_pan('iw', 'pan_x')} || ''':y=''' || {_pan('ih', 'pan_y')} || ''':d=1:s=1280x720:fps=30'"
)
_ANGLE = "(pi() / 5 + vignette * (pi() / 2 - pi() / 5))"
_TURN = num("(rotate * pi() / 180)")
_PICTURE = [
    ("tv", "true", _cut("trim")), ("cr", "crop IS NOT NULL", "'crop=640:480:10:20'"), ("rot", "rotate IS NOT NULL", f"'rotate=' || {_TURN} || ':fillcolor=black@0:ow=rotw(' || {_TURN} || '):oh=roth(' || {_TURN} || ')'"),
    ("fl", "flip IS NOT NULL", "'hflip,vflip'"), ("sc", "true", "'scale=1280:720'"), ("zp", "zoom IS NOT NULL", _ZOOM), ("spd", "speed IS NOT NULL", f"'setpts=PTS/' || {num('speed')}"),
    ("eq", "coalesce(brightness, contrast, saturation) IS NOT NULL", f"'eq=' || concat_ws(':', 'brightness=' || {num('brightness')}, 'contrast=' || {num('contrast')}, 'saturation=' || {num('saturation')})"),
    ("bl", "blur IS NOT NULL", "'boxblur=2:2'"), ("shp", "sharpen IS NOT NULL", "'unsharp=5:5:1.5:5:5:0'"), ("vig", "vignette IS NOT NULL", f"'vignette=angle=' || {num(_ANGLE)}"), ("grn", "grain IS NOT NULL", "'noise=alls=25:allf=t'"),
    ("opc", "opacity < 1", "'format=rgba,colorchannelmixer=aa=0.75'"), ("rev", "reverse", "'reverse'"), ("", "chromakey = '#12AB34'", "''"),
    ("ck", "chromakey IS NOT NULL", "'chromakey=' || CASE chromakey WHEN 'blue' THEN '0x0000FF' ELSE '0x12AB34' END || ':0.1:0.2'"), ("stb", "stabilize", "'deshake'"),
]
_SOUND = [
    ("sil", "mute", f"'aevalsrc=0:s=44100:d=' || {num('length_sec')}"), ("ta", "NOT mute", _cut("atrim")), ("vol", "NOT skipped AND volume IS NOT NULL", "'volume=0.5'"), ("at", "NOT skipped AND speed = 0.25", "'atempo=0.5'"), ("at", "NOT skipped AND speed = 0.25", "'atempo=0.5'"),
    ("at", "NOT skipped AND speed = 2", "'atempo=2'"), ("af", "NOT skipped AND fade_in IS NOT NULL", f"'afade=t=in:st=0:d=' || {num('fade_in')}"),
    ("af", "NOT skipped AND fade_out IS NOT NULL", f"'afade=t=out:st=' || {num('greatest(length_sec - fade_out, 0.0)')} || ':d=' || {num('fade_out')}"), ("arev", "NOT skipped AND reverse", "'areverse'"), ("ln", "NOT skipped AND normalize", "'loudnorm'"),
]
_S, _E = "at_sec", "(at_sec + duration_sec)"
_FALL = f"'if(gt(t\\,' || {num(f'({_E} - fade_out)')} || ')\\,(' || {num(_E)} || '-t)/' || {num('fade_out')} || '\\,1)'"
_ALPHA = f"coalesce('if(lt(t\\,' || {num(f'({_S} + fade_in)')} || ')\\,(t-' || {num(_S)} || ')/' || {num('fade_in')} || '\\,' || coalesce({_FALL}, '1') || ')', {_FALL})"
_TEXT = (
    "'drawtext=text=''' || replace(content, '''', '''\\''''') || ''':' || CASE WHEN font = 'Arial' THEN 'font' ELSE 'fontfile' END || '=''' || font || ''':fontsize=' || size || ':fontcolor=' || color || CASE position WHEN 'left' THEN ':x=10' ELSE ':x=(w-text_w)/2' END || ':y=(h-text_h)/2' "
    f"|| {_BETWEEN} || coalesce(':alpha=''' || {_ALPHA} || '''', '') || coalesce(':box=1:boxcolor=' || background || ':boxborderw=' || coalesce(background_padding, 12), '')"
)
_SPOT = "CASE position WHEN 'left' THEN 'x=10:y=(H-h)/2' WHEN 'top-right' THEN 'x=W-w-10:y=10' ELSE 'x=W-w-10:y=H-h-10' END"


def _chains(table: str, stage: str, stream: str, steps: list[tuple[str, str, str]], where: str) -> str:
    one = "SELECT program_id, {stage} AS stage, item_no, c AS part, {base} + {i} AS ord, '{stream}' AS stream, '{prefix}' AS prefix, {expr} AS expr, 1 AS uses FROM {table} WHERE {where} AND ({when})"
    return " UNION ALL ".join(one.format(stage=stage, i=i, base=0 if stream == "v" else 100, stream=stream, prefix=p, expr=e, table=table, where=where, when=w) for i, (p, w, e) in enumerate(steps))


_one = lambda stage, part, ord_, stream, prefix, expr, uses, rest: f"SELECT program_id, {stage} AS stage, item_no, {part} AS part, {ord_} AS ord, '{stream}' AS stream, '{prefix}' AS prefix, {expr} AS expr, {uses} AS uses {rest}"
GRAPH_ROWS = f"""
WITH base AS (
  SELECT *, bool_or(track_kind = 'audio') OVER w AS discard, bool_or(track_kind = 'video') OVER w AS pictured,
    CASE WHEN kind = 'clip' THEN {_RAW} / coalesce(speed, 1.0) ELSE duration_sec END AS length_sec
  FROM {_DEFAULTED} WINDOW w AS (PARTITION BY program_id)
), it AS (
  SELECT *, discard AND track_kind = 'video' AS skipped, (discard OR NOT coalesce(has_audio, true)) AND track_kind = 'video' AS mute FROM base WHERE pictured
), plan AS (
  SELECT * FROM {schedule_sql("(SELECT * FROM it WHERE track_kind = 'video')")}
), named AS (
  SELECT program_id, item_no, replace(last_value(transition IGNORE NULLS) OVER (PARTITION BY program_id ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-', '') AS name FROM it WHERE track_kind = 'video'
), uses AS (
  SELECT program_id, asset, min(CASE WHEN track_kind = 'video' THEN 0 WHEN track_kind = 'audio' THEN 1 WHEN kind = 'image' THEN 2 ELSE 3 END * 1000000 + item_no) AS f FROM it WHERE kind IN ('clip', 'freeze', 'image', 'pip') GROUP BY ALL
), nums AS (
  SELECT program_id, asset, row_number() OVER (PARTITION BY program_id ORDER BY f, asset) - 1 AS no FROM uses
), proj AS (
  SELECT program_id, -1 AS item_no, any_value(discard) AS discard, count(*) FILTER (track_kind = 'audio') AS sounds, program_id % 3 = 0 AS boxed, coalesce((SELECT max(segment_no) + 1 FROM plan WHERE plan.program_id = it.program_id), 0) AS segments FROM it GROUP BY program_id
), clips AS (
  SELECT it.*, c FROM it, unnest(range(0, CASE WHEN it.track_kind = 'video' AND it.kind = 'clip' THEN greatest(coalesce(loop_count, 1), 1) ELSE 1 END)) AS r(c)
), steps AS (
  {_chains('clips', '0', 'v', _PICTURE, "kind = 'clip' AND track_kind = 'video'")}
  UNION ALL {_chains('clips', '0', 'a', _SOUND, "kind = 'clip' AND track_kind = 'video'")}
  UNION ALL {_chains('clips', '8', 'a', _SOUND, "kind = 'clip' AND track_kind = 'audio'")}
  UNION ALL {_chains('clips', '0', 'v', [("clr", "true", f"'color=c=black:s=1280x720:r=30:d=' || {num('length_sec')}")], "kind = 'gap'")}
  UNION ALL {_chains('clips', '0', 'v', [("tv", "true", f"'trim=start=' || {num('at_sec')} || ':end=' || {num('(at_sec + 0.04::DOUBLE)')} || ',setpts=PTS-STARTPTS'"), ("sc", "true", "'scale=1280:720'"), ("tp", "true", f"'tpad=stop_mode=clone:stop_duration=' || {num('length_sec')}")], "kind = 'freeze'")}
  UNION ALL {_chains('clips', '0', 'a', [("sil", "true", f"'aevalsrc=0:s=44100:d=' || {num('length_sec')}")], "kind IN ('gap', 'freeze')")}
  UNION ALL {_chains('clips', '3', 'v', [("tv", "true", _cut("trim")), ("sc", "true", "'scale=' || floor(1280 * scale)::BIGINT || ':' || floor(720 * scale)::BIGINT")], "kind = 'pip'")}
  UNION ALL {_chains('clips', '4', 'v', [("sc", "scale IS NOT NULL", "'scale=iw*0.5:ih*0.5'"), ("op", "opacity < 1", "'format=rgba,colorchannelmixer=aa=0.75'")], "kind = 'image'")}
  UNION ALL {_one(0, 1000, 0, 'join', 'outv', "'concat=n=' || loop_count || ':v=1:a=1'", 2, "FROM it WHERE kind = 'clip' AND track_kind = 'video' AND loop_count > 1")}
  UNION ALL {_one(0, 1001, 0, 'xf', 'xf', f"'xfade=transition=' || name || ':duration=' || {num('pending')} || ':offset=' || {num('offset_sec')}", 1, "FROM plan JOIN named USING (program_id, item_no) WHERE action = 'merge'")}
  UNION ALL {_one(0, 1002, 0, 'axf', 'axf', f"'acrossfade=d=' || {num('pending')} || ':c1=tri:c2=tri'", 1, "FROM plan WHERE action = 'merge'")}
  UNION ALL {_one(1, 0, 0, 'concat', 'outv', "'concat=n=' || segments || ':v=1:a=1'", 2, "FROM proj WHERE segments > 1")}
  UNION ALL {_one(2, 0, 0, 'pad', 'pad', "'pad=1280:720:(ow-iw)/2:(oh-ih)/2:color=black'", 1, "FROM proj WHERE boxed")}
  UNION ALL {_one("CASE kind WHEN 'pip' THEN 3 ELSE 4 END", 1, 0, 'over', 'ov', f"'overlay=' || {_SPOT} || {_BETWEEN}", 1, "FROM it WHERE kind IN ('pip', 'image')")}
  UNION ALL {_one(5, 0, 0, 'over', 'sub', "'subtitles=filename=''' || replace(path, '''', '''\\''''') || ''''", 1, "FROM it WHERE kind = 'subtitle'")}
  UNION ALL {_one(6, 0, 0, 'over', 'txt', _TEXT, 1, "FROM it WHERE kind = 'text'")}
  UNION ALL {_one(7, 0, 0, 'sink', '', "'anullsink'", 0, "FROM proj WHERE discard")}
  UNION ALL {_one(9, 0, 0, 'mix', 'amx', "'amix=inputs=' || sounds || ':duration=longest'", 1, "FROM proj WHERE sounds > 1")}
), numbered AS (
  SELECT *, coalesce(sum(uses) OVER (PARTITION BY program_id ORDER BY stage, item_no, part, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM steps
), lab AS (
  SELECT *, prefix || pos AS label FROM numbered WHERE expr <> ''
), ends AS (
  SELECT program_id, stage, item_no, part, arg_max(label, ord) FILTER (stream = 'v') AS v, arg_max(label, ord) FILTER (stream = 'a') AS a FROM lab WHERE stream IN ('v', 'a') GROUP BY ALL
), own AS (
  SELECT p.program_id, p.item_no, p.action, p.segment_no, coalesce(j.label, e.v) AS v, coalesce('outa' || (j.pos + 1), e.a) AS a, coalesce(x.label, j.label, e.v) AS fv, coalesce(y.label, 'outa' || (j.pos + 1), e.a) AS fa
  FROM plan p JOIN ends e ON e.program_id = p.program_id AND e.item_no = p.item_no AND e.stage = 0 AND e.part = 0
  LEFT JOIN lab j ON j.program_id = p.program_id AND j.item_no = p.item_no AND j.stream = 'join' LEFT JOIN lab x ON x.program_id = p.program_id AND x.item_no = p.item_no AND x.stream = 'xf' LEFT JOIN lab y ON y.program_id = p.program_id AND y.item_no = p.item_no AND y.stream = 'axf'
), live AS (
  SELECT *, lag(fv) OVER w AS pv, lag(fa) OVER w AS pa, coalesce(lead(action) OVER w, 'push') = 'push' AS closes FROM own WHERE action <> 'drop' WINDOW w AS (PARTITION BY program_id ORDER BY item_no)
), closed AS (
  SELECT program_id, string_agg(fv || ' ' || fa, ' ' ORDER BY segment_no) AS pairs, any_value(fv) AS v, any_value(fa) AS a FROM live WHERE closes GROUP BY program_id
), low AS (
  SELECT p.program_id, p.discard, p.sounds, coalesce(c.label, closed.v, '0:v') AS v, coalesce('outa' || (c.pos + 1), closed.a, '0:a') AS a, coalesce(d.label, c.label, closed.v, '0:v') AS lowest, pairs
  FROM proj p LEFT JOIN closed USING (program_id) LEFT JOIN lab c ON c.program_id = p.program_id AND c.stream = 'concat' LEFT JOIN lab d ON d.program_id = p.program_id AND d.stream = 'pad'
), sung AS (
  SELECT program_id, string_agg(a, ' ' ORDER BY item_no) AS inputs, any_value(a) AS a FROM ends WHERE stage = 8 GROUP BY program_id
), loops AS (
  SELECT program_id, item_no, string_agg(v || ' ' || a, ' ' ORDER BY part) AS inputs FROM ends WHERE stage = 0 GROUP BY ALL
), overs AS (
  SELECT program_id, item_no, lag(label) OVER (PARTITION BY program_id ORDER BY stage, item_no) AS under, label, pos FROM lab WHERE stream = 'over'
), before AS (
  SELECT *, lag(label) OVER (PARTITION BY program_id, stage, item_no, part, stream ORDER BY ord) AS previous FROM lab
), read AS (
  SELECT b.program_id, b.stage, b.item_no, b.part, b.ord, b.pos, b.expr, b.stream, b.label, CASE b.stream
    WHEN 'v' THEN coalesce(previous, CASE WHEN b.prefix = 'clr' THEN '' ELSE nums.no || ':v' END) WHEN 'a' THEN coalesce(previous, CASE WHEN b.prefix = 'sil' THEN '' ELSE nums.no || ':a' END)
    WHEN 'join' THEN loops.inputs WHEN 'xf' THEN live.pv || ' ' || live.v WHEN 'axf' THEN live.pa || ' ' || live.a WHEN 'concat' THEN low.pairs WHEN 'pad' THEN low.v
    WHEN 'over' THEN coalesce(overs.under, low.lowest) || CASE WHEN b.prefix = 'ov' THEN ' ' || coalesce(ends.v, nums.no || ':v') ELSE '' END WHEN 'sink' THEN low.a ELSE sung.inputs END AS inputs
  FROM before b JOIN low USING (program_id) LEFT JOIN it ON it.program_id = b.program_id AND it.item_no = b.item_no LEFT JOIN nums ON nums.program_id = b.program_id AND nums.asset = it.asset
  LEFT JOIN loops ON loops.program_id = b.program_id AND loops.item_no = b.item_no LEFT JOIN live ON live.program_id = b.program_id AND live.item_no = b.item_no LEFT JOIN overs ON overs.program_id = b.program_id AND overs.item_no = b.item_no AND overs.pos = b.pos
  LEFT JOIN ends ON ends.program_id = b.program_id AND ends.item_no = b.item_no AND ends.stage IN (3, 4) LEFT JOIN sung ON sung.program_id = b.program_id
), maps AS (
  SELECT low.program_id, '[' || coalesce((SELECT arg_max(label, pos) FROM overs o WHERE o.program_id = low.program_id), lowest) || ']' AS v,
    '[' || CASE WHEN NOT discard THEN low.a WHEN sounds > 1 THEN (SELECT any_value(label) FROM lab WHERE lab.program_id = low.program_id AND lab.stream = 'mix') ELSE sung.a END || ']' AS a FROM low LEFT JOIN sung USING (program_id)
), rows AS (
  SELECT program_id, row_number() OVER (PARTITION BY program_id ORDER BY stage, item_no, part, ord) - 1 AS seq, pos AS "at", inputs, expr, CASE WHEN stream = 'sink' THEN '' WHEN stream IN ('join', 'concat') THEN label || ' outa' || (pos + 1) ELSE label END AS outputs FROM read
)
"""
_PADS = lambda x: f"CASE WHEN {x} = '' THEN '' ELSE '[' || replace({x}, ' ', '][') || ']' END"
_RENDERED = f"(SELECT program_id, string_agg({_PADS('inputs')} || expr || {_PADS('outputs')}, ';' ORDER BY seq) AS graph FROM rows GROUP BY program_id)"


def program_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_rows(programs(spark, sf_dir), projects(spark, sf_dir))


def program_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole command of each program: inputs in order of their numbers, graph, maps, output arguments."""
    items, own = programs(spark, sf_dir), projects(spark, sf_dir)
    quality = F.when(F.col("program_id") % 2 == 0, "high").otherwise("low")
    outs = own.select("program_id", F.concat(F.col("program_id").cast("string"), F.lit(".mp4")).alias("path"), "fps", "width", "height", F.lit("h265").alias("codec"), quality.alias("quality"))
    args = filters.output_args(outs, values.encoder_table(spark), values.quality_table(spark)).select("program_id", "args")
    met = graph.program_texts(items, own).join(args, "program_id")
    inputs = F.transform("inputs", lambda x: F.concat(x, F.lit(".mp4")))
    return met.select("program_id", filters.command_text(inputs, F.when(F.col("graph") != "", F.col("graph")), F.col("maps"), F.col("args")).alias("command"))


# -- errors and warnings ----------------------------------------------------------------------

_KEYS = ["reverse", "chromakey", "flip", "volume", "speed", "scale", "opacity", "from", "to", "other"]
#: (key, tag, text, value) of a line item's two attributes, from p.
_PARTS = {
    "key": "element_at(array(" + ", ".join(f"'{k}'" for k in _KEYS) + "), CAST((p + ord * 3) % 10 AS INT) + 1)",
    "tag": "element_at(array('float', 'int', 'string', 'bool', 'color', 'float', 'float'), CAST((p * 3 + ord) % 7 AS INT) + 1)",
    "text": "element_at(array('both', 'true', 'upside', 'AA00BB'), CAST((p + ord) % 4 AS INT) + 1)",
    "value": _d("(p % 23) / 4.0 - 1 + ord"),
}
_ATTRS_SQL = f"(SELECT *, {', '.join(re.sub(r'element_at[(]array[(](.*?)[)], (CAST.*)[)]$', r'list_extract([\1], \2)', e) + f' AS {k}' for k, e in _PARTS.items())} FROM {ITEMS} CROSS JOIN (SELECT unnest([0, 1])::INT AS ord))"
_ASSETS_SQL = "(SELECT o_orderkey AS program_id, 'a' || (o_custkey % 5) AS name FROM orders UNION SELECT o_orderkey, 'a' || ((o_custkey + k) % 5) FROM orders, (SELECT unnest([1, 2, 3]) AS k))"


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders")
    items = programs(spark, sf_dir).filter("program_id % 11 <> 0")
    owned = F.when(F.col("kind").isin("clip", "freeze", "image", "pip"), F.col("asset"))
    attrs = items.withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({k: F.expr(e) for k, e in _PARTS.items()})
    assets = orders.select(F.col("o_orderkey").alias("program_id"), F.explode(F.array(*[F.concat(F.lit("a"), ((F.col("o_custkey") + k) % 5).cast("string")) for k in range(4)])).alias("name"))
    every = orders.select(F.col("o_orderkey").alias("program_id"))
    return checks.program_errors(every, every.filter("program_id % 13 <> 0"), items.withColumn("asset", owned), attrs, assets, values.item_rules(spark))


def program_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir)


def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.first_errors(_checked(spark, sf_dir))


_ERRORS = f"""
WITH a AS (SELECT * FROM {_ATTRS_SQL} WHERE program_id % 11 <> 0), e AS (
  SELECT o_orderkey AS program_id, 1 AS stage, -1 AS item_no, -1 AS ord, 'no_project' AS error FROM orders WHERE o_orderkey % 13 = 0
  UNION ALL SELECT o_orderkey, 2, -1, -1, 'no_timeline' FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT program_id, 6, item_no, -1, 'undefined_asset' FROM {ITEMS} i WHERE program_id % 11 <> 0 AND kind IN ('clip', 'freeze', 'image', 'pip') AND (program_id, asset) NOT IN (SELECT (program_id, name) FROM {_ASSETS_SQL})
  UNION ALL SELECT program_id, 6, item_no, ord, CASE
    WHEN kind = 'clip' AND key = 'reverse' AND tag <> 'bool' THEN 'type_mismatch' WHEN kind = 'clip' AND key = 'chromakey' AND tag NOT IN ('string', 'color') THEN 'type_mismatch'
    WHEN kind = 'clip' AND key = 'flip' AND tag = 'string' AND text NOT IN ('horizontal', 'vertical', 'both') THEN 'invalid_value'
    WHEN ((kind = 'clip' AND key IN ('volume', 'speed', 'opacity')) OR (kind = 'image' AND key IN ('scale', 'opacity'))) THEN CASE WHEN tag NOT IN ('int', 'float') THEN 'type_mismatch'
      WHEN key = 'speed' AND (value <= 0 OR value > 100) OR key = 'scale' AND (value < 0 OR value > 10) OR key IN ('volume', 'opacity') AND (value < 0 OR value > 1) THEN 'invalid_value' END END AS error FROM a WHERE error IS NOT NULL
  UNION ALL SELECT program_id, 6, item_no, max(ord) + 1000, 'invalid_time_range' FROM a WHERE kind = 'clip' AND key IN ('from', 'to') GROUP BY program_id, item_no
    HAVING arg_max(value, ord) FILTER (key = 'from') >= arg_max(value, ord) FILTER (key = 'to')
)
"""


def program_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of the programs' items: assets a3 and a4 have no probe, "/f/a.ttf" no file."""
    probe = spark.createDataFrame([("a0",), ("a1",), ("a2",)], "asset string")
    fonts = tables.match_fonts(spark.createDataFrame([("Arial",), ("/f/a.ttf",)], "family string"), spark.createDataFrame([("/x/arial.ttf",)], "path string"))
    items = graph.with_defaults(programs(spark, sf_dir))
    return checks.warnings(items.withColumn("asset", F.when(F.col("kind").isin("clip", "freeze", "image", "pip"), F.col("asset"))), probe, fonts)


def item_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind's defaults: clips keep what is not set null."""
    return graph.with_defaults(programs(spark, sf_dir)).select("program_id", "item_no", "kind", "at_sec", "duration_sec", "speed", "font", "size", "color", "position", "scale", "transition")


QUERIES = {"program_graph": program_graph, "program_command": program_command, "program_errors": program_errors, "first_errors": first_errors, "program_warnings": program_warnings, "item_defaults": item_defaults}
ORACLE_SQL = {
    "program_errors": _ERRORS + "SELECT * FROM e",
    "first_errors": _ERRORS + "SELECT program_id, stage, item_no, ord, error FROM (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY stage, item_no, ord) AS n FROM e) WHERE n = 1",
    "program_warnings": f"SELECT program_id, min(item_no) AS item_no, 'no probe of ' || asset AS warning FROM {ITEMS} WHERE kind IN ('clip', 'freeze', 'image', 'pip') AND asset IN ('a3', 'a4') GROUP BY program_id, asset UNION ALL SELECT program_id, item_no, 'no font /f/a.ttf' FROM {ITEMS} WHERE font = '/f/a.ttf'",
    "item_defaults": f"SELECT program_id, item_no, kind, at_sec, duration_sec, speed, font, size, color, position, scale, transition FROM {_DEFAULTED}",
    "program_graph": GRAPH_ROWS + "SELECT * FROM rows",
    "program_command": GRAPH_ROWS
    + f"SELECT m.program_id, 'ffmpeg -y ' || coalesce((SELECT string_agg('-i ' || asset || '.mp4', ' ' ORDER BY no) || ' ' FROM nums n WHERE n.program_id = m.program_id), '') || coalesce('-filter_complex ' || g.graph || ' ', '') || '-map ' || m.v || ' -map ' || m.a || ' -c:v libx265 -preset ' "
    f"|| CASE WHEN m.program_id % 2 = 0 THEN 'slow -crf 18' ELSE 'ultrafast -crf 28' END || ' -r 30 -s 1280x720 ' || m.program_id || '.mp4' AS command FROM maps m LEFT JOIN {_RENDERED} g USING (program_id)",
}
