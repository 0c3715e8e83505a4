"""A resolved program as filter rows and command arguments: an inspectable plan made with windows and aggregations."""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicery.functions.times import crop_filter, number_text
from splicery.functions.values import BOX_PADDING, UNKNOWN_LENGTH
from splicery.operators.signal import tempo_steps


def trim_text(name: str, start: Column, end: Column) -> Column:
    bounds = F.concat_ws(":", F.concat(F.lit("start="), number_text(start)), F.concat(F.lit("end="), number_text(end)))
    stamp = "setpts" if name == "trim" else "asetpts"
    return F.concat(F.lit(name), F.when(bounds == "", "").otherwise(F.concat(F.lit("="), bounds)), F.lit(f",{stamp}=PTS-STARTPTS"))


def rotate_radians(degrees: Column) -> Column:
    return degrees * F.pi() / 180


def vignette_angle(strength: Column) -> Column:
    fifth = F.pi() / 5
    return fifth + strength * (F.pi() / 2 - fifth)


def flip_text(mode: Column) -> Column:
    return F.when(mode == "horizontal", "hflip").when(mode == "vertical", "vflip").when(mode == "both", "hflip,vflip")


def key_color(name: Column) -> Column:
    hexed = F.concat(F.lit("0x"), F.substring(name, 2, 20))
    return F.when(name == "blue", "0x0000FF").when(name.startswith("#"), hexed).otherwise("0x00FF00")


def zoompan(width: Column, height: Column) -> Column:
    """Zoom to `zoom` over 30 % of the clip's frames, hold, and back over the last 30 %; pans shift the focus."""
    n = number_text
    total = F.floor(F.coalesce(F.coalesce("duration_sec", F.col("to_sec") - F.col("from_sec")), F.lit(UNKNOWN_LENGTH)) * F.col("fps"))
    up, back = F.floor(total * 0.30), F.floor(total * 0.70)
    t = lambda c: c.cast("bigint").cast("string")
    peak, rise = n(F.col("zoom")), n(F.col("zoom") - 1)
    ramp = F.concat(F.lit("if(lt(on\\,"), t(up), F.lit(")\\,1+on/"), t(up), F.lit("*"), rise, F.lit("\\,if(lt(on\\,"), t(back), F.lit(")\\,"), peak, F.lit("\\,"), peak, F.lit("-(on-"), t(back), F.lit(")/"), t(total - back), F.lit("*"), rise, F.lit("))"))

    def focus(side: str, pan: str) -> Column:
        middle = f"{side}/2-({side}/zoom/2)"
        return F.when(F.coalesce(pan, F.lit(0.0)) == 0, middle).otherwise(F.concat(F.lit(f"{middle}+{side}*"), n(F.col(pan)), F.lit("*(1-1/zoom)/2")))

    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    return F.concat(F.lit("zoompan=z='"), ramp, F.lit("':x='"), focus("iw", "pan_x"), F.lit("':y='"), focus("ih", "pan_y"), F.lit("':d=1:s="), size, F.lit(":fps="), F.col("fps").cast("string"))


def having(name: str, expr: Column) -> Column:
    """The expression where the column is set; elsewhere nothing of it is evaluated."""
    return F.when(F.col(name).isNotNull(), expr)


def effect_steps(width: Column, height: Column) -> list[tuple[str, Column]]:
    """(prefix, expression) of a clip's picture effects, in their fixed order; null where the clip has none."""
    text = lambda name, c: having(c, F.concat(F.lit(name), number_text(F.col(c))))
    eq = F.concat_ws(":", *[F.concat(F.lit(f"{c}="), number_text(F.col(c))) for c in ("brightness", "contrast", "saturation")])
    radius = F.least(F.greatest(F.col("blur") / 5, F.lit(1.0)), F.lit(20.0)).cast("int").cast("string")
    turn = number_text(rotate_radians(F.col("rotate")))
    true = lambda c, what: F.when(F.col(c), F.lit(what))
    return [
        ("cr", F.when(F.col("crop").isNotNull(), crop_filter(F.col("crop")))),
        ("rot", having("rotate", F.concat(F.lit("rotate="), turn, F.lit(":fillcolor=black@0:ow=rotw("), turn, F.lit("):oh=roth("), turn, F.lit(")")))),
        ("fl", flip_text(F.col("flip"))),
        ("sc", F.concat(F.lit("scale="), width.cast("string"), F.lit(":"), height.cast("string"))),
        ("zp", having("zoom", zoompan(width, height))),
        ("spd", text("setpts=PTS/", "speed")),
        ("eq", F.when(F.coalesce("brightness", "contrast", "saturation").isNotNull(), F.concat(F.lit("eq="), eq))),
        ("bl", F.when(F.col("blur").isNotNull(), F.concat(F.lit("boxblur="), radius, F.lit(":"), radius))),
        ("shp", having("sharpen", F.concat(F.lit("unsharp=5:5:"), number_text(F.col("sharpen")), F.lit(":5:5:0")))),
        ("vig", having("vignette", F.concat(F.lit("vignette=angle="), number_text(vignette_angle(F.col("vignette")))))),
        ("grn", having("grain", F.concat(F.lit("noise=alls="), (F.col("grain") * 100).cast("int").cast("string"), F.lit(":allf=t")))),
        ("opc", F.when(F.col("opacity") < 1, text("format=rgba,colorchannelmixer=aa=", "opacity"))),
        ("rev", true("reverse", "reverse")),
        # A key given as #hex uses up two label numbers: the first belongs to no filter.
        ("", F.when(F.col("chromakey").startswith("#"), F.lit(""))),
        ("ck", F.when(F.col("chromakey").isNotNull(), F.concat(F.lit("chromakey="), key_color(F.col("chromakey")), F.lit(":0.1:0.2")))),
        ("stb", true("stabilize", "deshake")),
    ]


def tempo_texts(speed: Column) -> Column:
    """The atempo filters of a speed, in order: a chain where one filter's range does not hold it."""
    steps = F.when(speed > 0, tempo_steps(speed)).otherwise(F.array(speed))
    # A full step up is written as 100.0, what is left the shortest way.
    text = lambda x, i: F.when(i < F.size(steps) - 1, x.cast("string")).otherwise(number_text(x))
    return F.transform(steps, lambda x, i: F.concat(F.lit("atempo="), text(x, i)))


def sound_steps() -> list[tuple[str, Column]]:
    """(prefix, expression) of a clip's sound, in their fixed order; an array is a filter for each entry."""
    text = lambda name, c: having(c, F.concat(F.lit(name), number_text(F.col(c))))
    start = F.greatest(F.col("estimate_sec") - F.col("fade_out"), F.lit(0.0))
    return [
        ("vol", text("volume=", "volume")),
        ("at", having("speed", tempo_texts(F.col("speed")))),
        ("af", having("fade_in", F.concat(F.lit("afade=t=in:st=0:d="), number_text(F.col("fade_in"))))),
        ("af", having("fade_out", F.concat(F.lit("afade=t=out:st="), number_text(start), F.lit(":d="), number_text(F.col("fade_out"))))),
        ("arev", F.when(F.col("reverse"), F.lit("areverse"))),
        ("ln", F.when(F.col("normalize"), F.lit("loudnorm"))),
    ]


FILTERS = "array<struct<at:bigint,inputs:array<string>,expr:string,outputs:array<string>>>"


class Link(NamedTuple):
    """A filter as columns; expr is null where an item does not have it. A single input that is null is none.

    `many`: expr is an array of filters, one after another, labelled "at".
    """

    at: Column
    inputs: list[Column] | Column
    expr: Column
    outputs: list[Column]
    many: bool = False

    def row(self) -> Column:
        """struct(at, inputs, expr, outputs), or null."""
        none = F.array().cast("array<string>")
        ins = F.array(*self.inputs) if isinstance(self.inputs, list) and self.inputs else none if isinstance(self.inputs, list) else self.inputs
        if isinstance(self.inputs, list) and len(self.inputs) == 1:
            ins = F.when(self.inputs[0].isNull(), none).otherwise(ins)
        made = F.struct(self.at.cast("bigint").alias("at"), ins.alias("inputs"), self.expr.alias("expr"), (F.array(*self.outputs) if self.outputs else none).alias("outputs"))
        return F.when(self.expr.isNotNull(), made)

    def text(self) -> Column:
        """[inputs]expr[outputs], or null."""
        pad = lambda x: F.concat(F.lit("["), x, F.lit("]"))
        ins = [F.coalesce(pad(x), F.lit("")) for x in self.inputs] if isinstance(self.inputs, list) else [pad(F.array_join(self.inputs, "]["))]
        return F.concat(*ins, self.expr, *map(pad, self.outputs))

    def each(self, made) -> Column:
        """made(filter) of the filters of an array."""
        before = lambda i: F.when(i == 0, self.inputs[0]).otherwise(label("at", self.at + i - 1))
        return F.transform(self.expr, lambda x, i: made(Link(self.at + i, [before(i)], x, [label("at", self.at + i)])))


def label(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def link_rows(links: list[Link]) -> Column:
    """FILTERS of the links in order, null for those that an item does not have."""
    runs = []
    for many, run in groupby(links, lambda x: x.many):
        runs += [F.coalesce(x.each(Link.row), F.array().cast(FILTERS)) for x in run] if many else [F.array(*[x.row() for x in run])]
    return F.concat(*runs)


def link_text(links: list[Link]) -> Column:
    """The links' texts in order, joined by ;."""
    return F.concat_ws(";", *[F.array_join(x.each(Link.text), ";") if x.many else x.text() for x in links])


def present(name: str) -> Column:
    """The filters of the column `name`, an array of link_rows(), without nulls.

    The column is named twice, which keeps its texts in a projection of their own: Spark compiles that, but not what a lambda function reads.
    """
    return F.when(F.size(name) > 0, F.filter(name, lambda f: f.isNotNull())).otherwise(F.col(name))


class Chain:
    """The steps of a chain as columns of an item's row: a text for each, null where the item does not have it.

    `texts` become columns first, then `labels`, and links() reads both: each is a projection of its own, so that no text is built twice,
    and none of them is inside a lambda function, which Spark does not compile. A label is its filter's prefix with the number of labels
    before it. A step without a prefix only uses up a number; the step "at" is an array.
    """

    def __init__(self, name: str, steps: list[tuple[str, Column]]):
        self.slots = [(prefix, f"_{name}{i}") for i, (prefix, _) in enumerate(steps)]
        self.texts = {c: e for (_, c), (_, e) in zip(self.slots, steps)}

    @staticmethod
    def _uses(prefix: str, c: str) -> Column:
        return F.when(F.col(c).isNull(), 0).otherwise(F.size(c) if prefix == "at" else F.lit(1))

    def count(self, unused: bool = True) -> Column:
        """Labels that the chain uses up, or without the unused ones its filters."""
        return reduce(add, [self._uses(p, c) for p, c in self.slots if p or unused])

    def end(self, base: Column, count: Column) -> Column:
        """Label of the last of `count` labels."""
        last = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(p)) for p, c in reversed(self.slots) if p])
        return F.concat(last, (base + count - 1).cast("string"))

    def labels(self, base: Column) -> dict[str, Column]:
        """The label of each step, of an array its last one."""
        made, n = {}, base
        for prefix, c in self.slots:
            n = n + self._uses(prefix, c)
            if prefix:
                made[f"{c}_label"] = F.when(F.col(c).isNotNull(), label(prefix, n - 1))
        return made

    def links(self, base: Column, source: Column) -> list[Link]:
        """The filters in order: each reads the one before it, the first one `source`."""
        made, read, n = [], [source], base
        for prefix, c in self.slots:
            if prefix:
                made.append(Link(n, [F.coalesce(*read)], F.col(c), [F.col(f"{c}_label")], prefix == "at"))
                read.insert(0, F.col(f"{c}_label"))
            n = n + self._uses(prefix, c)
        return made


def _linked(clips: DataFrame, width: Column, height: Column) -> tuple[DataFrame, list[Link]]:
    """A row for each clip, and the links of its chain, trim first.

    The number of labels before a clip is a prefix sum over a program's clips. The first filter of a stream reads the clip's input.
    """
    video = Chain("v", [("tv", trim_text("trim", F.col("from_sec"), F.col("to_sec"))), *effect_steps(width, height)])
    sound = Chain("a", [("ta", trim_text("atrim", F.col("from_sec"), F.col("to_sec"))), *sound_steps()])
    # Clips are brought into order while their rows are narrow.
    chains = clips.sortWithinPartitions("program_id", "item_no").select("program_id", F.col("item_no").alias("clip_no"), "input_no", *[e.alias(c) for c, e in (video.texts | sound.texts).items()])
    before = Window.partitionBy("program_id").orderBy("clip_no").rowsBetween(Window.unboundedPreceding, -1)
    chains = chains.withColumns({"nv": video.count(), "na": sound.count()})
    placed = chains.withColumn("base", F.coalesce(F.sum(F.col("nv") + F.col("na")).over(before), F.lit(0)))
    base, number = F.col("base"), F.col("input_no").cast("string")
    placed = placed.withColumns(video.labels(base) | sound.labels(base + F.col("nv")))
    return placed, video.links(base, F.concat(number, F.lit(":v"))) + sound.links(base + F.col("nv"), F.concat(number, F.lit(":a")))


def filter_rows(clips: DataFrame, width: Column, height: Column) -> DataFrame:
    """(program_id, seq, clip_no, input, expr, output) of every clip's chain."""
    placed, links = _linked(clips, width, height)
    rows = placed.select("program_id", "clip_no", F.explode(link_rows(links)).alias("f")).filter("f is not null")
    return rows.select("program_id", F.col("f.at").alias("seq"), "clip_no", F.get("f.inputs", F.lit(0)).alias("input"), "f.expr", F.get("f.outputs", F.lit(0)).alias("output"))


def filter_graphs(clips: DataFrame, width: Column, height: Column) -> DataFrame:
    """(program_id, graph): what rendered(filter_rows()) gives; a clip's filters are joined inside its row, so that only clips are gathered."""
    placed, links = _linked(clips, width, height)
    gathered = placed.select("program_id", "clip_no", link_text(links).alias("x")).groupBy("program_id").agg(F.sort_array(F.collect_list(F.struct("clip_no", "x"))).alias("xs"))
    return gathered.select("program_id", F.array_join(F.col("xs").getField("x"), ";").alias("graph"))


def rendered(rows: DataFrame) -> DataFrame:
    """(program_id, graph): [input]expr[output] joined by ; in order. A program's filters are few: one array each."""
    one = F.concat(F.lit("["), F.col("input"), F.lit("]"), F.col("expr"), F.lit("["), F.col("output"), F.lit("]"))
    gathered = rows.groupBy("program_id").agg(F.sort_array(F.collect_list(F.struct("seq", one.alias("x")))).alias("xs"))
    return gathered.select("program_id", F.array_join(F.transform("xs", lambda x: x["x"]), ";").alias("graph"))


def drawtext(x: Column, y: Column) -> Column:
    """Filter text of a text overlay (content, font, size, color, start_sec, end_sec, fade_in, fade_out, background, background_padding)."""
    n = lambda c: number_text(c if isinstance(c, Column) else F.col(c))
    quote = F.replace("content", F.lit("'"), F.lit("'\\''"))
    font = F.when(F.col("font").rlike(r"[/\\]"), F.concat(F.lit("fontfile='"), F.col("font"), F.lit("'"))).otherwise(F.concat(F.lit("font='"), F.col("font"), F.lit("'")))
    rise = F.concat(F.lit("(t-"), n("start_sec"), F.lit(")/"), n("fade_in"))
    fall = F.concat(F.lit("("), n("end_sec"), F.lit("-t)/"), n("fade_out"))
    rising = lambda other: F.concat(F.lit("if(lt(t\\,"), n(F.col("start_sec") + F.col("fade_in")), F.lit(")\\,"), rise, F.lit("\\,"), other, F.lit(")"))
    falling = F.concat(F.lit("if(gt(t\\,"), n(F.col("end_sec") - F.col("fade_out")), F.lit(")\\,"), fall, F.lit("\\,1)"))
    alpha = F.coalesce(rising(falling), rising(F.lit("1")), falling)
    box = F.concat(F.lit(":box=1:boxcolor="), F.col("background"), F.lit(":boxborderw="), F.coalesce("background_padding", F.lit(BOX_PADDING)).cast("string"))
    return F.concat(
        F.lit("drawtext=text='"), quote, F.lit("':"), font, F.lit(":fontsize="), F.col("size").cast("string"), F.lit(":fontcolor="), F.col("color"), F.lit(":x="), x, F.lit(":y="), y,
        F.lit(":enable='between(t,"), n("start_sec"), F.lit(","), n("end_sec"), F.lit(")'"), F.coalesce(F.concat(F.lit(":alpha='"), alpha, F.lit("'")), F.lit("")), F.coalesce(box, F.lit("")),
    )


def output_args(outputs: DataFrame, encoders: DataFrame, qualities: DataFrame) -> DataFrame:
    """outputs with `args`: encoder, preset, quality, rate, size and path. The lookups have four rows each."""
    met = outputs.join(F.broadcast(encoders), "codec").join(F.broadcast(qualities), "quality")
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    parts = [F.lit("-c:v"), F.col("encoder"), F.lit("-preset"), F.col("preset"), F.lit("-crf"), F.col("crf").cast("string"), F.lit("-r"), F.col("fps").cast("string"), F.lit("-s"), size, F.col("path")]
    return met.select(*outputs.columns, F.array(*parts).alias("args"))


def command_text(inputs: Column, graph: Column, maps: Column, args: Column) -> Column:
    """The whole command, its arguments joined by spaces; without a graph there is no graph argument."""
    flag = lambda name, xs: F.flatten(F.transform(xs, lambda x: F.array(F.lit(name), x)))
    graphed = F.when(graph.isNotNull(), F.array(F.lit("-filter_complex"), graph)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.lit("ffmpeg"), F.lit("-y")), flag("-i", inputs), graphed, flag("-map", maps), args), " ")
