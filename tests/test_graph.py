"""Whole-program graphs against a plain builder that adds one filter after another, and graphs known by heart."""

import random

import pytest

from splicery.plans import graph

SCHEMA = "program_id int, track_kind string, item_no int, kind string, asset string, " + ", ".join(
    f"{c} {t}" for t, names in graph.COLUMNS.items() for c in names.split() if c not in ("track_kind", "kind", "asset", "width", "height", "fps", "fit")
)
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
DEFAULT = {"gap": {"duration_sec": 1.0}, "freeze": {"at_sec": 0.0, "duration_sec": 3.0}, "transition": {"duration_sec": 1.0, "transition": "fade"}}
DEFAULT |= {"text": {"at_sec": 0.0, "duration_sec": 5.0, "font": "Arial", "size": 24, "color": "FFFFFF", "position": "center"}}
DEFAULT |= {"image": {"at_sec": 0.0, "duration_sec": 5.0, "position": "top-right"}, "pip": {"at_sec": 0.0, "duration_sec": 5.0, "position": "bottom-right", "scale": 0.25}}


def n(x):
    return str(int(x)) if x == int(x) else repr(x)


class Plain:
    """One program, filter by filter."""

    def __init__(self, items, width, height, fps, fit):
        self.out, self.labels, self.size = [], 0, f"{width}:{height}"
        self.w, self.h, self.fps = width, height, fps
        items = [DEFAULT.get(i["kind"], {}) | {k: v for k, v in i.items() if v is not None} for i in items]
        video = [i for i in items if i["track_kind"] == "video"]
        audio = [i for i in items if i["track_kind"] == "audio" and i["kind"] == "clip"]
        over = {k: [i for i in items if i["track_kind"] == "overlay" and i["kind"] == k] for k in ("pip", "image", "subtitle")}
        texts = [i for i in items if i["track_kind"] == "text" and i["kind"] == "text"]
        known = dict.fromkeys([i["asset"] for i in video if i["kind"] in ("clip", "freeze")] + [i["asset"] for i in [*audio, *over["image"], *over["pip"]]])
        self.number = {a: k for k, a in enumerate(known)}
        self.maps = []
        if not video:
            return
        v, a = self.sequence(video, bool(audio))
        if fit == "letterbox":
            v = self.add("pad", [v], f"pad={self.size}:(ow-iw)/2:(oh-ih)/2:color=black")
        for i in over["pip"]:
            t = self.add("tv", [self.source(i, "v")], self.cut("trim", i))
            v = self.lay(v, self.add("sc", [t], f"scale={int(width * i['scale'])}:{int(height * i['scale'])}"), i)
        for i in over["image"]:
            t = self.source(i, "v")
            if "scale" in i:
                t = self.add("sc", [t], f"scale=iw*{n(i['scale'])}:ih*{n(i['scale'])}")
            if i.get("opacity", 1) < 1:
                t = self.add("op", [t], f"format=rgba,colorchannelmixer=aa={n(i['opacity'])}")
            v = self.lay(v, t, i)
        for i in over["subtitle"]:
            v = self.add("sub", [v], "subtitles=filename='" + i["path"].replace("\\", "/").replace("'", "'\\''") + "'")
        for i in texts:
            v = self.text(v, i)
        if audio:
            self.out.append(([a], "anullsink", []))
            sung = [self.sound(i, self.add("ta", [self.source(i, "a")], self.cut("atrim", i))) for i in audio]
            a = sung[0] if len(sung) == 1 else self.add("amx", sung, f"amix=inputs={len(sung)}:duration=longest")
        self.maps = [f"[{v}]", f"[{a}]"]

    def add(self, prefix, inputs, expr, second=None):
        made = [f"{p}{self.labels + k}" for k, p in enumerate(filter(None, [prefix, second]))]
        self.labels += len(made)
        self.out.append((inputs, expr, made))
        return made if second else made[0]

    def source(self, i, stream):
        return f"{self.number[i['asset']]}:{stream}"

    def cut(self, name, i):
        bounds = ":".join(f"{k}={n(i[c])}" for k, c in (("start", "from_sec"), ("end", "to_sec")) if c in i)
        return name + (f"={bounds}" if bounds else "") + (",setpts" if name == "trim" else ",asetpts") + "=PTS-STARTPTS"

    def raw(self, i):
        return i["duration_sec"] if "duration_sec" in i else i["to_sec"] - i["from_sec"] if "from_sec" in i and "to_sec" in i else 10.0

    def seconds(self, i):
        return i["resolved_sec"] if "resolved_sec" in i else self.raw(i) / i.get("speed", 1.0)

    def lay(self, v, image, i):
        x, y = {"center": ("(W-w)/2", "(H-h)/2"), "top-right": ("W-w-10", "10"), "bottom-right": ("W-w-10", "H-h-10"), "left": ("10", "(H-h)/2")}[i["position"]]
        return self.add("ov", [v, image], f"overlay=x={x}:y={y}:enable='between(t,{n(i['at_sec'])},{n(i['at_sec'] + i['duration_sec'])})'")

    def text(self, v, i):
        x, y = {"center": ("(w-text_w)/2", "(h-text_h)/2"), "top-right": ("w-text_w-10", "10"), "bottom-right": ("w-text_w-10", "h-text_h-10"), "left": ("10", "(h-text_h)/2")}[i["position"]]
        start, end = i["at_sec"], i["at_sec"] + i["duration_sec"]
        font = f"font{'file' * ('/' in i['font'])}='{i['font']}'"
        alpha = ""
        if "fade_out" in i:
            alpha = f"if(gt(t\\,{n(end - i['fade_out'])})\\,({n(end)}-t)/{n(i['fade_out'])}\\,1)"
        if "fade_in" in i:
            alpha = f"if(lt(t\\,{n(start + i['fade_in'])})\\,(t-{n(start)})/{n(i['fade_in'])}\\,{alpha or 1})"
        box = f":box=1:boxcolor={i['background']}:boxborderw={i.get('background_padding', 12)}" if "background" in i else ""
        alpha = f":alpha='{alpha}'" if alpha else ""
        shown = i["content"].replace("'", "'\\''")
        return self.add("txt", [v], f"drawtext=text='{shown}':{font}:fontsize={i['size']}:fontcolor={i['color']}:x={x}:y={y}:enable='between(t,{n(start)},{n(end)})'{alpha}{box}")

    def picture(self, i):
        v = self.add("tv", [self.source(i, "v")], self.cut("trim", i))

        def then(prefix, expr):
            nonlocal v
            v = self.add(prefix, [v], expr)

        if "crop" in i:
            then("cr", "crop=100:50:1:2")
        if "flip" in i:
            then("fl", "hflip,vflip")
        then("sc", f"scale={self.size}")
        if "speed" in i:
            then("spd", f"setpts=PTS/{n(i['speed'])}")
        if "brightness" in i or "saturation" in i:
            then("eq", "eq=" + ":".join(f"{k}={n(i[k])}" for k in ("brightness", "saturation") if k in i))
        if "blur" in i:
            then("bl", "boxblur=3:3")
        if "sharpen" in i:
            then("shp", f"unsharp=5:5:{n(i['sharpen'])}:5:5:0")
        if "grain" in i:
            then("grn", f"noise=alls={int(i['grain'] * 100)}:allf=t")
        if i.get("opacity", 1) < 1:
            then("opc", f"format=rgba,colorchannelmixer=aa={n(i['opacity'])}")
        if i.get("reverse"):
            then("rev", "reverse")
        if "chromakey" in i:
            self.labels += i["chromakey"].startswith("#")
            then("ck", "chromakey=" + {"blue": "0x0000FF", "green": "0x00FF00"}.get(i["chromakey"], "0x" + i["chromakey"][1:]) + ":0.1:0.2")
        if i.get("stabilize"):
            then("stb", "deshake")
        return v

    def sound(self, i, a):
        def then(prefix, expr):
            nonlocal a
            a = self.add(prefix, [a], expr)

        if "volume" in i:
            then("vol", f"volume={n(i['volume'])}")
        speed = i.get("speed")
        while speed and speed < 0.5:
            then("at", "atempo=0.5")
            speed /= 0.5
        if speed:
            then("at", f"atempo={n(speed)}")
        if "fade_in" in i:
            then("af", f"afade=t=in:st=0:d={n(i['fade_in'])}")
        if "fade_out" in i:
            then("af", f"afade=t=out:st={n(max(self.seconds(i) - i['fade_out'], 0.0))}:d={n(i['fade_out'])}")
        if i.get("reverse"):
            then("arev", "areverse")
        if i.get("normalize"):
            then("ln", "loudnorm")
        return a

    def silence(self, seconds):
        return self.add("sil", [], f"aevalsrc=0:s=44100:d={n(seconds)}")

    def clip(self, i, quiet):
        v = self.picture(i)
        if quiet:
            return v, self.silence(self.seconds(i))
        a = self.add("ta", [self.source(i, "a")], self.cut("atrim", i)) if i.get("has_audio", True) else self.silence(self.seconds(i))
        return v, self.sound(i, a)

    def joined(self, pairs):
        return tuple(self.add("outv", [x for p in pairs for x in p], f"concat=n={len(pairs)}:v=1:a=1", "outa"))

    def sequence(self, items, quiet):
        segments, waiting, total = [], None, 0.0
        for i in items:
            d = i.get("duration_sec")
            if i["kind"] == "clip":
                copies = [self.clip(i, quiet) for _ in range(max(1, i.get("loop_count", 1)))]
                v, a = copies[0] if len(copies) == 1 else self.joined(copies)
                if waiting is None:
                    segments.append((v, a))
                    total += self.seconds(i)
                elif segments:
                    length, kind = waiting
                    pv, pa = segments[-1]
                    v = self.add("xf", [pv, v], f"xfade=transition={kind}:duration={n(length)}:offset={n(max(total - length, 0.0))}")
                    segments[-1] = v, self.add("axf", [pa, a], f"acrossfade=d={n(length)}:c1=tri:c2=tri")
                    total += self.seconds(i) - length
                waiting = None
            elif i["kind"] == "transition":
                waiting = d, i["transition"].replace("-", "")
            elif i["kind"] == "gap":
                segments.append((self.add("clr", [], f"color=c=black:s={self.w}x{self.h}:r={self.fps}:d={n(d)}"), self.silence(d)))
                total += d
            elif i["kind"] == "freeze":
                t = self.add("tv", [self.source(i, "v")], f"trim=start={n(i['at_sec'])}:end={n(i['at_sec'] + 0.04)},setpts=PTS-STARTPTS")
                segments.append((self.add("tp", [self.add("sc", [t], f"scale={self.size}")], f"tpad=stop_mode=clone:stop_duration={n(d)}"), self.silence(d)))
                total += d
        if not segments:
            return "0:v", "0:a"
        return segments[0] if len(segments) == 1 else self.joined(segments)


def rendered(p):
    return ";".join("".join(f"[{x}]" for x in i) + e + "".join(f"[{x}]" for x in o) for i, e, o in p.out)


def graphs(spark, programs, projects):
    rows = [tuple((i | {"program_id": p, "item_no": k}).get(c) for c in NAMES) for p, items in programs.items() for k, i in enumerate(items)]
    made = graph.program_graphs(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame([(p, *v) for p, v in projects.items()], "program_id int, width int, height int, fps int, fit string"))
    return {r.program_id: (r.graph, r.maps) for r in made.select("program_id", graph.graph_text(made.filters).alias("graph"), "maps").collect()}


def clip(asset="v", **more):
    return {"track_kind": "video", "kind": "clip", "asset": asset} | more


def item(track, kind, **more):
    return {"track_kind": track, "kind": kind} | more


def random_program(rng):
    some = lambda p, **more: more if rng.random() < p else {}
    asset = lambda: f"a{rng.randint(0, 3)}"
    q = lambda lo, hi: rng.randint(lo * 4, hi * 4) / 4

    def one():
        kind = rng.choice(["clip"] * 5 + ["transition", "transition", "gap", "freeze", "text", "audio", "audio clip", "title", "image", "pip", "subtitle"])
        if kind in ("clip", "audio clip"):
            out = {"kind": "clip", "asset": asset(), "track_kind": "video" if kind == "clip" else "audio"}
            out |= some(0.7, from_sec=q(0, 5)) | some(0.7, to_sec=q(6, 20)) | some(0.3, duration_sec=q(1, 9)) | some(0.3, speed=rng.choice([0.25, 0.5, 2.0])) | some(0.2, resolved_sec=q(1, 9)) | some(0.2, loop_count=rng.randint(1, 3))
            out |= some(0.2, crop="100x50+1+2") | some(0.2, flip="both") | some(0.2, brightness=0.5) | some(0.2, saturation=1.25) | some(0.2, blur=15.0) | some(0.2, sharpen=1.5) | some(0.2, grain=0.25) | some(0.2, opacity=rng.choice([0.5, 1.0]))
            return out | some(0.2, reverse=True) | some(0.3, chromakey=rng.choice(["green", "blue", "#12AB34"])) | some(0.2, stabilize=True) | some(0.2, volume=0.5) | some(0.2, fade_in=1.5) | some(0.2, fade_out=2.0) | some(0.2, normalize=True) | some(0.2, has_audio=False)
        if kind == "transition":
            return item("video", kind, **some(0.8, duration_sec=q(1, 3)), **some(0.7, transition=rng.choice(["wipe-left", "dissolve"])))
        if kind in ("gap", "freeze"):
            return item("video", kind, **some(0.7, duration_sec=q(1, 5)), **({"asset": asset()} | some(0.5, at_sec=q(0, 3)) if kind == "freeze" else {}))
        if kind == "audio":
            return item("audio", "gap", duration_sec=1.0)
        spot = some(0.5, at_sec=q(0, 4)) | some(0.5, duration_sec=q(1, 9)) | some(0.5, position=rng.choice(["center", "top-right", "bottom-right", "left"]))
        if kind in ("text", "title"):
            return item("text" if kind == "title" else "video", "text", content="It's on", **spot, **some(0.5, fade_in=0.5), **some(0.5, fade_out=1.0), **some(0.3, background="red"), **some(0.2, background_padding=4), **some(0.3, font="/f/a.ttf"), **some(0.3, size=64))
        if kind == "subtitle":
            return item("overlay", kind, path="it's\\a.srt")
        return item("overlay", kind, asset=asset(), **spot, **some(0.5, scale=0.5), **(some(0.5, opacity=0.75) if kind == "image" else some(0.5, from_sec=2.0)))

    return [one() for _ in range(rng.randint(1, 12))]


def test_graphs_equal_the_plain_builder(spark):
    rng = random.Random(17)
    programs = {p: random_program(rng) for p in range(300)}
    projects = {p: (rng.choice([1280, 1921]), 720, rng.choice([24, 30]), rng.choice(["fill", "letterbox"])) for p in programs}
    got = graphs(spark, programs, projects)
    for p, items in programs.items():
        plain = Plain(items, *projects[p])
        assert got.get(p, ("", [])) == (rendered(plain), plain.maps), (p, items)


@pytest.mark.parametrize(
    ("items", "fit", "want", "maps"),
    [
        ([clip(to_sec=5.0)], "letterbox", "[0:v]trim=end=5,setpts=PTS-STARTPTS[tv0];[tv0]scale=640:360[sc1];[0:a]atrim=end=5,asetpts=PTS-STARTPTS[ta2];[sc1]pad=640:360:(ow-iw)/2:(oh-ih)/2:color=black[pad3]", ["[pad3]", "[ta2]"]),
        ([item("video", "gap", duration_sec=2.0)], "fill", "color=c=black:s=640x360:r=30:d=2[clr0];aevalsrc=0:s=44100:d=2[sil1]", ["[clr0]", "[sil1]"]),
        (
            [clip(has_audio=False, duration_sec=3.0), item("audio", "clip", asset="m")], "fill",
            "[0:v]trim,setpts=PTS-STARTPTS[tv0];[tv0]scale=640:360[sc1];aevalsrc=0:s=44100:d=3[sil2];[sil2]anullsink;[1:a]atrim,asetpts=PTS-STARTPTS[ta3]", ["[sc1]", "[ta3]"],
        ),
        (
            [clip("a", duration_sec=10.0), item("video", "transition"), clip("b", duration_sec=5.0)], "fill",
            "[0:v]trim,setpts=PTS-STARTPTS[tv0];[tv0]scale=640:360[sc1];[0:a]atrim,asetpts=PTS-STARTPTS[ta2];[1:v]trim,setpts=PTS-STARTPTS[tv3];[tv3]scale=640:360[sc4];[1:a]atrim,asetpts=PTS-STARTPTS[ta5];"
            "[sc1][sc4]xfade=transition=fade:duration=1:offset=9[xf6];[ta2][ta5]acrossfade=d=1:c1=tri:c2=tri[axf7]", ["[xf6]", "[axf7]"],
        ),
        ([item("video", "transition"), item("text", "text", content="x")], "fill", "[0:v]drawtext=text='x':font='Arial':fontsize=24:fontcolor=FFFFFF:x=(w-text_w)/2:y=(h-text_h)/2:enable='between(t,0,5)'[txt0]", ["[txt0]", "[0:a]"]),
    ],
)
def test_graphs_known_by_heart(spark, items, fit, want, maps):
    assert graphs(spark, {1: items}, {1: (640, 360, 30, fit)})[1] == (want, maps)


def test_programs_without_pictures_have_no_graph(spark):
    assert graphs(spark, {1: [item("audio", "clip", asset="m")]}, {1: (640, 360, 30, "fill")}) == {}


def test_whole_programs_read_their_lines_once(spark):
    from splicery.program_queries import QUERIES

    for name in ("program_graph", "program_command"):
        lines = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert sum("l_orderkey" in x and "Relation " in x for x in lines) == 1
