"""Fixed values of the timeline model, and the lookup tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# They must be these for equal results.
TRANSITIONS = (
    "fade fadeblack fadewhite dissolve wipeleft wiperight wipeup wipedown slideleft slideright slideup slidedown "
    "zoomin smoothleft smoothright smoothup smoothdown squeezeh squeezev circlecrop pixelize"
).split()
HYPHENATED = (
    "fade-black fade-white wipe-left wipe-right wipe-up wipe-down slide-left slide-right slide-up slide-down "
    "zoom-in smooth-left smooth-right smooth-up smooth-down squeeze-h squeeze-v circle-crop"
).split()
POSITIONS = "center top-left top-right bottom-left bottom-right top bottom left right".split()
FORMATS = "mp4 mkv webm mov".split()
ENCODERS = {"h264": "libx264", "h265": "libx265", "vp9": "libvpx-vp9", "av1": "libaom-av1"}
QUALITIES = {"low": ("ultrafast", 28), "medium": ("medium", 23), "high": ("slow", 18), "lossless": ("veryslow", 0)}
FITS = "fill crop letterbox".split()
PROJECT = {"width": 1920, "height": 1080, "fps": 30, "format": "mp4", "codec": "h264", "quality": "high", "fit": "fill"}
DEFAULTS = {
    "text": {"at": 0.0, "duration": 5.0, "font": "Arial", "size": 24, "color": "FFFFFF", "position": "center"},
    "image": {"at": 0.0, "duration": 5.0, "position": "top-right"},
    "pip": {"at": 0.0, "duration": 5.0, "position": "bottom-right", "scale": 0.25},
    "gap": {"duration": 1.0},
    "freeze": {"at": 0.0, "duration": 3.0},
    "transition": {"type": "fade", "duration": 1.0},
}
#: Closed ranges of clip attributes; the others of RULES are strict or minima.
RANGES = {
    "zoom": (1.0, 10.0), "blur": (0.0, 100.0), "opacity": (0.0, 1.0), "vignette": (0.0, 1.0), "grain": (0.0, 1.0), "pan_x": (-1.0, 1.0),
    "pan_y": (-1.0, 1.0), "volume": (0.0, 1.0), "brightness": (-1.0, 1.0), "contrast": (0.0, 3.0), "saturation": (0.0, 3.0),
}
UNKNOWN_LENGTH = 10.0
MARGIN = "10"
BOX_PADDING = 12


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def transition_names(spark: SparkSession) -> DataFrame:
    """(spelling, name) of the 21 kinds; a hyphenated spelling names the joined one."""
    return _table(spark, [(x, x.replace("-", "")) for x in TRANSITIONS + HYPHENATED], "spelling string, name string")


def _axis(word: str, near: str, far: str, whole: str, part: str) -> str:
    parts = word.split("-")
    return MARGIN if near in parts else f"{whole}-{part}-{MARGIN}" if far in parts else f"({whole}-{part})/2"


#: (x, y) of each position, 10 pixels from the edges, or centred.
TEXT_SPOTS = {p: (_axis(p, "left", "right", "w", "text_w"), _axis(p, "top", "bottom", "h", "text_h")) for p in POSITIONS}
IMAGE_SPOTS = {p: (_axis(p, "left", "right", "W", "w"), _axis(p, "top", "bottom", "H", "h")) for p in POSITIONS}


def position_table(spark: SparkSession) -> DataFrame:
    """(position, text_x, text_y, image_x, image_y)."""
    return _table(spark, [(p, *TEXT_SPOTS[p], *IMAGE_SPOTS[p]) for p in POSITIONS], "position string, text_x string, text_y string, image_x string, image_y string")


def encoder_table(spark: SparkSession) -> DataFrame:
    return _table(spark, list(ENCODERS.items()), "codec string, encoder string")


def quality_table(spark: SparkSession) -> DataFrame:
    return _table(spark, [(k, p, c) for k, (p, c) in QUALITIES.items()], "quality string, preset string, crf int")


def range_rules(spark: SparkSession) -> DataFrame:
    """(key, low, high, low_open): values allowed for numeric attributes."""
    rows = [(k, a, b, False) for k, (a, b) in RANGES.items()] + [("sharpen", 0.0, None, True), ("speed", 0.0, 100.0, True), ("loop", 1.0, None, False)]
    return _table(spark, rows, "key string, low double, high double, low_open boolean")


def item_rules(spark: SparkSession) -> DataFrame:
    """(kind, key, low, high, low_open): the rules of clips, and those of images."""
    clips = range_rules(spark).select(F.lit("clip").alias("kind"), "key", "low", "high", "low_open")
    return clips.unionByName(_table(spark, [("image", "scale", 0.0, 10.0, False), ("image", "opacity", 0.0, 1.0, False)], "kind string, key string, low double, high double, low_open boolean"))


def violation(value, low, high, low_open):
    """True where a value is outside its rule."""
    return F.coalesce(F.when(low_open, value <= low).otherwise(value < low), F.lit(False)) | F.coalesce(value > high, F.lit(False))
