"""Column helpers and the shared-folder rule that several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicery.sources.shared import discard, scratch, shared_dir, stored  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHITE = " \t\n\x0b\f\r"  # [\x20\x09-\x0D]


def without_white(text: Column) -> Column:
    """The text after deleting every character of [\\x20\\x09-\\x0D]."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else. Pure ASCII takes the byte-wise lower()."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def carried(df: DataFrame, *made: str) -> list[Column]:
    """The columns of df that pass through: all but those whose names the operator itself makes."""
    names = {m.lower() for m in made}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
