"""License scan: Aho-Corasick over notice phrases and identifier tags, a shunting-yard parser for expressions.

Every word of every text is hashed; rows that hold a trigger word (one of each phrase's words) go through
the automaton over their words, joined by single spaces, so that a match is a run of whole words. Notices in
running text are expressions too: each phrase is an operand, and two of them with nothing but a joining word and some
filling words between (FILLING, numbers, "or later") belong to one expression ("the MIT License or the Apache License,
version 2.0"). Where the words of an identifier tag match, the expression behind each tag is parsed. All expressions go
through one shunting-yard parser: WITH binds tighter than AND, AND tighter than OR, parentheses as usual. An operand is worth its license's openness (PERMISSIVE);
OR takes the larger, AND the smaller, WITH the left one. A text's score is the smallest over its notices
and expressions: all of them bind its reader. Without any it is 0.

Defined results: null and empty texts have no words and no labels ("" and ""), null first and last word,
score 0. An expression that does not parse still gives the known names in it as labels, at the smallest
of their values. Repeated rows are alike; an empty table gives no rows; other columns pass through, an
input column named like an output column is replaced.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicery.llm.common import carried
from splicery.llm.words import ALNUM, words

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution license": "cc-by",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
    "artistic license": "artistic",
    "zlib license": "zlib",
    "the unlicense": "unlicense",
    "python software foundation license": "psf",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "open database license": "odbl",
    "sil open font license": "ofl",
    "microsoft public license": "ms-pl",
    "postgresql license": "postgresql",
    "blue oak model license": "blueoak",
    "server side public license": "sspl",
    "business source license": "busl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "gpl v2": "gpl",
    "gpl v3": "gpl",
    "gplv2": "gpl",
    "gplv3": "gpl",
    "lgplv2": "lgpl",
    "lgplv3": "lgpl",
    "agplv3": "agpl",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
}
#: Operands that only WITH takes.
EXCEPTIONS = {"classpath exception": "classpath-exception", "runtime library exception": "gcc-exception", "linking exception": "linking-exception", "llvm exception": "llvm-exception"}
#: Words that may stand between two phrases of one expression, at most GAP of them.
FILLING = frozenset("the a an any either version versions v terms of under license licence licenses its your option at choice".split())
GAP = 10
TAG = "spdx license identifier"
#: Openness of a family: the longest of these names that an identifier begins with counts; unknown names get 0.5.
PERMISSIVE = {
    "0bsd": 1.0, "afl": 0.9, "agpl": 0.3, "apache": 1.0, "artistic": 0.8, "blueoak": 1.0, "bsd": 1.0, "bsl": 1.0, "busl": 0.2, "cc-by": 0.9, "cc-by-nc": 0.2,
    "cc-by-nd": 0.2, "cc-by-sa": 0.6, "cc0": 1.0, "cddl": 0.6, "cecill": 0.4, "epl": 0.7, "eupl": 0.4, "gfdl": 0.4, "gpl": 0.4, "isc": 1.0, "lgpl": 0.6,
    "mit": 1.0, "mpl": 0.7, "ms-pl": 0.8, "ms-rl": 0.6, "ncsa": 1.0, "odbl": 0.5, "ofl": 0.9, "openssl": 0.9, "osl": 0.4, "postgresql": 1.0,
    "proprietary": 0.0, "psf": 1.0, "public-domain": 1.0, "python": 1.0, "sspl": 0.1, "unlicense": 1.0, "upl": 1.0, "w3c": 1.0, "wtfpl": 1.0, "x11": 1.0,
    "zlib": 1.0, "zpl": 0.9,
}
_RANK = {"or": 1, "and": 2, "with": 3}
_TAGGED = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACED = bytes(b if ALNUM[b] else 32 for b in _FOLD)


def openness(name: str) -> float:
    known = [k for k in PERMISSIVE if name == k or name.startswith(f"{k}-")]
    return PERMISSIVE[max(known, key=len)] if known else 0.5


def parse_expression(text: str) -> tuple[list[str], float] | None:
    """(license names, value) of an expression, or None if it is not one."""
    return parse_tokens(_TOKEN.findall(text.lower()))


def parse_tokens(tokens: list[str]) -> tuple[list[str], float] | None:
    values: list[tuple[list[str], float]] = []
    waiting: list[str] = []

    def reduce() -> bool:
        op = waiting.pop()
        if len(values) < 2 or op == "(":
            return False
        (right, y), (left, x) = values.pop(), values.pop()
        values.append((left, x) if op == "with" else (left + right, min(x, y) if op == "and" else max(x, y)))
        return True

    operand_next = True
    for token in tokens:
        if token == "(":
            if not operand_next:
                return None
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                if not reduce():
                    return None
            if not waiting or operand_next:
                return None
            waiting.pop()
        elif token in _RANK:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[token]:
                if not reduce():
                    return None
            waiting.append(token)
            operand_next = True
        elif operand_next:
            name = token.rstrip("+.")
            values.append(([name], openness(name)))
            operand_next = False
        else:
            return None
    while waiting:
        if not reduce():
            return None
    return values[0] if len(values) == 1 and not operand_next else None


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in [*BASE, *MORE, *EXCEPTIONS, TAG]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def _triggers() -> np.ndarray:
    """Hashes of one word of each phrase: its last, or the brand of the short ones."""
    rare = {p.split()[0] if p.startswith("cc ") else p.split()[-1] for p in [*BASE, *MORE, TAG]}
    return np.sort(next(words(pa.array([" ".join(sorted(rare))]), ALNUM)).hash)


def joining(gap: list[str]) -> str | None:
    """The joining word of the words between two phrases, if nothing but filling words stands beside it."""
    text = " ".join(gap)
    for later in ("or any later version", "or any later", "or later version", "or later"):
        text = f" {text} ".replace(f" {later} ", " ").strip()
    rest = [w for w in text.split() if w not in FILLING and not w.isdigit()]
    return rest[0] if len(rest) == 1 and rest[0] in _RANK else None


def notice_expressions(line: str, hits: list[tuple[int, int, str]]) -> list[list[str]]:
    """Token lists of the phrases (start, end, name) of a text, joined where the words between say so."""
    out: list[list[str]] = []
    last = 0
    for start, end, name in hits:
        gap = line[last:start].split() if out and start - last < 16 * GAP else [""] * (GAP + 1)
        word = joining(gap) if out and len(gap) <= GAP else None
        if name in EXCEPTIONS.values():
            if word != "with" or out[-1][-2:-1] == ["with"]:
                continue
        if word:
            out[-1] += [word, name]
        else:
            out.append([name])
        last = end
    return out


_ready: dict[str, object] = {}


def scan_text(text: str) -> tuple[int, int | None, int | None, str, str, float]:
    """(places of base phrases, first, last, base labels, labels, score) of one text."""
    if "automaton" not in _ready:
        _ready["automaton"] = _automaton()
    line = " " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_SPACED).split()).decode("utf-8", "surrogatepass") + " "
    before = None
    places, base, labels, worth, tagged = [], set(), set(), [], False
    hits: dict[int, tuple[int, str]] = {}
    for end, phrase in _ready["automaton"].iter(line):
        if phrase in BASE:
            if before is None:
                before = np.cumsum(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
            places.append(int(before[end - len(phrase) - 1]) - 1)
            base.add(BASE[phrase])
        elif phrase == TAG:
            tagged = True
            continue
        name = BASE.get(phrase) or MORE.get(phrase) or EXCEPTIONS[phrase]
        if phrase not in EXCEPTIONS:
            labels.add(name)
        start = end - len(phrase) - 1
        hits[start] = max(hits.get(start, (0, "")), (end, name))  # of phrases that begin together the longest is the operand
    for tokens in notice_expressions(line, [(a, b, name) for a, (b, name) in sorted(hits.items())]):
        worth.append(parse_tokens(tokens)[1])
    for expression in _TAGGED.findall(text) if tagged else ():
        got = parse_expression(expression)
        if got is None:
            names = [n for t in _TOKEN.findall(expression.lower()) if t not in _RANK and openness(n := t.rstrip("+.")) != 0.5]
            got = names, min((openness(n) for n in names), default=0.5)
        labels.update(got[0])
        worth.append(got[1])
    return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(worth, default=0.0)


_FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


def _scan(column: pa.Array) -> pa.Array:
    triggers = _triggers()
    out = []
    for first, last, row, h in words(column, ALNUM):
        n = np.bincount(row, minlength=last - first).tolist()
        hits = set(row[triggers[np.minimum(np.searchsorted(triggers, h), len(triggers) - 1)] == h].tolist())
        out += [(n[i], *(scan_text(column[first + i].as_py()) if i in hits else (0, None, None, "", "", 0.0))) for i in range(last - first)]
    columns = zip(*out, strict=True) if out else [[] for _ in _FIELDS]
    return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _FIELDS.values(), strict=True)], list(_FIELDS))


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    kind = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    found = docs.withColumn("_x_scan", F.arrow_udf(_scan, kind)(F.col(text)))
    return found.select(*carried(docs, *_FIELDS), *[F.col(f"_x_scan.{k}").alias(k) for k in _FIELDS])
