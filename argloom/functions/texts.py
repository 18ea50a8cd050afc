"""Distances and cuts of texts: helpers for one pair at a time, and the same as functions of columns."""

from __future__ import annotations

import re
from difflib import unified_diff
from textwrap import wrap

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .reading import plain
from .reading import shorten as _shorten


def _core(a: str, b: str) -> tuple[str, str]:
    """Two texts without what they begin and end with in common."""
    lo, most = 0, min(len(a), len(b))
    step = most
    while step:  # the common beginning, by halves
        if a[lo : lo + step] == b[lo : lo + step] and lo + step <= most:
            lo += step
        step //= 2
    while lo < most and a[lo] == b[lo]:
        lo += 1
    a, b = a[lo:], b[lo:]
    hi, most = 0, min(len(a), len(b))
    while hi < most and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    return a[: len(a) - hi], b[: len(b) - hi]


def distance(a: str, b: str, restricted: bool = True, most: int | None = None) -> int:
    """Damerau-Levenshtein distance; restricted: nothing is edited twice (optimal string alignment), a column of the table at a time.

    A column is two numbers with a bit for each row, where the table rises and where it falls (Hyyrö's recurrence), so a step costs a few
    operations on long integers. With `most` it ends, with a larger number, once the distance can't be within it."""
    if not restricted:
        return _unrestricted(a, b)
    a, b = _core(a, b)
    if len(a) > len(b):
        a, b = b, a
    if not a or most is not None and len(b) - len(a) > most:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    rises, falls, same, last, out = full, 0, 0, 0, len(a)
    for j, c in enumerate(b):
        here = where.get(c, 0)
        swapped = (~same & here) << 1 & last
        same = ((here & rises) + rises ^ rises | here | falls | swapped) & full
        up, down = (falls | ~(same | rises)) & full, same & rises
        out += bool(up & top) - bool(down & top)
        if most is not None and out - (len(b) - 1 - j) > most:
            return most + 1
        up, down = up << 1 | 1, down << 1
        rises, falls, last = (down | ~(same | up)) & full, up & same & full, here
    return out


def _unrestricted(a: str, b: str) -> int:
    most = len(a) + len(b)
    table = [[most] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        table[i + 1][1] = i
    for j in range(len(b) + 1):
        table[1][j + 1] = j
    seen: dict[str, int] = {}
    for i, c in enumerate(a, 1):
        match = 0
        for j, d in enumerate(b, 1):
            k, m = seen.get(d, 0), match
            if c == d:
                match = j
            table[i + 1][j + 1] = min(table[i][j] + (c != d), table[i + 1][j] + 1, table[i][j + 1] + 1, table[k][m] + (i - k - 1) + 1 + (j - m - 1))
        seen[c] = i
    return table[-1][-1]


def relative(a: str, b: str) -> float:
    """The distance as a share of the longer text; 0 for two empty ones."""
    return distance(a, b) / max(len(a), len(b), 1)


def _within(a: str, b: str, most: int) -> bool:
    """Whether the distance is at most so much; texts far apart in length aren't compared."""
    return abs(len(a) - len(b)) <= most and (a == b or distance(a, b, most=most) <= most)


#: What a text may differ by, and the words from which on it may be shortened.
TOLERANCE, SHORTENING_FROM = 0.01, 200


def altered(source: str | None, body: str, propositions: list[str], tolerance: float = TOLERANCE, shortening_from: int = SHORTENING_FROM, own: str | None = None) -> list[str] | None:
    """What an annotation changed in its source; null without a source. Long sources may be shortened, but propositions stay in order.
    `own` is the annotation without its tags, where that is known."""
    if source is None:
        return None
    if own is None:
        own = plain(body)
    if len(source.split()) <= shortening_from:
        a, b = ("".join(x.split()) for x in (source, own))
        if _within(a, b, int(tolerance * max(len(a), len(b)))):
            return []
        lines = (wrap(" ".join(x.split()), 60) for x in (source, own))
        diff = "\n".join(unified_diff(*lines, n=2, lineterm=""))
        return [f"Source text '{_shorten(source, 40)}' was altered. Diff:\n{diff}"]
    whole, out, at = "".join(source.split()), [], 0
    for p in propositions:
        bare = "".join(p.split())
        if bare not in whole:
            out.append(f"Annotated proposition '{_shorten(p, 40)}' is missing from the source text.")
        elif whole.find(bare, at) < 0:
            out.append(f"Text flow mixup: Annotated proposition '{_shorten(p, 40)}' does not appear _after_ the previous annotation in the source text.")
        else:
            at += len(bare)
    return out


def _stuck(lines: list[str], size: int, times: int) -> bool:
    """Whether the last line, perhaps cut off, begins what the `size` lines before it have said so many times; blank lines say nothing."""
    said = {"".join(lines[-1 - size * (i + 1) : -1 - size * i]) for i in range(times)}
    block = lines[-1 - size : -1]
    return len(said) == 1 and block[0].startswith(lines[-1]) and any(x.strip() for x in (block if size == 1 else block[1:]))


def without_repetitions(answer: str, keep: int = 3, least: int = 16) -> str:
    """An answer whose end repeats one, two or three lines over and over, with `keep` of the repeats and `least` lines at least."""
    lines = answer.split("\n")
    for size in (1, 2, 3):
        while len(lines) > least and _stuck(lines, size, keep + 1):
            del lines[-1 - size : -1]
    return "\n".join(lines)


def _pairs(function, kind: str):
    @F.pandas_udf(kind)
    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return each


def edit_distance(a: Column, b: Column, restricted: bool = True) -> Column:
    return _pairs(lambda x, y: distance(x, y, restricted), "long")(a, b)


def difference(a: Column, b: Column) -> Column:
    """The distance as a share of the longer text."""
    return _pairs(relative, "double")(a, b)


def similarity(a: Column, b: Column) -> Column:
    return 1 - difference(a, b)


def mean_difference(a: Column, others: Column) -> Column:
    """The mean difference of a text from those of an array; null for an empty one."""
    return _pairs(lambda x, ys: float(np.mean([relative(x, y) for y in ys])) if len(ys) else None, "double")(a, others)


def mean_similarity(left: Column, right: Column) -> Column:
    """The mean similarity of the texts of left (structs of key and text) and right (keys and text) where the key is among the keys; null without such."""
    def mean(a, b) -> float | None:
        found = [1 - relative(x["text"], y["text"]) for x in a for y in b if y["keys"] is not None and x["key"] is not None and x["key"] in y["keys"] and x["text"] is not None and y["text"] is not None]
        return float(np.mean(found)) if found else None

    return _pairs(mean, "double")(left, right)


def least_difference(texts: Column) -> Column:
    """The least difference between two texts of an array; null for fewer than two."""
    @F.pandas_udf("double")
    def least(rows: pd.Series) -> pd.Series:
        return pd.Series([min((relative(a, b) for i, a in enumerate(r) for b in r[:i]), default=None) if r is not None else None for r in rows], dtype=object)

    return least(texts)


def html_text(text: Column) -> Column:
    @F.pandas_udf("string")
    def strip(rows: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else plain(x) for x in rows], dtype=object)

    return strip(text)


def remove_repetitions(answer: Column, keep: int = 3, least: int = 16) -> Column:
    @F.pandas_udf("string")
    def cut(rows: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else without_repetitions(x, keep, least) for x in rows], dtype=object)

    return cut(answer)


def shorten(text: Column, width: int) -> Column:
    """Blanks collapsed; cut behind a word, with [...], if it is longer than the width."""
    bare = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.regexp_extract(bare, "^(.{0,%d})(?: |$)" % (width - 6), 1)
    return F.when(F.length(bare) <= width, bare).when(cut == "", "[...]").otherwise(F.concat(cut, F.lit(" [...]")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


#: Words that take a period anywhere.
ABBREVIATIONS = tuple("mr mrs ms dr prof st jr sr vs etc e.g i.e cf al no vol ed eds fig p pp approx dept est inc ltd co corp gen col sen rep gov hon rev capt sgt mt ca bzw z.b d.h usw nr m mme mlle ej sra".split())


def pieces(text: Column) -> Column:
    """What a text has between blanks that follow a mark, with the marks, trimmed."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|(?<=[.!?][\"')\]])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def last_word(piece: Column) -> Column:
    """The last word of a piece in lower case, without brackets in front and the period behind."""
    return F.regexp_extract(F.lower(piece), r"([^\s(\[\"']*)\.$", 1)


def sentences_of(text: Column, abbreviations: Column) -> Column:
    """The sentences of a text: pieces, joined where the first ends in an abbreviation or an initial, or the second goes on in lower case."""
    open_ = lambda a, b: (F.endswith(a, F.lit(".")) & (F.array_contains(abbreviations, last_word(a)) | last_word(a).rlike(r"^\p{L}$"))) | b.rlike(r"^\p{Ll}")
    add = lambda s, x: F.when((F.size(s) > 0) & open_(F.coalesce(F.get(s, F.size(s) - 1), F.lit("")), x), F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.concat(F.get(s, F.size(s) - 1), F.lit(" "), x)))).otherwise(F.concat(s, F.array(x)))
    return F.aggregate(pieces(text), F.array().cast("array<string>"), add)


def sentences(text: Column) -> Column:
    """The sentences of a text, by known abbreviations (`operators.sentences` learns others)."""
    return sentences_of(text, F.array(*[F.lit(w) for w in ABBREVIATIONS]))


def prefix_matches(text: Column, pattern: str) -> Column:
    """Whether the pattern matches at the beginning."""
    return text.rlike(f"^(?:{pattern})")


#: Marks that may stand next to a key.
_MARKS = r"[ ()\[\]{}:.>\-&!]"


def key_in_formula(formula: Column, key: str) -> Column:
    """Whether the key stands in the formula next to a mark."""
    own = re.escape(key)
    return formula.rlike(f"{_MARKS}{own}|{own}{_MARKS}")
