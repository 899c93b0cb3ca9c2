"""Problem 1: per-document text statistics that tell prose from lists, tables and junk.

Word, symbol and punctuation ratios give each line points; vertical delimiter
alignment, indentation periodicity and the autocorrelation of line lengths give the
lines of a run more, so that tables and lists are found among lines that look ordinary
one by one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import map_batches
from foliomill.llm.encoding import repair
from foliomill.llm.furniture import site_lines
from foliomill.llm.residue import heading_lines, is_residue

#: The commonest words of the five languages.
COMMON = frozenset(
    (
        "the of and to a in is was that it he she his her for with as on at by from but not be had were which who what when where why all they them this there before after only while so or an into no nobody knew said"
        " de la le les et des un une du en que qui dans il elle son sa ses au aux pour par sur avec pas ne se mais plus était avait ce cette dit quand pendant sans est ou où l d s c n qu j"
        " el los las y lo una del al con por para su sus se no pero como más era había este esta dijo cuando sin mientras nadie sabía qué es o"
        " der die das und den dem ein eine einen einer eines im in zu von mit auf für ist war nicht sich sie er es aber als auch nur noch am an bei nach wie dass hatte sagte wenn während ohne wo vor warum niemand wusste"
        " في من على إلى عن أن ما لا لم هذا هذه ذلك التي الذي كان كانت قال ثم لكن أو مع بعد قبل عند بين كل هل لماذا حين أحد دون حيث بينما عندما لأن ظل يعد وهذا قد"
    ).split()
) - frozenset("acdjlnoqsuy")
_PART = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"[.!?؟…。](?:[\s»”“\"’')\]‌-‏])*$")
_BULLET = re.compile(r"^\s*(?:[-*•►▪◦–—·]|\(?\d{1,4}[.):]|#\d+)\s+\S")
_DELIMITERS = re.compile(r"\t|;|\||/|,|:|=|—|–|->|\.{3,}|·{2,}")
_COLUMNS = re.compile(rf"(?<=\S)\s{{2,}}|{_DELIMITERS.pattern}")
_DIGITS = re.compile(r"\d")
#: Points from which a line isn't prose.
ODD = 2
#: The share of its own lines from which a document isn't prose.
MOST = 0.5
#: So many neighbouring lines of one pattern are a table or list.
ALIGNED_RUN = 3
#: So many lines show a rhythm, if lengths correlate or indentation repeats so much.
RHYTHM_RUN, RHYTHM, RHYTHM_INDENT = 8, 0.5, 0.75


def line_statistics(line: str) -> dict[str, float]:
    """Ratios of one line: words, mean word length, symbols, common words, ..."""
    s = line.strip()
    if not s.isascii() and not unicodedata.is_normalized("NFKC", s):
        s = unicodedata.normalize("NFKC", s)
    low = _PART.findall(s.lower())
    n = len(low)
    tokens = s.count(" ") + 1
    solid = len(s) - tokens + 1
    letters = sum(map(len, low))
    return {
        "words": n,
        "letters": letters,
        "letter_share": letters / solid if solid else 0.0,
        "digit_share": len(_DIGITS.findall(s)) / solid if solid else 0.0,
        "mean": letters / n if n else 0.0,
        "token": solid / tokens,
        "distinct": len(set(low)) / n if n else 0.0,
        "common": len([w for w in low if w in COMMON]) / n if n else 0.0,
        "ends": float(bool(_SENTENCE_END.search(s[-6:]))),
        "bullet": float(bool(_BULLET.match(line))),
        "commas": (s.count(",") + s.count("،")) / max(1, n),
    }


def ratio_points(f: dict[str, float]) -> int:
    """Points against a line by its ratios: ``ODD`` where one ratio is beyond any prose,
    one each for a missing sentence end, few words, few common words, many commas."""
    n = f["words"]
    if n == 0 or f["letter_share"] < 0.6 or f["digit_share"] > 0.25 or not 1.5 <= f["mean"] <= 16:
        return ODD
    if f["token"] > 22 and n < 40:
        return ODD  # no word is that long: encoded bytes
    if n >= 6 and f["distinct"] * n < 0.3 * min(n, 40):
        return ODD  # a few words over and over
    if f["bullet"] and n < 12:
        return ODD
    if f["ends"]:
        return (n < 2) + (f["common"] == 0 and n >= 9)
    return 1 + (n < 7) + (f["common"] < 0.12 or f["common"] * n < 2.5) + (f["commas"] >= 0.3)


def running_prose(f: dict[str, float]) -> bool:
    """Whether a line is running prose by its ratios alone."""
    return ratio_points(f) < ODD


def pattern(line: str) -> str:
    """The sequence of delimiters of a line, runs joined; lines of one table agree."""
    return "".join(dict.fromkeys(m[0] for m in _DELIMITERS.findall(line)))


def aligned(lines: list[str]) -> list[bool]:
    """Lines in runs of one delimiter pattern at least ``ALIGNED_RUN`` long."""
    pats = [pattern(x) for x in lines]
    out = [False] * len(lines)
    a = 0
    while a < len(pats):
        b = a
        while b < len(pats) and pats[b] == pats[a]:
            b += 1
        if pats[a] and b - a >= ALIGNED_RUN:
            out[a:b] = [True] * (b - a)
        a = b
    return out


def autocorrelation(values: list[float], longest: int = 4) -> float:
    """The highest autocorrelation at lags 1 to ``longest``; 1 for constant values,
    0 for fewer than four."""
    if len(values) < 4:
        return 0.0
    x = np.asarray(values, float)
    x = x - x.mean()
    power = float(x @ x)
    if power < 1e-9:
        return 1.0
    return max(float(x[k:] @ x[:-k]) / power for k in range(1, min(longest, len(x) - 2) + 1))


def indentation_period(lines: list[str]) -> float:
    """Share of lines indented as the line two or one before them, if any is indented."""
    depth = [len(x) - len(x.lstrip()) for x in lines]
    if len(depth) < 4 or not any(depth):
        return 0.0
    return max(float(np.mean([a == b for a, b in zip(depth[k:], depth)])) for k in (1, 2))


def _spread(links: list[bool], step: int, least: int) -> list[tuple[int, int]]:
    """Runs of at least ``least`` lines, each linked to the one ``step`` before it."""
    out, a = [], 0
    for k in range(step, len(links) + 1):
        if k == len(links) or not links[k]:
            if k - a >= least and k - a > step:
                out.append((a, k))
            a = k - step + 1
    return out


def columns(line: str) -> frozenset[tuple[int, str]]:
    """Where the delimiters and gaps of a line end, with what they are."""
    return frozenset((m.end(), "" if m[0].isspace() else m[0]) for m in _COLUMNS.finditer(line.rstrip()))


def in_columns(lines: list[str]) -> list[bool]:
    """Lines in runs of at least ``ALIGNED_RUN`` whose delimiters or gaps stand at the same
    places: two at least, and half of all. Prose of any length has no such neighbours."""
    at = [columns(x) for x in lines]
    links = [k > 0 and len(at[k] & at[k - 1]) >= max(2, max(len(at[k]), len(at[k - 1])) / 2) for k in range(len(at))]
    out = [False] * len(lines)
    for a, b in _spread(links, 1, ALIGNED_RUN):
        out[a:b] = [True] * (b - a)
    return out


def rhythmic(lines: list[str], ends: list[float]) -> list[int]:
    """Points of runs of at least ``RHYTHM_RUN`` lines, one for each of three that agree:
    the same delimiters in the same order (of every or every other line), line lengths
    that correlate with those before, periodic indentation. Without common delimiters
    only lines that end no sentence count."""
    pats = [tuple(_DELIMITERS.findall(x)) for x in lines]
    depth = [len(x) - len(x.lstrip()) for x in lines]
    out = [0] * len(lines)

    def judge(a: int, b: int, points: int) -> None:
        points += autocorrelation([len(x) for x in lines[a:b]]) >= RHYTHM
        points += len(set(depth[a:b])) > 1 and indentation_period(lines[a:b]) >= RHYTHM_INDENT
        out[a:b] = [max(points, old) for old in out[a:b]]

    for step in (1, 2):
        for a, b in _spread([k >= step and bool(pats[k]) and pats[k] == pats[k - step] for k in range(len(pats))], step, RHYTHM_RUN):
            judge(a, b, 1)
    for a, b in _spread([k > 0 and not ends[k] and not ends[k - 1] for k in range(len(ends))], 1, RHYTHM_RUN):
        judge(a, b, 0)
    return out


def layout_points(lines: list[str], ends: list[float]) -> list[int]:
    """Points against each line by its neighbours: ``ODD`` for delimiters or gaps at the
    same columns, else one for a shared delimiter pattern, or those of ``rhythmic``."""
    return [ODD if placed else max(t, r) for t, placed, r in zip(aligned(lines), in_columns(lines), rhythmic(lines, ends))]


def document_statistics(lines: list[str], own: list[bool]) -> dict:
    """Statistics of a document over its own non-blank lines."""
    body = [x for x, mine in zip(lines, own) if mine and x.strip()]
    each = [line_statistics(x) for x in body]
    layout = layout_points(body, [f["ends"] for f in each])
    table = [p > 0 for p in layout]
    similar = autocorrelation([len(x) for x in body])
    odd = sum(p + ratio_points(f) >= ODD for f, p in zip(each, layout))
    words = sum(f["words"] for f in each)
    letters = sum(f["letters"] for f in each)
    solid = sum(f["letters"] / f["letter_share"] for f in each if f["letter_share"]) or 1
    share = odd / len(body) if body else 0.0
    kind = "prose"
    if body and share > MOST:
        digits = sum(f["digit_share"] for f in each) / len(body)
        tabular = sum(table) / len(body)
        listed = sum(1 for f in each if f["bullet"] or 2 <= f["words"] <= 12) / len(body)
        known = sum(f["common"] for f in each) / len(body)
        kind = "table" if tabular > 0.5 and digits > 0.2 else "list" if tabular > 0.5 or (listed > 0.5 and known > 0.02) else "junk"
    return {
        "words": words,
        "mean_word_length": letters / words if words else 0.0,
        "symbol_ratio": 1 - letters / solid if body else 0.0,
        "ending_share": sum(f["ends"] for f in each) / len(body) if body else 0.0,
        "common_share": sum(f["common"] * f["words"] for f in each) / words if words else 0.0,
        "aligned_share": sum(table) / len(body) if body else 0.0,
        "indent_period": indentation_period(body),
        "length_correlation": similar,
        "not_prose_share": share,
        "own_lines": len(body),
        "kind": kind,
    }


_FIELDS = (
    "words int, mean_word_length double, symbol_ratio double, ending_share double, common_share double, aligned_share double,"
    " indent_period double, length_correlation double, not_prose_share double, own_lines int, kind string"
)
_NAMES = [x.split()[0] for x in _FIELDS.split(",")]
CHUNK = 512


def own_lines(texts: list[str], titles: list[str | None]) -> list[tuple[list[str], list[bool]]]:
    """Lines of each text and whether they are its own: not the site's, not its heading."""
    lines = [t.split("\n") for t in texts]
    out = []
    for ls, site, title in zip(lines, site_lines(lines, titles), titles):
        heading = set(heading_lines(ls, title, site))
        out.append((ls, [not s and k not in heading for k, s in enumerate(site)]))
    return out


def text_statistics(chapters: DataFrame, columns: tuple[str, str, str] = ("chapter_id", "title", "plain_text")) -> DataFrame:
    """One row per chapter with text: the statistics of its own lines and its kind
    (prose, list, table, junk; residue for rows of problem 7).

    Null and blank texts give no row. A text of only headings and site lines is
    prose with no lines. Garbled characters are restored before lines are
    judged that look wrong.
    """
    key, title, text = columns

    def make() -> Callable:
        def run(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {key: [], **{n: [] for n in _NAMES}}
            rows = [x for x in zip(cols["i"], cols["h"], cols["t"]) if x[2] and not x[2].isspace()]
            for a in range(0, len(rows), CHUNK):
                part = rows[a : a + CHUNK]
                for (i, h, t), (lines, own) in zip(part, own_lines([r[2] for r in part], [r[1] for r in part])):
                    stats = document_statistics(lines, own)
                    if stats["not_prose_share"] > 0 and (fixed := repair(t))[0]:
                        stats = document_statistics(*own_lines([fixed[1]], [h])[0])
                    if is_residue(t, h):
                        stats["kind"] = "residue"
                    out[key].append(i)
                    for n in _NAMES:
                        out[n].append(stats[n])
            return out

        return run

    rows = chapters.select(F.col(key).alias("i"), F.col(title).alias("h"), F.col(text).alias("t")).where("t IS NOT NULL")
    return map_batches(rows, make, f"{key} bigint, {_FIELDS}")
