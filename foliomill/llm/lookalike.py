"""Problem 6: visually identical text with different characters.

Pairs of strings that look the same (compatibility forms, composed and combining
accents, letters shared by scripts, spaces, invisible characters) are joined into
transitive classes by union-find. The member that occurs most often in the corpus
represents its class; letters that several scripts share take the script of their
word. An Aho-Corasick automaton over the members rewrites texts greedily, longest
member first.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import map_batches
from foliomill.llm.encoding import repair

#: Letters of Greek and Cyrillic that look like the Latin letter.
SCRIPT_LETTERS = (
    "A Α А", "B Β В", "C С", "E Ε Е", "H Η Н", "I Ι І", "J Ј", "K Κ К", "M Μ М", "N Ν", "O Ο О", "P Ρ Р",
    "S Ѕ", "T Τ Т", "X Χ Х", "Y Υ У", "Z Ζ", "a а", "c с", "e е", "i і", "j ј", "o ο о", "p р", "s ѕ",
    "v ν", "x х", "y у", "ï ї", "ë ё", "é έ", "ó ό",
)
#: Persian letters that look like an Arabic one.
ARABIC_LETTERS = ("ك ک", "ي ی", "ه ہ")
#: Letters of which a text is Persian or Urdu, not misspelt Arabic.
PERSIAN_ONLY = "پچژگٹڈڑںھے"
_PERSIAN_TEXT = re.compile(f"[{PERSIAN_ONLY}]")
#: Characters without any visible form.
INVISIBLE = (
    [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0xFEFF, 0x3164, 0xFFA0]
    + [*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10)]
)
HYPHENS = (0x2010, 0x2011)
#: Compatibility forms that look like their plain form; others (fractions,
#: superscripts, circled forms) look different and stay.
LOOK_SAME = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")
#: Of the joined Arabic forms only lam-alef is one with its letters; the other
#: ligatures of several letters look different from letters written singly.
#: Compatibility letters that don't look like their plain form: the long s.
NOT_SAME = "ſﬅẛ"


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        sets: dict[str, list[str]] = {}
        for x in self.parent:
            sets.setdefault(self.find(x), []).append(x)
        return [sorted(m) for m in sets.values() if len(m) > 1]


def look_alike_pairs() -> Iterable[tuple[str, str]]:
    """All pairs of strings that look the same, from the character database and
    the tables above."""
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or 0xE000 <= cp <= 0xF8FF or 0xF900 <= cp <= 0xFAFF or 0x20000 <= cp:
            continue
        ch = chr(cp)
        d = unicodedata.decomposition(ch)
        if d:
            kind, _, rest = d.partition(" ") if d[0] == "<" else ("", "", d)
            plain = unicodedata.normalize("NFKC", ch) if kind else unicodedata.normalize("NFD", ch)
            ligature = kind == "<compat>" and unicodedata.category(ch)[0] in "LN" and ch not in NOT_SAME and 0xFB00 <= cp <= 0xFB17
            if kind in LOOK_SAME or ligature or (not kind and unicodedata.normalize("NFC", ch) == ch):
                arabic_pair = kind in LOOK_SAME[4:] and len(plain) > 1 and not 0xFEF5 <= cp <= 0xFEFC
                if len(plain) <= 4 and plain != ch and not arabic_pair:
                    yield ch, plain
        if unicodedata.category(ch) == "Zs":
            yield ch, " "
    for row in (*SCRIPT_LETTERS, *ARABIC_LETTERS):
        first, *others = row.split()
        for other in others:
            yield first, other
    for cp in INVISIBLE:
        yield chr(cp), ""
    for cp in HYPHENS:
        yield chr(cp), "-"


@cache
def look_alike_classes() -> list[list[str]]:
    sets = UnionFind()
    for a, b in look_alike_pairs():
        sets.union(a, b)
    return sets.classes()


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """Member to representative, for every member that isn't its class's own.

    The most frequent member represents a class; the empty string, where it is a
    member, stands everywhere and so always does. Ties go to the normalised form,
    then to the shorter string, then to the lower code point, which also decides
    for classes the corpus doesn't have.
    """
    out = {}
    for members in look_alike_classes():
        rank = lambda m: (m != "", -counts.get(m, 0), m != unicodedata.normalize("NFKC", m), len(m), m)
        best = min(members, key=rank)
        out |= {m: best for m in members if m != best}
    return out


EUROPEAN = ("Latin", "Greek", "Cyrillic")


@cache
def script(ch: str) -> str:
    """Latin, Greek, Cyrillic, Arabic or "" for anything else; compatibility letters
    have the script of their plain form."""
    cp = ord(unicodedata.normalize("NFKC", ch)[:1] or ch)
    if cp < 0x250 or 0x1E00 <= cp < 0x1F00:
        return "Latin" if chr(cp).isalpha() else ""
    if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000:
        return "Greek"
    if 0x400 <= cp < 0x530:
        return "Cyrillic"
    return "Arabic" if 0x620 <= cp < 0x700 else ""


_PERSIAN = {c: row.split()[0] for row in ARABIC_LETTERS for c in row.split()[1:]}
_FOREIGN = re.compile("[\u0370-\u052f]")
_WORD = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[\u0300-\u036f])*")


@cache
def cross_classes() -> dict[str, tuple[dict[str, str], list[str]]]:
    """Member to (its class's plain letter of each script, the class), for classes that
    have letters of several scripts."""
    out = {}
    for members in look_alike_classes():
        by: dict[str, str] = {}
        for m in members:
            if len(m) == 1 and script(m) in EUROPEAN and unicodedata.is_normalized("NFKC", m):
                by.setdefault(script(m), m)
        if len(by) > 1:
            out |= {m: (by, members) for m in members}
    return out


class Rewriter:
    """The automata over the members of look-alike classes, and a class of the
    characters without which no member can occur.

    Members that aren't representatives are rewritten wherever they stand. Letters
    shared by scripts belong to the word they stand in, whichever of them is the
    commonest, so all of them are members; the Latin ones are only looked for in
    texts that also have Greek or Cyrillic letters."""

    def __init__(self, mapping: dict[str, str]) -> None:
        self.mapping = mapping
        self.cross = cross_classes()
        shared = {m for m in self.cross if m}
        latin = {by["Latin"] for by, _ in self.cross.values() if "Latin" in by}
        members = {m for m in mapping if m} | shared | set(_PERSIAN)
        self.usual, self.mixed = self._automaton(members - latin), self._automaton(members)
        last = {m[-1] for m in members - latin}
        self._low = re.compile("[" + "".join(sorted(re.escape(c) for c in last if c <= "\uffff")) + "]")
        self._high = re.compile("[\U00010000-\U0010ffff]")

    @staticmethod
    def _automaton(members: set[str]) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for m in members:
            out.add_word(m, m)
        out.make_automaton()
        return out

    def needed(self, text: str) -> bool:
        return bool(self._low.search(text) or self._high.search(text))

    def places(self, text: str) -> Iterator[tuple[int, str]]:
        """(last position, member) of the members in a text, longest first."""
        return (self.mixed if _FOREIGN.search(text) else self.usual).iter_long(text)

    def written(self, member: str, start: int, scripts: Scripts) -> str:
        """How a member found at ``start`` is to be written."""
        pair = _PERSIAN.get(member)
        if pair:
            return member if scripts.persian() else pair
        if member not in self.cross:
            best = self.mapping.get(member, member)
            return best if best not in _PERSIAN or scripts.persian() else member
        by, members = self.cross[member]
        best = self.mapping.get(members[0], members[0])
        return by.get(scripts.at(start, script(best[0]))) or by.get(script(member[0])) or best


class Scripts:
    """The script to which each word of a text belongs, found once per text.

    A word's script is that of most of its letters without look-alikes. Without such
    letters it is that of the nearest words that have one, if those before and
    after agree, else the commonest of the text. A text without any such word leaves a
    word of one script as it is; one of several takes the commonest of its letters,
    and at a tie the given one."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts: list[int] | None = None
        self._persian: bool | None = None

    def persian(self) -> bool:
        """Whether a text has letters only Persian or Urdu has."""
        if self._persian is None:
            self._persian = bool(_PERSIAN_TEXT.search(self.text))
        return self._persian

    def _read(self) -> None:
        cross = cross_classes()
        self.starts, self.words, sure = [], [], []
        for m in _WORD.finditer(self.text):
            n = Counter(x for ch in m.group() if ch not in cross and (x := script(ch)) in EUROPEAN)
            self.starts.append(m.start()), self.words.append(m.group())
            sure.append(max(n, key=lambda x: (n[x], x)) if n else "")
        total = Counter(x for x in sure if x)
        self.common = max(total, key=lambda x: (total[x], x)) if total else ""
        before, after, last = [], [], ""
        for x in sure:
            before.append(last)
            last = x or last
        last = ""
        for x in reversed(sure):
            after.append(last)
            last = x or last
        near = ((b or a) if not (a and b) or a == b else self.common for b, a in zip(before, reversed(after)))
        self.scripts = [x or n or self.common for x, n in zip(sure, near)]

    def at(self, position: int, tie: str) -> str:
        if self.starts is None:
            self._read()
        k = bisect_right(self.starts, position) - 1
        if k < 0:
            return ""
        if self.scripts[k]:
            return self.scripts[k]
        n = Counter(x for ch in self.words[k] if (x := script(ch)) in EUROPEAN)
        return max(n, key=lambda x: (n[x], x == tie)) if n else tie


def rewrite(text: str | None, rewriter: Rewriter) -> tuple[str | None, int]:
    """(text in one form, number of places rewritten). Null and empty stay."""
    if not text or not rewriter.needed(text):
        return text, 0
    parts, at, n = [], 0, 0
    scripts = Scripts(text)
    for end, member in rewriter.places(text):
        start = end - len(member) + 1
        if start < at:
            continue
        best = rewriter.written(member, start, scripts)
        if best != member:
            parts += (text[at:start], best)
            at, n = end + 1, n + 1
    if not n:
        return text, 0
    return "".join(parts) + text[at:], n


def member_counts(df: DataFrame, fields: list[str]) -> dict[str, int]:
    """How often each member of a look-alike class occurs in the fields.

    Counted per batch, then summed over all rows; the result has at most one row
    per member of the fixed classes, so its size doesn't depend on the data."""

    def make() -> Callable:
        single = {m for c in look_alike_classes() for m in c if len(m) == 1}
        several = {m for c in look_alike_classes() for m in c if len(m) > 1}
        plain = [m for m in several if unicodedata.is_normalized("NFC", m)]
        longer = ahocorasick.Automaton()
        for m in several.difference(plain):
            longer.add_word(m, m)
        longer.make_automaton()

        def run(cols: dict[str, list]) -> dict[str, list]:
            total: Counter = Counter()
            for name in fields:
                texts = [t for t in cols[name] if t]
                joined = "\n".join(texts)
                chars = Counter(joined)
                total.update({c: n for c, n in chars.items() if c in single})
                total.update({m: n for m in plain if (n := joined.count(m))})
                if any(unicodedata.combining(c) for c in chars):
                    for t in texts:
                        if not t.isascii() and not unicodedata.is_normalized("NFC", t):
                            total.update(m for _, m in longer.iter(t))
            return {"member": list(total), "n": list(total.values())}

        return run

    got = map_batches(df.select(*fields), make, "member string, n bigint")
    return {r["member"]: r["s"] for r in got.groupBy("member").agg(F.sum("n").alias("s")).collect()}


def one_form(chapters: DataFrame, key: str = "chapter_id", fields: tuple[str, ...] = ("title", "plain_text"), damaged: tuple[str, ...] = ("plain_text",)) -> DataFrame:
    """``key``, ``field``, ``text``, ``places``: the rewritten fields of all rows that
    hold look-alike characters. Values that need no change give no row; of the
    fields ``damaged``, neither do those that problem 2 finds decoded wrongly."""
    mapping = representatives(member_counts(chapters, list(fields)))

    def make() -> Callable:
        rewriter = Rewriter(mapping)

        def run(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {key: [], "field": [], "text": [], "places": []}
            for name in fields:
                for i, t in zip(cols[key], cols[name]):
                    new, n = rewrite(t, rewriter)
                    if n and not (name in damaged and repair(t)[0]):
                        out[key].append(i), out["field"].append(name), out["text"].append(new), out["places"].append(n)
            return out

        return run

    return map_batches(chapters.select(key, *fields), make, f"{key} bigint, field string, text string, places int")
