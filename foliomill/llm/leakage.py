"""Problem 8: evaluation texts leaking into training text.

The test items are put into an inverted index of five-word shingles with BM25
impacts and block maxima. Every training passage is a query; block-max WAND
retrieves all items that reach the threshold, which is the least score that any
ten shared consecutive words can give, so none is lost. Each retrieved pair is
then checked word by word.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import map_batches

SHARED_WORDS = 10
SHINGLE = 5
K1, B = 1.2, 0.75
BLOCK = 64
#: Test items whose index is sent to the executors at once; more are answered in
#: several passes over the training text, so the broadcast never grows further.
ITEMS_PER_PASS = 20_000

_MARKS = re.compile("[\\u0300-\\u036f\\u0483-\\u0487\\u0591-\\u05bd\\u0610-\\u061a\\u064b-\\u065f\\u0670\\u06d6-\\u06dc]+")
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, without case and accents."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold())


def shingle_hashes(ids: np.ndarray) -> np.ndarray:
    """Hash of the ids at each position and the four after it."""
    n = len(ids) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    ids = ids.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = (h ^ ids[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


class Postings:
    """One term's items, ascending, with impacts and the maximum of each block."""

    __slots__ = ("items", "impacts", "block_max", "most", "at")

    def __init__(self, items: list[int], impacts: list[float]) -> None:
        self.items, self.impacts = items, impacts
        self.block_max = [max(impacts[i : i + BLOCK]) for i in range(0, len(items), BLOCK)]
        self.most = max(impacts)
        self.at = 0

    def block_end(self) -> int:
        """The last item of the block at hand."""
        return self.items[min((self.at // BLOCK + 1) * BLOCK, len(self.items)) - 1]

    def seek(self, item: int) -> int | None:
        """The first item from ``item`` on; whole blocks are skipped by their last."""
        items = self.items
        while self.at < len(items) and items[min(self.at // BLOCK * BLOCK + BLOCK, len(items)) - 1] < item:
            self.at = (self.at // BLOCK + 1) * BLOCK
        while self.at < len(items) and items[self.at] < item:
            self.at += 1
        return items[self.at] if self.at < len(items) else None


class Index:
    """Inverted index of test items with BM25 impacts."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        rows = sorted((i, t) for i, t in rows if i is not None)
        texts = [words(t) for _, t in rows]
        self.item_ids = [i for i, _ in rows]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t), 1)}
        ids = [np.array([self.vocabulary[w] for w in t], np.int64) for t in texts]
        shingles = [shingle_hashes(a).tolist() for a in ids]
        self.grams = [{tuple(a[k : k + SHARED_WORDS].tolist()) for k in range(len(a) - SHARED_WORDS + 1)} for a in ids]
        length = [max(1, len(s)) for s in shingles]
        mean = sum(length) / max(1, len(length))
        df = Counter(h for s in shingles for h in set(s))
        by_term: dict[int, tuple[list[int], list[float]]] = {}
        self.threshold = []
        window = SHARED_WORDS - SHINGLE + 1
        for k, s in enumerate(shingles):
            impact = {}
            for h, tf in Counter(s).items():
                idf = math.log(1 + (len(rows) - df[h] + 0.5) / (df[h] + 0.5))
                impact[h] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[k] / mean))
                items, impacts = by_term.setdefault(h, ([], []))
                items.append(k), impacts.append(impact[h])
            sums = [sum(impact[h] for h in set(s[j : j + window])) for j in range(len(s) - window + 1)]
            self.threshold.append(min(sums, default=math.inf) * (1 - 1e-9))
        self.least = min(self.threshold, default=math.inf)
        self.terms = {h: Postings(*p) for h, p in by_term.items()}
        self.hashes = np.array(sorted(self.terms), np.uint64)

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all (item, score) whose score reaches the item's threshold."""
        lists = [self.terms[h] for h in dict.fromkeys(terms)]
        for p in lists:
            p.at = 0
        current = [(p.items[0], p) for p in lists]
        found = []
        while current:
            current.sort(key=lambda x: x[0])
            bound, pivot = 0.0, None
            for item, p in current:
                bound += p.most
                if bound >= self.least:
                    pivot = item
                    break
            if pivot is None:
                break
            if current[0][0] == pivot:
                here = [p for item, p in current if item == pivot]
                target = pivot + 1
                most = sum(p.block_max[p.at // BLOCK] for p in here)
                if most >= self.threshold[pivot]:
                    score = sum(p.impacts[p.at] for p in here)
                    if score >= self.threshold[pivot]:
                        found.append((pivot, score))
                elif most < self.least:
                    # nothing up to the end of these blocks, or to the next list, can reach it
                    others = [item for item, _ in current if item > pivot]
                    target = max(target, min([p.block_end() + 1 for p in here] + others[:1]))
            else:
                target = pivot
            moved = [(p.seek(target) if item < target else item, p) for item, p in current]
            current = [x for x in moved if x[0] is not None]
        return found


def leaks_of(index: Index, texts: list[str | None]) -> list[tuple[int, int, float, int]]:
    """(position of the text, item, score, shared ten-word runs) of a batch."""
    get = index.vocabulary.get
    parts, starts = [], [0]
    gap = [0] * SHINGLE
    for t in texts:
        ids = [get(w, 0) for w in words(t)]
        parts += ids
        parts += gap
        starts.append(len(parts))
    ids = np.array(parts, np.int64)
    h = shingle_hashes(ids)
    if not len(h) or not len(index.hashes):
        return []
    known = np.concatenate(([0], np.cumsum(ids == 0)))
    full = known[SHINGLE : SHINGLE + len(h)] == known[: len(h)]
    place = np.minimum(np.searchsorted(index.hashes, h), len(index.hashes) - 1)
    hit = full & (index.hashes[place] == h)
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first >= SHARED_WORDS - SHINGLE + 1
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for a, b in zip(first[long].tolist(), last[long].tolist()):
        passage = ids[a : b + SHINGLE - 1].tolist()
        grams = {tuple(passage[k : k + SHARED_WORDS]) for k in range(len(passage) - SHARED_WORDS + 1)}
        text = int(np.searchsorted(starts, a, "right")) - 1
        for item, score in index.search(h[a:b].tolist()):
            shared = len(grams & index.grams[item])
            if shared:
                old = best.get((text, item), (0.0, 0))
                best[text, item] = (max(old[0], score), old[1] + shared)
    return [(t, i, s, n) for (t, i), (s, n) in sorted(best.items())]


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``score``, ``shared``: documents that share at least
    ten consecutive words with a test item, the best BM25 score of a passage, and the
    number of shared ten-word runs.

    Texts that are null, empty or shorter than ten words share nothing. Repeated
    documents are answered each; a pair is answered once. Items with the same text
    are all reported.
    """
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    passes = max(1, math.ceil(items.count() / ITEMS_PER_PASS))
    out = None
    for k in range(passes):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        # built once; a worker process reads it once, however many tasks it runs
        sent = documents.sparkSession.sparkContext.broadcast(Index([(r[0], r[1]) for r in block.collect()]))

        def make(sent=sent) -> Callable:
            index = sent.value

            def run(cols: dict[str, list]) -> dict[str, list]:
                got = leaks_of(index, cols["text"])
                return {
                    "doc_id": [cols["doc_id"][t] for t, *_ in got],
                    "item_id": [index.item_ids[i] for _, i, *_ in got],
                    "score": [s for *_, s, _ in got],
                    "shared": [n for *_, n in got],
                }

            return run

        got = map_batches(documents.select("doc_id", "text"), make, "doc_id bigint, item_id bigint, score double, shared int")
        out = got if out is None else out.unionByName(got)
    return out
