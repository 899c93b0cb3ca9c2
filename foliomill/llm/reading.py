"""Problem 10: the reading level of each document.

Interpolated n-gram models are trained on all graded documents of each level. A
document's words have a surprisal under each model; the distribution of the
surprisal differences over the whole document is summed up by its mean and
quartiles, and isotonic regression maps the resulting score monotonically to the
probability of reaching each level.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliomill.llm.common import map_batches, pack, unpack

LEVELS = (1, 2, 3, 4)
#: Least and most slots of a hashed count table; words kept apart, the rest are one word.
SLOTS, MOST_SLOTS, VOCABULARY = 1 << 18, 1 << 22, 20_000
#: Characters of graded text for each slot.
SLOT_CHARACTERS = 8
LAMBDA = (0.45, 0.35, 0.15, 0.05)
CHUNK = 512
#: Words a task counts before it hands the counts on; slots of a count table that go in one row.
WORDS_HELD, SEGMENT = 200_000, 1 << 14
_TOKEN = re.compile(r"[^\W\d_]+|[.!?؟…;:؛]|[,،]")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str) -> list[str]:
    """Words in lower case, and punctuation, of a text."""
    return _TOKEN.findall(text.lower())


def encode(vocabulary: dict[str, int], words: list[str]) -> np.ndarray:
    """Numbers of words; 0 for those that the vocabulary lacks."""
    get = vocabulary.get
    return np.array([get(w, 0) for w in words], np.int64)


def _hash(slots: int, *columns: np.ndarray) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * _A
        h ^= h >> np.uint64(31)
        h *= _B
    return (h >> np.uint64(20)).astype(np.int64) % slots


def _in_document(document: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each slot occurs in its own document."""
    _, where, n = np.unique(document * MOST_SLOTS + at, return_inverse=True, return_counts=True)
    return n[where].astype(np.float32)


class NGrams:
    """Word trigram, bigram and unigram probabilities, interpolated, of one group of
    documents. Counts live in hashed tables of ``slots``."""

    def __init__(self, size: int, slots: int = SLOTS, kind: type = np.float32) -> None:
        self.size, self.slots = size, slots
        self.uni = np.zeros(size, kind)
        self.bi, self.tri = np.zeros(slots, kind), np.zeros(slots, kind)

    def __getstate__(self) -> dict:
        # mostly zeros: a broadcast copy is small
        return vars(self) | {part: (zlib.compress(t.tobytes(), 1), t.dtype.str) for part in ("uni", "bi", "tri") for t in [getattr(self, part)]}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state | {part: np.frombuffer(zlib.decompress(state[part][0]), state[part][1]) for part in ("uni", "bi", "tri")})

    def add(self, ids: np.ndarray) -> None:
        """Count a document."""
        np.add.at(self.uni, ids, 1)
        np.add.at(self.bi, _hash(self.slots, ids[:-1], ids[1:]), 1)
        np.add.at(self.tri, _hash(self.slots, ids[:-2], ids[1:-1], ids[2:]), 1)

    def surprisal(self, ids: np.ndarray, h2: np.ndarray, h3: np.ndarray, total: float | np.ndarray, own: tuple | None = None) -> np.ndarray:
        """-log probability of each word from the third on; ``own`` has the counts of
        words, pairs and triples to be left out."""
        c1, c2, c3 = self.uni[ids], self.bi[h2], self.tri[h3]
        if own:
            c1, c2, c3 = c1 - own[0], c2 - own[1], c3 - own[2]
        # no pair is commoner than its words, no triple than its pairs: that undoes most collisions
        c2 = np.minimum(c2, np.minimum(c1[:-1], c1[1:]))
        c3 = np.minimum(c3, np.minimum(c2[:-1], c2[1:]))
        p1 = (c1[2:] + 0.1) / (total + 0.1 * self.size)
        p2 = c2[1:] / np.maximum(c1[1:-1], 1)
        p3 = c3 / np.maximum(c2[:-1], 1)
        return -np.log(LAMBDA[0] * np.minimum(p3, 1) + LAMBDA[1] * np.minimum(p2, 1) + LAMBDA[2] * p1 + LAMBDA[3] / self.size)


class Pooled:
    """Pool adjacent violators: the best monotone fit as blocks of least and greatest
    x, sum of y and number. Pooled stretches of x can be pooled further, with the same
    result as all points at once; equal x must come as one point."""

    def __init__(self) -> None:
        self.blocks: list[list[float]] = []

    def add(self, low: float, high: float, total: float, n: float) -> None:
        self.blocks.append([low, high, total, n])
        while len(self.blocks) > 1 and self.blocks[-2][2] * self.blocks[-1][3] >= self.blocks[-1][2] * self.blocks[-2][3]:
            _, high, total, n = self.blocks.pop()
            last = self.blocks[-1]
            last[1], last[2], last[3] = high, last[2] + total, last[3] + n

    def knots(self) -> tuple[np.ndarray, np.ndarray]:
        """Knots and non-decreasing values."""
        return np.array([v for a, b, *_ in self.blocks for v in (a, b)]), np.array([t / n for *_, t, n in self.blocks for _ in (0, 1)])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and non-decreasing values of the best monotone fit."""
    fit = Pooled()
    at, where = np.unique(x, return_inverse=True)
    for v, total, n in zip(at, np.bincount(where, y, len(at)), np.bincount(where, minlength=len(at))):
        fit.add(float(v), float(v), float(total), int(n))
    return fit.knots()


def level_index(grade: float) -> int:
    """The level, from 0, whose model a document of this grade trains."""
    return int(min(max(round(grade), 1), 4)) - 1


def chunks(values: list) -> Iterator[list]:
    return (values[a : a + CHUNK] for a in range(0, len(values), CHUNK))


class ReadingModel:
    """Level models, the vocabulary and the monotone maps from score to level."""

    def __init__(self, graded: list[tuple[str, float]]) -> None:
        """The model of these texts and grades; ``fit`` makes the same one of tables."""
        docs = [(tokens(t), g) for t, g in graded]
        df = Counter(w for d, _ in docs for w in set(d))
        self.start((w for w, n in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n > 1), sum(len(t) for t, _ in graded))
        ids, level = [self.encode(d) for d, _ in docs], [level_index(g) for _, g in docs]
        for a, k in zip(ids, level):
            if len(a) > 2:
                self.models[k].add(a)
        self.totals = [float(m.uni.sum(dtype=np.float64)) for m in self.models]
        if not docs:
            return
        table = np.concatenate([self.batch_scores(a, k) for a, k in zip(chunks(ids), chunks(level))])
        for k in range(len(LEVELS) - 1):
            self.knots.append(isotonic(table[:, k], np.array([reaches(g, k) for _, g in docs], float)))

    def start(self, vocabulary: Iterable[str], characters: int) -> None:
        """Empty models of these words, for so many characters of graded text. The more
        text, the larger the tables, so that few counts collide."""
        self.vocabulary = {w: k for k, w in enumerate(vocabulary, 1)}
        slots = SLOTS
        while slots < min(MOST_SLOTS, characters // SLOT_CHARACTERS):
            slots *= 2
        # neighbouring levels share a model at either end: plain and demanding text
        self.models = [NGrams(len(self.vocabulary) + 1, slots) for _ in LEVELS]
        self.totals = [0.0 for _ in LEVELS]
        self.knots: list[tuple[np.ndarray, np.ndarray]] = []

    def save(self) -> bytes:
        arrays = {f"{part}{k}": getattr(m, part) for k, m in enumerate(self.models) for part in ("uni", "bi", "tri")}
        arrays |= {f"knots{k}{j}": v for k, pair in enumerate(self.knots) for j, v in enumerate(pair)}
        return pack({"vocabulary": list(self.vocabulary), "totals": self.totals}, arrays)

    @staticmethod
    def load(payload: bytes) -> ReadingModel:
        facts, arrays = unpack(payload)
        model = ReadingModel([])
        model.vocabulary = {w: k for k, w in enumerate(facts["vocabulary"], 1)}
        model.totals = facts["totals"]
        for k, m in enumerate(model.models):
            m.size = len(model.vocabulary) + 1
            m.uni, m.bi, m.tri = (arrays[f"{part}{k}"] for part in ("uni", "bi", "tri"))
            m.slots = len(m.bi)
        model.knots = [(arrays[f"knots{k}0"], arrays[f"knots{k}1"]) for k in range(len(LEVELS) - 1) if f"knots{k}0" in arrays]
        return model

    def encode(self, words: list[str]) -> np.ndarray:
        return encode(self.vocabulary, words)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """The scores of one document."""
        return self.batch_scores([ids])[0]

    def batch_scores(self, documents: list[np.ndarray], trained: list[int] | None = None) -> np.ndarray:
        """For each document and boundary between levels how much better the models
        above it predict the document: the mean and the quartiles of the differences
        over its known words. Documents that the models were trained on are scored
        without themselves; ``trained`` has the model of each."""
        out = np.full((len(documents), len(LEVELS) - 1), -10.0)
        ids = np.concatenate(documents) if documents else np.zeros(0, np.int64)
        if len(ids) <= 2:
            return out
        lengths = np.array([len(d) for d in documents])
        doc = np.repeat(np.arange(len(documents)), lengths)
        slots = self.models[0].slots
        h2, h3 = _hash(slots, ids[:-1], ids[1:]), _hash(slots, ids[:-2], ids[1:-1], ids[2:])
        use = (doc[:-2] == doc[2:]) & (ids[2:] > 0)
        left_out: list[tuple] = [(t, None) for t in self.totals]
        if trained is not None:
            # pairs and triples across two documents were not counted
            whole = [doc, *(np.where(doc[:-n] == doc[n:], doc[:-n], len(documents)) for n in (1, 2))]
            counts = [np.where(d < len(documents), _in_document(d, at), 0) for d, at in zip(whole, (ids, h2, h3))]
            model = np.array(trained)[doc]
            left_out = [(t - (lengths[doc] * (model == k))[2:], tuple(c * (model[: len(c)] == k) for c in counts)) for k, t in enumerate(self.totals)]
        doc = doc[2:][use]
        if not len(doc):
            return out
        s = np.stack([m.surprisal(ids, h2, h3, *x)[use] for m, x in zip(self.models, left_out)])
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        n = np.diff(np.concatenate((first, [len(doc)])))
        for k in range(1, len(LEVELS)):
            d = s[:k].min(0) - s[k:].min(0)
            ranked = d[np.lexsort((d, doc))]
            quartiles = sum(ranked[first + ((n - 1) * q).astype(np.int64)] for q in (0.25, 0.5, 0.75))
            out[doc[first], k - 1] = 0.7 * np.add.reduceat(d, first) / n + 0.1 * quartiles
        return out

    def level(self, score: np.ndarray) -> tuple[int, float, list[float]]:
        """(level, expected level, probabilities of at least level 2, 3, 4)."""
        p = [float(np.interp(s, *k)) for s, k in zip(score, self.knots)]
        p = np.minimum.accumulate(p).tolist()
        return 1 + sum(x >= 0.5 for x in p), 1 + sum(p), p


def reaches(grade: float, boundary: int) -> bool:
    """Whether a grade lies above a boundary between levels."""
    return grade >= LEVELS[boundary + 1] - 0.5


def graded_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``text`` and ``grade`` of every graded document; several grades of one document
    are averaged, of several texts the least is taken. Grades of unknown documents drop
    out."""
    grades = labels.where("reading_level IS NOT NULL").groupBy("doc_id").agg(F.avg("reading_level").alias("grade"))
    texts = documents.where("text IS NOT NULL").select("doc_id", "text").join(grades, "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("grade").alias("grade")).select("text", "grade")


def _fold(df: DataFrame, make: Callable[[], Any], schema: str) -> DataFrame:
    """What a task gathers over all of its Arrow batches. ``make`` gives an object whose
    ``add`` gets a batch's columns as lists and whose ``rows`` empties it into columns of
    ``schema``, at the end or as soon as it is ``full``."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = held or make()
            held.add(batch.to_pydict())
            if held.full():
                yield pa.RecordBatch.from_pydict(held.rows(), arrow)
        if held:
            yield pa.RecordBatch.from_pydict(held.rows(), arrow)

    return df.mapInArrow(run, schema)


class _Words:
    """Documents that have each word."""

    def __init__(self) -> None:
        self.df: Counter[str] = Counter()

    def add(self, cols: dict[str, list]) -> None:
        for t in cols["text"]:
            self.df.update(set(tokens(t)))

    def full(self) -> bool:
        return len(self.df) > WORDS_HELD

    def rows(self) -> dict[str, list]:
        out = {"word": list(self.df), "n": list(self.df.values())}
        self.df.clear()
        return out


class _Counts:
    """N-gram counts of each level, in segments of the tables."""

    def __init__(self, vocabulary: dict[str, int], slots: int) -> None:
        self.vocabulary = vocabulary
        self.counts = [NGrams(len(vocabulary) + 1, slots, np.int64) for _ in LEVELS]

    def add(self, cols: dict[str, list]) -> None:
        for t, g in zip(cols["text"], cols["grade"]):
            ids = encode(self.vocabulary, tokens(t))
            if len(ids) > 2:
                self.counts[level_index(g)].add(ids)

    def full(self) -> bool:
        return False

    def rows(self) -> dict[str, list]:
        got = [(k, part, a, getattr(m, part)[a : a + SEGMENT]) for k, m in enumerate(self.counts) for part in ("uni", "bi", "tri") for a in range(0, len(getattr(m, part)), SEGMENT)]
        got = [(k, part, a, zlib.compress(c.tobytes(), 1)) for k, part, a, c in got if c.any()]
        return dict(zip(("level", "part", "start", "counts"), map(list, zip(*got)))) if got else {"level": [], "part": [], "start": [], "counts": []}


class _Blocks:
    """Pooled blocks of each boundary; points come in order of x."""

    def __init__(self) -> None:
        self.pools = [Pooled() for _ in LEVELS[1:]]

    def add(self, cols: dict[str, list]) -> None:
        for k, x, total, n in zip(cols["boundary"], cols["score"], cols["total"], cols["n"]):
            self.pools[k].add(x, x, total, n)

    def full(self) -> bool:
        return False

    def rows(self) -> dict[str, list]:
        got = [(k, *b) for k, p in enumerate(self.pools) for b in p.blocks]
        return dict(zip(("boundary", "low", "high", "total", "n"), map(list, zip(*got))))


def _vocabulary(graded: DataFrame) -> list[str]:
    """The words that most documents have, two at least."""
    counted = _fold(graded.select("text"), _Words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counted.where("n > 1").orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]


def _summed(group: pa.Table) -> pa.Table:
    """The sum of the rows of one segment."""
    total: Any = 0
    for c in group.column("counts"):
        total = total + np.frombuffer(zlib.decompress(c.as_py()), np.int64)
    return group.slice(0, 1).set_column(group.schema.get_field_index("counts"), "counts", pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()))


def _count(graded: DataFrame, model: ReadingModel) -> None:
    """Train the level models: tasks count in tables like the model's, which are added up
    segment by segment."""
    sent, slots = graded.sparkSession.sparkContext.broadcast(model.vocabulary), model.models[0].slots
    schema = "level int, part string, start int, counts binary"
    segments = _fold(graded, lambda: _Counts(sent.value, slots), schema)
    totals = np.zeros(len(LEVELS), np.int64)
    for r in segments.groupBy("level", "part", "start").applyInArrow(_summed, schema).collect():
        counts = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64)
        getattr(model.models[r["level"]], r["part"])[r["start"] : r["start"] + len(counts)] = counts
        totals[r["level"]] += counts.sum() if r["part"] == "uni" else 0
    model.totals = [float(t) for t in totals]
    sent.unpersist()


def _map_scores(graded: DataFrame, model: ReadingModel) -> None:
    """Fit the maps from score to level. Every graded document is scored without itself;
    scores are ordered in ranges, pooled there, and the blocks of all ranges are pooled
    again."""
    sent = graded.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        model = sent.value

        def run(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"boundary": [], "score": [], "above": []}
            for texts, grades in zip(chunks(cols["text"]), chunks(cols["grade"])):
                scores = model.batch_scores([model.encode(tokens(t)) for t in texts], [level_index(g) for g in grades])
                for k in range(len(LEVELS) - 1):
                    out["boundary"] += [k] * len(texts)
                    out["score"] += scores[:, k].tolist()
                    out["above"] += [int(reaches(g, k)) for g in grades]
            return out

        return run

    scored = map_batches(graded, make, "boundary int, score double, above bigint")
    points = scored.groupBy("boundary", "score").agg(F.sum("above").alias("total"), F.count("*").alias("n"))
    ranges = points.repartitionByRange("boundary", "score").sortWithinPartitions("boundary", "score")
    blocks = _fold(ranges, _Blocks, "boundary int, low double, high double, total bigint, n bigint").collect()
    pools = [Pooled() for _ in LEVELS[1:]]
    for r in sorted(blocks):
        pools[r["boundary"]].add(*r[1:])
    model.knots = [p.knots() for p in pools if p.blocks]
    sent.unpersist()


def fit(documents: DataFrame, labels: DataFrame) -> ReadingModel:
    """The level models and maps of all graded documents; without any graded text it
    knows no level. Texts are joined to their grades once and then read three times: for
    the vocabulary, the counts and the scores."""
    graded = graded_texts(documents, labels).persist(StorageLevel.DISK_ONLY)
    try:
        model = ReadingModel([])
        characters = graded.agg(F.sum(F.length("text"))).first()[0] or 0
        model.start(_vocabulary(graded), characters)
        _count(graded, model)
        _map_scores(graded, model)
        return model
    finally:
        graded.unpersist()


def reading_levels(documents: DataFrame, model: ReadingModel) -> DataFrame:
    """``doc_id``, ``level`` (1 to 4), ``expected`` (the mean of the level's distribution),
    ``at_least_4`` of every document.

    Null and empty texts and texts without known words are level 1. Repeated
    documents get the same level. Without any graded document there is no row.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        model = sent.value

        def run(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": [], "level": [], "expected": [], "at_least_4": []}
            if not model.knots:
                return out
            for ids, texts in zip(chunks(cols["doc_id"]), chunks(cols["text"])):
                scores = model.batch_scores([model.encode(tokens(t or "")) for t in texts])
                for i, score in zip(ids, scores):
                    level, expected, p = model.level(score)
                    out["doc_id"].append(i), out["level"].append(level), out["expected"].append(expected), out["at_least_4"].append(p[-1])
            return out

        return run

    return map_batches(documents.select("doc_id", "text"), make, "doc_id bigint, level int, expected double, at_least_4 double")
