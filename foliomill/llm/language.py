"""Problem 3: missing or wrong language labels, and language segments of mixed texts.

A linear-chain conditional random field labels the words of a text with languages.
Affixes, character n-grams and a lexicon of hashed words give the emissions, the
transitions are learned, and forward-backward gives each word's probabilities. It
is trained on code-switched sequences made from a bounded sample of documents
whose language is known. Sentences and works take their language from the words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm import quality
from foliomill.llm.common import bounded_sample, cut, map_batches, pack, unpack
from foliomill.llm.encoding import repair
from foliomill.llm.quality import own_lines
from foliomill.llm.residue import is_residue

#: Training documents of each language, at most; also words of a training sequence.
SAMPLE_PER_LANGUAGE, SEQUENCE_WORDS = 160, 100
DIMS = 1 << 15
EPOCHS, BATCH, RATE = 4, 32, 0.06
#: A segment is at least so many consecutive whole sentences ...
SENTENCES = 2
#: ... each of at least so many words, surer of its language than this.
SENTENCE_WORDS, SURE = 3, 0.75
CHUNK = 512

#: Names of languages besides their two-letter codes.
NAMES = {
    "en": "eng english anglais inglés ingles englisch الإنجليزية انجليزي",
    "fr": "fra fre french français francais francés französisch الفرنسية فرنسي",
    "es": "spa spanish espagnol español espanol castellano spanisch الإسبانية اسباني",
    "de": "deu ger german allemand alemán aleman deutsch الألمانية ألماني",
    "ar": "ara arabic arabe árabe arabisch العربية عربي",
}
#: The other two-letter codes of ISO 639-1.
ISO_CODES = frozenset(
    (
        "aa ab ae af ak am an as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da dv dz ee el eo et eu fa ff fi fj fo fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz"
        " ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny"
        " oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
    ).split()
)
_ALIASES = {n: code for code, names in NAMES.items() for n in (code, *names.split())}


def normal_code(code: str | None) -> str | None:
    """The two-letter code that a label means; None if it names no known language.

    Case, regions, three-letter codes and names in five languages are understood;
    another two-letter code that exists is returned as it is."""
    if not code or not code.strip():
        return None
    s = code.strip().casefold()
    if s in _ALIASES:
        return _ALIASES[s]
    first = re.split(r"[-_\s(]", s)[0]
    return _ALIASES.get(first) or (first if first in ISO_CODES else None)


_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?؟…])(?:[»”“\"’)\]]|\s»)*\s+(?=\S)")


def sentences(line: str) -> list[str]:
    """Whole sentences of a line. A question or exclamation that ends a quotation
    inside a sentence doesn't end it."""
    out, at = [], 0
    for m in _SENTENCE.finditer(line):
        closing = m.group().strip()
        if closing and line[m.start() - 1] in "?!؟" and len(closing) > 0:
            continue
        out.append(line[at : m.end()].strip())
        at = m.end()
    rest = line[at:].strip()
    return out + [rest] if rest else out


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself, affixes, inner n-grams, script and case."""
    w = word.lower()
    script = "l" if w[0] < "ɐ" else "a" if "؀" <= w[0] <= "ۿ" or "ﭐ" <= w[0] else "o"
    s = f"^{w}$"
    keys = [f"w{w}", f"s{script}{word[:1].isupper()}", f"p{w[:1]}", f"p{w[:2]}", f"p{w[:3]}", f"e{w[-1:]}", f"e{w[-2:]}", f"e{w[-3:]}", f"e{w[-4:]}"]
    keys += {"t" + s[i : i + 3] for i in range(len(s) - 2)}
    return [zlib.crc32(k.encode("utf-8", "replace")) % DIMS for k in keys]


class LinearChain:
    """The conditional random field: feature weights, transitions, start weights."""

    def __init__(self, languages: list[str]) -> None:
        n = len(languages)
        self.languages = languages
        self.w = np.zeros((DIMS, n), np.float32)
        self.trans = np.eye(n, dtype=np.float32)
        self.start = np.zeros(n, np.float32)

    def save(self) -> bytes:
        return pack({"languages": self.languages}, {"w": self.w, "trans": self.trans, "start": self.start})

    @staticmethod
    def load(payload: bytes) -> LinearChain:
        facts, arrays = unpack(payload)
        model = LinearChain(facts["languages"])
        model.w, model.trans, model.start = arrays["w"], arrays["trans"], arrays["start"]
        return model

    def emission(self, word: str) -> np.ndarray:
        return self.w[word_features(word)].sum(0)

    def marginals(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward in scaled probabilities. ``e``: time, batch, language.
        Returns word marginals and expected transition counts."""
        t, b, n = e.shape
        x = np.exp(e - e.max(2, keepdims=True))
        a = np.exp(self.trans - self.trans.max())
        alpha = np.zeros_like(x)
        cur = np.exp(self.start - self.start.max()) * x[0]
        cur /= cur.sum(1, keepdims=True)
        alpha[0] = cur
        for k in range(1, t):
            new = (cur @ a) * x[k]
            new /= new.sum(1, keepdims=True)
            cur = np.where(mask[k][:, None], new, cur)
            alpha[k] = cur
        gamma = np.zeros_like(x)
        gamma[t - 1] = alpha[t - 1]
        beta = np.ones((b, n), np.float32)
        pairs = np.zeros((n, n), np.float32)
        for k in range(t - 2, -1, -1):
            live = mask[k + 1][:, None]
            right = x[k + 1] * beta
            right /= right.sum(1, keepdims=True)
            back = right @ a.T
            joint = alpha[k][:, :, None] * a[None] * right[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            pairs += (joint * live[:, :, None]).sum(0)
            beta = np.where(live, back / back.sum(1, keepdims=True), beta)
            g = alpha[k] * beta
            gamma[k] = g / g.sum(1, keepdims=True)
        return gamma, pairs

    def word_marginals(self, e: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Forward-backward without transition counts, for labelling."""
        t, b, n = e.shape
        x = np.exp(e - e.max(2, keepdims=True))
        a = np.exp(self.trans - self.trans.max())
        alpha = np.zeros_like(x)
        cur = np.exp(self.start - self.start.max()) * x[0]
        alpha[0] = cur = cur / cur.sum(1, keepdims=True)
        for k in range(1, t):
            new = (cur @ a) * x[k]
            new /= new.sum(1, keepdims=True)
            alpha[k] = cur = np.where(mask[k][:, None], new, cur)
        beta = np.ones((b, n), np.float32)
        for k in range(t - 2, -1, -1):
            back = (x[k + 1] * beta) @ a.T
            beta = np.where(mask[k + 1][:, None], back / back.sum(1, keepdims=True), beta)
            alpha[k] *= beta
        return alpha / alpha.sum(2, keepdims=True)

    def train(self, sequences: list[tuple[list[str], list[int]]], seed: int = 3) -> None:
        """Adagrad on the conditional log-likelihood."""
        r = np.random.default_rng(seed)
        n = len(self.languages)
        gw, gt, gs = (np.full(shape, 1e-3, np.float32) for shape in ((DIMS, n), (n, n), n))
        index: dict[str, int] = {}
        feats: list[np.ndarray] = []
        for words, _ in sequences:
            for w in words:
                if w not in index:
                    index[w] = len(feats)
                    feats.append(np.array(word_features(w)))
        for _ in range(EPOCHS):
            order = r.permutation(len(sequences))
            for at in range(0, len(order), BATCH):
                part = [sequences[k] for k in order[at : at + BATCH]]
                t = max(len(w) for w, _ in part)
                ids = np.full((t, len(part)), -1)
                gold = np.zeros((t, len(part)), np.int64)
                for j, (w, y) in enumerate(part):
                    ids[: len(w), j] = [index[x] for x in w]
                    gold[: len(w), j] = y
                mask = ids >= 0
                used, inverse = np.unique(ids[mask], return_inverse=True)
                e = np.zeros((t, len(part), n), np.float32)
                e[mask] = np.stack([self.w[feats[k]].sum(0) for k in used])[inverse]
                gamma, pairs = self.marginals(e, mask)
                diff = np.eye(n, dtype=np.float32)[gold] - gamma
                per_word = np.zeros((len(used), n), np.float32)
                np.add.at(per_word, inverse, diff[mask])
                grad = np.zeros_like(self.w)
                size = np.array([len(feats[k]) for k in used])
                flat = np.concatenate([feats[k] for k in used])
                by = np.argsort(flat, kind="stable")
                first = np.flatnonzero(np.diff(flat[by], prepend=-1))
                grad[flat[by][first]] = np.add.reduceat(np.repeat(per_word, size, axis=0)[by], first, axis=0)
                both = mask[1:] & mask[:-1]
                seen = np.zeros((n, n), np.float32)
                np.add.at(seen, (gold[:-1][both], gold[1:][both]), 1)
                gtrans = seen - pairs
                gstart = diff[0][mask[0]].sum(0)
                gw += grad * grad
                gt += gtrans * gtrans
                gs += gstart * gstart
                self.w += RATE * grad / np.sqrt(gw)
                self.trans += RATE * gtrans / np.sqrt(gt)
                self.start += RATE * gstart / np.sqrt(gs)


def training_sequences(rows: list[tuple[str, str]], languages: list[str], seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """Sequences of sentences that change language now and then."""
    r = np.random.default_rng(seed)
    pool = {lang: [s for t, x in rows if x == lang for line in t.split("\n") for s in sentences(line)] for lang in languages}
    pool = {k: v for k, v in pool.items() if v}
    present = sorted(pool)
    out = []
    total = sum(map(len, pool.values()))
    while total > 0 and present:
        words: list[str] = []
        gold: list[int] = []
        lang = present[r.integers(len(present))]
        while len(words) < SEQUENCE_WORDS:
            s = _WORD.findall(pool[lang][r.integers(len(pool[lang]))])
            words += s
            gold += [languages.index(lang)] * len(s)
            total -= 1
            if not s and total <= 0:
                break
            if r.random() < 0.25:
                lang = present[r.integers(len(present))]
        if words:
            out.append((words, gold))
    return out


def fit(documents: DataFrame) -> LinearChain:
    """The field for the languages of the labelled documents. Without any there is
    nothing to learn from, which is an error."""
    rows = bounded_sample(documents.where("text IS NOT NULL AND text <> ''"), "doc_id", F.col("lang"), SAMPLE_PER_LANGUAGE, ["doc_id", "text", "lang"])
    pairs = [(r["text"], c) for r in rows if (c := normal_code(r["lang"]))]
    if not pairs:
        raise ValueError("no document has a text and a known language to learn from")
    model = LinearChain(sorted({c for _, c in pairs}))
    model.train(training_sequences(pairs, model.languages))
    return model


class Labeller:
    """Labels words of many texts at once; emissions of words seen before are kept."""

    def __init__(self, model: LinearChain) -> None:
        self.model = model
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages)), np.float32)

    def ids(self, words: list[str]) -> list[int]:
        get = self.index.get
        out = [get(w, -1) for w in words]
        if -1 in out:
            for k, w in enumerate(words):
                if out[k] < 0:
                    j = self.index.get(w)
                    if j is None:
                        j = self.index[w] = len(self.index)
                        if j >= len(self.table):
                            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
                        self.table[j] = self.model.emission(w)
                    out[k] = j
        return out

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Word marginals of each text, given as its words."""
        if len(self.index) > 300_000:
            self.index.clear()
        out: list[np.ndarray] = [np.zeros((0, len(self.model.languages)), np.float32)] * len(texts)
        order = sorted((k for k in range(len(texts)) if texts[k]), key=lambda k: len(texts[k]))
        at = 0
        while at < len(order):
            # batches of at most so many cells, so that one long text needs no more
            size = max(1, min(CHUNK, 400_000 // len(texts[order[min(at + CHUNK, len(order)) - 1]])))
            part = order[at : at + size]
            at += size
            t = len(texts[part[-1]])
            ids = np.zeros((t, len(part)), np.int64)
            mask = np.zeros((t, len(part)), bool)
            for j, k in enumerate(part):
                n = len(texts[k])
                ids[:n, j] = self.ids(texts[k])
                mask[:n, j] = True
            gamma = self.model.word_marginals(self.table[ids], mask)
            for j, k in enumerate(part):
                out[k] = gamma[: len(texts[k]), j]
        return out


def segments(marginals: np.ndarray, lengths: list[int], languages: list[str]) -> list[tuple[str, int, int, float]]:
    """(language, first sentence, sentences, confidence) of the runs of sentences.

    Sentences of too few words or of no sure language end no run and join none."""
    runs: list[list] = []
    at = 0
    for k, n in enumerate(lengths):
        p = marginals[at : at + n].mean(0) if n else np.zeros(len(languages))
        at += n
        best = int(p.argmax()) if n else 0
        if n < SENTENCE_WORDS or p[best] < SURE:
            continue
        if runs and runs[-1][0] == best:
            runs[-1][2] += 1
            runs[-1][3].append(float(p[best]))
        else:
            runs.append([best, k, 1, [float(p[best])]])
    return [(languages[b], first, n, sum(c) / len(c)) for b, first, n, c in runs]


SEGMENT = "array<struct<lang string, first int, sentences int, confidence double>>"


def label_texts(rows: DataFrame, model: LinearChain) -> DataFrame:
    """``book_id``, ``chapter_id``, ``mass`` (expected words of each language) and
    ``segments`` of rows (``book_id``, ``chapter_id``, ``title``, ``text``).

    Only the document's own lines are labelled, garbled characters restored first. Texts in place of content have no
    mass; texts that aren't prose keep their mass but have no segments.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        labeller = Labeller(sent.value)
        languages = sent.value.languages

        def split(lines: list[str], own: list[bool]) -> tuple[list[str], list[int]]:
            words: list[str] = []
            lengths: list[int] = []
            for x, mine in zip(lines, own):
                if mine and x:
                    for s in sentences(x):
                        w = _WORD.findall(s)
                        words += w
                        lengths.append(len(w))
            return words, lengths

        def run(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"book_id": [], "chapter_id": [], "mass": [], "segments": []}
            rows = [x for x in zip(cols["book_id"], cols["chapter_id"], cols["title"], cols["text"]) if x[3] and not x[3].isspace() and not is_residue(x[3], x[2])]
            for a in range(0, len(rows), CHUNK):
                part = [(b, c, h, repair(t)[1]) for b, c, h, t in rows[a : a + CHUNK]]
                lined = own_lines([r[3] for r in part], [r[2] for r in part])
                parts = [split(*x) for x in lined]
                for r, x, (_, lengths), m in zip(part, lined, parts, labeller.label([w for w, _ in parts])):
                    segs = segments(m, lengths, languages)
                    mass = m.sum(0)
                    if len({s[0] for s in segs if s[2] >= SENTENCES}) > 1 and quality.document_statistics(*x)["kind"] != "prose":
                        segs = []
                    out["book_id"].append(r[0]), out["chapter_id"].append(r[1])
                    out["mass"].append(mass.tolist()), out["segments"].append([dict(zip(("lang", "first", "sentences", "confidence"), s)) for s in segs])
            return out

        return run

    return map_batches(rows.select("book_id", "chapter_id", "title", "text"), make, f"book_id bigint, chapter_id bigint, mass array<double>, segments {SEGMENT}")


def _texts(books: DataFrame, chapters: DataFrame) -> DataFrame:
    own = chapters.select("book_id", "chapter_id", "title", F.col("plain_text").alias("text")).where("plain_text IS NOT NULL")
    about = books.select("book_id", F.lit(None).cast("bigint").alias("chapter_id"), F.lit("").alias("title"), F.concat_ws("\n", "title", "description").alias("text"))
    return own.unionByName(about)


def languages(books: DataFrame, chapters: DataFrame, model: LinearChain) -> tuple[DataFrame, DataFrame]:
    """(works, segments).

    Works: ``book_id``, ``lang``, ``confidence`` (its share of the expected words of the
    work's texts, title and description), ``label`` (the code its label means, or null),
    ``wrong`` (whether the label is missing or names another language). Works without
    any word have a null language and aren't wrong.
    Segments: ``chapter_id``, ``lang``, ``first``, ``sentences``, ``confidence`` of every
    run of sentences of one language; a chapter of one language has one.
    """
    got = cut(label_texts(_texts(books, chapters), model))
    langs = model.languages
    sums = got.groupBy("book_id").agg(*[F.sum(F.col("mass")[k]).alias(f"m{k}") for k in range(len(langs))])
    total = sum(F.col(f"m{k}") for k in range(len(langs)))
    best = F.array_max(F.array(*[F.struct(F.col(f"m{k}").alias("m"), F.lit(x).alias("lang")) for k, x in enumerate(langs)]))
    works = sums.where(total > 0).select("book_id", best["lang"].alias("lang"), (best["m"] / total).alias("confidence"))
    alias = F.create_map(*[F.lit(x) for pair in ({c: c for c in ISO_CODES} | _ALIASES).items() for x in pair])
    code = F.lower(F.trim("language_code"))
    label = F.coalesce(F.try_element_at(alias, code), F.try_element_at(alias, F.split(code, r"[-_\s(]")[0]))
    works = books.select("book_id", label.alias("label")).join(works, "book_id", "left")
    works = works.select("book_id", "lang", "confidence", "label", (F.col("lang").isNotNull() & ~F.col("lang").eqNullSafe(F.col("label"))).alias("wrong"))
    segs = got.where("chapter_id IS NOT NULL").select("chapter_id", F.inline("segments"))
    return works, segs


def found(books: DataFrame, chapters: DataFrame, model: LinearChain) -> DataFrame:
    """``src_table``, ``row_id``, ``lang``: works whose label is missing or wrong, and
    each language of chapters with at least two sentences running in two or more."""
    works, segs = languages(books, chapters, model)
    long = segs.where(F.col("sentences") >= SENTENCES).groupBy("chapter_id").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    mixed = long.where(F.size("langs") > 1).select(F.lit("chapters").alias("src_table"), F.col("chapter_id").alias("row_id"), F.explode("langs").alias("lang"))
    return works.where("wrong").select(F.lit("books").alias("src_table"), F.col("book_id").alias("row_id"), "lang").unionByName(mixed)
