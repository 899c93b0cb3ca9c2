"""Problem 4: page boilerplate mixed with main content.

A recurrent labeller reads the leaves of a page, or the blocks of a document, in
order. Each is a vector of its tag path, its shape and the mean of learned vectors of
its hashed words; a bidirectional LSTM in numpy classifies every one with the whole
document as context. It is trained here on bounded samples of chapters and pages whose
labels come from the data: what stands outside of the element that holds most of a
page's text, and what recurs across works, is the site's. Blocks of which neither
can be told take no part in the training.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions.htmltree import Node, normalize, parse
from foliomill.llm.common import bounded_sample, map_batches, pack, unpack
from foliomill.llm.residue import HEADING, is_residue

#: Chapters of the training sample: about so many of each of so many groups of hosts,
#: at most twice as many; and pages, at most twice as many.
HOST_GROUPS, PER_GROUP, SAMPLE_PAGES = 64, 36, 400
BUCKETS, PATH_BUCKETS = 8192, 256
WORD_DIM, PATH_DIM, HIDDEN, BATCH, RATE = 24, 6, 24, 96, 0.02
#: Times the sample is seen; a small one as often as gives so many steps.
EPOCHS, STEPS = 6, 160
CHUNK = 512
#: A form that stands in so many works recurs; so many words make a form that may
#: leave out names and numbers.
RECURS, FORM_WORDS = 3, 3
#: Menus are told by the words of recurring forms of up to so many words; boxes have no
#: more than so many short blocks beside a recurring one.
MENU_WORDS, BOX = 4, 8
#: A block with a sentence end and so many words that doesn't recur is the document's.
STORY_WORDS = 8
#: The content of a page is the innermost element with such a share of its letters.
CONTENT_SHARE = 0.5
_WORD = re.compile(r"[^\W\d_]+|\d+|[|/·»©↑★:–—=]")
_LETTERS = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?؟…][»”“\"’')\]]*\s*$")
_DIGIT = re.compile(r"\d")
#: How readers' comments begin: a name with a number and a mark.
_READER = re.compile(r"^[^\W\d_]+_?\d+\s*[:–—-]\s")
SHAPE = 14


def block_shape(tag: str, text: str, n: int, k: int, total: int, titled: bool) -> list[float]:
    """What can be seen of a block without its words."""
    return [
        float(tag == "p"),
        float(tag == "h"),
        float(tag == "img"),
        min(n, 60) / 30,
        min(len(text), 400) / 200,
        float(bool(_END.search(text[-8:]))),
        float(text.isupper()),
        float(bool(_DIGIT.search(text))),
        float(titled),
        float(bool(HEADING.match(text)) and n < 20),
        float(k < 3),
        float(total - k <= 4),
        k / max(1, total - 1),
        float("," in text or "،" in text),
    ]


class Buckets(dict):
    """Word to hash bucket, kept for words seen before."""

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        b = self[w] = zlib.crc32((w if not w.isdigit() else "0").encode("utf-8", "replace")) % BUCKETS
        return b


class Features:
    """Turns documents into word buckets, tag-path buckets and shape rows."""

    def __init__(self) -> None:
        self.bucket = Buckets()

    def words(self, text: str) -> list[int]:
        bucket = self.bucket
        return [bucket[w] for w in _WORD.findall(text.lower())]

    def document(self, blocks: list[dict], title: str | None) -> tuple[list[list[int]], list[list[int]], list[list[float]]]:
        head = " ".join((title or "").split()).casefold()
        ids, paths, shapes = [], [], []
        for k, b in enumerate(blocks):
            kind = b.get("type") or "p"
            text = (b.get("text") or "") if kind != "img" else ""
            w = self.words(text)
            titled = bool(head) and len(text) < 4 * len(head) + 40 and " ".join(text.split()).casefold() == head
            ids.append(w)
            paths.append([self.bucket[f"<{x}>"] % PATH_BUCKETS for x in b.get("path") or (kind,)])
            shapes.append(block_shape(kind, text, len(w), k, len(blocks), titled))
        return ids, paths, shapes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, and how many each has."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((w for x in lists for w in x), np.int64, int(n.sum())), n


def _row_sums(ids: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The rows of equal ids added up."""
    out = np.zeros((size, rows.shape[1]), np.float32)
    if len(ids):
        order = np.argsort(ids, kind="stable")
        at = np.flatnonzero(np.diff(ids[order], prepend=-1))
        out[ids[order][at]] = np.add.reduceat(rows[order], at, axis=0)
    return out


class Labeller:
    """Bidirectional LSTM over block vectors, with hand-written backpropagation."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + PATH_DIM + SHAPE, HIDDEN
        init = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": init(BUCKETS, WORD_DIM) * np.float32(np.sqrt(BUCKETS) * 0.1)}
        self.p["P"] = init(PATH_BUCKETS, PATH_DIM) * np.float32(np.sqrt(PATH_BUCKETS) * 0.1)
        for side in "fb":
            self.p["W" + side] = init(d, 4 * h)
            self.p["U" + side] = init(h, 4 * h)
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1
            self.p["c" + side] = bias
        self.p["V"] = init(2 * h + d, 1)
        self.p["v"] = np.zeros(1, np.float32)

    def block_vectors(self, ids: list[list[int]], paths: list[list[int]], shapes: list[list[float]]) -> np.ndarray:
        """Mean word vectors beside mean path vectors and shapes, for all blocks of many documents."""
        return self._vectors(_flat(ids), _flat(paths), np.array(shapes, np.float32).reshape(len(ids), SHAPE))

    def _vectors(self, words: tuple[np.ndarray, np.ndarray], paths: tuple[np.ndarray, np.ndarray], shapes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(shapes), WORD_DIM + PATH_DIM + SHAPE), np.float32)
        for table, (flat, n), at, dim in (("E", words, 0, WORD_DIM), ("P", paths, WORD_DIM, PATH_DIM)):
            full = n > 0
            if len(flat):
                start = np.concatenate(([0], np.cumsum(n)))[:-1][full]
                out[full, at : at + dim] = np.add.reduceat(self.p[table][flat], start, axis=0) / n[full, None]
        out[:, WORD_DIM + PATH_DIM :] = shapes
        return out

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: time, batch, dim. Returns the hidden states and what backpropagation needs."""
        t, b, _ = x.shape
        h = np.zeros((b, HIDDEN), np.float32)
        c = np.zeros((b, HIDDEN), np.float32)
        u = self.p["U" + side]
        pre = x @ self.p["W" + side] + self.p["c" + side]
        out = np.zeros((t, b, HIDDEN), np.float32)
        tape = []
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            z = pre[k] + h @ u
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[k][:, None]
            c2 = (f * c + i * g) * m + c * (1 - m)
            tc = np.tanh(c2)
            h2 = o * tc * m + h * (1 - m)
            if keep:
                tape.append((k, h, c, i, f, o, g, tc, m))
            h, c = h2, c2
            out[k] = h2
        return out, tape

    def _back(self, dout: np.ndarray, x: np.ndarray, tape: list, side: str, grad: dict) -> np.ndarray:
        t, b, _ = x.shape
        dz_all = np.zeros((t, b, 4 * HIDDEN), np.float32)
        dh = np.zeros((b, HIDDEN), np.float32)
        dc = np.zeros((b, HIDDEN), np.float32)
        u = self.p["U" + side]
        du = np.zeros_like(u)
        for k, h, c, i, f, o, g, tc, m in reversed(tape):
            dh = dh + dout[k]
            dhm = dh * m
            do = dhm * tc
            dct = (dc * m) + dhm * o * (1 - tc * tc)
            dz = np.concatenate((dct * g * i * (1 - i), dct * c * f * (1 - f), do * o * (1 - o), dct * i * (1 - g * g)), axis=1)
            dz_all[k] = dz
            du += h.T @ dz
            dc = dct * f + dc * (1 - m)
            dh = dz @ u.T + dh * (1 - m)
        flat, dflat = x.reshape(t * b, -1), dz_all.reshape(t * b, -1)
        grad["W" + side] = flat.T @ dflat
        grad["U" + side] = du
        grad["c" + side] = dflat.sum(0)
        return dz_all @ self.p["W" + side].T

    @staticmethod
    def _pad(vectors: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, b = max(lengths), len(lengths)
        place = np.concatenate([np.arange(n) * b + j for j, n in enumerate(lengths)])
        x = np.zeros((t * b, vectors.shape[1]), np.float32)
        x[place] = vectors
        mask = np.zeros(t * b, np.float32)
        mask[place] = 1
        return x.reshape(t, b, -1), mask.reshape(t, b), place

    def scores(self, ids: list[list[int]], paths: list[list[int]], shapes: list[list[float]], lengths: list[int]) -> np.ndarray:
        """Log odds that each block is boilerplate, documents one after the other."""
        x, mask, place = self._pad(self.block_vectors(ids, paths, shapes), lengths)
        a, _ = self._run(x, mask, "f", False)
        b, _ = self._run(x, mask, "b", False)
        z = np.concatenate((a, b, x), axis=2).reshape(mask.size, -1) @ self.p["V"] + self.p["v"]
        return z[place, 0]

    def train(self, documents: list[tuple[list[list[int]], list[list[int]], list[list[float]], list[int]]], seed: int = 7) -> None:
        """Adam on the logistic loss of all labelled blocks (label -1 is none), the
        document order drawn anew each epoch."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        ready = [(_flat(i), _flat(p), np.array(x, np.float32), np.array(y, np.float32)) for i, p, x, y in documents]
        epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(documents))))
        for epoch in range(epochs):
            order = r.permutation(len(documents))
            order = order[np.argsort([len(documents[k][0]) // 6 for k in order], kind="stable")]
            batches = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
            for j in r.permutation(len(batches)):
                part = [ready[k] for k in batches[j]]
                y = np.concatenate([d[3] for d in part])
                told = y >= 0
                if not told.any():
                    continue
                flat, n = (np.concatenate([d[0][k] for d in part]) for k in (0, 1))
                # words are dropped now and then, so that no single one decides
                keep = r.random(len(flat)) > 0.1
                block = np.repeat(np.arange(len(n)), n)[keep]
                words = flat[keep], np.bincount(block, minlength=len(n))
                paths = tuple(np.concatenate([d[1][k] for d in part]) for k in (0, 1))
                lengths = [len(d[3]) for d in part]
                x, mask, place = self._pad(self._vectors(words, paths, np.concatenate([d[2] for d in part])), lengths)
                a, ta = self._run(x, mask, "f", True)
                b, tb = self._run(x, mask, "b", True)
                top = np.concatenate((a, b, x), axis=2)
                flat = top.reshape(mask.size, -1)
                prob = _sigmoid(flat[place] @ self.p["V"] + self.p["v"])[:, 0]
                dz = (np.where(told, prob - y, 0) / told.sum())[:, None].astype(np.float32)
                grad = {"V": flat[place].T @ dz, "v": dz.sum(0)}
                dtop = np.zeros_like(flat)
                dtop[place] = dz @ self.p["V"].T
                dtop = dtop.reshape(top.shape)
                dx = dtop[:, :, 2 * HIDDEN :].copy()
                dx += self._back(dtop[:, :, :HIDDEN], x, ta, "f", grad)
                dx += self._back(dtop[:, :, HIDDEN : 2 * HIDDEN], x, tb, "b", grad)
                dvec = dx.reshape(mask.size, -1)[place]
                for table, (flat, n), at, dim in (("E", words, 0, WORD_DIM), ("P", paths, WORD_DIM, PATH_DIM)):
                    share = dvec[:, at : at + dim] / np.maximum(n, 1)[:, None]
                    grad[table] = _row_sums(flat, np.repeat(share, n, axis=0), len(self.p[table]))
                step += 1
                rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    self.p[k] -= (rate * m[k] / (np.sqrt(s[k]) + 1e-8)).astype(np.float32)


    def save(self) -> bytes:
        return pack({}, self.p)

    @staticmethod
    def load(payload: bytes) -> Labeller:
        model = Labeller()
        model.p = unpack(payload)[1]
        return model


# Labels from the data


def forms(text: str) -> tuple[str, str]:
    """(form without names and numbers, whole form) of a block; an empty string where
    too few words are left, or where numbers are all that differs."""
    words = _LETTERS.findall(text)
    folded = [w.casefold() for w in words]
    bare = [w.casefold() for w in words if not w[0].isupper() or (len(w) > 1 and w.isupper())]
    several = len(set(folded)) >= FORM_WORDS or (2 * len(set(folded)) > len(folded) and not _DIGIT.search(text))
    enough = FORM_WORDS - (len(words) > 2 * FORM_WORDS)
    return " ".join(bare) if len(set(bare)) >= enough else "", " ".join(folded) if several else ""


class Recurrence:
    """Which blocks of a sample recur across works, and the words of menus: those of
    short forms that recur across sources. Takes (texts, work, source) of each document."""

    def __init__(self, documents: Iterable[tuple[list[str], object, object]]) -> None:
        works: dict[str, set] = defaultdict(set)
        sources: dict[str, set] = defaultdict(set)
        whole: dict[str, set[str]] = defaultdict(set)
        for texts, work, source in documents:
            for text in texts:
                bare, full = forms(text)
                for form in {bare, full} - {""}:
                    works[form].add(work)
                    sources[form].add(source)
                if full:
                    whole[bare].add(full)
        self.forms = {f for f, w in works.items() if len(w) >= RECURS}
        self.menu = {w for f in self.forms if len(f.split()) <= MENU_WORDS and len(sources[f]) >= RECURS for w in f.split()}
        # a block in capitals has no bare form of its own, but the words of one that has
        self.forms |= {full for bare in self.forms for full in whole.get(bare, ()) if bare}

    def recurs(self, text: str) -> bool:
        if any(f in self.forms for f in forms(text) if f):
            return True
        words = _LETTERS.findall(text.casefold())
        return len(words) > 1 and not _END.search(text) and not _DIGIT.search(text) and all(w in self.menu for w in words)


def block_texts(blocks: list[dict]) -> list[str]:
    return [" ".join((b.get("text") or "").split()) if b.get("type") != "img" else "" for b in blocks]


def weak_labels(blocks: list[dict], title: str | None, seen: Recurrence) -> list[int]:
    """1 for blocks that recur across works or begin as readers' comments do, 0 for
    headings, images, whole sentences and what stands among them, -1 for up to ``BOX``
    short blocks beside recurring ones. A document without whole sentences is a list or
    table, whose short blocks are its own."""
    head = " ".join((title or "").split()).casefold()
    out = []
    for text in block_texts(blocks):
        if not text or text.casefold() == head or (HEADING.match(text) and not _END.search(text)):
            out.append(0)
        elif seen.recurs(text) or _READER.match(text):
            out.append(1)
        else:
            out.append(0 if _END.search(text) and len(_LETTERS.findall(text)) >= STORY_WORDS and not text.isupper() else -1)
    if not any(y == 0 and _END.search(t) for t, y in zip(block_texts(blocks), out)):
        return [max(y, 0) for y in out]
    a = 0
    for b in range(len(out) + 1):
        if b == len(out) or out[b] >= 0:
            if b - a > BOX or 1 not in (out[a - 1] if a else 0, out[b] if b < len(out) else 0):
                out[a:b] = [0] * (b - a)
            a = b + 1
    return out


_SKIP = frozenset("script style template head noscript".split())
_INLINE = frozenset("a abbr b bdi bdo cite code em font i img kbd mark q s samp small span strong sub sup time u var".split())


def page_leaves(html: str | None) -> list[dict]:
    """The leaves of a page in order: ``type`` (h or p), ``text``, ``path`` (tags with
    classes from the outside in) and ``nodes``, the elements around it.

    Text of inline elements belongs to the block around them; links one after the other
    are leaves of their own, and a line break ends a leaf. Null and empty pages have none."""
    out: list[dict] = []
    text: list[str] = []

    def end(node: Node) -> None:
        said = " ".join(normalize("".join(text)).split())
        text.clear()
        if not said:
            return
        nodes: list[Node] = []
        up: Node | None = node
        while up is not None and up.tag != "#document":
            nodes.append(up)
            up = up.parent
        nodes.reverse()
        path = [x for n in nodes for x in (n.tag, *(f"{n.tag}.{c}" for c in (n.get("class") or n.get("id")).split()[:2]))]
        out.append({"type": "h" if re.fullmatch("h[1-6]", node.tag) else "p", "text": said, "path": path, "nodes": nodes})

    root = parse(html)
    stack: list[tuple[Node | str, Node, bool]] = [(c, root, False) for c in reversed(root.children)]
    while stack:
        item, parent, leaving = stack.pop()
        if leaving:
            end(item)  # type: ignore[arg-type]
        elif isinstance(item, str):
            text.append(item)
        elif item.tag in _SKIP:
            continue
        elif item.tag == "br":
            end(parent)
        else:
            links = item.tag == "a" and not any(isinstance(c, str) and c.strip() for c in parent.children)
            inline = item.tag in _INLINE and not links
            if not inline:
                end(parent)
                stack.append((item, parent, True))
            stack.extend((c, parent if inline else item, False) for c in reversed(item.children))
    end(root)
    return out


def outside_content(leaves: list[dict]) -> list[bool]:
    """Whether each leaf stands outside of the innermost element that holds half of the
    page's letters and more than one leaf."""
    letters: Counter = Counter()
    parts: Counter = Counter()
    depth: dict[int, int] = {}
    total = 0
    for leaf in leaves:
        n = len(leaf["text"])
        total += n
        for d, node in enumerate(leaf["nodes"]):
            letters[id(node)] += n
            parts[id(node)] += 1
            depth[id(node)] = d
    holders = [k for k, n in letters.items() if n >= CONTENT_SHARE * total and parts[k] > 1]
    content = max(holders, key=lambda k: depth[k]) if holders else None
    return [content is not None and all(id(n) != content for n in leaf["nodes"]) for leaf in leaves]


def train_labeller(chapters: list[tuple[list[dict], str | None, object, object]], pages: list[tuple[str, str]] = (), seed: int = 13) -> Labeller | None:
    """The labeller for chapters (blocks, title, work, source) and pages (HTML, source); None
    without any.

    Half of the pages are shown with their tag paths, half with the last tag only,
    as the blocks of chapters have it."""
    docs = [([b for b in blocks if b], title, work, source) for blocks, title, work, source in chapters]
    read = [(x, source) for html, source in pages if (x := page_leaves(html))]
    seen = Recurrence([(block_texts(d), work, source) for d, _, work, source in docs] + [([x["text"] for x in leaves], ("page", k), source) for k, (leaves, source) in enumerate(read)])
    features, data = Features(), []
    for blocks, title, *_ in docs:
        if blocks:
            data.append((*features.document(blocks, title), weak_labels(blocks, title, seen)))
    r = np.random.default_rng(seed)
    for leaves, _ in read:
        labels = [1 if out else y for out, y in zip(outside_content(leaves), weak_labels(leaves, None, seen))]
        whole = r.random() < 0.5
        blocks = [{"type": x["type"], "text": x["text"], "path": x["path"] if whole else None} for x in leaves]
        data.append((*features.document(blocks, None), labels))
    if not data:
        return None
    model = Labeller()
    model.train(data)
    return model


def label_blocks(model: Labeller | None, features: Features, documents: list[tuple[list[dict], str | None]]) -> list[np.ndarray]:
    """For each document which of its p and h blocks are boilerplate; without a model none."""
    order = sorted(range(len(documents)), key=lambda k: len(documents[k][0]))
    out: list[np.ndarray] = [np.zeros(len(d), bool) for d, _ in documents]
    at = 0
    while at < len(order) and model is not None:
        # batches of at most so many cells, so that one long document needs no more
        longest = len(documents[order[min(at + CHUNK, len(order)) - 1]][0])
        size = max(1, min(CHUNK, 100_000 // max(1, longest)))
        part = [k for k in order[at : at + size] if documents[k][0]]
        at += size
        if not part:
            continue
        got = [features.document(*documents[k]) for k in part]
        lengths = [len(x) for x, *_ in got]
        score = model.scores([w for x, *_ in got for w in x], [w for _, y, _ in got for w in y], [s for *_, z in got for s in z], lengths)
        a = 0
        for k, n in zip(part, lengths):
            text = np.array([b.get("type") != "img" and bool((b.get("text") or "").strip()) for b in documents[k][0]])
            out[k] = (score[a : a + n] > 0) & text
            a += n
    return out


def fit(chapters: DataFrame, pages: DataFrame | None = None, per: int = PER_GROUP) -> Labeller | None:
    """A labeller trained on bounded samples; None if no chapter has two blocks.

    Every group of hosts gives its share, so that small ones aren't drowned by a hot one."""
    blocks = F.transform("blocks", lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"))).alias("blocks")
    has = chapters.where(F.size("blocks") > 1).select("chapter_id", "book_id", "title", "plain_text", "host", blocks)
    group = F.pmod(F.xxhash64(F.coalesce("host", F.lit(""))), F.lit(HOST_GROUPS))
    rows = bounded_sample(has, "chapter_id", group, per, ["chapter_id", "book_id", "title", "plain_text", "host", "blocks"])
    docs = [([b.asDict() for b in r["blocks"] if b is not None], r["title"], r["book_id"], r["host"]) for r in rows if not is_residue(r["plain_text"], r["title"])]
    html: list[tuple[str, str]] = []
    if pages is not None:
        has = pages.where("html IS NOT NULL").select("page_id", "html", F.regexp_extract("url", "^[^/]*//[^/]*", 0).alias("source"))
        html = [(r["html"], r["source"]) for r in bounded_sample(has, "page_id", F.lit("all"), SAMPLE_PAGES, ["page_id", "html", "source"])]
    return train_labeller(docs, html)


def boilerplate(chapters: DataFrame, model: Labeller | None) -> DataFrame:
    """``chapter_id``, ``boilerplate``: positions in ``blocks`` of the blocks that aren't
    the chapter's own, for every chapter with blocks.

    Null and empty block arrays give no row, null blocks and blank texts are never
    boilerplate, and chapters that problem 7 excludes have none.
    """
    sent = chapters.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        features = Features()

        def run(cols: dict[str, list]) -> dict[str, list]:
            ids, out = [], []
            rows = list(zip(cols["chapter_id"], cols["blocks"], cols["title"], cols["plain_text"]))
            for a in range(0, len(rows), 4 * CHUNK):
                part = [(i, [b or {} for b in bs], h) for i, bs, h, t in rows[a : a + 4 * CHUNK] if bs and not is_residue(t, h)]
                for (i, *_), gone in zip(part, label_blocks(sent.value, features, [(bs, h) for _, bs, h in part])):
                    ids.append(i), out.append(np.flatnonzero(gone).tolist())
            return {"chapter_id": ids, "boilerplate": out}

        return run

    blocks = F.transform("blocks", lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"))).alias("blocks")
    rows = chapters.select("chapter_id", "title", "plain_text", blocks).where("blocks IS NOT NULL")
    return map_batches(rows, make, "chapter_id bigint, boilerplate array<int>")


def page_content(pages: DataFrame, model: Labeller | None) -> DataFrame:
    """``page_id``, ``main_text`` (the leaves of the main body, one a line), ``leaves`` and
    ``removed``, their numbers, of every page. Null and empty pages have no leaves."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        features = Features()

        def run(cols: dict[str, list]) -> dict[str, list]:
            read = [page_leaves(h) for h in cols["html"]]
            gone = label_blocks(sent.value, features, [(x, None) for x in read])
            kept = ["\n".join(x["text"] for x, g in zip(leaves, out) if not g) for leaves, out in zip(read, gone)]
            return {"page_id": cols["page_id"], "main_text": kept, "leaves": [len(x) for x in read], "removed": [int(g.sum()) for g in gone]}

        return run

    return map_batches(pages.select("page_id", "html"), make, "page_id bigint, main_text string, leaves int, removed int")


def main_content(chapters: DataFrame, model: Labeller | None) -> DataFrame:
    """``chapter_id``, ``blocks``, ``plain_text`` reduced to the chapter itself, and
    ``removed``, the number of blocks left out; one row per chapter with blocks."""
    labels = boilerplate(chapters, model).where(F.size("boilerplate") > 0)
    joined = chapters.select("chapter_id", "blocks").where("blocks IS NOT NULL").join(labels, "chapter_id", "left")
    none = F.array().cast("array<int>")
    kept = F.filter("blocks", lambda b, i: ~F.array_contains(F.coalesce(F.col("boilerplate"), none), i))
    texts = F.filter("blocks", lambda b: b["type"].isin("p", "h") & b["text"].isNotNull())
    return joined.select(
        "chapter_id", kept.alias("blocks"), F.size(F.coalesce("boilerplate", none)).alias("removed")
    ).select("chapter_id", "blocks", F.array_join(F.transform(texts, lambda b: b["text"]), "\n").alias("plain_text"), "removed")
