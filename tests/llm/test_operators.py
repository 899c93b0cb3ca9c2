"""The text operators on small tables against brute force, round trips and held-out
accuracy; nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns with clashing names."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import block
from foliomill.llm import boilerplate, encoding, language, leakage, lookalike, mixing, quality, reading, repeated_lines, residue
from foliomill.llm.furniture import site_lines

PROSE = {
    "en": "The old miller opened the window and looked at the river. Nobody knew why the boat was gone before the rain. She said that the letter had never been in the house.",
    "fr": "Le vieux meunier ouvrit la fenêtre et regarda la rivière. Personne ne savait pourquoi le bateau avait disparu avant la pluie. Elle dit que la lettre n’était jamais dans la maison.",
    "es": "El viejo molinero abrió la ventana y miró el río. Nadie sabía por qué el barco había desaparecido antes de la lluvia. Ella dijo que la carta nunca estaba en la casa.",
    "de": "Der alte Müller öffnete das Fenster und sah den Fluss. Niemand wusste, warum das Boot vor dem Regen verschwunden war. Sie sagte, dass der Brief nie im Haus gewesen ist.",
    "ar": "فتح الطحان العجوز النافذة ونظر إلى النهر. لم يعرف أحد لماذا اختفى القارب قبل المطر. قالت إن الرسالة لم تكن في البيت أبدا.",
}


def found(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# 1


def test_statistics(make_chapters):
    table = "\n".join(f"Name{k}; {k}; {k * 7}; 12" for k in range(9))
    noise = "\n".join("xq wz rtpl mnbv kjh qwp zxcv lkj" for _ in range(5))
    rows = [PROSE["en"] + "\n" + PROSE["en"], table, noise, None, "", "Chapter 1", PROSE["fr"] + "\nMana: 3", PROSE["ar"].encode().decode("cp1252", "replace").replace("�", "\x81"), "404 not found", PROSE["de"] * 3000, "\n".join(["• Red door / Ann Lee"] * 6 + [PROSE["es"]])]
    df = make_chapters([dict(chapter_id=k, plain_text=t) for k, t in enumerate(rows)], ", i string, kind string")
    got = {r["chapter_id"]: r for r in quality.text_statistics(df).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {0: "prose", 1: "table", 2: "junk", 5: "prose", 6: "prose", 7: "prose", 8: "residue", 9: "prose", 10: "list"}
    assert got[5]["own_lines"] == 0 and got[1]["aligned_share"] == 1 and got[0]["ending_share"] == 1
    assert quality.text_statistics(df.where("false")).count() == 0


def test_autocorrelation():
    assert quality.autocorrelation([5, 9, 5, 9, 5, 9, 5, 9]) > 0.5 and quality.autocorrelation([1, 2]) == 0 and quality.autocorrelation([3] * 5) == 1
    assert quality.indentation_period(["a", "  b", "a", "  b"]) == 1 and quality.indentation_period(["a"] * 4) == 0


def test_rows_that_look_like_prose(make_chapters):
    nouns = ["the old miller of the house", "the river and the boat", "the letter that was in the rain", "a window to the north", "the door of the mill"]
    long = ["; ".join(f"{n} was seen by the {k + j}" for j, n in enumerate(nouns * 2)) for k in range(5)]  # over 160 characters
    phrases = [", ".join(nouns[(k + j) % 5] for j in range(3 + k % 2)) for k in range(6)]
    spaced = [f"{a:<24}{b:<26}{c} was here." for a, b, c in zip(["The miller said", "She was in the boat", "Nobody knew why", "He had the letter"], ["that it was the house", "and the rain was in", "they were at the mill", "but not the window"], ["the one", "nobody we knew", "it", "what she had"])]
    asked = [x for k in range(5) for x in (f"Where was: the miller of the river when it rained {k}?", f"  Answer: he was in the house {k}.")]
    outline = [x for k in range(5) for x in ("the miller and the boat that was on the river at the end of the house by the mill", "    the window of the house to the north")]
    story = [PROSE["en"], PROSE["en"] + " He was, it was said, there.", "“Where,” she asked, “is the boat?” Nobody knew, and the rain was on the river."] * 4
    docs = {"long": long, "phrases": phrases, "spaced": spaced, "asked": asked, "outline": outline, "story": story, "again": [x * 9 for x in story]}
    got = {k: quality.document_statistics(v, [True] * len(v)) for k, v in docs.items()}
    assert {k for k, r in got.items() if r["kind"] == "prose"} == {"story", "again"}
    assert all(quality.running_prose(quality.line_statistics(x)) for x in [*spaced, *asked])


# 2


@pytest.mark.parametrize("lang", list(PROSE))
@pytest.mark.parametrize("codec", ["cp1252", "mac_roman", "cp850", "cp437"])
def test_misread_text_comes_back(lang, codec):
    text = PROSE[lang] + " “Yes,” she said — “no.”"
    table = {b: chr(c) for c, b in encoding.to_byte(codec).items()}
    bad = "".join(table.get(b, chr(b)) for b in text.encode())
    assert encoding.repair(bad) == (True, text, True)
    if codec == "cp1252":
        twice = "".join(table.get(b, chr(b)) for b in bad.encode())
        assert encoding.repair(twice)[1] == text
    part = PROSE["en"] + "\n" + bad
    assert encoding.repair(part)[1] == PROSE["en"] + "\n" + text


def test_legacy_to_legacy():
    arabic = "نص: " + PROSE["ar"]
    for read_as in ("cp1252", "mac_roman"):
        bad = PROSE["ar"].encode("cp1256").decode(read_as)
        assert encoding.repair(bad)[1] == PROSE["ar"]
    assert encoding.repair(PROSE["de"].encode("cp1252").decode("cp1256"))[1] == PROSE["de"]
    french = "La rivière brisée était près du pont. Le vieux meunier s’arrêta."
    assert encoding.repair(french.encode("cp1252").decode("mac_roman"))[0]
    assert not encoding.repair(arabic)[0]


@pytest.mark.parametrize(
    "text",
    [*PROSE.values(), None, "", "ÂNGSTAÐ and the rune Ø, older than Ã.", "CHÂTEAU DE L’ÂME et ÎLE AUX OIES ;", "¤×¤×¤×¤×¤×¤×", "▒░▒░▒░▒░", "غغغ غغغ، «غغغ»", "FÜNFZIG PLÄTZE", "Capítulo 7: ¿Quién?", "قرأ، ثم بدأ» و«أ»", "“…” — “…”", "naïve café", "l·l col·lecció"],
)
def test_letters_meant_are_no_case(text):
    assert encoding.repair(text) == (False, text, True)


def test_lost_characters(spark, make_books, make_chapters):
    books = make_books([dict(title="caf�", description="Ã©tÃ©"), dict(book_id=2, title=None, description="")])
    chapters = make_chapters([dict(plain_text="Â« oui Â»"), dict(chapter_id=2, plain_text=None), dict(chapter_id=3, plain_text="ok " * 100000)], ", id string, t string, restored string")
    got = encoding.damaged_values(books, chapters)
    assert found(got, "src_table", "row_id", "field", "complete") == [("books", 1, "description", True), ("books", 1, "title", False), ("chapters", 1, "plain_text", True)]


# 3


@pytest.fixture(scope="module")
def field():
    rows = [(t + " " + t, lang) for lang, t in PROSE.items() for _ in range(4)]
    rng = random.Random(1)
    names = {"en": "the and of to was with she he not from where before", "fr": "le la et les des dans une pour avec elle ne pas", "es": "el la y los de en una por con ella no antes", "de": "der die das und den mit nicht sie war aus vor ein", "ar": "في من على إلى التي لم قد هذا ذلك بعد عند ثم"}
    rows += [(". ".join(" ".join(rng.choices(names[lang].split(), k=6)) for _ in range(5)) + ".", lang) for lang in names for _ in range(6)]
    model = language.LinearChain(sorted(PROSE))
    model.train(language.training_sequences(rows, model.languages))
    return model


def test_forward_backward_is_exact(field):
    rng = np.random.default_rng(0)
    e = rng.standard_normal((4, 1, 5)).astype(np.float32)
    got = field.word_marginals(e, np.ones((4, 1), bool))[:, 0]
    both, _ = field.marginals(e, np.ones((4, 1), bool))
    want = np.zeros((4, 5))
    for path in np.ndindex(5, 5, 5, 5):
        w = field.start[path[0]] + sum(e[k, 0, s] for k, s in enumerate(path)) + sum(field.trans[a, b] for a, b in zip(path, path[1:]))
        for k, s in enumerate(path):
            want[k, s] += np.exp(w)
    want /= want.sum(1, keepdims=True)
    assert np.allclose(got, want, atol=1e-4) and np.allclose(both[:, 0], want, atol=1e-4)


def test_segments(spark, field, make_chapters):
    two_fr = " ".join(PROSE["fr"].split(". ")[:2]) if False else PROSE["fr"]
    quote = "«" + PROSE["es"].split(".")[0] + "»."
    df = make_chapters(
        [
            dict(chapter_id=1, plain_text=PROSE["en"] + "\n" + two_fr + "\n" + PROSE["en"]),
            dict(chapter_id=2, plain_text=PROSE["en"] + " " + quote + " " + PROSE["en"]),
            dict(chapter_id=3, plain_text=PROSE["ar"] + "\nTranslated for Some Books readers, release 1 of 2.\nSupport the translators of Some Books: every coffee counts."),
            dict(chapter_id=4, plain_text=None), dict(chapter_id=5, plain_text=" "), dict(chapter_id=6, plain_text="404 not found"), dict(chapter_id=7, book_id=None, plain_text=PROSE["de"]),
        ]
    )
    got = {r["chapter_id"]: r for r in language.label_texts(df.withColumn("text", F.col("plain_text")), field).collect()}
    langs = {k: [(s["lang"], s["sentences"]) for s in r["segments"]] for k, r in got.items()}
    assert [x[0] for x in langs[1]] == ["en", "fr", "en"] and all(n >= 2 for _, n in langs[1])
    assert {x for x, n in langs[2] if n >= 2} == {"en"} and {x for x, _ in langs[3]} == {"ar"}
    assert {x for x, _ in langs[7]} == {"de"} and not {4, 5, 6} & set(got)


def test_codes_and_sentences():
    codes = ["EN", "en-US", "fra", "German", " es ", "", None, "xx", "und", "ar_EG", "Français", "nl"]
    assert [language.normal_code(c) for c in codes] == ["en", "en", "fr", "de", "es", None, None, None, None, "ar", "fr", "nl"]
    assert len(language.sentences("“Where is it?” Ann asked. “Here.” Then rain fell.")) == 3
    assert language.sentences("") == []


def test_works_take_right_language(spark, make_books, make_chapters):
    docs = spark.createDataFrame([(k * 10 + j, t, lang) for k, (lang, t) in enumerate(PROSE.items()) for j in range(8)] + [(900, None, "en"), (901, "x", None)], "doc_id bigint, text string, lang string")
    books = make_books([dict(book_id=1, title="T", description=None, language_code="xx"), dict(book_id=2, title="Y", description=PROSE["fr"], language_code="fr-CA"), dict(book_id=3, title="", description="", language_code=None), dict(book_id=4, title="Z", description=PROSE["de"], language_code="en")])
    chapters = make_chapters([dict(book_id=1, plain_text=PROSE["es"] * 2)])
    assert found(language.found(books, chapters, language.fit(docs)), "src_table", "row_id", "lang") == [("books", 1, "es"), ("books", 4, "de")]
    with pytest.raises(ValueError):
        language.fit(docs.where("lang IS NULL"))


# 4


def page_of(rng, k):
    site = rng.choice(["Red Books", "Blue Tales", "Green Novels", "Old Serials"])
    head = [block("p", "Home | Library | Genres | Log in")] if rng.random() < 0.5 else [block("p", x) for x in rng.sample(["Home", "Library", "Forum", "Settings"], 3)]
    body = [block("h", f"Chapter {k} – The Door")] + [block("p", " ".join(rng.sample(rng.choice(list(PROSE.values())).replace(".", "").split(), 14)) + ".") for _ in range(rng.randrange(2, 6))]
    if rng.random() < 0.5:
        body.insert(2, block("p", f"Support the translators of {site}: every coffee helps."))
    tail = [block("p", "Comments")] + [block("p", f"Ann{rng.randrange(99)}: I liked the old {rng.choice(NAMES)}, thank you for the chapter") for _ in range(2)] + [block("p", "Back to top ↑"), block("p", f"© {site}. All chapters remain the property of their authors.")]
    mine = [0] * len(head) + [0 if "Support" in b["text"] else 1 for b in body] + [0] * len(tail)
    return head + body + tail, f"Chapter {k} – The Door", k, site, [1 - x for x in mine]


NAMES = [a + b for a in "Ba Ce Di Fo Gu Ha Ke Li Mo Nu Pa Re Si To Vu".split() for b in "ran lith mund dor wick".split()]


def test_labeller_learns_from_recurrence(make_chapters):
    """No phrase is listed anywhere: the labels come from what recurs across works."""
    rng = random.Random(3)
    docs = [page_of(rng, k) for k in range(200)]
    model = boilerplate.train_labeller([d[:4] for d in docs[:150]])
    got = boilerplate.label_blocks(model, boilerplate.Features(), [d[:2] for d in docs[150:]])
    pairs = [(int(a), b) for g, d in zip(got, docs[150:]) for a, b in zip(g, d[4])]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.95
    again = boilerplate.Labeller.load(model.save())
    assert all((a == b).all() for a, b in zip(got, boilerplate.label_blocks(again, boilerplate.Features(), [d[:2] for d in docs[150:]])))
    rows = [dict(chapter_id=k, book_id=k, host=d[3], blocks=d[0], title=d[1], plain_text="x") for k, d in enumerate(docs[:60])]
    rows += [dict(chapter_id=900, blocks=None), dict(chapter_id=901, blocks=[]), dict(chapter_id=902, blocks=[block("img", None, "s")]), dict(chapter_id=903, blocks=[block("p", None), block("p", "404 not found")], plain_text="404 not found"), dict(chapter_id=904, blocks=[block("p", "word " * 50000)] * 3, title=None)]
    df = make_chapters(rows, ", boilerplate string")
    kept = {r["chapter_id"]: r for r in boilerplate.main_content(df, boilerplate.fit(df)).collect()}
    assert set(kept) == {*range(60), 901, 902, 903, 904} and kept[903]["removed"] == 0 and len(kept[902]["blocks"]) == 1
    assert boilerplate.boilerplate(df.where("false"), boilerplate.fit(df.where("false"))).count() == 0 and boilerplate.fit(df.where("false")) is None


HTML = """<html><head><title>x</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>Forum</a></ul></nav>
<div class="modal">We use small files. <b>OK</b></div><main><h2>Chapter 4</h2><p>%s<p>%s</main><aside><h3>You might like</h3><a href=1>The Red Door</a><a href=2>The Sea</a></aside><footer>About<br>Contact</footer>"""


def test_leaves_and_content_of_pages(spark):
    html = HTML % (PROSE["en"], PROSE["fr"])
    leaves = boilerplate.page_leaves(html)
    assert [x["text"] for x in leaves] == ["Home", "Forum", "We use small files. OK", "Chapter 4", PROSE["en"], PROSE["fr"], "You might like", "The Red Door", "The Sea", "About", "Contact"]
    assert [x["type"] for x in leaves].count("h") == 2 and leaves[2]["path"][-1] == "div.modal" and "nav" in leaves[0]["path"]
    assert boilerplate.outside_content(leaves) == [True] * 3 + [False] * 3 + [True] * 5
    assert boilerplate.page_leaves(None) == boilerplate.page_leaves("") == [] and len(boilerplate.page_leaves("<div>" * 5000 + "x")) == 1
    rng = random.Random(4)
    said = lambda lang: " ".join(rng.sample(PROSE[lang].replace(".", "").split(), 16)) + "."
    sites = [(HTML % (said("en"), said("fr")), f"h{k % 5}") for k in range(80)]
    model = boilerplate.train_labeller([], sites)
    df = spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", "")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in boilerplate.page_content(df, model).collect()}
    assert got[1]["main_text"] == "Chapter 4\n" + PROSE["en"] + "\n" + PROSE["fr"] and got[1]["removed"] == 8 and got[2]["leaves"] == got[3]["leaves"] == 0


def test_digits_anywhere_in_a_block():
    shape = lambda text: boilerplate.block_shape("p", text, 9, 1, 9, False)
    plain = "All chapters remain the property of their authors and of this site, since "
    assert [a != b for a, b in zip(shape(plain + "2024"), shape(plain + "ever"))] == [k == 7 for k in range(14)]


def test_gradients():
    rng = np.random.default_rng(0)
    model = boilerplate.Labeller()
    ids, shapes = [[1, 2], [3], [], [2, 5]], [list(rng.random(boilerplate.SHAPE)) for _ in range(4)]
    x, mask, place = model._pad(model.block_vectors(ids, [[1], [2, 3], [1], []], shapes), [3, 1])
    out, tape = model._run(x, mask, "f", True)
    weight = rng.standard_normal(out.shape).astype(np.float32)
    grad = {}
    model._back(weight, x, tape, "f", grad)
    for name in ("Uf", "Wf", "cf"):
        p = model.p[name]
        at = np.unravel_index(np.abs(grad[name]).argmax(), p.shape)
        old, step = p[at], 1e-2
        p[at] = old + step
        up = float((model._run(x, mask, "f", False)[0] * weight).sum())
        p[at] = old - step
        down = float((model._run(x, mask, "f", False)[0] * weight).sum())
        p[at] = old
        assert abs((up - down) / (2 * step) - grad[name][at]) < 0.02 * max(1, abs(grad[name][at]))


def test_site_lines():
    lines = ["You might like these serials", "The Red Door", "Ann and the Sea", PROSE["en"], "She laid the cookies on the table and asked him to accept all of them.", "Comments", "Bob_12 – thank you"]
    assert site_lines([lines, []], ["t", None]) == [[True, True, True, False, False, True, True], []]


# 5


def brute_lines(rows, hosts):
    norm = lambda s: " ".join(re.sub(r"\d+", "", s.casefold()).split())
    at = defaultdict(set)
    for r in rows:
        for x in (r["plain_text"] or "").split("\n"):
            if sum(c.isalpha() for c in x) >= 10 and r["book_id"] in hosts:
                at[hosts[r["book_id"]], norm(x)].add((r["book_id"], r["idx"]))
    return sorted((r["chapter_id"], n) for r in rows for n, x in enumerate((r["plain_text"] or "").split("\n")) if r.get("book_id") in hosts and len(at.get((hosts[r["book_id"]], norm(x)), ())) >= 6)


def test_repeated_lines(make_chapters, make_books):
    rng = random.Random(5)
    lines = ["Posted by the desk on {}/1", "POSTED  by the Desk on 3/{}", "short {}", "A line of its own number {} here", "Groß und KLEIN geschrieben", "GROSS und klein geschrieben", "unique words {} {}", ""]
    rows = [dict(chapter_id=k, book_id=rng.choice([1, 2, 3, 9, None]), idx=rng.choice([1, 2, 3, 4, None]), plain_text="\n".join(rng.choice(lines).format(k, rng.random()) for _ in range(5))) for k in range(120)]
    rows += [dict(chapter_id=500, plain_text=None), dict(chapter_id=501, plain_text="")]
    books = make_books([dict(book_id=1, host="a"), dict(book_id=2, host="a"), dict(book_id=3, host="b"), dict(book_id=4, host=None)])
    df = make_chapters(rows, ", k1 string, line_no int")
    assert found(repeated_lines.repeated_lines(df, books), "chapter_id", "line_no") == brute_lines(rows, {1: "a", 2: "a", 3: "b"})
    gone = set(brute_lines(rows, {1: "a", 2: "a", 3: "b"}))
    got = {r["chapter_id"]: r for r in repeated_lines.without_repeated_lines(df, books).collect()}
    for r in rows:
        t = r["plain_text"]
        assert got[r["chapter_id"]]["plain_text"] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (r["chapter_id"], n) not in gone))
    assert repeated_lines.repeated_lines(df.where("false"), books).count() == 0


# 6


def test_look_alikes(make_chapters):
    texts = {
        1: "ｆｕｌｌ width", 2: "café near", 3: "zero​width", 4: "thе door", 5: "Мирослава and Ωμέγα came", 6: "no break", 7: "plain “quotes” — and… dots", 8: None, 9: "", 10: "оса и рыба", 11: "لکن الحذر", 12: "ﻻ شيء", 13: "𝐛𝐨𝐥𝐝", 14: "eﬃcient", 15: "گفت کتاب", 16: "é ê ß ç", 17: "a‑b", 18: "x " * 200000 + "ｙ",
    }
    df = make_chapters([dict(chapter_id=k, title="t", plain_text=t) for k, t in texts.items()] + [dict(chapter_id=50 + k, plain_text=t) for k, t in enumerate([*PROSE.values(), "efficient staff - fine, لا شيء في كتاب كل يوم هل"] * 3)] + [dict(chapter_id=30, title="Chap­ter", plain_text="Ã©tÃ© no break")], ", field string, member string")
    got = {(r["chapter_id"], r["field"]): r["text"] for r in lookalike.one_form(df).collect()}
    assert {k for k, f in got if f == "plain_text"} == {1, 2, 3, 4, 6, 11, 12, 13, 14, 17, 18}
    assert got[1, "plain_text"] == "full width" and got[2, "plain_text"] == "café near" and got[4, "plain_text"] == "the door" and got[14, "plain_text"] == "efficient"
    assert got[30, "title"] == "Chapter" and got[11, "plain_text"] == "لكن الحذر"
    assert lookalike.one_form(df.where("false")).count() == 0


def test_shared_letters_take_the_script_of_their_word():
    """Whichever letter is the commonest: Latin words stay Latin, Cyrillic ones Cyrillic."""
    for counts in ({"а": 50, "a": 3, "о": 60, "с": 9, "е": 70}, {"a": 50, "o": 60, "e": 70}):
        once = lookalike.Rewriter(lookalike.representatives(counts))
        same = ("a cat on a mat", "Мама мыла раму", "оса и рыба", "оса", "Anna met Мирослава and сорока at sea", "ace", "")
        for t in same:
            assert lookalike.rewrite(t, once)[0] == t
        assert lookalike.rewrite("a cаt on a mаt", once) == ("a cat on a mat", 2)
        assert lookalike.rewrite("Мaма мыла рaму", once) == ("Мама мыла раму", 2)
        assert lookalike.rewrite("the сор came", once) == ("the cop came", 3)
        assert lookalike.rewrite("ｃａｔ and mat", once) == ("cat and mat", 3)


def test_rewriting_is_linear_in_the_text():
    import time

    once = lookalike.Rewriter(lookalike.representatives({"a": 5}))
    took = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        new, places = lookalike.rewrite("сор the door " * n, once)
        took.append(time.perf_counter() - start)
        assert places == 3 * n and new == "cop the door " * n
    assert took[1] < 12 * took[0]


def test_classes_are_transitive_and_stable():
    sets = lookalike.UnionFind()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "x")):
        sets.union(a, b)
    assert sets.classes() == [["a", "b", "c", "d"]]
    mapping = lookalike.representatives({"e": 5, "é": 9})
    once = lookalike.Rewriter(mapping)
    for t in ("thе ｆｕｌｌ é ﬁn x", "Мирослава", "لکن"):
        new, _ = lookalike.rewrite(t, once)
        assert lookalike.rewrite(new, once) == (new, 0)
    assert lookalike.representatives({"ο": 50, "o": 3})["o"] == "ο"


# 7


def test_residue(make_chapters):
    yes = ["{{ chapter.body }}", "Chapter 3\n__CHAPTER_TEXT__", "lorem ipsum dolor sit", "502 Bad Gateway\nproxy", "Please turn on JavaScript in your browser to read this chapter.", "undefined", "Dear {name}, your chapter #{number} is ready.", "Title\nKapitel 2\nZugriff verweigert. Ihre Anfrage wurde blockiert."]
    no = [PROSE["en"] + "\n" + "“Access denied,” said the voice of stone to Ann near the river; the old captain studied the key." * 6, None, "", " \n ", "Chapter 5", "Title", "Mana: 3\nLuck: 4"]
    df = make_chapters([dict(chapter_id=k, title="Title", plain_text=t, host=None if k % 2 else "h") for k, t in enumerate(yes + no)], ", k string, kind string")
    assert found(residue.residue(df), "chapter_id") == [(k,) for k in range(len(yes))]
    assert residue.residue(df.where("false")).count() == 0
    wide = make_chapters([dict(chapter_id=k, host=f"h{k % 4}", title="T", plain_text=f"We will be back on {k}.{k}.2024, promised by the whole team of this place\n503 service unavailable") for k in range(8)])
    got = residue.residue(wide).collect()
    assert len(got) == 8 and {r["sources"] for r in got} == {4} and {r["rows"] for r in got} == {8}


def test_recurring_message_without_phrase(make_chapters):
    said = "The reading room is closed to guests until the {} of this month.\nOnly members of the house may pass the gate."
    mirrored = PROSE["en"] + "\n" + PROSE["en"][:60]
    rows = [dict(host=f"h{k % 4}", idx=k, plain_text=said.format(k)) for k in range(8)]
    rows += [dict(host=f"h{k}", idx=7, plain_text=mirrored) for k in range(8)]  # one chapter on eight sites
    rows += [dict(host="h", idx=k, plain_text=said.format("first") + "!") for k in range(8)]  # one site only
    rows += [dict(host=f"h{k}", idx=k, plain_text=f"Mana: {k}\nLuck: {k}") for k in range(8)]  # no words
    df = make_chapters([dict(chapter_id=k, title="T") | r for k, r in enumerate(rows)])
    got = residue.residue(df).collect()
    assert {r["chapter_id"] for r in got} == set(range(8)) and {r["kind"] for r in got} == {"message"}


def test_residue_of_any_length(make_chapters):
    errors = "\n".join(f"Error 503 service unavailable, node {k}" for k in range(60))  # 2,000 characters
    fields = "\n".join(f"{{{{ chapter.body_{k} }}}}" for k in range(40))
    notice = "Please turn on JavaScript in your browser to read the chapters of this library " + "and of all the other houses " * 8 + "by the river."
    rows = [errors, fields, notice, notice + " " + PROSE["en"] * 3]
    df = make_chapters([dict(chapter_id=k, title="T", plain_text=t) for k, t in enumerate(rows)])
    assert len(errors) > 2000 and len(notice) > 250 and found(residue.residue(df), "chapter_id") == [(0,), (1,), (2,)]


def test_contents_lists_and_own_headings(make_chapters):
    contents = "\n".join(f"Chapter {k} {'.....' if k % 2 else '->'} Strange Ledger" for k in range(1, 9))
    things = "\n".join(", ".join(f"{a} {b}" for a in ("heavy", "old")[: 1 + k % 2] for b in ("ledger", "lantern", "map")) for k in range(6))
    wide = "\n".join("; ".join(f"a long entry of the table in row {k} and column {j} of it" for j in range(7)) for k in range(5))  # over 300 characters
    story = "\n".join([PROSE["en"]] * 5)
    rows = [("", contents), ("Chapter 2", "Chapter 2\n" + PROSE["en"].split(".")[0] + ".\n" + contents), ("", things), ("", wide), ("", "Chapter 9: At the mill\n" + story), ("T", story), ("Chapter 9", "Chapter 9")]
    df = make_chapters([dict(chapter_id=k, title=h, plain_text=t) for k, (h, t) in enumerate(rows)])
    got = {r["chapter_id"]: r for r in quality.text_statistics(df).collect()}
    assert {k for k, r in got.items() if r["kind"] == "prose"} == {4, 5, 6}
    assert got[4]["own_lines"] == 5 and got[6]["own_lines"] == 0 and got[0]["own_lines"] == 8


def test_long_site_notice():
    notice = "If you find errors on this page, please write to the editors of the library, who read every letter with care, " + "and to the translators of all the other houses, " * 4 + "so that they can mend them."
    story = PROSE["en"] + " “Rate this chapter,” said the old captain, and nobody knew why he had uses cookies in mind. " + PROSE["en"]
    assert len(notice) > 250 and site_lines([[notice, story, PROSE["en"]]], [None]) == [[True, False, False]]


def test_long_residue(make_chapters):
    trace = "Traceback (most recent call last):\n" + "\n".join(f'  File "/srv/app/part{k}.py", line {k}, in load\n    return the_reader.read(chapter, page, {k})' for k in range(40)) + "\nKeyError: 'body'"
    fields = "\n".join(f"The part named {{{{ field_{k} }}}} of the book {{{{ book.name }}}} belongs here" for k in range(30))
    line = " ".join(f"Dear {{name}}, part {k} of {{book}} is ready." for k in range(12))
    story = (PROSE["en"] + " “Access denied,” said the voice. ") * 4 + "\n" + PROSE["en"]
    page = "503 service unavailable\n" + PROSE["en"] + "\n" + PROSE["en"] + "\n" + PROSE["en"] + " It is over on {k}.{k}.2024."
    rows = [dict(plain_text=t, host="h") for t in (trace, fields, line, story)] + [dict(plain_text=page.replace("{k}", str(k)), host=f"h{k % 4}") for k in range(1, 9)]
    rows += [dict(plain_text=story, host=f"g{k}") for k in range(6)]  # widely told, one mention
    got = {r["chapter_id"]: r["kind"] for r in residue.residue(make_chapters([dict(chapter_id=k, title="T") | r for k, r in enumerate(rows)])).collect()}
    assert got == {0: "error", 1: "template", 2: "template"} | {k: "error" for k in range(4, 12)}
    assert [residue.is_residue(t, None) for t in (trace, fields, line, story, page)] == [True, True, True, False, False]
    assert residue.hints([trace, fields, line, story, page, "...", PROSE["en"]]) == [True] * 6 + [False]


# 8


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(30)] + ["Été", "STRASSE", "ß"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([5, 12, 30])))) for k in range(40)] + [(90, None), (91, ""), (92, "w1 " * 30)]
    items.append((93, items[1][1]))
    docs = []
    for k in range(150):
        words = rng.choices(vocabulary, k=40)
        src = (items[rng.randrange(40)][1] or "").split()
        cut = rng.choice([0, 8, 9, 10, 11, 14])
        words[10:10] = [w.upper() if rng.random() < 0.3 else w + rng.choice(["", ",", ".\n", "!"]) for w in src[:cut]]
        docs.append((k, " ".join(words)))
    docs += [(900, None), (901, ""), (902, "w1 " * 20000), (903, docs[0][1])]
    grams = lambda t: {tuple(w[k : k + 10]) for w in [leakage.words(t)] for k in range(len(w) - 9)}
    per = {i: grams(t) for i, t in items}
    want = sorted((d, i) for d, t in docs for g in [grams(t)] for i in per if g & per[i])
    a = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("x"))
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    assert want and found(leakage.leaks(a, b), "doc_id", "item_id") == want
    assert leakage.leaks(a.where("false"), b).count() == 0 and leakage.leaks(a, b.where("false")).count() == 0


def test_leaks_in_passes(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"a{k}b{j}" for j in range(12))) for k in range(9)], "item_id bigint, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), "text")
    monkeypatch.setattr(leakage, "ITEMS_PER_PASS", 3)
    assert found(leakage.leaks(docs, items), "doc_id", "item_id") == [(k, k) for k in range(9)]


def test_wand_equals_full_scores():
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choices("abcdefgh", k=25))) for k in range(200)]
    index = leakage.Index(rows)
    for k in range(20):
        ids = np.array([index.vocabulary[w] for w in rows[k][1].split()])
        terms = [t for t in dict.fromkeys(leakage.shingle_hashes(ids).tolist()) if t in index.terms]
        full = defaultdict(float)
        for t in terms:
            for i, w in zip(index.terms[t].items, index.terms[t].impacts):
                full[i] += w
        want = {i for i, s in full.items() if s >= index.threshold[i]}
        assert {i for i, _ in index.search(terms)} == want and k in want


# 9


def test_mixture(spark):
    rng = random.Random(4)
    docs = [(k, rng.choice(["a", "a", "a", "b", "c", None, "z"]), "word " * rng.randrange(1, 40)) for k in range(1500)] + [(9000, "a", None), (9001, "a", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("tokens", F.lit(1))
    targets = spark.createDataFrame([("a", 0.2, 2), ("b", 0.5, 3), ("c", 0.2, 5), ("gone", 0.1, 4)], "source string, target_share double, max_repeats int")
    mix = mixing.mixture(df, targets).collect()
    assert len({r["doc_id"] for r in mix}) == len(mix) and {r["source"] for r in mix} == {"a", "b", "c"}
    limits = {"a": 2, "b": 3, "c": 5}
    assert all(1 <= r["copies"] <= limits[r["source"]] for r in mix)
    share = {r["source"]: r["share"] for r in mixing.mix_report(mixing.mixture(df, targets), targets).collect()}
    assert all(abs(share[s] - w / 0.9) < 0.02 for s, w in (("a", 0.2), ("b", 0.5), ("c", 0.2))) and share["gone"] == 0
    assert sorted(mix) == sorted(mixing.mixture(df.repartition(7), targets).collect())
    assert mixing.mixture(df.where("false"), targets).count() == 0 and mixing.mixture(df, targets.where("false")).count() == 0


def test_budgets():
    total, parts = mixing.budgets([("a", 100), ("b", 10)], [("a", 0.5, 1), ("b", 0.5, 4), ("c", 0.5, 1), (None, 0.1, 1)])
    assert (total, parts) == (80, {"a": 40, "b": 40}) and mixing.budgets([], [("a", 1.0, 1)]) == (0.0, {})


# 10


def test_isotonic_is_best_monotone_fit():
    x, y = np.array([3.0, 1, 2, 5, 4, 2]), np.array([1.0, 0, 1, 1, 0, 0])
    knots, values = reading.isotonic(x, y)
    assert list(values) == sorted(values) and np.isclose(np.interp(4, knots, values), 0.5) and np.isclose(np.interp(2, knots, values), 0.5)


def test_levels(spark):
    rng = random.Random(6)
    words = {1: "cat dog sun run sit big red hat", 2: "river window quickly because morning garden answered", 3: "although remembered lantern nevertheless whispered uncertain journey", 4: "epistemological notwithstanding jurisprudence asymmetrical presupposed phenomenological"}
    text = lambda lv: ". ".join(" ".join(rng.choices(words[lv].split() + ["the", "a", "and"], k=3 + 3 * lv)) for _ in range(12)) + "."
    level = {k: 1 + k % 4 for k in range(240)}
    docs = spark.createDataFrame([(k, text(lv)) for k, lv in level.items()] + [(900, None), (901, ""), (902, "zz qq")], "doc_id bigint, text string").withColumn("level", F.lit("x"))
    graded = [(k, float(lv), "g1") for k, lv in level.items() if k < 160] + [(1, None, "g2"), (2, 3.0, "g2"), (900, 2.0, "g1"), (777, 4.0, "g1")]
    labels = spark.createDataFrame(graded, "doc_id bigint, reading_level double, grader string")
    got = {r["doc_id"]: r["level"] for r in reading.reading_levels(docs, reading.fit(docs, labels)).collect()}
    held = [k for k in level if k >= 160]
    assert len(got) == 243 and sum(got[k] == level[k] for k in held) / len(held) > 0.9 and got[900] == got[901] == 1
    assert reading.reading_levels(docs, reading.fit(docs, labels.where("false"))).count() == 0 and reading.reading_levels(docs.where("false"), reading.fit(docs, labels)).count() == 0


def test_every_graded_document_trains_the_model(spark):
    rng = random.Random(8)
    text = lambda k: " ".join(rng.choices(["river", "window", "notwithstanding", "cat", "although", "garden", "the", "a"][k % 4 : k % 4 + 4], k=9)) + ". rare" + "".join("abcdefghij"[int(c)] for c in str(k // 2))
    texts = [text(k) for k in range(2_399)] + ["cat"]  # some are equal, so scores tie
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    grades = [(k, float(1 + k % 4)) for k in range(len(texts))] + [(5, 3.0), (9_999, 4.0)]
    labels = spark.createDataFrame(grades, "doc_id bigint, reading_level double")
    model = reading.fit(docs.repartition(5), labels.repartition(3))
    brute = reading.ReadingModel([(t, 2.5 if k == 5 else float(1 + k % 4)) for k, t in enumerate(texts)])
    assert sum(model.totals) == sum(len(reading.tokens(t)) for t in texts[:-1]) and model.totals == brute.totals
    assert model.vocabulary == brute.vocabulary and "rareh" in model.vocabulary
    assert all(np.array_equal(getattr(a, part), getattr(b, part)) for a, b in zip(model.models, brute.models) for part in ("uni", "bi", "tri"))
    assert len(model.knots) == 3 and all(np.allclose(a, b) for m, n in zip(model.knots, brute.knots) for a, b in zip(m, n))


def test_documents_are_scored_without_themselves():
    docs = [PROSE["en"], PROSE["en"] + " " + PROSE["fr"], "the old miller", PROSE["de"], "", PROSE["en"]]
    levels = [0, 1, 0, 2, 3, 0]
    model = reading.ReadingModel([(d, k + 1.0) for d, k in zip(docs, levels)])
    ids = [model.encode(reading.tokens(d)) for d in docs]
    got = model.batch_scores(ids, levels)
    for k, (a, level) in enumerate(zip(ids, levels)):
        rest = reading.ReadingModel([])
        rest.start(model.vocabulary, 0)
        for j, b in enumerate(ids):
            if j != k and len(b) > 2:
                rest.models[levels[j]].add(b)
        rest.totals = [float(m.uni.sum()) for m in rest.models]
        assert np.allclose(got[k], rest.scores(a), atol=1e-5)  # 32-bit numbers


def test_stretches_pool_to_the_same_fit():
    rng = random.Random(3)
    points = [(float(x), float(x), rng.randint(0, n), n) for x, n in ((x, rng.randint(1, 4)) for x in range(90))]
    whole, joined = reading.Pooled(), reading.Pooled()
    for p in points:
        whole.add(*p)
    for a in range(0, 90, 13):
        part = reading.Pooled()
        for p in points[a : a + 13]:
            part.add(*p)
        for b in part.blocks:
            joined.add(*b)
    assert whole.blocks == joined.blocks
    # equal scores are one point, whatever their order
    for y in ([0, 0, 1], [0, 1, 0]):
        knots, values = reading.isotonic(np.array([1.0, 2, 2]), np.array(y, float))
        assert np.interp(1, knots, values) == 0 and np.interp(2, knots, values) == 0.5


def test_counts_that_collide_are_bounded():
    model = reading.NGrams(50, slots=64)
    ids = np.array([random.Random(k).randrange(50) for k in range(3_000)])
    model.add(ids)
    new = np.array([1, 2, 49])
    model.uni[2] = 0  # a word never seen has no pair or triple, whatever shares their slots
    h2, h3 = reading._hash(64, new[:-1], new[1:]), reading._hash(64, new[:-2], new[1:-1], new[2:])
    p1 = (model.uni[49] + 0.1) / (3_000 + 5)
    assert np.isclose(model.surprisal(new, h2, h3, 3_000.0)[0], -np.log(reading.LAMBDA[2] * p1 + reading.LAMBDA[3] / 50))


def test_models_can_be_saved(spark, field, tmp_path):
    from foliomill.llm.common import load_model, save_model

    model = reading.ReadingModel([(t, float(k)) for k in (1, 2, 3, 4) for t in PROSE.values()])
    for name, m in (("field", field), ("levels", model)):
        save_model(spark, m, str(tmp_path / name))
    field2, model2 = load_model(spark, language.LinearChain, str(tmp_path / "field")), load_model(spark, reading.ReadingModel, str(tmp_path / "levels"))
    words = PROSE["fr"].split()
    assert np.array_equal(language.Labeller(field).label([words])[0], language.Labeller(field2).label([words])[0])
    ids = model.encode(reading.tokens(PROSE["en"]))
    assert np.array_equal(model.scores(ids), model2.scores(model2.encode(reading.tokens(PROSE["en"])))) and model2.level(model.scores(ids)) == model.level(model.scores(ids))


def test_batches_score_as_single_documents():
    docs = ["the cat sat on the mat and the dog ran off.", "a very short one", "", "the the the", "notwithstanding the asymmetrical cat and the dog"]
    model = reading.ReadingModel([(d, float(1 + k % 4)) for k, d in enumerate(docs * 3)])
    ids = [model.encode(reading.tokens(d)) for d in docs]
    assert np.allclose(model.batch_scores(ids), np.stack([model.scores(a) for a in ids]))
