"""Parsing of pages, expected values by hand from the rules."""

from foliomill.functions import page
from foliomill.functions.htmltree import parse
from foliomill.functions.loose import embedded_object, loose_json, parse_dump

LONG = "Once upon a time there was a sentence that had to be long enough to count as the text of a whole chapter, so it went on and on. " * 2


def test_implied_ends_and_entities():
    doc = parse("<ul><li>a<li>b</ul><p>one<p>two &amp; three<div>x</div>")
    assert [n.text() for n in doc.find(page.tag("li"))] == ["a", "b"]
    assert [n.text() for n in doc.find(page.tag("p"))] == ["one", "two & three"]


def test_empty_pages():
    assert page.chapter("https://a.example/x", None)["blocks"] == []
    assert page.chapter("https://a.example/x", "")["blocks"] == []
    meta = page.book_meta("https://a.example/x", None)
    assert meta["title"] == "بدون عنوان" and [c["url"] for c in meta["chapters"]] == ["https://a.example/x"]


def test_content_and_junk():
    html = f"<html><body><nav>Menu</nav><article><h1>Title</h1><p>Title</p><p>{LONG}</p><p>12</p><p>Next</p><p class='share-box'>Share</p><p>{LONG}</p><img src='/a.png'><img src='/logo.png'></article></body></html>"
    got = page.chapter("https://a.example/b/chapter-1", html)
    assert got["title"] == "Title"
    assert [(b["type"], (b["text"] or b["src"])[:9]) for b in got["blocks"]] == [("h", "Title"), ("p", "Once upon"), ("img", "https://a")]


def test_first_rich_group_wins_else_fullest():
    assert page.chapter("https://a.example/x", f"<article>short</article><div class='chapter-content'><p>{LONG}</p></div>")["blocks"][0]["text"].startswith("Once")
    assert page.chapter("https://a.example/x", "<article>short</article><div id='content'>a bit longer</div>")["blocks"][0]["text"] == "a bit longer"
    assert page.chapter("https://a.example/x", "<body><div>only body</div></body>")["blocks"][0]["text"] == "only body"


def test_element_with_image_is_opened():
    html = "<article><div>before<p>x</p><img data-src='/i.png' alt=' An  image '>after</div><div><p>a</p><p>b</p></div></article>"
    blocks = page.element_blocks(parse(html).first(page.tag("article")), "https://a.example/")
    assert [(b["type"], b["text"] or b["src"]) for b in blocks] == [("p", "before"), ("p", "x"), ("img", "https://a.example/i.png"), ("p", "after"), ("p", "ab")]
    assert blocks[2]["alt"] == "An image"


def test_generic_links():
    links = "".join(f"<a href='/book/chapter-{k}'>Chapter {k}</a>" for k in (10, 2, 1))
    html = f"<h1>Work</h1>{links}<a href='https://other.example/chapter-3'>Chapter 3</a><a href='/login'>Chapter login</a><a href='/book/chapter-4'>Next chapter</a><a href='#x'>Chapter 9</a>"
    meta = page.book_meta("https://a.example/book", html)
    assert [(c["idx"], c["title"]) for c in meta["chapters"]] == [(1, "Chapter 1"), (2, "Chapter 2"), (3, "Chapter 10")]


def test_portal_links_keep_place_and_take_title():
    html = "<a href='read.php?post_id=9'>Start reading</a><a href='read.php?post_id=3'><small>Chapter 3</small><strong>C</strong></a><a href='read.php?post_id=9'><small>Chapter 1</small></a>"
    meta = page.book_meta("https://x.novlar.example/details.php?id=1", html)
    assert meta["adapter"] == "portal" and meta["language_code"] == "ar"
    assert [c["title"] for c in meta["chapters"]] == ["Chapter 1", "Chapter 3 — C"]


def test_modern_links_of_own_work():
    html = "<a href='/novels/7/chapters/2'><h4>Two</h4></a><a href='/novels/7/chapters/1'>One</a><a href='/novels/8/chapters/1'>Other</a><div id='tab-summary'>اللغة: x\n" + LONG + "</div>"
    meta = page.book_meta("https://novelsite.example/novels/7", html)
    assert [c["title"] for c in meta["chapters"]] == ["One", "Two"] and meta["description"].startswith("Once")


def test_linked_data_cover_and_description():
    html = """<script type="application/ld+json">{"@graph":[{"image":{"url":"/c.png"},"description":"%s"}]}</script><script type="application/ld+json">{bad</script>""" % LONG
    doc = parse(html)
    assert page.find_cover(doc, "https://a.example/") == "https://a.example/c.png"
    assert page.find_description(doc).startswith("Once")
    doc = parse("<img src='/s.png' width=10 height=10><img src='/k.png' class=cover><img src='/l.png' alt=book>")
    assert page.find_cover(doc, "https://a.example/") == "https://a.example/k.png"
    assert page.pick_string([{"name": "n"}]) == "n" and page.pick_string(None) == ""


def test_embedded_and_dumps():
    html = 'x {"a":{"title":"S","user":{"name":"U"},"language":{"name":"Français"},"parts":[{"id":1,"title":"P1","url":"/1"}],"note":"}"}}'
    assert embedded_object(html)["title"] == "S"
    assert embedded_object("nothing") is None and embedded_object(None) is None
    meta = page.book_meta("https://www.wattpad.com/story/1", html)
    assert (meta["title"], meta["author"], meta["language_code"]) == ("S", "U", "fr") and meta["chapters"][0]["url"] == "https://www.wattpad.com/1"
    assert page.chapter("https://www.wattpad.com/1", "ERROR: no")["blocks"] == []
    assert [b["text"] for b in page.chapter("https://www.wattpad.com/1", "<p>a</p><p>b</p>")["blocks"]] == ["a", "b"]
    assert parse_dump("array ( 'a' => array ( 0 => 'x', 1 => 'it\\'s' ), 'b' => true, 'c' => NULL, 'd' => 1.5 )") == {"a": ["x", "it's"], "b": True, "c": None, "d": 1.5}
    assert parse_dump("array ( 1 => 'b', 0 => 'a'") == ["a", "b"]
    assert loose_json('{"a": 1}') == {"a": 1} and loose_json("<html>") is None and loose_json(None) is None


def test_short_answers_are_read_from_the_rendered_page():
    url = "https://www.wattpad.com/123456789-part"
    said = "<p>" + "The miller opened the door and went out. " * 3 + "</p>"
    whole = f"<html><body><h1>Part One</h1><article>{said}</article></body></html>"
    assert page.chapter(url, said, "T")["title"] == "T" and len(page.chapter(url, said, "T", whole)["blocks"]) == 1
    got = page.chapter(url, "<p>short</p>", "T", whole)
    assert got["title"] == "Part One" and "miller" in got["blocks"][0]["text"]
    assert page.chapter(url, "<p>short</p>", "T")["blocks"][0]["text"] == "short"
    assert page.chapter(url, "{error: no}", "T")["blocks"] == [] and page.chapter(url, None, "T")["blocks"] == []
