"""Parsing of one fetched page: metadata, links, content blocks.

Pure functions of (url, html). Each page is parsed once; ``operators.pages`` runs
them over DataFrames.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

from foliomill.functions.htmltree import Node, either, has, ident, inside, normalize, parse, tag
from foliomill.functions.loose import embedded_object

Test = Callable[[Node], bool]

#: Elements and class names that are never content.
JUNK_TAGS = frozenset("script style noscript iframe form button nav aside header footer svg video audio ins canvas select input textarea".split())
JUNK_NAMES = re.compile(
    "advert|google-ad|google_ads|sponsor|promo|banner-ad|share|social|comment|disqus|rating|breadcrumb|pagination|newsletter|notification|cookie|popup"
    "|modal|toolbar|menu|sidebar|related|recommend|login|register|favicon|avatar|logo|chapter-header|chapter-nav|chapter-footer|chapter-meta|navigation|pager|controls",
    re.I,
)
AD_CLASS = re.compile(r"(?:^|\s)(?:ad|ads|advertisement)(?:\s|$)", re.I)
JUNK_IMAGE = re.compile("sprite|icon|avatar|emoji|logo|badge|pixel|1x1|spacer|placeholder")
#: Words of navigation, calls, a site's own pages, parts, facts and covers.
NOISE_LINE = re.compile(r"(?:الفصل|الجزء|chapter|chapitre|part|episode)\s*(?:السابق|التالي|previous|next|précédent|suivant)?\s*", re.I)
NOISE_EXACT = re.compile(
    "السابق|التالي|الفصل السابق|الفصل التالي|مشاركة|الإبلاغ|إبلاغ|تعليقات|رد|إعجاب|views?|likes?|comments?|share|report|next|previous|prev|next chapter|previous chapter|chapter list|فهرس الفصول|قائمة الفصول|<|>",
    re.I,
)
CALL = re.compile("ابدأ القراءة|أبدأ القراءة|اقرأ الآن|اقرأي|متابعة القراءة|الصفحة التالية|السابق|التالي|start reading|read now|continue reading|next chapter|previous chapter|login|sign in|register|share|comments?", re.I)
BLACKLIST = re.compile("login|signin|register|signup|privacy|terms|contact|about|dmca|policy|tag|genre|category|search|دخول|تسجيل|سياسة|اتصل|حول|تصنيف", re.I)
CHAPTER_LIKE = re.compile(r"chapter|chapitre|capitulo|capítulo|part|partie|episode|ep\b|read|فصل|جزء|قراءة", re.I)
SUMMARY_LABEL = re.compile("كتبت بتاريخ|عدد الفصول|حالة الرواية|اللغة|آخر تحديث|المشاهدات|التقييم|الناشر|سنة النشر")
COVER_WORD = re.compile("cover|book|novel|poster|thumb|story")
#: Letters and images from which a group of elements is a chapter.
RICH_LETTERS, RICH_IMAGES, IMAGE_SCORE = 120, 2, 200
MOST_LINKS = 500
_EDGE = re.compile(r"^[\s\-–—:_.]+|[\s\-–—:_.]+$")
_HEADING = re.compile("h[1-6]")
_SPACES = re.compile(r"\s+")


def sanitize(text: str) -> str:
    return _EDGE.sub("", normalize(text))


def strip_suffixes(title: str, suffixes: tuple[str, ...]) -> str:
    for s in suffixes:
        title = re.sub(rf"\s*[-–|—:]\s*{re.escape(s)}\s*$", "", title, flags=re.I)
    return normalize(title)


def absolute(href: str, base: str) -> str:
    """Absolute form of a link; empty for blank, data, script and fragment links."""
    value = (href or "").strip()
    if not value or value.lower().startswith(("data:", "javascript:", "#")):
        return ""
    try:
        return urljoin(base, value)
    except ValueError:
        return ""


def origin(url: str) -> str:
    p = urlsplit(url)
    return f"{p.scheme}://{p.netloc}" if p.netloc else ""


def is_junk(n: Node) -> bool:
    """Whether an element and all in it are never content."""
    if n.tag in JUNK_TAGS:
        return True
    names = f"{n.get('class')} {n.get('id')}".strip()
    if names and (JUNK_NAMES.search(names) or AD_CLASS.search(n.get("class"))):
        return True
    if "display:none" in n.get("style").lower().replace(" ", ""):
        return True
    if n.tag == "a":
        href = n.get("href").lower()
        return n.get("rel").lower() in ("prev", "next") or "prev" in href or "next" in href
    if n.tag == "img":
        src = (n.get("src") or n.get("data-src")).lower()
        return not src or bool(JUNK_IMAGE.search(src))
    return False


def element_blocks(root: Node, base: str) -> list[dict]:
    """Ordered blocks of an element: its direct children, and those of children that
    hold an image; each image once."""
    out: list[dict] = []
    images: set[str] = set()
    stack: list[Node | str] = list(reversed(root.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            if text := normalize(c):
                out.append({"type": "p", "text": text, "src": None, "alt": None})
        elif c.tag in ("img", "source"):
            raw = next((c.get(a) for a in ("src", "data-src", "data-original", "data-lazy-src") if c.get(a)), "")
            url = absolute(raw, base)
            if url.startswith(("http:", "https:")) and url not in images:
                images.add(url)
                out.append({"type": "img", "text": None, "src": url, "alt": normalize(c.get("alt"))})
        elif c.first(tag("img", "source")):
            stack.extend(reversed(c.children))
        elif text := c.text():
            out.append({"type": "h" if _HEADING.fullmatch(c.tag) else "p", "text": text, "src": None, "alt": None})
    return out


def is_noise(block: dict, title: str) -> bool:
    text = (block["text"] or "").strip()
    if block["type"] != "p" or not text:
        return False
    if re.fullmatch(r"\d{1,5}", text) or NOISE_EXACT.fullmatch(text) or NOISE_LINE.fullmatch(text):
        return True
    flat = lambda x: _SPACES.sub(" ", x).strip()
    return bool(title) and flat(text) == flat(title) or bool(re.fullmatch(r"(?:الفصل|chapter)\s+\d+\s*", text, re.I))


def clean(blocks: list[dict], title: str) -> list[dict]:
    """Without noise and blanks, each text once."""
    out, seen = [], set()
    for b in blocks:
        if is_noise(b, title):
            continue
        if b["type"] != "img":
            key = (b["text"] or "").strip()
            if not key or key in seen:
                continue
            seen.add(key)
        out.append(b)
    return out


def plain(blocks: list[dict]) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(b["text"] or "" for b in blocks if b["type"] != "img")).strip()


def extract(doc: Node, base: str, selectors: tuple[Test, ...], title: str) -> list[dict]:
    """Blocks of the first group of elements that holds a chapter, else of the fullest
    group, else of the body."""
    best: tuple[int, list[dict]] = (-1, [])
    for test in selectors:
        nodes = doc.find(test)
        blocks = clean([b for n in nodes for b in element_blocks(n.without(is_junk), base)], title)
        letters = len(_SPACES.sub("", plain(blocks)))
        images = sum(b["type"] == "img" for b in blocks)
        if letters >= RICH_LETTERS or images >= RICH_IMAGES:
            return blocks
        score = letters + IMAGE_SCORE * images
        if score > max(best[0], 0):
            best = (score, blocks)
    if best[1]:
        return best[1]
    body = doc.first(tag("body"))
    return clean(element_blocks(body.without(is_junk), base), title) if body else []


def meta(doc: Node, *names: str) -> str:
    """First non-blank content of meta tags, by property and then by name."""
    tags = doc.find(tag("meta"))
    for name in names:
        for attr in ("property", "name"):
            for m in tags:
                if m.get(attr) == name and m.get("content").strip():
                    return normalize(m.get("content"))
    return ""


def json_ld(doc: Node) -> list[dict]:
    """Objects of all linked-data scripts, lists and graphs opened; bad scripts are skipped."""
    out: list[dict] = []
    for script in doc.find(lambda n: n.tag == "script" and "ld+json" in n.get("type")):
        try:
            stack = [json.loads(script.raw_text())]
        except ValueError:
            continue
        while stack:
            x = stack.pop(0)
            if isinstance(x, list):
                stack = x + stack
            elif isinstance(x, dict):
                out.append(x)
                if isinstance(x.get("@graph"), list):
                    stack = x["@graph"] + stack
    return out


def pick_string(value: object) -> str:
    """A string from linked data: itself, its url or name, or that of its first entry."""
    if isinstance(value, str):
        return normalize(value)
    if isinstance(value, dict):
        return next((value[k] if k == "url" else normalize(value[k]) for k in ("url", "name") if isinstance(value.get(k), str)), "")
    return pick_string(value[0]) if isinstance(value, list) and value else ""


def find_cover(doc: Node, base: str) -> str:
    """Cover: from linked data, from meta tags, else the largest picture."""
    for ld in json_ld(doc):
        raw = ld.get("image", ld.get("thumbnailUrl"))
        if raw is not None and (url := absolute(pick_string(raw), base)):
            return url
    if og := meta(doc, "og:image", "og:image:url", "twitter:image", "twitter:image:src"):
        return absolute(og, base)
    best = ("", 0)
    number = lambda s: int(m.group()) if (m := re.match(r"\s*\d+", s)) else 0
    for img in doc.find(tag("img")):
        src = absolute(img.get("src") or img.get("data-src"), base)
        if src.startswith(("http:", "https:")):
            names = f"{img.get('class')} {img.get('id')} {img.get('alt')}".lower()
            size = (500 if COVER_WORD.search(names) else 0) + number(img.get("width")) * number(img.get("height"))
            if size > best[1]:
                best = (src, size)
    return best[0]


_DESCRIPTIONS = (
    ident("synopsisText"), has("class", "synopsis"), ident("summary"), has("class", "summary"), lambda n: n.get("itemprop") == "description",
    has("class", "novel-summary"), has("class", "description"), has("class", "desc"), tag("article"),
)


def find_description(doc: Node, least: int = 40) -> str:
    """Description: from linked data, else the longest candidate, else from meta tags."""
    for ld in json_ld(doc):
        if isinstance(ld.get("description"), str) and len(ld["description"].strip()) > least:
            return normalize(ld["description"])
    best = ""
    for test in _DESCRIPTIONS:
        for n in doc.find(test):
            text = n.without(is_junk).text()
            if len(text) > max(len(best), least):
                best = text
    if best:
        return best
    said = meta(doc, "og:description", "twitter:description", "description")
    return said if len(said) > least else ""


def text_of(doc: Node, *tests: Test) -> str:
    """Text of the first element of the first test that has any."""
    for t in tests:
        n = doc.first(t)
        if n is not None and (text := n.text()):
            return text
    return ""


def html_language(doc: Node) -> str:
    root = doc.first(tag("html"))
    code = (root.get("lang") if root else "").lower()[:2]
    return code if code in ("ar", "fr", "en") else "ar"


def ordinal(label: str, url: str) -> int | None:
    m = re.search(r"(?:الفصل|الجزء|chapter|chapitre|part|episode)\s*[-_#]*\s*(\d{1,4})", label, re.I) or re.search(r"(?:post_id|chapter|chapitre|chapter_id|ep|part|id)=(\d{1,7})", url, re.I)
    return int(m.group(1)) if m else None


def generic_number(url: str, title: str) -> float:
    m = re.search(r"(?:chapter|chapters|chapitre|part|episode|read|فصل)[-_/]?(\d{1,4})", url, re.I) or re.search(r"[?&](?:chapter|chap|ep|part|id)=(\d{1,4})", url, re.I)
    if not m:
        m = next((x for seg in reversed(url.split("?")[0].split("/")) if (x := re.search(r"(\d{1,4})(?:\D|$)", seg))), None) or re.search(r"(\d{1,4})", title)
    return int(m.group(1)) if m else float("inf")


def _numbered(links: list[tuple[str, str]]) -> list[dict]:
    return [{"idx": k, "title": t or f"الفصل {k}", "url": u} for k, (t, u) in enumerate(links, 1)]


def portal_links(doc: Node, base: str) -> list[dict]:
    """Links to parts, grouped by URL: a call to read gives its place to a later title."""
    by: dict[str, list] = {}
    for pos, a in enumerate(doc.find(has("href", "read.php", "a"))):
        url = absolute(a.get("href"), base)
        if not url:
            continue
        label = sanitize(" — ".join(x for x in (text_of(a, tag("small")), text_of(a, tag("strong"))) if x) or a.text())
        noise = bool(CALL.search(label) or CALL.search(a.text()))
        if url not in by:
            by[url] = ["" if noise else label, ordinal(label or a.text(), url), pos]
        elif not by[url][0] and not noise and label:
            by[url][:2] = [label, ordinal(label, url)]
    rows = [(o if o is not None else float("inf"), p, t, u) for u, (t, o, p) in by.items() if t or len(by) == 1]
    return _numbered([(t, u) for *_, t, u in sorted(rows)])


def modern_links(doc: Node, base: str) -> list[dict]:
    own = re.search(r"/novels/\d+", urlsplit(base).path, re.I)
    seen: dict[str, str] = {}
    for a in doc.find(has("href", "/chapters/", "a")):
        href = a.get("href")
        if not re.search(r"/chapters/\d+", href, re.I) or (own and own.group() not in href):
            continue
        url = absolute(href, base)
        if url and url not in seen:
            inner = a.first(either(tag("h4", "h3", "strong"), has("class", "chapter-title")))
            seen[url] = sanitize(inner.text() if inner else "") or sanitize(a.text())
    number = lambda u: int(m.group(1)) if (m := re.search(r"chapters/(\d+)", u, re.I)) else float("inf")
    return _numbered([(t, u) for u, t in sorted(seen.items(), key=lambda x: number(x[0]))])


def generic_links(doc: Node, base: str) -> list[dict]:
    """Links of the page's own site that look like parts, by number, at most 500."""
    seen: dict[str, str] = {}
    for a in doc.find(tag("a")):
        url = absolute(a.get("href"), base)
        if not url or origin(url) != origin(base) or BLACKLIST.search(url):
            continue
        label = sanitize(a.get("title") or a.text())
        path = urlsplit(url).path or "/"
        like = CHAPTER_LIKE.search(f"{url} {label}") or (re.search(r"\d", path) and len(path.split("/")) >= 3)
        if like and len(label) >= 2 and not CALL.search(label) and url not in seen:
            seen[url] = label
    rows = sorted(seen.items(), key=lambda x: generic_number(x[0], x[1]))
    return _numbered([(t, u) for u, t in rows[:MOST_LINKS]])


def clean_summary(text: str) -> str:
    """Without blank lines and lines that are labelled facts."""
    return normalize("\n".join(x for line in text.split("\n") if (x := line.strip()) and not SUMMARY_LABEL.match(x)))


@dataclass(frozen=True)
class Adapter:
    """The rules for one kind of site."""

    title: tuple[Test, ...]
    content: tuple[Test, ...]
    author: tuple[Test, ...]
    links: Callable[[Node, str], list[dict]]
    suffixes: tuple[str, ...] = ()
    meta_title_first: bool = True
    description: tuple[Test, ...] = ()
    language: str | None = None


_ARTICLE = tag("article")
ADAPTERS: dict[str, Adapter] = {
    "portal": Adapter(
        title=(inside(has("class", "chapter-header"), tag("h1")), tag("h1"), tag("h2")),
        content=(
            inside(ident("chapterContent"), has("class", "paragraph-content")), ident("chapterContent"), has("class", "chapter-content"),
            has("class", "chapter-container"), has("class", "paragraph-content"), _ARTICLE,
        ),
        author=(inside(has("class", "author-card"), tag("h4")), inside(has("href", "author-profile"), tag("h4")), has("href", "author-profile", "a")),
        links=portal_links, suffixes=("منصة الروايات", "روايات"), meta_title_first=False,
        description=(ident("synopsisText"), has("class", "synopsis-text")), language="ar",
    ),
    "modern": Adapter(
        title=(has("class", "chapter-title-main"), inside(has("class", "chapter-header"), tag("h1")), tag("h1"), tag("title")),
        content=(
            ident("readingBody"), has("class", "reading-body"), ident("chapterContent"), has("class", "chapter-content-area"),
            has("class", "chapter-content"), has("class", "reading-container"), _ARTICLE,
        ),
        author=(has("href", "/profile/", "a"), has("href", "/author", "a")), links=modern_links,
        suffixes=("منصة الروايات", "أورانوس", "Uranus Novel", "Uranus", "منصة عربية رائدة لنشر وقراءة الروايات والقصص"), description=(ident("tab-summary"),),
    ),
    "generic": Adapter(
        title=(tag("h1"), has("class", "chapter-title")),
        content=(
            _ARTICLE, has("class", "chapter-content"), has("id", "chapter-content"), has("class", "chapter"), has("class", "reading"), has("class", "novel-content"),
            has("class", "entry-content"), has("class", "post-content"), has("id", "content"), tag("main"),
        ),
        author=(lambda n: n.tag == "a" and n.get("rel") == "author", has("class", "author")), links=generic_links,
    ),
}


def adapter_name(url: str) -> str:
    host = (urlsplit(url).hostname or "").removeprefix("www.")
    routes = ((r"wattpad\.com$", "wattpad"), ("novlar|khalidblog", "portal"), ("uranus-novel|novel", "modern"))
    return next((name for p, name in routes if re.search(p, host)), "generic")


def embedded_meta(url: str, html: str | None) -> dict | None:
    """Metadata and parts from the story object a page embeds; None without one."""
    story = embedded_object(html)
    if not story:
        return None
    text = lambda v: normalize(v) if isinstance(v, str) else ""
    language = story.get("language") or {}
    spoken = (language.get("name") or "").lower() if isinstance(language, dict) else ""
    parts = [(sanitize(text(p.get("title"))), absolute(p.get("url") or "", url)) for p in story["parts"] if isinstance(p, dict)]
    return {
        "adapter": "wattpad",
        "host": origin(url),
        "title": text(story.get("title")) or "بدون عنوان",
        "author": pick_string({"name": (story.get("user") or {}).get("name") or ""}) if isinstance(story.get("user"), dict) else "",
        "description": text(story.get("description")),
        "language_code": next((code for pattern, code in (("عرب|arab", "ar"), ("fran|fren", "fr"), ("engl", "en")) if re.search(pattern, spoken)), "ar"),
        "cover_url": absolute(story.get("cover") or "", url),
        "chapters": _numbered([(t, u) for t, u in parts if u]) or [{"idx": 1, "title": text(story.get("title")), "url": url}],
    }


def book_meta(url: str, html: str | None) -> dict:
    """Title, author, description, language, cover and ordered parts of a work's page.

    A page without links to parts is itself the only part."""
    name = adapter_name(url)
    if name == "wattpad" and (found := embedded_meta(url, html)):
        return found
    rules = ADAPTERS.get(name, ADAPTERS["generic"])
    doc = parse(html)
    said, seen = meta(doc, "og:title", "twitter:title"), sanitize(text_of(doc, tag("h1")))
    title = (said or seen) if rules.meta_title_first else (seen or said)
    title = strip_suffixes(title or sanitize(text_of(doc, tag("title"))), rules.suffixes) or "بدون عنوان"
    description = text_of(doc, *rules.description) if rules.description else ""
    if name == "modern":
        description = clean_summary(description)
        description = description if len(description) >= 40 else ""
    links = rules.links(doc, url)
    if len(links) < (2 if rules.links is generic_links else 1):
        links = [{"idx": 1, "title": title, "url": url}]
    cover = find_cover(doc, url)
    return {
        "adapter": name,
        "host": origin(url),
        "title": title,
        "author": text_of(doc, *rules.author) if name != "generic" else meta(doc, "author", "article:author") or text_of(doc, *rules.author),
        "description": description or find_description(doc),
        "language_code": rules.language or html_language(doc),
        "cover_url": "" if re.search("logo|default-cover|placeholder|favicon", cover, re.I) and name == "modern" else cover,
        "chapters": links,
    }


#: A story service's text of fewer letters, without images, is looked for in
#: the rendered page; a refusal says so among its first characters.
SHORT_LETTERS, REFUSAL_CHARS = 40, 80


def _fragment(url: str, html: str | None, title: str) -> list[dict] | None:
    """Blocks of a bare fragment, as story services send it, taken whole; None for a whole page."""
    if "<html" in (html or "").lower():
        return None
    if "error" in (html or "")[:REFUSAL_CHARS].lower():
        return []
    return clean(element_blocks(parse(html).without(is_junk), url), title)


def chapter(url: str, html: str | None, title: str = "", rendered: str | None = None) -> dict:
    """Title and blocks of a part's page. A story service's answer is a bare fragment; a
    refusal has no blocks, and where an answer has hardly any text the ``rendered`` page, if
    there is one, is read instead."""
    if adapter_name(url) == "wattpad":
        blocks = _fragment(url, html, title)
        if blocks is not None:
            enough = len(_SPACES.sub("", plain(blocks))) >= SHORT_LETTERS or any(b["type"] == "img" for b in blocks)
            if enough or not rendered:
                return {"title": title, "blocks": blocks}
            html = rendered
    rules = ADAPTERS.get(adapter_name(url), ADAPTERS["generic"])
    doc = parse(html)
    found = next((t for test in rules.title if (t := sanitize(text_of(doc, test)))), "") or sanitize(meta(doc, "og:title"))
    found = strip_suffixes(found, rules.suffixes) or title
    return {"title": found, "blocks": extract(doc, url, rules.content, found)}
