"""Problem 7: template residue and error-page text in place of content.

Numbers, dates and addresses are masked and bodies with the same normalised form are
grouped by hash across sources. What recurs widely is a message, whose kind phrase and
placeholder rules name; bodies that these rules know as a whole need no recurrence.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import cut, map_batches

#: The rules name the kind of a body from such a share of message lines.
MESSAGE_SHARE = 0.2
#: A body recurs widely from so many rows on so many sources; one that no rule names
#: also at so many places in works, as copies of one chapter on several sites don't.
WIDE_ROWS, WIDE_SOURCES, WIDE_PLACES = 5, 3, 3
#: A body that no rule knows needs a line of so many words to be a message.
MESSAGE_WORDS = 4

#: How chapter headings begin in the five languages.
HEADING = re.compile(r"^\W*(?:chapter|chapitre|cap[ií]tulo|kapitel|الفصل)\s*\d+\b|^\W*\d{1,5}\W*$", re.I)

_PLACEHOLDER = re.compile(
    r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|\$\{[^}\n]*\}|#\{[^}\n]*\}|\{[A-Za-z_][\w.]*\}|\[\[[^\]\n]*\]\]|%%\w+%%|__[A-Za-z]\w*__|@@\w+@@"
    r"|\[object object\]|\b(?:undefined|null|nan|none|n/a|nil|todo|tbd)\b",
    re.I | re.S,
)
_TEMPLATE_FIELD = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|[$#]?\{[A-Za-z_][\w.]*\}|%%\w+%%|\[\[[^\]\n]*\]\]|__[A-Z]{2}\w*__", re.S | re.I)
_LOREM = re.compile(r"^\W*lorem ipsum\b", re.I)

#: Phrases of failure messages, visitor notices and filler.
PHRASES = {
    "error": (
        r"\b[45]\d\d\b.{0,40}\b(?:not found|bad gateway|unavailable|forbidden|error|gateway|server|timeout)", r"bad gateway", r"gateway time-?out",
        r"sqlstate\[", r"traceback \(most recent call", r"^(?:key|value|type|index|runtime|attribute)error\b", r"fatal error:", r"(?:warning|notice): .* on line \d+",
        r"undefined (?:array key|index|variable)", r"internal server error", r"server has gone away", r"connection (?:refused|timed out|reset)", r"stack trace",
        r"page (?:you \w+ for|requested)?.{0,20}(?:could not be|was not|not) found", r"page .{0,30}(?:introuvable|n.existe pas)", r"no se encontró la página|página .{0,25}no (?:existe|encontrada)",
        r"seite .{0,30}nicht gefunden", r"الصفحة .{0,20}غير موجودة", r"^(?:error|erreur|fehler|خطأ) \d{3}\b", r"temporarily unavailable|(?:down|closed) for maintenance",
        r"momentanément indisponible|temporairement indisponible|en maintenance", r"no (?:está )?disponible (?:por el momento|temporalmente)|en mantenimiento", r"vorübergehend nicht (?:erreichbar|verfügbar)|wartungsarbeiten",
        r"غير متاحة? مؤقتا|قيد الصيانة", r"server is (?:too )?busy", r"try again (?:in a few|later)|réessayez plus tard|inténtelo más tarde|versuchen sie es später|حاول مرة أخرى لاحقا",
        r"access (?:to \w+ \w+ )?(?:is |was )?(?:denied|blocked)|accès (?:refusé|interdit|bloqué)|acceso (?:denegado|bloqueado)|zugriff verweigert|تم (?:حظر|رفض) ", r"request (?:was|has been) blocked|anfrage wurde blockiert|solicitud (?:fue|ha sido) bloqueada",
        r"too many requests|trop de (?:requêtes|demandes)|demasiadas solicitudes|zu viele anfragen|كثرة الزيارات|طلبات كثيرة", r"not available in your (?:country|region)",
    ),
    "notice": (
        r"(?:turn on|enable|activate|requires?) javascript|javascript (?:is |must be )?(?:required|disabled|enabled)|(?:activez|activer|active|aktivieren sie) javascript|تفعيل جافا ?سكر[يبت]+",
        r"not a robot|you are (?:a )?human|pas un robot|no es un robot|no eres un robot|kein roboter|لست روبوت", r"your browser will be|navegador será|navigateur sera|ihr browser wird", r"(?:checking|verifying) (?:your browser|that you)",
        r"(?:complete|solve) the captcha|unusual traffic",
    ),
    "filler": (
        r"(?:chapter |chapter's )?text (?:goes|will go|comes) here", r"replace this (?:paragraph|text)", r"texte du chapitre (?:sera|viendra|ici)", r"aquí va el texto|el texto del capítulo (?:va|irá) aquí", r"hier steht später|hier (?:kommt|folgt) der text",
        r"يوضع نص الفصل|نص الفصل هنا", r"placeholder text|sample text|insert (?:text|content) here",
    ),
}
_PHRASE = {kind: re.compile("|".join(f"(?:{p})" for p in ps), re.I) for kind, ps in PHRASES.items()}
_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"[.!?؟…][»”“\"’')\]]*$")
_SENTENCES = re.compile(r"(?<=[.!?؟…])\s+")
#: Lines of a stack trace; after a Python frame comes a line of code.
_FRAME = re.compile(r"^(?:file \".*\", line \d+|at [\w$.<>/]+\s?\(.*\)$|#\d+ .+\(\d+\)|caused by: |\.{3} \d+ more$)", re.I)
_ANY_PHRASE = re.compile("|".join(f"(?:{p})" for ps in PHRASES.values() for p in ps), re.I)

_MASKS = (
    (re.compile(r"https?://\S+|\bwww\.\S+|\b[\w.+-]+@[\w-]+\.\w+|(?<!\w)(?:/[\w.-]+){2,}"), "ADDRESS"),
    (re.compile(r"\b\d{1,4}[./-]\d{1,2}[./-]\d{1,4}\b"), "DATE"),
    (re.compile(r"\d+"), "0"),
)
#: Without these a mask has nothing to find.
_SIGNS = (re.compile(r"[@/]|www\.", re.I), re.compile(r"\d"), re.compile(r"\d"))


#: The rules for lines as one automaton over bodies; without word limits it finds no less.
_HINT = "(?im)" + "|".join(
    re.sub(r"\\b", "", p).replace(r"\d", r"\p{Nd}").replace(r"\w", r"[\pL\pN_]")
    for p in [f"(?:{x})" for ps in PHRASES.values() for x in ps] + [r"\{\{|\{%|<%|[$#]?\{|\[\[|%%|__|@@|\[object|undefined|null|nan|none|n/a|nil|todo|tbd", r"^[ \t.,;:!?'\"()-]+$"]
)


def hints(bodies: list[str]) -> list[bool]:
    """Whether a body may have a message line."""
    return pc.match_substring_regex(pa.array(bodies, pa.string()), _HINT).to_pylist()


def heading_lines(lines: list[str], title: str | None, site: list[bool] | None = None) -> list[int]:
    """Positions of a document's own heading: every line equal to its title, and its
    first line (the site's lines aside) if that begins as headings do and ends no
    sentence. Three such lines in a row are a list of headings, none of them its own."""
    head = " ".join((title or "").split()).casefold()
    own = [k for k, x in enumerate(lines) if x.strip() and not (site and site[k])]
    out = [k for k in own if head and " ".join(lines[k].split()).casefold() == head]
    rest = [k for k in own if k not in out][:3]
    like = [bool(HEADING.match(lines[k])) and not _SENTENCE_END.search(lines[k].rstrip()) for k in rest]
    return out + rest[:1] if like[:1] == [True] and (len(like) < 3 or not all(like)) else out


def own_body(text: str, title: str | None) -> list[str]:
    """The non-blank lines but the document's own heading, trimmed."""
    lines = [" ".join(x.split()) for x in text.split("\n")]
    heading = heading_lines(lines, title)
    return [x for k, x in enumerate(lines) if x and k not in heading]


def masked(lines: list[str]) -> str:
    """The normalised form in which messages are grouped."""
    text = "\n".join(lines)
    for (pattern, name), signs in zip(_MASKS, _SIGNS):
        if signs.search(text):
            text = pattern.sub(name, text)
    return text.casefold()


def line_kind(line: str) -> str | None:
    """The kind of message a line is as a whole, if rules tell."""
    if not _PLACEHOLDER.sub("", line).strip(" \t.,;:!?'\"()-"):
        return "template"
    if not (first := _message(line)):
        return None
    parts = _SENTENCES.split(line)
    if len(parts) < 3:
        return first
    return first if 2 * sum(len(x) for x in parts if _message(x)) >= sum(map(len, parts)) else None


def _message(text: str) -> str | None:
    if _TEMPLATE_FIELD.search(text):
        return "template"
    return next((kind for kind, pattern in _PHRASE.items() if pattern.search(text)), None) if _ANY_PHRASE.search(text) else None


def _kinds(lines: list[str]) -> Iterator[str | None]:
    """The kind of each line; frames and their code belong to an error before them."""
    error, code = False, False
    for x in lines:
        kind = line_kind(x)
        if error and kind is None and (code or _FRAME.match(x)):
            kind, code = "error", not code and x[:5].casefold() == "file "
        else:
            error, code = error or kind == "error", False
        yield kind


def _brief(line: str) -> bool:
    return len(line) <= 40 and len(line.split()) <= 3


def classify(text: str | None, title: str | None) -> tuple[str | None, bool, str | None]:
    """(kind, certain, normalised body) of a text.

    Certain are bodies of which every line is a message or filler by the rules. Any
    other body is a message only if it recurs widely; the rules name its kind where
    a fifth of its lines are theirs. Null and blank texts and bodies that are
    only a heading have no kind and no normalised body.
    """
    if not text or text.isspace():
        return None, False, None
    return classify_lines(own_body(text, title))


def classify_lines(lines: list[str], hint: bool = True) -> tuple[str | None, bool, str | None]:
    """``classify`` of the own lines of a text; without a hint none is a message."""
    if not lines:
        return None, False, None
    if _LOREM.match(lines[0]):
        return "filler", True, masked(lines)
    kinds = list(_kinds(lines)) if hint else []
    known = [k for k in kinds if k]
    if not known or len(known) < MESSAGE_SHARE * len(lines):
        return None, False, masked(lines)
    short = all(k or _brief(x) for k, x in zip(kinds, lines))
    return known[0], len(known) == len(lines) or (short and 2 * len(known) >= len(lines)), masked(lines)


def worded(lines: list[str]) -> bool:
    """Whether a body has a line of some words, so that it can be a message at all."""
    return any(len(_WORDS.findall(x)) >= MESSAGE_WORDS for x in lines)


def is_residue(text: str | None, title: str | None) -> bool:
    """Whether ``classify`` is certain; ends at the first line that is no message."""
    if not text or text.isspace() or not (lines := own_body(text, title)):
        return False
    if _LOREM.match(lines[0]):
        return True
    known = 0
    for kind, x in zip(_kinds(lines), lines):
        if not kind and not _brief(x):
            return False
        known += bool(kind)
    return known > 0 and 2 * known >= len(lines)


def residue(chapters: DataFrame, columns: tuple[str, str, str, str, str] = ("chapter_id", "host", "idx", "title", "plain_text")) -> DataFrame:
    """``chapter_id``, ``kind`` (template, filler, error, notice, or message where no rule
    names it), ``rows`` and ``sources`` of the message, of every row that holds a message
    in place of content.

    A null source or place counts as one. Repeated rows are answered each. Texts that
    only mention such messages have other lines and are no case; nor are copies of
    a text that stand at one place of their works.
    """
    key, source, place, title, text = columns

    def make() -> Callable:
        def run(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"chapter_id": [], "source": [], "place": [], "kind": [], "certain": [], "k": []}
            bodies = [own_body(t, h) for h, t in zip(cols["h"], cols["t"])]
            for i, s, p, lines, hint in zip(cols["i"], cols["s"], cols["p"], bodies, hints(["\n".join(x) for x in bodies])):
                kind, certain, norm = classify_lines(lines, hint)
                if norm and (kind or worded(lines)):
                    k = int.from_bytes(hashlib.blake2b(norm.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
                    for name, v in zip(out, (i, s, p, kind, certain, k)):
                        out[name].append(v)
            return out

        return run

    rows = chapters.select(F.col(key).alias("i"), F.col(source).alias("s"), F.hash(F.col(place)).alias("p"), F.col(title).alias("h"), F.col(text).alias("t")).where("t IS NOT NULL")
    bodies = cut(map_batches(rows, make, "chapter_id bigint, source string, place int, kind string, certain boolean, k bigint"))
    # combined by place first, so that a message in a third of all rows burdens no task
    spots = bodies.groupBy("k", "source", "place").agg(F.count("*").alias("n"), F.max("certain").alias("certain"))
    one = lambda c: F.countDistinct(F.coalesce(F.col(c), F.lit(0).cast(spots.schema[c].dataType)))
    forms = spots.groupBy("k").agg(F.sum("n").alias("rows"), one("source").alias("sources"), one("place").alias("places"), F.max("certain").alias("certain"))
    wide = (F.col("rows") >= WIDE_ROWS) & (F.col("sources") >= WIDE_SOURCES)
    known = forms.where(F.col("certain") | wide).select("k", "rows", "sources", wide.alias("wide"), (wide & (F.col("places") >= WIDE_PLACES)).alias("unnamed"))
    got = bodies.join(known, "k").where(F.col("certain") | F.when(F.col("kind").isNull(), F.col("unnamed")).otherwise(F.col("wide")))
    return got.select(F.col("chapter_id").alias(key), F.coalesce("kind", F.lit("message")).alias("kind"), "rows", "sources")
