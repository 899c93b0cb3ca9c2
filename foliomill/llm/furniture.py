"""Rules that recognise single lines a site puts around or into a text.

They are the weak labels from which problem 4's labeller learns, and they tell
problems 1 and 3 which lines aren't the document's own. Phrases are fixed values.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliomill.llm.residue import HEADING

#: Words of site menus.
MENU = (
    "home", "library", "genres", "rankings", "ranking", "latest releases", "latest updates", "random novel", "my shelf", "bookshelf", "bookmarks", "forum", "log in", "login", "sign in", "sign up", "register",
    "previous", "previous chapter", "next", "next chapter", "settings", "contents", "table of contents", "search", "about", "contact", "help", "faq", "news",
    "accueil", "bibliothèque", "classements", "classement", "nouveautés", "roman au hasard", "mon étagère", "connexion", "inscription", "précédent", "suivant", "réglages", "paramètres", "sommaire", "recherche",
    "inicio", "biblioteca", "géneros", "clasificación", "clasificaciones", "novedades", "novela al azar", "mi estante", "foro", "acceder", "registrarse", "anterior", "siguiente", "ajustes", "índice", "buscar",
    "startseite", "bibliothek", "genre", "ranglisten", "rangliste", "neuerscheinungen", "zufallsroman", "mein regal", "anmelden", "registrieren", "zurück", "weiter", "einstellungen", "inhalt", "suche",
    "الرئيسية", "المكتبة", "الأنواع", "التصنيفات", "أحدث الفصول", "رواية عشوائية", "رفي الخاص", "المنتدى", "تسجيل الدخول", "السابق", "التالي", "الإعدادات", "الفهرس", "المحتويات", "بحث",
)
_MENU_WORD = "|".join(re.escape(w) for w in sorted(MENU, key=len, reverse=True))
_MENU_LINE = rf"^[^\pL\pN]*(?:{_MENU_WORD})(?:[\s|/·»›>•–—-]+(?:{_MENU_WORD}))*[^\pL\pN]*$"

#: Phrases of notices, calls, footers and boxes.
PHRASES = (
    r"you are reading (?:this|the) \w+ (?:at|on)\b", r"copies elsewhere", r"if you find errors", r"translated for .* readers", r"support the (?:translators|authors|site)", r"share this \w+ with (?:your )?friends",
    r"reproduction of any passage", r"^posted by the .* desk", r"^made for readers by", r"\bsitemap\b", r"terms of use", r"content policy|privacy policy", r"back to top", r"is run by volunteers", r"report (?:a problem|broken)",
    r"remain the property of their", r"^font size\b", r"night mode", r"^trending tags", r"remembers your font size", r"value your privacy", r"stores small files on your device", r"our use of cookies|uses cookies", r"you might (?:also )?like these",
    r"^readers also (?:opened|liked|read)", r"^popular this (?:week|month)", r"^top authors of the", r"^rate this chapter", r"^enter your e-?mail", r"^(?:subscribe|sign up) (?:to|for) ", r"^(?:leave a )?comments?\W*\d*\W*$",
    r"vous lisez ce chapitre sur", r"toute copie ailleurs", r"toute reproduction sans", r"soutenez les traducteurs", r"partagez ce chapitre", r"^traduit pour les lecteurs", r"^publié par la rédaction", r"restent la propriété de leurs",
    r"est tenu par des bénévoles", r"^à propos – ", r"conditions d.utilisation", r"haut de page", r"votre vie privée compte", r"l.usage de cookies", r"enregistre de petits fichiers", r"^laissez votre adresse", r"les lecteurs ont aussi ouvert",
    r"vous aimerez peut-être ces", r"^populaire cette semaine", r"^taille du texte", r"^étiquettes du moment", r"^notez ce chapitre", r"^commentaires\W*\d*\W*$", r"^meilleurs auteurs du mois|^auteurs du mois", r"^signaler un chapitre|^fabriqué pour les lecteurs|^fait pour les lecteurs", r"si vous trouvez des (?:erreurs|fautes)", r"se souvient de la taille",
    r"está leyendo este capítulo en", r"las copias en otros sitios", r"^apoye a los traductores", r"comparta este capítulo con", r"prohibida la reproducción", r"^traducido para los lectores", r"^publicado por la redacción", r"pertenecen a sus autores",
    r"funciona gracias a voluntarios", r"^quiénes somos", r"condiciones de uso", r"^volver arriba", r"valoramos su privacidad", r"el uso de cookies", r"guarda pequeños archivos", r"^deje su correo", r"^otros lectores abrieron", r"quizá le gusten estas",
    r"^lo más leído esta semana", r"^tamaño de letra", r"^etiquetas del momento", r"^valore este capítulo", r"^comentarios\W*\d*\W*$", r"^autores del mes|^mejores autores del mes", r"^avisar de un capítulo|^hecho para los lectores", r"si encuentra errores", r"recuerda (?:su|el) tamaño de letra",
    r"sie lesen dieses kapitel auf", r"kopien an anderer stelle", r"^unterstützen sie die übersetzer", r"teilen sie dieses kapitel", r"^jede wiedergabe ohne", r"^übersetzt für die leser", r"^veröffentlicht von der redaktion", r"bleiben eigentum ihrer",
    r"wird von freiwilligen betrieben", r"^über uns – ", r"nutzungsbedingungen", r"^nach oben ↑?", r"ihre privatsphäre zählt", r"nutzung von cookies", r"speichert kleine dateien", r"mit ihrer e-mail erfahren", r"^andere leser öffneten", r"könnten ihnen gefallen",
    r"^diese woche beliebt", r"^schriftgröße", r"^schlagworte:", r"^bewerten sie dieses kapitel", r"^kommentare\W*\d*\W*$", r"^autoren des monats|^top-autoren", r"^defektes kapitel melden|^für leser gemacht", r"wenn sie fehler (?:finden|entdecken)", r"merkt sich (?:ihre )?schriftgröße",
    r"شارك هذا الفصل مع", r"ترجم لقراء", r"ادعم مترجمي", r"يمنع نقل أي", r"أنت تقرأ هذا الفصل على", r"أبلغ عن مشكلة في هذه", r"نشره فريق", r"من نحن – اتصل بنا", r"شروط الاستخدام", r"العودة إلى الأعلى", r"جميع الفصول ملك لأصحابها",
    r"خصوصيتك تهمنا", r"ملفات تعريف الارتباط", r"يحفظ موقع", r"^قيم هذا الفصل", r"قراء آخرون فتحوا", r"^اترك بريدك", r"^حجم الخط", r"^وسوم رائجة", r"قد تعجبك هذه", r"^الأكثر قراءة هذا", r"^التعليقات\W*\d*\W*$", r"^أبلغ عن فصل|^مؤلفو الشهر|^أفضل مؤلفي الشهر", r"إذا وجدت أخطاء",
    r"^©\s", r"★{3,}", r"\brss – ",
)
_PHRASE = "|".join(f"(?:{p})" for p in PHRASES)
#: Heads of boxes that list other works or authors.
_BOX = re.compile(
    r"^(?:you might|readers also|popular this|top authors|trending tags|les lecteurs ont|vous aimerez|populaire cette|étiquettes du|auteurs du|meilleurs auteurs|otros lectores|quizá le|lo más leído|etiquetas del|autores del|mejores autores"
    r"|andere leser|diese reihen|diese woche|schlagworte|autoren des|top-autoren|قراء آخرون|قد تعجبك|الأكثر قراءة|وسوم رائجة|مؤلفو الشهر|أفضل مؤلفي)",
    re.I,
)
#: What titles listed in a box don't have: digits, columns, bullets, leaders.
_NO_TITLE = re.compile(r"[\d\t;=\[\]|]|^\s*[•*►▪◦-]\s|—|·{2}|\.{3}|->|[,،].*[,،]")
#: A reader's name with a number, then what they wrote.
_COMMENT = r"^\pL+_?\d+\s*(?::|–|-|—)\s"
_SENTENCES = re.compile(r"(?<=[.!?؟…])[»”“\"’')\]]*\s+")
#: What is said in quotes is story, whatever it says.
_QUOTED = re.compile(r"«[^»]*»|“[^”]*”|„[^“]*“")
_LINE = re.compile(_PHRASE, re.I)
_ENDS = re.compile(r"[.!?؟…][»”“\"’')\]]*\s*$")


def _spaced(line: str) -> str:
    return " ".join(line.split()) if "  " in line or not line.isprintable() or line[:1] == " " or line[-1:] == " " else line


def _mostly(line: str) -> bool:
    """Whether half of a line's sentences, or of its letters, are a site's."""
    parts = _SENTENCES.split(line)
    if len(parts) < 2:
        return len(_QUOTED.split(line)) < 2 or _LINE.search(_QUOTED.sub(" ", line)) is not None
    hits = [x for x in parts if _LINE.search(x)]
    return 2 * len(hits) >= len(parts) or 2 * sum(map(len, hits)) >= len(line)


def alone(lines: list[str]) -> np.ndarray:
    """Whether each line, taken alone, is a site's own. The patterns run as automata
    over the whole list; lines of several sentences need hits in half of them."""
    column = pa.array(lines, pa.string())
    found = pc.match_substring_regex(column, _PHRASE, ignore_case=True).to_numpy(zero_copy_only=False).copy()
    for k in np.flatnonzero(found).tolist():
        found[k] = _mostly(lines[k])
    menu = pc.match_substring_regex(column, _MENU_LINE, ignore_case=True)
    comment = pc.match_substring_regex(column, _COMMENT)
    return found | pc.or_(menu, comment).to_numpy(zero_copy_only=False)


def site_lines(documents: list[list[str]], titles: list[str | None]) -> list[list[bool]]:
    """For each line of each document whether it is the site's; titles listed in a
    box belong to it. Blank lines are nobody's and count as the document's."""
    spaced = [[_spaced(x) for x in lines] for lines in documents]
    flat = alone([x for lines in spaced for x in lines]).tolist()
    out, at = [], 0
    for lines, title in zip(spaced, titles):
        own = flat[at : at + len(lines)]
        at += len(lines)
        box = False
        for k, s in enumerate(lines):
            if not s:
                continue
            if box and not own[k]:
                box = not _ENDS.search(s) and not _NO_TITLE.search(s) and not HEADING.match(s) and s.casefold() != " ".join((title or "").split()).casefold()
                own[k] = box
            else:
                box = bool(own[k] and _BOX.match(s))
        out.append(own)
    return out
