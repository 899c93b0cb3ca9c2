"""Arabic letters to joined forms, and lines to visual order, for writers that place
glyphs from left to right."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

#: Marks that don't take part in joining.
_MARK = re.compile("[ؐ-ًؚ-ٰٟۖ-ۭ]")
#: Brackets that change sides in right-to-left text.
MIRROR = dict(zip("()[]{}<>«»", ")(][}{><»«"))
_RTL_SIGN = frozenset("،؛؟٪٫٬٭")


@cache
def joining_forms() -> dict[str, dict[str, str]]:
    """Letter (or lam-alef pair) to its isolated, final, initial and medial form, read
    from the character database."""
    forms: dict[str, dict[str, str]] = {}
    for cp in (*range(0xFB50, 0xFC00), *range(0xFE70, 0xFEFD)):
        kind, _, codes = unicodedata.decomposition(chr(cp)).partition(" ")
        if kind in ("<isolated>", "<final>", "<initial>", "<medial>"):
            letters = "".join(chr(int(c, 16)) for c in codes.split())
            if len(letters) == 1 and letters != " " or len(letters) == 2 and letters[0] == "ل":
                forms.setdefault(letters, {}).setdefault(kind[1:-1], chr(cp))
    forms["ـ"] = dict.fromkeys(("isolated", "final", "initial", "medial"), "ـ")
    return forms


def shape(text: str) -> str:
    """Logical text with joined forms; marks are kept and joined across."""
    text = unicodedata.normalize("NFC", text)
    forms = joining_forms()
    letters = [k for k, ch in enumerate(text) if not _MARK.match(ch)]
    neighbour = {k: (letters[j - 1] if j else None, letters[j + 1] if j + 1 < len(letters) else None) for j, k in enumerate(letters)}
    out, skip = [], None
    for k, ch in enumerate(text):
        if k == skip or k not in neighbour:
            if k != skip:
                out.append(ch)
            continue
        before, after = neighbour[k]
        own = forms.get(ch)
        joined = before is not None and "initial" in forms.get(text[before], {})
        pair = forms.get(ch + text[after]) if after is not None and ch == "ل" else None
        if pair:
            out.append(pair["final" if joined and "final" in pair else "isolated"])
            skip = after
        elif not own:
            out.append(ch)
        else:
            follows = after is not None and ("final" in forms.get(text[after], {}) or "initial" in forms.get(text[after], {}))
            wanted = ("medial",) * (joined and follows) + ("final",) * joined + ("initial",) * follows + ("isolated",)
            out.append(next((own[w] for w in wanted if w in own), ch))
    return "".join(out)


def _side(ch: str) -> str:
    if ch in _RTL_SIGN or ("ء" <= ch <= "ۿ" and not ch.isdigit()) or "ﭐ" <= ch <= "ﻼ":
        return "r"
    return "l" if ch.isalnum() else ""


def visual(text: str, rtl: bool = True) -> str:
    """A line in visual order: runs from right to left where it begins so, brackets
    mirrored in right-to-left runs."""
    runs: list[list[str]] = []
    first = next((s for ch in text if (s := _side(ch))), "r" if rtl else "l")
    for ch in shape(text):
        side = _side(ch) or (runs[-1][0] if runs else first)
        if runs and runs[-1][0] == side:
            runs[-1][1] += ch
        else:
            runs.append([side, ch])
    turned = [r[1] if r[0] == "l" else "".join(MIRROR.get(c, c) for c in reversed(r[1])) for r in runs]
    return "".join(reversed(turned) if first == "r" else turned)
