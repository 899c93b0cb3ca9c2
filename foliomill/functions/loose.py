"""Data that is almost JSON: printed arrays, and objects embedded in pages."""

from __future__ import annotations

import json
import re

#: Enclosing objects that are tried outwards from a marker.
MOST_OUTWARD = 24
_TOKEN = re.compile(
    r"""\s*(?:(?P<open>array\s*\()|(?P<close>\))|(?P<arrow>=>)|(?P<comma>,)|(?P<text>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]+)|(?P<other>\S))""",
    re.S | re.I,
)
_WORDS = {"true": True, "false": False, "null": None}


def parse_dump(text: str) -> object:
    """Value of a printed array, ``array ( 'k' => v, ... )``.

    Arrays whose keys are all integers become lists in the order of their keys, keys
    that are missing count on; unknown words are strings, stray signs are skipped.
    An array that isn't closed ends with the text."""
    stack: list[list] = []
    key: object = None
    value: object = None
    have = waiting = False
    done: list[object] = []

    def put() -> None:
        nonlocal key, have, waiting
        if have:
            (stack[-1].append((key if waiting else None, value)) if stack else done.append(value))
        key, have, waiting = None, False, False

    def close() -> object:
        pairs = stack.pop()
        if all(k is None or isinstance(k, int) for k, _ in pairs):
            numbered, n = [], 0
            for k, v in pairs:
                n = k if k is not None else n
                numbered.append((n, v))
                n += 1
            return [v for _, v in sorted(numbered, key=lambda x: x[0])]
        return {str(k if k is not None else j): v for j, (k, v) in enumerate(pairs)}

    keys: list[tuple] = []
    for m in _TOKEN.finditer(text):
        kind, s = m.lastgroup, m.group(m.lastgroup)
        if kind == "open":
            keys.append((key, waiting))
            stack.append([])
            key, have, waiting = None, False, False
        elif kind == "close" and stack:
            put()
            value = close()
            key, waiting = keys.pop()
            have = True
        elif kind == "arrow":
            key, have, waiting = value, False, True
        elif kind == "comma":
            put()
        elif kind == "text":
            value, have = re.sub(r"\\(['\"\\])", r"\1", s[1:-1]), True
        elif kind == "number":
            value, have = (float(s) if "." in s else int(s)), True
        elif kind == "name":
            value, have = _WORDS.get(s.lower(), s), True
    while stack:
        put()
        value = close()
        key, waiting = keys.pop()
        have = True
    put()
    return done[0] if done else None


def loose_json(text: str | None) -> object:
    """Value of JSON, else of a printed array; None for anything else."""
    text = (text or "").strip()
    try:
        return json.loads(text)
    except ValueError:
        return parse_dump(text) if re.match(r"array\s*\(", text, re.I) else None


def embedded_object(html: str | None, marker: str = '"parts":[') -> dict | None:
    """The innermost object around a marker in a page that is JSON and has the
    marker's key as a list."""
    html = html or ""
    at = html.find(marker)
    name = marker.split('"')[1]
    decoder = json.JSONDecoder()
    depth = tried = 0
    while at > 0 and tried < MOST_OUTWARD:
        at -= 1
        if html[at] == "}":
            depth += 1
        elif html[at] == "{" and depth:
            depth -= 1
        elif html[at] == "{":
            tried += 1
            try:
                got, _ = decoder.raw_decode(html, at)
            except ValueError:
                continue
            if isinstance(got, dict) and isinstance(got.get(name), list):
                return got
    return None
