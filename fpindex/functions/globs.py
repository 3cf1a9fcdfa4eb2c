"""Shell globs as Spark predicates.

``*`` and ``**`` match any text including ``/``, ``?`` one character,
``[abc]``/``[a-z]``/``[!x]`` a class; a backslash quotes; the whole path has to
match, with case. A pattern is translated once on the driver into the cheapest
predicate Spark has for it, so that literal heads reach the Parquet scan as
``StringStartsWith``.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: End of the text, where Java and Python differ about a final line break with ``$``.
REGEX_END = r"(?![\s\S])"

_STAR = ("star", "")
_ONE = ("one", "")

# Named character classes inside brackets.
_NAMED = {
    "alpha": "a-zA-Z",
    "digit": "0-9",
    "alnum": "a-zA-Z0-9",
    "upper": "A-Z",
    "lower": "a-z",
    "space": r" \t\n\r\f\x0B",
    "blank": r" \t",
    "punct": r"!-/:-@\[-`{-~",
    "xdigit": "0-9A-Fa-f",
    "cntrl": r"\x00-\x1F\x7F",
    "print": r"\x20-\x7E",
    "graph": r"\x21-\x7E",
}


def _class_char(ch: str) -> str:
    return ch if ch.isalnum() else "\\" + ch


def _bracket(glob: str, start: int) -> tuple[str, int] | None:
    """Regex class for the bracket opening at ``start`` and the index after it."""
    i = start + 1
    negated = i < len(glob) and glob[i] in "!^"
    i += negated
    body: list[str] = []
    first = True
    while i < len(glob):
        ch = glob[i]
        if ch == "]" and not first:
            return f"[{'^' if negated else ''}{''.join(body)}]", i + 1
        first = False
        named = re.match(r"\[:([a-z]+):\]", glob[i:])
        if named and named.group(1) in _NAMED:
            body.append(_NAMED[named.group(1)])
            i += named.end()
            continue
        if ch == "\\" and i + 1 < len(glob):
            i += 1
            ch = glob[i]
        low = ch
        if glob[i + 1 : i + 2] == "-" and glob[i + 2 : i + 3] not in ("", "]"):
            i += 2
            if glob[i] == "\\" and i + 1 < len(glob):
                i += 1
            if low <= glob[i]:
                body.append(f"{_class_char(low)}-{_class_char(glob[i])}")
        else:
            body.append(_class_char(low))
        i += 1
    return None


def _tokens(glob: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []

    def literal(ch: str) -> None:
        if out and out[-1][0] == "lit":
            out[-1] = ("lit", out[-1][1] + ch)
        else:
            out.append(("lit", ch))

    i = 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            if not out or out[-1] != _STAR:
                out.append(_STAR)
        elif ch == "?":
            out.append(_ONE)
        elif ch == "[" and (found := _bracket(glob, i)) is not None:
            # a class left without members matches nothing, its negation anything
            out.append(("class", {"[]": "(?!)", "[^]": "."}.get(found[0], found[0])))
            i = found[1]
            continue
        elif ch == "\\" and i + 1 < len(glob):
            i += 1
            literal(glob[i])
        else:
            literal(ch)
        i += 1
    return out


def glob_to_regex(glob: str) -> str:
    """Anchored regular expression that Java and Python read alike."""
    parts = []
    for kind, text in _tokens(glob):
        if kind == "star":
            parts.append(".*")
        elif kind == "one":
            parts.append(".")
        elif kind == "class":
            parts.append(text)
        else:
            parts.append("".join(_class_char(c) if ord(c) < 128 else c for c in text))
    return "(?s)^(?:" + "".join(parts) + ")" + REGEX_END


def glob_prefix(glob: str) -> str:
    """Literal text every match starts with."""
    tokens = _tokens(glob)
    return tokens[0][1] if tokens and tokens[0][0] == "lit" else ""


class GlobParts(NamedTuple):
    """What plain comparisons say about the matches of a glob; ``plain`` if they say it all."""

    head: str
    tail: str
    least: int
    inner: str | None
    plain: bool


def glob_parts(glob: str) -> GlobParts:
    """Literal head and tail of a glob, the least length of a match, and a text inside of it."""
    tokens = _tokens(glob)
    kinds = [kind for kind, _ in tokens]
    head = tokens[0][1] if kinds[:1] == ["lit"] else ""
    tail = tokens[-1][1] if kinds[-1:] == ["lit"] and (len(tokens) > 1 or not head) else ""
    least = sum(len(text) if kind == "lit" else kind != "star" for kind, text in tokens)
    body = kinds[bool(head) : len(kinds) - bool(tail)]
    inner = [text for kind, text in tokens[bool(head) : len(tokens) - bool(tail)] if kind == "lit"]
    plain = body in (["star"], ["star", "lit", "star"] if not head and not tail else ["star"])
    return GlobParts(head, tail, least, max(inner, key=len) if inner else None, plain)


def glob_match(path: Column, glob: str) -> Column:
    """Predicate: the whole ``path`` matches ``glob``."""
    tokens = _tokens(glob)
    kinds = tuple(kind for kind, _ in tokens)
    texts = [text for kind, text in tokens if kind == "lit"]
    if not tokens:
        return path == ""
    if kinds == ("star",):
        return path.isNotNull()
    if kinds == ("lit",):
        return path == texts[0]
    if kinds == ("lit", "star"):
        return path.startswith(texts[0])
    if kinds == ("star", "lit"):
        return path.endswith(texts[0])
    if kinds == ("star", "lit", "star"):
        return path.contains(texts[0])
    if kinds == ("lit", "star", "lit"):
        return (
            path.startswith(texts[0])
            & path.endswith(texts[1])
            & (F.length(path) >= len(texts[0]) + len(texts[1]))
        )
    match = path.rlike(glob_to_regex(glob))
    if tokens[-1][0] == "lit":
        match = path.endswith(tokens[-1][1]) & match
    if tokens[0][0] == "lit":
        match = path.startswith(tokens[0][1]) & match
    return match
