"""Headers of declarations in Java and Kotlin source, by their tokens and how braces nest; nothing is resolved."""

from __future__ import annotations

import re
from typing import NamedTuple

_TOKEN = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:.*?)(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|`[^`\n]*`|[\w$]+|->|[^\s\w]', re.S)
_TYPES = {"class", "interface", "enum", "record", "object"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, set(")]}")


class Header(NamedTuple):
    """``owners``: the types around it, itself included for a type; ``kind``: TYPE, FIELD, METHOD, CONSTRUCTOR."""

    owners: tuple[str, ...]
    kind: str
    name: str
    arity: int | None
    offset: int


def _tokens(text: str) -> list[tuple[str, int]]:
    out = []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t.startswith(("//", "/*")):
            continue
        out.append(('""' if t[0] in "\"'" else t.strip("`"), m.start() + (t[0] == "`")))
    return out


def _past(t: list[tuple[str, int]], i: int) -> int:
    """Behind the bracket that closes the one at ``i``."""
    depth = 0
    while i < len(t):
        depth += (t[i][0] in _OPEN) - (t[i][0] in _CLOSE)
        i += 1
        if not depth:
            break
    return i


def _past_generics(t, i: int) -> int:
    depth = 0
    while i < len(t):
        depth += (t[i][0] == "<") - (t[i][0] == ">")
        i += 1
        if not depth:
            break
    return i


def _word(x: str) -> bool:
    return bool(re.fullmatch(r"[\w$]+", x)) and not x[0].isdigit()


def _parts(t, i: int, end: int) -> list[list[tuple[str, int]]]:
    """Between the brackets ``i`` and ``end`` - 1, what commas outside of brackets part."""
    parts, depth = [[]], 0
    for x in t[i + 1 : end - 1]:
        depth += (x[0] in _OPEN or x[0] == "<") - (x[0] in _CLOSE or x[0] == ">")
        if x[0] == "," and not depth:
            parts.append([])
        else:
            parts[-1].append(x)
    return [p for p in parts if p]


def _annotation(t, i: int) -> int:
    """Behind the annotation at ``i``."""
    i += 2
    while i + 1 < len(t) and t[i][0] in (".", ":"):
        i += 2
    return _past(t, i) if i < len(t) and t[i][0] == "(" else i


def headers(text: str, kotlin: bool) -> tuple[str, list[Header]]:
    """(package, headers of types and their members in order of appearance)."""
    t, out, scopes, package = _tokens(text), [], [], ""
    for k, (x, _) in enumerate(t):
        if x == "package" and (not k or t[k - 1][0] in (";", '""', ")") or _word(t[k - 1][0])):
            package = ""
            for y, _ in t[k + 1 :]:
                if not (_word(y) or y == ".") or (package and _word(y) and not package.endswith(".")):
                    break
                package += y
            break
    (_kotlin if kotlin else _java)(t, out, scopes)
    return package, out


def _java(t, out: list[Header], owners: list[str]) -> None:
    def members(i: int, enum: bool) -> int:
        while enum and i < len(t) and t[i][0] not in (";", "}"):  # constants come first
            if t[i][0] == "@":
                i = _annotation(t, i)
            elif _word(t[i][0]):
                out.append(Header(tuple(owners), "FIELD", t[i][0], None, t[i][1]))
                i += 1
                while i < len(t) and t[i][0] in ("(", "{"):
                    i = _past(t, i)
            else:
                i += 1
        while i < len(t) and t[i][0] != "}":
            i = member(i)
        return i + 1

    def member(i: int) -> int:
        """A declaration, from its first token to behind its last."""
        start = i
        names: list[tuple[str, int]] = []
        while i < len(t):
            x, at = t[i]
            if x == "@" and i + 1 < len(t) and t[i + 1][0] != "interface":
                i = _annotation(t, i)
                continue
            if x in _TYPES and i + 1 < len(t) and _word(t[i + 1][0]) and (x != "record" or (i + 2 < len(t) and t[i + 2][0] in ("(", "<"))):
                return type_(i, x)
            if x == "<":
                i = _past_generics(t, i)
                names.append(("<>", at))
                continue
            if x == "(":
                end = _past(t, i)
                if names and _word(names[-1][0]) and owners:
                    # a return type stands before a method's name
                    made = names[-1][0] == owners[-1] and (len(names) == 1 or not (_word(names[-2][0]) and names[-2][0] not in _MODIFIERS or names[-2][0] == "[]"))
                    name = "<init>" if made else names[-1][0]
                    out.append(Header(tuple(owners), "CONSTRUCTOR" if made else "METHOD", name, len(_parts(t, i, end)), names[-1][1]))
                i = end
                while i < len(t) and t[i][0] not in ("{", ";", "}"):
                    i = _annotation(t, i) if t[i][0] == "@" else i + 1
                return _past(t, i) if i < len(t) and t[i][0] == "{" else i + (i < len(t) and t[i][0] == ";")
            if x == "[":
                i = _past(t, i)
                if not (names and i < len(t) and t[i][0] in (",", ";", "=")):
                    names.append(("[]", at))
                continue
            if x in (";", "=", ","):
                if names and _word(names[-1][0]) and len(names) > 1 and owners:
                    out.append(Header(tuple(owners), "FIELD", names[-1][0], None, names[-1][1]))
                if x == "=":
                    while i < len(t) and t[i][0] not in (";", ","):
                        i = _past(t, i) if t[i][0] in _OPEN else i + 1
                if i >= len(t) or t[i][0] == ";":
                    return i + 1
                i += 1
                continue
            if x == "{":
                return _past(t, i)  # an initializer
            if x == "}":
                return max(i, start + 1) if i > start else i
            names.append((x, at))
            i += 1
        return i

    def type_(i: int, keyword: str) -> int:
        name, at = t[i + 1]
        owners.append(name)
        out.append(Header(tuple(owners), "TYPE", name, None, at))
        i += 2
        if i < len(t) and t[i][0] == "<":
            i = _past_generics(t, i)
        if keyword == "record" and i < len(t) and t[i][0] == "(":
            i = _past(t, i)
        while i < len(t) and t[i][0] not in ("{", ";"):
            i += 1
        i = members(i + 1, keyword == "enum") if i < len(t) and t[i][0] == "{" else i + 1
        owners.pop()
        return i

    i = 0
    while i < len(t):
        i = max(i + 1, member(i))


_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "default", "strictfp", "transient", "volatile", "sealed", "non"}


def _kotlin(t, out: list[Header], owners: list[str]) -> None:
    scopes: list[bool] = []  # whether each open brace is a type's
    i, pending = 0, False
    while i < len(t):
        x, at = t[i]
        if x == "@":
            i = _annotation(t, i)
        elif x == "{":
            scopes.append(pending)
            pending = False
            i += 1
        elif x == "}":
            if pending:
                owners.pop()
                pending = False
            if scopes and scopes.pop():
                owners.pop()
            i += 1
        elif not all(scopes):
            i += 1  # within a body
        elif x in ("(", "["):
            i = _past(t, i)
        elif x in ("class", "interface", "object") and (i == 0 or t[i - 1][0] not in (":", ".", "=")):
            if pending:
                owners.pop()
            named = i + 1 < len(t) and _word(t[i + 1][0]) and t[i + 1][0] not in _KOTLIN_STARTS
            name, at = t[i + 1] if named else ("Companion", at)
            owners.append(name)
            out.append(Header(tuple(owners), "TYPE", name, None, at))
            pending = True
            i += 1 + named
            if i < len(t) and t[i][0] == "<":
                i = _past_generics(t, i)
            while i < len(t) and (t[i][0] in ("private", "internal", "protected", "public", "constructor") or t[i][0] == "@"):
                i = _annotation(t, i) if t[i][0] == "@" else i + 1
            if i < len(t) and t[i][0] == "(":
                end = _past(t, i)
                parts = _parts(t, i, end)
                out.append(Header(tuple(owners), "CONSTRUCTOR", "<init>", len(parts), at))
                for p in parts:
                    k = next((k for k, (y, _) in enumerate(p) if y in ("val", "var")), None)
                    if k is not None and k + 1 < len(p):
                        out.append(Header(tuple(owners), "FIELD", *p[k + 1][:1], None, p[k + 1][1]))
                i = end
        elif x in ("fun", "val", "var", "constructor", "init", "typealias"):
            if pending:
                owners.pop()
                pending = False
            i += 1
            if i < len(t) and t[i][0] == "<":
                i = _past_generics(t, i)
            if x == "constructor" and i < len(t) and t[i][0] == "(":
                out.append(Header(tuple(owners), "CONSTRUCTOR", "<init>", len(_parts(t, i, _past(t, i))), at))
            elif x in ("fun", "val", "var") and i < len(t) and _word(t[i][0]):
                name, extension = t[i], False
                i += 1
                while i + 1 < len(t) and t[i][0] in (".", "<", "?"):  # the receiver's type
                    if t[i][0] == "<":
                        i = _past_generics(t, i)
                    elif t[i][0] == "?":
                        i += 1
                    else:
                        name, extension, i = t[i + 1], True, i + 2
                if x == "fun" and i < len(t) and t[i][0] == "(" and not extension:
                    out.append(Header(tuple(owners), "METHOD", name[0], len(_parts(t, i, _past(t, i))), name[1]))
                elif x != "fun" and not extension:
                    out.append(Header(tuple(owners), "FIELD", name[0], None, name[1]))
        else:
            i += 1


_KOTLIN_STARTS = {"fun", "val", "var", "class", "interface", "object", "private", "internal", "public", "protected", "override", "constructor", "init"}
