"""Relations that SQL text names."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"""--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|\[[^\]\s]+\]|[A-Za-z_][\w$]*|\d+(?:\.\d+)?|[^\s\w]""", re.S)
# What can follow a relation's name, what starts statements, functions with FROM inside.
_STOP = frozenset("WHERE ON USING JOIN INNER LEFT RIGHT FULL CROSS NATURAL OUTER GROUP ORDER HAVING LIMIT OFFSET UNION EXCEPT INTERSECT SET VALUES SELECT RETURNING FETCH FOR WINDOW WITH AS LATERAL".split())
_HEADS = frozenset("SELECT INSERT UPDATE DELETE WITH MERGE CREATE ALTER DROP TRUNCATE REPLACE".split())
_INSIDE = frozenset("EXTRACT TRIM SUBSTRING OVERLAY POSITION".split())


def _tokens(sql: str) -> list[str]:
    return [t for t in _TOKEN.findall(sql) if not t.startswith(("--", "/*"))]


def _is_name(t: str) -> bool:
    return bool(re.match(r'[A-Za-z_"`\[]', t))


def _plain(t: str) -> str:
    if t[0] in "\"`[":
        return t[1:-1].replace('""', '"').replace(".", "%2E")
    return t


def _fold(t: str) -> str:
    return _plain(t) if t[0] in "\"`[" else t.lower()


def _statements(tokens: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for t in tokens:
        if t == ";":
            out.append([])
        else:
            out[-1].append(t)
    return out


def _with_names(t: list[str]) -> set[str]:
    """Names that WITH gives to queries, anywhere in the statement."""
    names: set[str] = set()
    for i, x in enumerate(t):
        if x.upper() != "WITH":
            continue
        j = i + 1 + (i + 1 < len(t) and t[i + 1].upper() == "RECURSIVE")
        while j < len(t) and _is_name(t[j]):
            name, j = t[j], j + 1
            if j < len(t) and t[j] == "(":
                j = _close(t, j) + 1
            if j >= len(t) or t[j].upper() != "AS":
                break
            j += 1
            while j < len(t) and t[j].upper() in ("NOT", "MATERIALIZED"):
                j += 1
            if j >= len(t) or t[j] != "(":
                break
            names.add(_fold(name))
            j = _close(t, j) + 1
            if j >= len(t) or t[j] != ",":
                break
            j += 1
    return names


def _close(t: list[str], i: int) -> int:
    depth = 0
    for k in range(i, len(t)):
        depth += (t[k] == "(") - (t[k] == ")")
        if not depth:
            return k
    return len(t) - 1


#: Words that end the list of a FROM.
_AFTER_FROM = frozenset("SELECT WHERE GROUP ORDER HAVING LIMIT UNION INTERSECT EXCEPT SET VALUES WINDOW RETURNING FETCH OFFSET".split())


def relations(sql: str) -> tuple[list[str], int]:
    """(relation names in order of appearance, operands that are not names).

    Names follow FROM, JOIN, INTO, UPDATE and TABLE, and commas after them; names of a WITH count only
    outside its statement, FROM inside functions and DISTINCT FROM not at all.  Prose has no relations.
    """
    found: list[str] = []
    unresolved = 0
    for t in _statements(_tokens(sql)):
        if not t or t[0].upper() not in _HEADS or (t[0].upper() == "UPDATE" and "SET" not in (x.upper() for x in t)):
            continue
        hidden, stack, listed, followed = _with_names(t), [""], [False], set()
        for i, x in enumerate(t):
            up = x.upper()
            if x == "(":
                stack.append(t[i - 1].upper() if i else "")
                listed.append(False)
            elif x == ")":
                stack, listed = stack[:-1] or [""], listed[:-1] or [False]
            elif up in _AFTER_FROM:
                listed[-1] = False
            elif x == "," and listed[-1] and i not in followed:  # a further item of the list, after a join's condition
                up = "FROM"
            if up not in ("FROM", "JOIN", "INTO", "UPDATE", "TABLE") or (up == "UPDATE" and i and t[i - 1].upper() in ("FOR", "ON", "DO")):
                continue
            if up == "FROM" and (stack[-1] in _INSIDE or (i and t[i - 1].upper() == "DISTINCT" and i > 1 and t[i - 2].upper() in ("IS", "NOT"))):
                continue
            listed[-1] = listed[-1] or up == "FROM"
            j = i + 1
            while j < len(t):
                while j < len(t) and t[j].upper() in ("ONLY", "LATERAL", "IF", "EXISTS", "NOT"):
                    j += 1
                if j >= len(t) or t[j] == "(" or t[j].upper() == "SELECT":
                    j = _close(t, j) + 1 if j < len(t) and t[j] == "(" else len(t)
                elif not _is_name(t[j]) or t[j].upper() in _STOP:
                    unresolved += 1
                    break
                else:
                    parts, j = [t[j]], j + 1
                    while j + 1 < len(t) and t[j] == "." and _is_name(t[j + 1]):
                        parts.append(t[j + 1])
                        j += 2
                    if up in ("FROM", "JOIN") and j < len(t) and t[j] == "(":
                        unresolved += 1
                        j = _close(t, j) + 1
                    elif len(parts) > 1 or _fold(parts[0]) not in hidden:
                        name = ".".join(map(_plain, parts))
                        if name not in found:
                            found.append(name)
                # an alias, then perhaps a further item of the list
                if j < len(t) and t[j].upper() == "AS":
                    j += 1
                if j < len(t) and _is_name(t[j]) and t[j].upper() not in _STOP:
                    j += 1
                if up not in ("FROM", "JOIN") or j >= len(t) or t[j] != ",":
                    break
                followed.add(j)
                j += 1
    return found, unresolved
