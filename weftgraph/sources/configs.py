"""Small files that people write: layer rules, keep rules, baselines.  Parsed on the driver."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession


def layer_yaml(text: str) -> tuple[list[tuple[str, list[str]]], list[dict]]:
    """(layers, rules) of a file of two lists, ``layers`` and ``rules``; anything unknown is an error."""
    sections: dict[str, list[dict[str, str]]] = {}
    allowed = {"layers": {"name", "match"}, "rules": {"name", "from", "allow", "deny"}}
    section, item = None, None
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        if not line.startswith(" "):
            if line not in ("layers:", "rules:") or line[:-1] in sections:
                raise ValueError(f"line {n}: unknown or duplicate root key")
            section, item = line[:-1], None
            sections[section] = []
            continue
        entry = line.strip()
        if section is None:
            raise ValueError(f"line {n}: entry before a section")
        if entry.startswith("- "):
            item, entry = {}, entry[2:].strip()
            sections[section].append(item)
        key, colon, value = entry.partition(":")
        if item is None or not colon or not key or key in item or key not in allowed[section]:
            raise ValueError(f"line {n}: unknown, duplicate or misplaced property")
        item[key] = value.strip()

    def values(v: str) -> list[str]:
        if not (v.startswith("[") and v.endswith("]")):
            raise ValueError("lists are written [value, ...]")
        out = [x.strip().strip("\"'") for x in v[1:-1].split(",")] if v[1:-1].strip() else []
        if any(not x for x in out):
            raise ValueError("list entries must not be blank")
        return out

    layers = [(x.get("name", ""), values(x.get("match", ""))) for x in sections.get("layers", [])]
    if not layers or any(not n or not ps for n, ps in layers) or len({n for n, _ in layers}) < len(layers):
        raise ValueError("layers need unique names and patterns")
    rules = []
    for x in sections.get("rules", []):
        if ("allow" in x) == ("deny" in x) or not x.get("from"):
            raise ValueError("a rule has from, and one of allow and deny")
        rule = {"name": x.get("name") or f"{x['from']} dependency rule", "from": x["from"]} | {k: values(x[k]) for k in ("allow", "deny") if k in x}
        if missing := {rule["from"], *rule.get("allow", []), *rule.get("deny", [])} - {n for n, _ in layers}:
            raise ValueError(f"unknown layer {sorted(missing)[0]}")
        rules.append(rule)
    if len({r["name"] for r in rules}) < len(rules):
        raise ValueError("rules need unique names")
    return layers, rules


_DIRECTIVES = {"-keep": {}, "-keepclassmembers": {"members_only": True}, "-keepclasseswithmembers": {"conditional": True}}
_IGNORED = ("-keepattributes", "-dontwarn", "-dontnote", "-dontoptimize", "-dontobfuscate", "-optimizations", "-keepnames", "-verbose", "-printmapping", "-assumenosideeffects", "-repackageclasses", "-allowaccessmodification")


def keep_rules(text: str, path: str = "rules.pro") -> list[dict]:
    """Rules of a shrinker's configuration, as ``operators.retention.keep_rules`` takes them."""
    clean = re.sub(r"#[^\n]*", "", text)
    out = []
    for m in re.finditer(r"(?m)^\s*(-\w+)((?:,\w+)*)([^{}]*?)(?:\{(.*?)\}|(?=^\s*-)|\Z)", clean, re.S):
        name, head, body = m[1], m[3].strip(), m[4]
        line = clean.count("\n", 0, m.start(1)) + 1
        if name == "-dontshrink":
            out.append({"shrinking_disabled": True, "path": path, "line": line})
            continue
        if name not in _DIRECTIVES:
            if name in _IGNORED:
                continue
            raise ValueError(f"{path}:{line}: unknown directive {name}")
        c = re.fullmatch(r"(?:@(?P<annotation>[\w.$*?]+)\s+)?(?P<access>(?:!?(?:public|final|abstract|private|protected|static)\s+)*)(?P<kind>!?(?:class|interface|enum|@interface))\s+(?P<name>[\w.$*?,/]+)(?:\s+(?:extends|implements)\s+(?P<extends>[\w.$*?]+))?", head)
        if not c:
            raise ValueError(f"{path}:{line}: class specification is not understood")
        rule = {"declaration": c["kind"], "class_pattern": c["name"], "path": path, "line": line, **_DIRECTIVES[name]}
        if c["annotation"]:
            rule["annotation"] = c["annotation"]
        if c["extends"]:
            rule["extends"] = c["extends"]
        if access := c["access"].split():
            rule["access"] = {a.lstrip("!"): not a.startswith("!") for a in access}
        rule["members"] = [_member(x.strip()) for x in (body or "").split(";") if x.strip()]
        out.append(rule)
    return out


# One-letter names of primitive types in descriptors.
_PRIMITIVES = {"boolean": "Z", "byte": "B", "char": "C", "short": "S", "int": "I", "long": "J", "float": "F", "double": "D", "void": "V"}


def _descriptor(kind: str) -> str | None:
    """Of a Java type; None for patterns."""
    base, _, dims = kind.partition("[")
    if re.search(r"[*?%]|\.\.\.", kind):
        return None
    return "[" * (1 if dims else 0) * kind.count("[") + (_PRIMITIVES.get(base) or f"L{base.replace('.', '/')};")


def _member(text: str) -> dict:
    access: dict[str, bool] = {}
    more: dict = {}
    while m := re.match(r"@([\w.$*?]+)\s+|(!?)(public|private|protected|static|final|abstract|native|synchronized|transient|volatile)\s+", text):
        if m[1]:
            more["annotation"] = m[1]
        else:
            access[m[3]] = not m[2]
        text = text[m.end() :]
    if access:
        more["access"] = access
    if text == "*":
        return {"name": "*", **more}
    if text in ("<methods>", "<fields>"):
        return {"name": "*", "kind": ["METHOD", "FUNCTION"] if text == "<methods>" else ["FIELD", "PROPERTY"], **more}
    call = re.fullmatch(r"(?:(?P<type>[\w.$*?%\[\]]+)\s+)?(?P<name><init>|[\w$*?]+)\s*\((?P<args>.*)\)", text)
    if call:
        kind = ["CONSTRUCTOR"] if call["name"] == "<init>" else ["METHOD", "FUNCTION"]
        types = [_descriptor(x.strip()) for x in call["args"].split(",") if x.strip()]
        back = _descriptor(call["type"]) if call["type"] else "V"
        if None not in types and back is not None and (call["type"] or call["name"] == "<init>"):
            more["descriptor"] = f"({''.join(types)}){back}"
        return {"name": call["name"], "kind": kind, **more}
    return {"name": text.split()[-1], "kind": ["FIELD", "PROPERTY"], **more}


def baseline(spark: SparkSession, text: str) -> DataFrame:
    doc = json.loads(text)
    if doc.get("version") != 1 or not isinstance(doc.get("fingerprints"), list):
        raise ValueError("not a version 1 baseline")
    return spark.createDataFrame([(f,) for f in doc["fingerprints"]], "fingerprint string")


def render_baseline(fingerprints: list[str]) -> str:
    return json.dumps({"fingerprints": sorted(set(fingerprints)), "generatedBy": "weftgraph", "version": 1}, indent=2)


def suppressions(spark: SparkSession, text: str) -> DataFrame:
    import datetime

    doc = json.loads(text)
    if doc.get("version") != 1:
        raise ValueError("not a version 1 list")
    rows = [(x["fingerprint"], x["reason"], datetime.date.fromisoformat(x["expires"])) for x in doc["suppressions"]]
    if any(not r[1].strip() for r in rows):
        raise ValueError("a suppression needs a reason")
    return spark.createDataFrame(rows, "fingerprint string, reason string, expires date")


def traversal_roots(text: str) -> list[str]:
    doc = json.loads(text)
    names = doc if isinstance(doc, list) else [x["usr"] for x in doc["facts"] if x.get("usr")]
    return list(dict.fromkeys(names))
