"""JVM class files to rows: a class, its members, and the edges and calls of its code.

The format is that of the JVM specification, chapter 4.
"""

from __future__ import annotations

import re
import struct
from collections import Counter

import pyarrow as pa

_MEMBER = "struct<id:string,name:string,kind:string,line:int,visibility:string,modifiers:array<string>,annotations:array<string>,constant:boolean,synthesized:boolean>"
_EDGE = "struct<source:string,target:string,kind:string,weight:bigint,origin:string,lines:array<int>>"
_CALL = "struct<caller:string,owner:string,name:string,descriptor:string,kind:string,ordinal:int>"
SCHEMA = f"root string, name string, kind string, source string, visibility string, modifiers array<string>, annotations array<string>, supertypes array<string>, synthesized boolean, enclosing string, members array<{_MEMBER}>, edges array<{_EDGE}>, calls array<{_CALL}>"

_strings = pa.list_(pa.string())
_ARROW = pa.schema(
    [
        *((c, pa.string()) for c in ("root", "name", "kind", "source", "visibility")),
        ("modifiers", _strings), ("annotations", _strings), ("supertypes", _strings), ("synthesized", pa.bool_()), ("enclosing", pa.string()),
        ("members", pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("visibility", pa.string()), ("modifiers", _strings), ("annotations", _strings), ("constant", pa.bool_()), ("synthesized", pa.bool_())]))),
        ("edges", pa.list_(pa.struct([("source", pa.string()), ("target", pa.string()), ("kind", pa.string()), ("weight", pa.int64()), ("origin", pa.string()), ("lines", pa.list_(pa.int32()))]))),
        ("calls", pa.list_(pa.struct([("caller", pa.string()), ("owner", pa.string()), ("name", pa.string()), ("descriptor", pa.string()), ("kind", pa.string()), ("ordinal", pa.int32())]))),
    ]
)

# Bytes after each opcode, by rule: most have none.
_LENGTH = dict.fromkeys(range(256), 0)
_LENGTH |= dict.fromkeys((16, 18, *range(21, 26), *range(54, 59), 169, 188), 1)
_LENGTH |= dict.fromkeys((17, 19, 20, 132, *range(153, 169), *range(178, 185), 187, 189, 192, 193, 198, 199), 2)
_LENGTH |= dict.fromkeys((197,), 3) | dict.fromkeys((185, 186, 200, 201), 4)
_INVOKE = {182: "VIRTUAL", 183: "SPECIAL", 184: "STATIC", 185: "INTERFACE", 186: "BOOTSTRAP"}
_TYPE = re.compile(r"L([^;<]+)[;<]")
_WIDTH = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def u1(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def u2(self) -> int:
        self.at += 2
        return struct.unpack_from(">H", self.data, self.at - 2)[0]

    def u4(self) -> int:
        self.at += 4
        return struct.unpack_from(">I", self.data, self.at - 4)[0]

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]


class _Class:
    def __init__(self, data: bytes):
        r = self.r = _Reader(data)
        if r.u4() != 0xCAFEBABE:
            raise ValueError("not a class file")
        r.take(4)
        self.pool: list = [None] * r.u2()
        i = 1
        while i < len(self.pool):
            tag = r.u1()
            self.pool[i] = (tag, r.take(r.u2()).decode("utf-8", "replace") if tag == 1 else r.take(_WIDTH[tag]))
            i += 2 if tag in (5, 6) else 1
        self.access, this, up = r.u2(), r.u2(), r.u2()
        self.name = self.string(this)
        self.supers = ([self.string(up)] if up else []) + [self.string(r.u2()) for _ in range(r.u2())]
        self.fields = [self.member() for _ in range(r.u2())]
        self.methods = [self.member() for _ in range(r.u2())]
        self.attributes = self.read_attributes(r)

    def pair(self, i: int) -> tuple[int, int]:
        return struct.unpack(">HH", self.pool[i][1])

    def utf(self, i: int) -> str:
        return self.pool[i][1]

    def string(self, i: int) -> str:
        return self.utf(struct.unpack(">H", self.pool[i][1])[0])

    def reference(self, i: int) -> tuple[str, str, str]:
        """owner, name, descriptor; of a dynamic call the owner of its bootstrap is not here."""
        a, b = self.pair(i)
        name, kind = self.pair(b)
        return (self.string(a) if self.pool[i][0] in (9, 10, 11) else ""), self.utf(name), self.utf(kind)

    def read_attributes(self, r: _Reader) -> dict[str, bytes]:
        return {self.utf(r.u2()): r.take(r.u4()) for _ in range(r.u2())}

    def member(self):
        r = self.r
        return r.u2(), self.utf(r.u2()), self.utf(r.u2()), self.read_attributes(r)

    def annotations(self, attributes: dict[str, bytes]) -> list[str]:
        out = []
        for k in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
            if k in attributes:
                r = _Reader(attributes[k])
                for _ in range(r.u2()):
                    out.append(self.utf(r.u2())[1:-1])
                    for _ in range(r.u2()):
                        r.u2()
                        self.skip_value(r)
        return sorted(set(out))

    def skip_value(self, r: _Reader) -> None:
        tag = chr(r.u1())
        if tag == "e":
            r.take(4)
        elif tag == "@":
            r.u2()
            for _ in range(r.u2()):
                r.u2()
                self.skip_value(r)
        elif tag == "[":
            for _ in range(r.u2()):
                self.skip_value(r)
        else:
            r.u2()

    def code(self, attribute: bytes):
        """(offset, opcode, pool index) of instructions that name something, and offset -> line."""
        r = _Reader(attribute)
        r.take(4)
        code = r.take(r.u4())
        r.take(8 * r.u2())
        lines: list[tuple[int, int]] = []
        for k, v in self.read_attributes(r).items():
            if k == "LineNumberTable":
                t = _Reader(v)
                lines += [(t.u2(), t.u2()) for _ in range(t.u2())]
        found, at = [], 0
        while at < len(code):
            op = code[at]
            if op in (170, 171):
                base = at + 4 - at % 4
                low, high = struct.unpack_from(">ii", code, base + 4)
                at = base + (12 + 4 * (high - low + 1) if op == 170 else 8 + 8 * low)
                continue
            if op == 196:
                at += 6 if code[at + 1] == 132 else 4
                continue
            if op in _INVOKE or 178 <= op <= 181 or op in (187, 189, 192, 193, 197, 18, 19):
                found.append((at, op, code[at + 1] if op == 18 else struct.unpack_from(">H", code, at + 1)[0]))
            at += 1 + _LENGTH[op]
        return found, sorted(lines)


def _line(lines: list[tuple[int, int]], at: int) -> int | None:
    best = None
    for start, n in lines:
        if start > at:
            break
        best = n
    return best


def _visibility(a: int) -> str:
    return "PUBLIC" if a & 1 else "PRIVATE" if a & 2 else "PROTECTED" if a & 4 else "PACKAGE_PRIVATE"


def _modifiers(a: int, method: bool = True) -> list[str]:
    flags = {0x10: "FINAL", 0x400: "ABSTRACT", 0x1000: "SYNTHETIC", 0x8: "STATIC"} | ({0x100: "NATIVE"} if method else {})
    return sorted(v for k, v in flags.items() if a & k)


def parse(data: bytes, root: str) -> dict:
    c = _Class(data)
    me, edges = f"class:{c.name}", Counter()
    lines_of: dict[tuple, set[int]] = {}

    def edge(source: str, target: str, kind: str, line: int | None = None) -> None:
        if source != target and not target.startswith("class:["):
            edges[source, target, kind] += 1
            if line:
                lines_of.setdefault((source, target, kind), set()).add(line)

    def types(source: str, text: str) -> None:
        for t in _TYPE.findall(text):
            edge(source, f"class:{t}", "REFERENCE")

    for s in c.supers:
        edge(me, f"class:{s}", "INHERITANCE")
    members, calls = [], []
    for method, group in ((False, c.fields), (True, c.methods)):
        for access, name, kind, attributes in group:
            id_ = f"method:{c.name}#{name}{kind}" if method else f"field:{c.name}#{name}:{kind}"
            edge(me, id_, "MEMBER")
            edge(id_, me, "REFERENCE")
            if name == "<clinit>":
                edge(me, id_, "CALL")
            types(id_, kind)
            if "Signature" in attributes:
                types(id_, c.utf(struct.unpack(">H", attributes["Signature"])[0]))
            notes = c.annotations(attributes)
            for a in notes:
                edge(id_, f"class:{a}", "ANNOTATION")
            first = None
            if "Code" in attributes:
                found, lines = c.code(attributes["Code"])
                first = lines[0][1] if lines else None
                for ordinal, (at, op, i) in enumerate(found):
                    if op in _INVOKE:
                        owner, n, d = c.reference(i)
                        if owner and not owner.startswith("["):
                            edge(id_, f"method:{owner}#{n}{d}", "CALL", _line(lines, at))
                            edge(id_, f"class:{owner}", "REFERENCE")
                        calls.append({"caller": id_, "owner": owner, "name": n, "descriptor": d, "kind": _INVOKE[op], "ordinal": ordinal})
                    elif 178 <= op <= 181:
                        owner, n, d = c.reference(i)
                        edge(id_, f"field:{owner}#{n}:{d}", "FIELD_ACCESS")
                        edge(id_, f"class:{owner}", "REFERENCE")
                    elif c.pool[i][0] == 7:
                        t = c.string(i)
                        edge(id_, f"class:{t}", "REFERENCE") if t[0] != "[" else types(id_, t)
            what = "FIELD" if not method else "CONSTRUCTOR" if name == "<init>" else "METHOD"
            members.append({"id": id_, "name": name, "kind": what, "line": first, "visibility": _visibility(access), "modifiers": _modifiers(access, method), "annotations": notes, "constant": "ConstantValue" in attributes, "synthesized": bool(access & 0x1000)})
    a = c.access
    kind = "ANNOTATION_CLASS" if a & 0x2000 else "INTERFACE" if a & 0x200 else "ENUM" if a & 0x4000 else "CLASS"
    enclosing = None
    if "EnclosingMethod" in c.attributes:
        owner, where = struct.unpack(">HH", c.attributes["EnclosingMethod"])
        enclosing = f"class:{c.string(owner)}"
        if where:
            n, d = c.pair(where)
            enclosing = f"method:{c.string(owner)}#{c.utf(n)}{c.utf(d)}"
        edge(me, f"class:{c.string(owner)}", "REFERENCE")
    notes = c.annotations(c.attributes)
    for x in notes:
        edge(me, f"class:{x}", "ANNOTATION")
    source = c.utf(struct.unpack(">H", c.attributes["SourceFile"])[0]) if "SourceFile" in c.attributes else None
    return {
        "root": root, "name": c.name, "kind": kind, "source": source, "visibility": _visibility(a), "modifiers": _modifiers(a & ~0x28), "annotations": notes,
        "supertypes": c.supers, "synthesized": bool(a & 0x1000), "enclosing": enclosing, "members": members,
        "edges": [{"source": s, "target": t, "kind": k, "weight": n, "origin": "BYTECODE", "lines": sorted(lines_of.get((s, t, k), ()))} for (s, t, k), n in edges.items()],
        "calls": calls,
    }


def parsed(batches):
    """Rows of SCHEMA from batches of (root, name, content)."""
    for b in batches:
        rows = [parse(data, root) for root, data in zip(b.column("root").to_pylist(), b.column("content").to_pylist(), strict=True)]
        for i in range(0, max(1, len(rows)), 200):
            yield pa.RecordBatch.from_pylist(rows[i : i + 200], schema=_ARROW)
