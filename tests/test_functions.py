import random

import pytest

from weftgraph.functions import naming, sql, url
from weftgraph.operators.architecture import glob_regex
from weftgraph.operators.retention import class_glob
from weftgraph.sources import configs



def statement(r, depth=0):
    """A random statement, and the tables that it reads, in the order they are named in."""
    fresh = lambda k: f"{k}{r.randrange(10**6)}"

    def source():
        if depth < 3 and r.random() < 0.35:
            inner, names = statement(r, depth + 1)
            return f"({inner}) {fresh('q')}", names
        name = fresh("t")
        shown = r.choice([name, f"{name} AS {fresh('a')}", f"{name} {fresh('a')}", f'"{name}"', f"`{name}`"])
        return shown, [name]

    sources, joins = [source() for _ in range(r.randint(1, 3))], [", ", " JOIN ", " LEFT JOIN ", " CROSS JOIN "]
    text, names = sources[0][0], list(sources[0][1])
    for s, n in sources[1:]:
        link = r.choice(joins)
        text += link + s + (" ON 1 = 1" if link.endswith("T JOIN ") or link == " JOIN " else "")
        names += n
    columns = r.choice(["*", "c1, c2", "extract(day FROM c1)", "trim(BOTH 'x' FROM c1)", "substring(c1 FROM 2)", "'FROM hidden'", "c1 /* FROM hidden */"])
    tail = r.choice(["", " WHERE c1 IS DISTINCT FROM c2", " WHERE c1 > 2 -- FROM hidden\n", " GROUP BY c1"])
    if depth < 3 and not tail and r.random() < 0.5:
        inner, more = statement(r, depth + 1)
        tail, names = f" WHERE c1 IN ({inner})", names + more
    out = f"SELECT {columns} FROM {text}{tail}"
    if depth < 2 and r.random() < 0.3:
        inner, more = statement(r, depth + 1)
        local = fresh("w")
        out, names = f"WITH {local} AS ({inner}) SELECT * FROM {local}, ({out}) {fresh('q')}", more + names
    return out, names


@pytest.mark.parametrize("seed", range(60))
def test_relations_of_nested_queries(seed):
    text, names = statement(random.Random(seed))
    found, unknown = sql.relations(text)
    assert sorted(found) == sorted(set(names)) and not unknown, text


@pytest.mark.parametrize("before,names", [("INSERT INTO t0 (c1) ", ["t0"]), ("CREATE TABLE t0 AS ", None)])
def test_relations_of_other_statements(before, names):
    text, inner = statement(random.Random(1))
    found = sql.relations(before + text)[0]
    assert set(inner) <= set(found) and (names is None or set(found) == {*inner, *names})


def test_relations_of_changes():
    assert sql.relations("UPDATE t1 SET c = 1; DELETE FROM t2 WHERE c")[0] == ["t1", "t2"]
    assert sql.relations("the word update alone")[0] == [] and sql.relations("SELECT 1 FROM s.t1, `s.t2`")[0] == ["s.t1", "s%2Et2"]


def test_table_functions_are_unresolved():
    assert sql.relations("SELECT * FROM pragma_table_info('t')") == ([], 1)


def test_url_normal_form():
    assert url.normalize("/a%2fb/%7euser/é/{x}/100%") == "/a%2Fb/~user/%C3%A9/%7Bx%7D/100%25"
    assert url.remove_dots("/a/./b/../c/..") == "/a/"
    assert url.remove_dots("/..", "base") is None and url.remove_dots("/../a") == "/a"
    assert url.mask("/v1/abcdefgh12345678/x") == ("/v1/{}/x", 1)
    assert url.mask("/services/T0/B0", "hooks.slack.com") == ("/{}/{}/{}", 3)
    assert url.mask("/api/webhooks/1/tok", "discord.com:443") == ("/api/webhooks/{}/{}", 2)


@pytest.mark.parametrize("t,why", [("a", "not-rooted"), ("/" + "a" * 5000, "too-long"), ("/{**}/a", "catch-all-not-last"), ("/a{**}", "catch-all-partial"), ("/%zz", "malformed-percent"), ("/%2f", "lowercase-percent-hex"), ("/%41", "encoded-unreserved"), ("/{a}", "stray-brace"), ("/{}{}", "multiple-parameters"), ("/é", "invalid-character"), ("/a/{}/{**}", None)])
def test_url_grammar(t, why):
    assert url.validate(t) == why


def test_names():
    assert naming.snake("fooBarBaz") == "foo_bar_baz" and naming.snake("a.bURL", 6) == "a_burl"
    assert naming.snake("line1Item", 7) == "line1_item" and naming.snake("line1Item", 6) == "line1item"
    assert naming.snake("fooB") == "foob" and naming.snake("FooBar", 7, quoted=True) == "FooBar"
    assert naming.physical("fooBar", "hibernate-6") == "fooBar"


def test_globs():
    import re

    assert re.match(glob_regex("a.*?"), "a.bcd") and not re.match(glob_regex("a?"), "abc")
    assert re.match(class_glob("com.**.X*"), "com/a/b/Xyz") and not re.match(class_glob("com.*"), "com/a/b")
    assert re.match(class_glob("a+b.$C"), "a+b/$C") and not re.match(class_glob("a+b"), "aab")


def test_layer_file():
    layers, rules = configs.layer_yaml('layers:\n  - name: ui\n    match: [com.ui.*, "x"]\n  - name: db\n    match: [com.db.*]\nrules:\n  - from: ui # note\n    deny: [db]\n')
    assert layers == [("ui", ["com.ui.*", "x"]), ("db", ["com.db.*"])] and rules == [{"name": "ui dependency rule", "from": "ui", "deny": ["db"]}]
    for bad in ("layer:\n", "layers:\n  - name: a\n", "layers:\n  - name: a\n    match: [x]\n    match: [y]\n", "layers:\n  - name: a\n    match: [x]\nrules:\n  - from: b\n    deny: [a]\n"):
        with pytest.raises(ValueError):
            configs.layer_yaml(bad)


def test_keep_rule_file():
    rules = configs.keep_rules("# c\n-keep public class com.a.* extends b.C { *; }\n-keepclassmembers class ** {\n  void on*(int);\n  <init>(...);\n}\n-dontwarn x.**\n-dontshrink\n")
    assert [r["line"] for r in rules] == [2, 3, 8]
    assert rules[0]["extends"] == "b.C" and rules[0]["access"] == {"public": True} and rules[1]["members_only"]
    assert rules[1]["members"] == [{"name": "on*", "kind": ["METHOD", "FUNCTION"], "descriptor": "(I)V"}, {"name": "<init>", "kind": ["CONSTRUCTOR"]}]
    with pytest.raises(ValueError):
        configs.keep_rules("-what class x\n")
