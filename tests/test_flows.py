from collections import deque

import pytest

from tests.test_callbacks import make, method  # noqa: F401
from tests.test_graph import edge, node
from weftgraph.operators import flows as X

BODY, MAKER, SAM = "method:a/View#draw$lambda()V", "method:a/View#draw()V", "run()V"
RUN = "method:java/lang/Runnable#run()V"


def fn(name):
    return f"method:a/Kit#{name}(Ljava/lang/Runnable;)V"


def declared(m):
    return (m, 0, "DECLARED", None, None, None)


def runs(m, target=RUN):
    return (m, 0, "RECEIVER", target, "INTERFACE", None)


def gives(m, to, kind="STATIC"):
    return (m, 0, "ARGUMENT", to, kind, 0)


def catches(m, to):
    return (m, 0, "CAPTURE", to, "BOOTSTRAP", 0)


def field(m):
    return (m, 0, "FIELD", "field:a/Kit#kept", None, None)


def show(c):
    return f"method:a/{c}#show(Ljava/lang/Runnable;)V"


def chain(n):
    steps = [fn(f"s{i}") for i in range(n)]
    return steps[0], [u for a, b in zip(steps, steps[1:], strict=False) for u in (declared(a), gives(a, b))] + [declared(steps[-1]), runs(steps[-1])]


F_, G_, LOCAL = fn("f"), fn("g"), "class:a/View$1"
RUN_BODY, BRIDGE, AGAIN, LATER = "method:a/View$1#run()V", "method:a/View$1#run(I)V", "method:a/Kit#f$1(Ljava/lang/Runnable;)V", "method:a/Kit#f$2(Ljava/lang/Runnable;)V"
BOX = [node("class:a/Box", kind="INTERFACE", modifiers=["ABSTRACT"]), node("class:a/One", supertypes=["a/Box"]), method(show("Box"), modifiers=["ABSTRACT"])]
CLASS = [node(LOCAL), method(RUN_BODY), method(BRIDGE), node("method:a/View$1#<init>()V", kind="CONSTRUCTOR")]
MEMBERS = [edge(LOCAL, x, "MEMBER") for x in (RUN_BODY, BRIDGE, "method:a/View$1#<init>()V")]
CHECK = "method:kotlin/jvm/internal/Intrinsics#checkNotNullParameter(Ljava/lang/Object;Ljava/lang/String;)V"
ONCE = [declared(F_), runs(F_)]
BOUND, CANDIDATE = {("f", BODY): "BOUND"}, {("f", BODY): "CANDIDATE"}
# name: what is called and its uses, what else there is; edges and outcomes
CASES = {
    "chain": (dict(callee=F_, uses=[declared(F_), gives(F_, G_), declared(G_), runs(G_), gives(G_, CHECK), runs(G_, "method:java/lang/Object#hashCode()I")]), {("f", BODY): "BOUND", ("g", BODY): "BOUND"}, [("bound", ())]),
    "field": (dict(callee=F_, uses=[*ONCE, field(F_)]), CANDIDATE, [("candidate", ())]),
    "return": (dict(callee=F_, uses=[*ONCE, (F_, 0, "RETURN", None, None, None)]), CANDIDATE, [("candidate", ())]),
    "given back": (dict(callee=F_, uses=[*ONCE, gives(F_, "method:java/util/Objects#requireNonNull(Ljava/lang/Object;)Ljava/lang/Object;")]), CANDIDATE, [("candidate", ())]),
    "receiver": (dict(callee=F_, uses=[*ONCE, runs(F_, "method:a/Listener#fire()V")], nodes=[node("class:a/Listener", kind="INTERFACE")]), CANDIDATE, [("candidate", ())]),
    "only kept": (dict(callee=F_, uses=[declared(F_), field(F_)]), {}, [("unresolved", ("field",))]),
    "unknown": (dict(callee=F_, uses=[declared(F_), gives(F_, G_)]), {}, [("unresolved", ("unanalyzed",))]),
    "unused": (dict(callee=F_, uses=[declared(F_)]), {}, [("unused", ())]),
    "too deep": (dict(zip(("callee", "uses"), chain(10), strict=True)), {}, [("unresolved", ("depth",))]),
    "deep": (dict(zip(("callee", "uses"), chain(9), strict=True)), {(f"s{i}", BODY): "BOUND" for i in range(9)}, [("bound", ())]),
    "one body": (dict(callee=show("Box"), uses=[declared(show("One")), runs(show("One"))], nodes=BOX, invocation="INTERFACE"), {("show", BODY): "BOUND"}, [("bound", ())]),
    "two bodies": (dict(callee=show("Box"), uses=[declared(show("One")), runs(show("One"))], nodes=[*BOX, node("class:a/Two", supertypes=["a/Box"]), method(show("Two"))], invocation="INTERFACE"), {}, [("unresolved", ("dispatch",))]),
    "inherited": (dict(callee=show("Down"), uses=[declared(show("Up")), runs(show("Up"))], nodes=[node("class:a/Up"), node("class:a/Down", supertypes=["a/Up"]), method(show("Up"))], invocation="SPECIAL", absent=[show("Down")]), {("show", BODY): "BOUND"}, [("bound", ())]),
    "no such": (dict(callee=show("Down"), uses=[declared(F_)], nodes=[node("class:a/Down")], absent=[show("Down")]), {}, [("unresolved", ("unresolved-callee",))]),
    "library": (dict(callee=F_, uses=[declared(F_), gives(F_, "method:ext/Lib#button(Ljava/lang/Runnable;)V")], nodes=CLASS, edges=MEMBERS, lambda_=LOCAL, sam=None), {("f", RUN_BODY): "CANDIDATE", ("f", BRIDGE): "CANDIDATE"}, [("candidate", ())]),
    "local class": (dict(callee=F_, uses=ONCE, nodes=CLASS, edges=MEMBERS, lambda_=LOCAL, sam=None), {("f", RUN_BODY): "BOUND"}, [("bound", ())]),
    "fed back": (dict(callee=F_, uses=[*ONCE, catches(F_, AGAIN), declared(AGAIN), gives(AGAIN, F_)]), {("f", BODY): "BOUND", ("f$1", BODY): "BOUND"}, [("bound", ())]),
    "captured": (dict(callee=F_, uses=[declared(F_), catches(F_, LATER), declared(LATER), runs(LATER)]), {("f", BODY): "CANDIDATE", ("f$2", BODY): "CANDIDATE"}, [("candidate", ())]),
    "captured outside": (dict(callee=F_, uses=[declared(F_), catches(F_, "method:ext/X#x()V")]), {}, [("unresolved", ("capture",))]),
    "escaped": (dict(callee=F_, uses=ONCE, escapes=[(MAKER, BODY)]), CANDIDATE, [("candidate", ())]),
    "given away": (dict(callee=F_, uses=ONCE, more=[(MAKER, BODY, "method:ext/Lib#keep(Ljava/lang/Runnable;)V", "STATIC", 0, SAM)]), CANDIDATE, [("candidate", ()), ("library", ())]),
    "looked at": (dict(callee=F_, uses=ONCE, more=[(MAKER, BODY, "method:kotlin/jvm/internal/Intrinsics#checkNotNull(Ljava/lang/Object;)V", "STATIC", 0, SAM)]), BOUND, [("bound", ()), ("library", ())]),
    "two ways": (dict(callee=G_, uses=[declared(G_), gives(G_, fn("c")), field(G_), declared(F_), gives(F_, fn("c")), declared(fn("c")), runs(fn("c"))], more=[(MAKER, BODY, F_, "STATIC", 0, SAM)]), {(x, BODY): "CANDIDATE" for x in "fgc"}, [("candidate", ())] * 2),
}


def renamed(x, to):
    """``x`` with the package ``a`` called ``to``, in whatever it holds."""
    if isinstance(x, str):
        return x.replace(":a/", f":{to}/") if ":" in x else f"{to}/" + x[2:] if x.startswith("a/") else x
    return type(x)(renamed(y, to) for y in x) if isinstance(x, list | tuple) else {k: renamed(v, to) for k, v in x.items()} if isinstance(x, dict) else x


@pytest.fixture(scope="module")
def results(make, spark):  # noqa: F811
    """Edges and flows of all cases by their package, found in one run."""
    nodes, edges, arguments, uses, escapes = [], [], [], [], []
    for i, (case, *_) in enumerate(CASES.values()):
        case = {"nodes": [], "edges": [], "more": [], "escapes": [], "absent": [], "invocation": "STATIC", "lambda_": BODY, "sam": SAM} | case
        given = [(MAKER, case["lambda_"], case["callee"], case["invocation"], 0, case["sam"]), *case["more"]]
        there = {n["id"] if isinstance(n, dict) else n[0] for n in case["nodes"]}
        ids = {x for x in (BODY, MAKER, *(a[2] for a in given), *(u[0] for u in case["uses"]), *(u[3] for u in case["uses"])) if x and x.startswith("method:a/")} - there - {*case["absent"]}
        to = f"c{i}"
        nodes += renamed([*case["nodes"], *map(method, sorted(ids))], to)
        edges += renamed(case["edges"], to)
        arguments += renamed(given, to)
        uses += renamed(case["uses"], to)
        escapes += renamed(case["escapes"], to)
    return X.callback_flows(make(nodes, edges), spark.createDataFrame(arguments, X.ARGUMENTS), spark.createDataFrame(uses, X.USES), spark.createDataFrame(escapes, X.ESCAPES))


def test_cases(results):
    edges, flows = (df.collect() for df in results)
    for i, (name, (_, tiers, state)) in enumerate(CASES.items()):
        mine = f"method:c{i}/"
        back = lambda x, i=i: x.replace(f":c{i}/", ":a/")
        assert {(r.source.split("#")[1].split("(")[0], back(r.target)): r.tier for r in edges if r.source.startswith(mine)} == tiers, name
        assert sorted((r.outcome, tuple(r.reasons)) for r in flows if r.caller.startswith(mine)) == state, name


def test_summary_and_edges_of_a_traversal(results):
    edges, flows = results
    found = {(r.outcome, r.reason): r.n for r in X.callback_summary(flows).collect()}
    assert found[("unresolved", None)] == 6 and found[("unresolved", "depth")] == 1 and ("unused", None) not in found
    assert all(r.terminal and r.relationship == "callback" for r in X.callback_edges(edges).collect())


def test_random_graphs_like_a_walk(make, spark):  # noqa: F811
    import random

    r = random.Random(4)
    names = [fn(f"m{i}") for i in range(14)]
    uses = [declared(m) for m in names[:12]]
    for m in names:
        uses += [r.choice([gives, gives, catches])(m, r.choice(names)) for _ in range(r.randint(0, 2))]
        uses += [runs(m)] * (r.random() < 0.3) + [field(m)] * (r.random() < 0.2) + [gives(m, "method:ext/L#x()V")] * (r.random() < 0.1)
    arguments = [(f"method:a/V#v{i}()V", f"method:a/V#v{i}$b()V", m, "STATIC", 0, SAM) for i, m in enumerate(names)]
    g = make([method(m) for m in names] + [method(a[k]) for a in arguments for k in (0, 1)])
    edges, flows = X.callback_flows(g, spark.createDataFrame(arguments, X.ARGUMENTS), spark.createDataFrame(uses, X.USES), spark.createDataFrame([], X.ESCAPES), depth=3)
    expected, outcomes = set(), {}
    for _, body, start, *_ in arguments:
        seen, queue, links, sites, why, library = {start: 0}, deque([start]), set(), set(), set(), False
        while queue:
            m = queue.popleft()
            mine = [u for u in uses if u[0] == m]
            if declared(m) not in mine:
                why.add("unanalyzed")
                continue
            for _, _, kind, target, *_ in mine:
                if kind == "RECEIVER":
                    sites.add(m)
                elif kind == "FIELD":
                    why.add("field")
                elif kind in ("ARGUMENT", "CAPTURE") and target in names:
                    links.add((m, target, kind))
                    if target not in seen and seen[m] < 3:
                        seen[target] = seen[m] + 1
                        queue.append(target)
                    elif target not in seen:
                        why.add("depth")
                elif kind == "ARGUMENT":
                    library = True
                    sites.add(m)

        def reach(at, kinds, links=links):
            found, todo = {at}, [at]
            while todo:
                x = todo.pop()
                todo += [b for a, b, k in links if a == x and k in kinds and b not in found]
                found |= {b for a, b, k in links if a == x and k in kinds}
            return found

        if reach(start, ("ARGUMENT", "CAPTURE")) & sites != reach(start, ("ARGUMENT",)) & sites:
            why.add("closure")
        mine = {m for m in seen if reach(m, ("ARGUMENT", "CAPTURE")) & sites}
        tier = "CANDIDATE" if why or library else "BOUND"
        expected |= {(m, body, tier) for m in mine}
        outcomes[body] = tier.lower() if mine else "unresolved" if why else "unused"
    assert {(x.source, x.target, x.tier) for x in edges.collect()} == expected
    assert {x["lambda"]: x.outcome for x in flows.collect()} == outcomes and len(set(outcomes.values())) >= 3
