"""What users ask of a graph, from inputs to rows: evidence, what it reaches, findings, impact, rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from weftgraph import schema as S
from weftgraph.graph import Graph
from weftgraph.iterate import settled
from weftgraph.operators import architecture as A
from weftgraph.operators import impact as I
from weftgraph.operators import reach as R
from weftgraph.operators import retention as K
from weftgraph.operators import review as W
from weftgraph.operators import traverse as T
from weftgraph.sources import configs, documents


@dataclass(frozen=True)
class Inputs:
    """What there is besides the graph; all of it can be missing.

    ``evidence`` from other tools (S.RETENTION), service ``providers``, parsed keep ``rules``, the
    ``hierarchy`` of library classes, ``observed`` ids, open ``channels`` (path, channels), and
    ``baseline`` and ``suppressions`` of findings.
    """

    evidence: DataFrame | None = None
    providers: DataFrame | None = None
    rules: list[dict] = field(default_factory=list)
    hierarchy: DataFrame | None = None
    observed: DataFrame | None = None
    channels: DataFrame | None = None
    baseline: DataFrame | None = None
    suppressions: DataFrame | None = None
    private_members: bool = False


def _or_empty(g: Graph, df: DataFrame | None, schema: str) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([], schema) if df is None else df


def evidence(g: Graph, inputs: Inputs) -> DataFrame:
    """All evidence: what is given, and what follows from the graph, services and keep rules."""
    return K.default_evidence(g, _or_empty(g, inputs.evidence, S.RETENTION), inputs.providers, inputs.rules, inputs.hierarchy, inputs.private_members)


def reach(g: Graph, inputs: Inputs) -> DataFrame:
    """id, depth of what evidence reaches."""
    return R.reach(g, settled(evidence(g, inputs)))


def dead(g: Graph, inputs: Inputs, today: str = "1970-01-01") -> DataFrame:
    """id, path, line, fingerprint, status (new, baseline, suppressed), confidence of what nothing reaches."""
    reached = settled(reach(g, inputs))
    found = settled(R.dead_findings(g, reached, inputs.private_members))
    sure = R.finding_confidence(found, inputs.observed, _or_empty(g, inputs.channels, "path string, channels long"))
    marked = R.finding_delta(found, _or_empty(g, inputs.baseline, "fingerprint string"), _or_empty(g, inputs.suppressions, "fingerprint string, expires date"), today)
    return marked.join(sure.select("id", "confidence"), "id")


@dataclass(frozen=True)
class Report:
    """``rows`` asked for, ``summary`` of all of them, ``limitations``, and all as lines of a ``document``."""

    rows: DataFrame
    summary: DataFrame
    limitations: DataFrame
    document: DataFrame


def impact(revisions: dict[str, Graph], symbols: list[str] = (), files: list[str] = (), sort: str = "USR", limit: int = 500, offset: int = 0, path_limit: int | None = 100_000, visit_limit: int | None = 100_000, max_depth: int = 100, **filters) -> Report:
    """What changes of ``symbols`` and ``files`` can affect in any of ``revisions``: the page of the matching
    nodes in order, counts of all matching ones, and what the search left out."""
    changed, status = I.seeds(revisions, list(symbols), list(files))
    changed = settled(changed)
    items = settled(I.filtered(I.impact(revisions, changed, path_limit, max_depth=max_depth, visit_limit=visit_limit), **filters))
    nodes = revisions[list(revisions)[-1]].nodes
    reached = [name for name, g in revisions.items() if visit_limit is not None and I.affected(g, changed, max_depth, visit_limit).count() >= visit_limit]
    said = W.impact_limitations(items, nodes, path_limit or 0, visit_limit or 0, reached, limit, offset)
    rows, counts = I.sorted_page(items, sort, limit, offset), I.summary(items)
    return Report(rows, counts, said, documents.impact(status, counts, rows, said))


def traverse(g: Graph, edges: DataFrame, requested: list[str], max_depth: int = 128, max_reached: int | None = 100_000, **options) -> Report:
    """What several roots reach over ``edges`` (``dispatch.tiers``), with the number of nodes by depth."""
    roots = settled(T.resolve_roots(g.nodes, requested))
    rows = settled(T.traverse(edges, roots, max_depth=max_depth, max_reached=max_reached, **options))
    said = W.traversal_limitations(rows, roots, requested, max_depth, max_reached if max_reached is not None else (1 << 31) - 1)
    return Report(rows, rows.groupBy("depth").count(), said, documents.traversal(rows, said))


def rules(g: Graph, text: str) -> tuple[DataFrame, DataFrame]:
    """(violations, units that no layer has) of a layer file's text."""
    layers, allowed = configs.layer_yaml(text)
    return A.layer_violations(g, layers, allowed), A.layer_unassigned(g, layers)
