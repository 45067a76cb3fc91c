"""Reports as Markdown, from tables of a few dozen rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tripforge.operators.evaluate import MODELS


def markdown_table(head: list[str], rows: list[list]) -> list[str]:
    """None is a dash; numbers with a fraction have four digits."""
    told = lambda x: "-" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    line = lambda cells: "| " + " | ".join(map(told, cells)) + " |"
    return [line(head), "|" + "---|" * len(head), *map(line, rows)]


def cluster_report(grid: DataFrame, deltas: DataFrame | None = None) -> str:
    """The candidates of `density.experiment` and, if given, of `density.policy_deltas`."""
    rows = grid.orderBy("policy", "size", "min_cluster_size", "min_samples").collect()
    places = sorted({place for r in rows for place in (r.coverage or {})})
    head = ["policy", "size", "min_cluster_size", "min_samples", "clusters", "noise", "radius p90 km", *places, "status"]
    body = [[r.policy, r["size"], r.min_cluster_size, r.min_samples, r.clusters, r.noise_ratio, r.radius_p90_km, *((r.coverage or {}).get(x) for x in places), r.status] for r in rows]
    lines = ["# Areas by density", "", f"{sum(r.status == 'ok' for r in rows)} of {len(rows)} candidates fitted.", "", *markdown_table(head, body)]
    if bad := [r for r in rows if r.message]:
        lines += ["", "## Not fitted", "", *[f"- {r.policy} {r['size']}/{r.min_cluster_size}/{r.min_samples}: {r.message}" for r in bad]]
    if deltas is not None:
        found = deltas.orderBy("size", "min_cluster_size", "min_samples").collect()
        lines += ["", "## Between policies", "", *markdown_table(["size", "min_cluster_size", "min_samples", "clusters", "noise"], [[r["size"], r.min_cluster_size, r.min_samples, r.clusters_delta, r.noise_ratio_delta] for r in found])]
    return "\n".join(lines) + "\n"


def evaluation_report(selection: dict, validation: DataFrame, test: DataFrame, limits: list[str] = ()) -> str:
    """selection: of `release.select_model`; the others: `evaluate.metrics` of a split."""
    overall = lambda df: {r.model: r for r in df.where("grouping = 'overall'").collect()}
    a, b = overall(validation), overall(test)
    get = lambda side, m, c: side[m][c] if m in side else None
    body = [[m, get(a, m, "hit5"), get(a, m, "mrr5"), get(b, m, "hit5"), get(b, m, "mrr5")] for m in MODELS if m in a or m in b]
    lines = ["# Rankers", "", *[f"- {k.replace('_', ' ')}: {v}" for k, v in selection.items()], *[f"- {name} questions: {max((r.questions for r in side.values()), default=0)}" for name, side in (("validation", a), ("test", b))]]
    lines += ["", *markdown_table(["model", "validation hit@5", "validation MRR@5", "test hit@5", "test MRR@5"], body)]
    if limits:
        lines += ["", "## Limits", "", *[f"- {x}" for x in limits]]
    return "\n".join(lines) + "\n"
