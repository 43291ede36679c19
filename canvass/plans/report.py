"""HTML report over collected aggregates."""

from __future__ import annotations

import html
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from canvass.operators import charts
from canvass.operators.estimate import weighted_estimates
from canvass.plans.narrative import summary
from canvass.sources.registry import Registry, StoredRegistry


@dataclass(frozen=True)
class Analysis:
    """What an estimate was made of; the version pins the table that charts are drawn from."""

    name: str
    version: int
    table: DataFrame
    weight: str
    targets: tuple[str, ...]
    population: float | None
    estimates: DataFrame


def analyse(registry: Registry | StoredRegistry, name: str, targets: list[str], weight: str, population: float | None = None) -> Analysis:
    table = registry.get(name)
    if table is None:
        raise KeyError(f"no table {name}")
    if not targets:
        raise ValueError("name at least one target")
    return Analysis(name, registry.versions[name], table, weight, tuple(targets), population, weighted_estimates(table, targets, weight, population))


def visuals(analysis: Analysis) -> dict[str, DataFrame | str | None]:
    """Histogram of the first target, box statistics of the numeric ones with points outside their fences, and the text summary."""
    targets = list(analysis.targets)
    return {
        "histogram": charts.histogram(analysis.table, targets[0]), "box": charts.box_stats(analysis.table, targets), "points": charts.outlier_points(analysis.table, targets),
        "summary": summary(analysis.estimates, analysis.name),
    }


def pictures(analysis: Analysis) -> dict[str, str | None]:
    """PNG images of the histogram with its density and of the box plot, for ``report``; None without a plotting library."""
    table, target = analysis.table, analysis.targets[0]
    bins = charts.histogram(table, target)
    held = bins.agg({"count": "sum"}).first()[0]
    scale = held * (lambda r: r["high"] - r["low"])(bins.first()) if held else 0.0
    boxes = charts.box_stats(table, list(analysis.targets))
    return {
        "histogram": charts.png_base64(charts.draw_histogram(bins, charts.density(table, target, scale=scale))) if held else None,
        "box plot": charts.png_base64(charts.draw_boxes(boxes, charts.outlier_points(table, list(analysis.targets)))) if boxes is not None else None,
    }


def _number(x: float | None) -> str:
    return "N/A" if x is None else f"{x:,.4f}"


def report(analysis: Analysis, text: str | None = None, images: dict[str, str | None] | None = None, log: list[str] = (), printing: bool = False) -> str:
    """One HTML page: summary, estimate table, images that there are, and the log. All texts are escaped but the summary."""
    rows = "".join(
        f"<tr><td>{html.escape(r['column'])}</td><td>{_number(r['mean'])}</td><td>{_number(r['std_error'])}</td>"
        f"<td>{_number(r['ci_95_lower'])} to {_number(r['ci_95_upper'])}</td><td>{_number(r['population_estimate'])}</td></tr>"
        for r in analysis.estimates.collect()
    )
    pictures = "".join(f'<figure><img alt="{html.escape(k)}" src="data:image/png;base64,{v}"></figure>' for k, v in (images or {}).items() if v)
    lines = "".join(f"<li>{html.escape(x)}</li>" for x in log)
    return (
        f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(analysis.name)}</title></head><body>'
        f"<h1>{html.escape(analysis.name)}</h1><p>Reference {datetime.now():%Y%m%d-%H%M}</p>"
        + (f"<section>{text}</section>" if text else "")
        + f"<h2>1. Estimates</h2><table><tr><th>Variable</th><th>Mean</th><th>Standard error</th><th>95% interval</th><th>Projection</th></tr>{rows}</table>"
        + (f"<h2>2. Charts</h2>{pictures}" if pictures else "")
        + (f"<h2>3. Workflow</h2><ol>{lines}</ol>" if lines else "")
        + ("<script>window.print()</script>" if printing else "")
        + "</body></html>"
    )
