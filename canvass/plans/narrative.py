"""Templated text summary of an estimate table."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

from canvass.operators.estimate import reliability

NOTHING = "There are no estimates to summarise yet."


def summary(estimates: DataFrame, title: str = "the survey", absolute: bool = False) -> str:
    """Title, introduction, a paragraph for each variable and a note on method, joined for HTML."""
    rows = reliability(estimates, absolute).collect()  # a row for each target
    if not rows:
        return NOTHING
    parts = [f"<b>Summary of {html.escape(title)}</b>", f"Weighted estimates were made for {len(rows)} variable{'s' * (len(rows) > 1)}."]
    for r in rows:
        if r["mean"] is None:
            parts.append(f"<b>{html.escape(r['column'])}</b>: the weights sum to zero, so there is no estimate.")
            continue
        text = f"<b>{html.escape(r['column'])}</b>: the weighted mean is {r['mean']:,.2f}"
        if r["ci_95_lower"] is not None:
            text += f" (95% interval {r['ci_95_lower']:,.2f} to {r['ci_95_upper']:,.2f})"
        if r["std_error"] is not None:
            text += f", with a standard error of {r['std_error']:,.4f} at an effective sample of {r['n_effective']:,.2f}"
        text += f", of {r['reliability']} reliability" + (f" at a coefficient of variation of {r['cv']:.1f}%." if r["cv"] is not None else ".")
        if r["population_estimate"] is not None:
            text += f" Projected to the population, the total is {r['population_estimate']:,.2f}."
        parts.append(text)
    parts.append("Method: design weights, effective sample size after Kish, Student intervals on its degrees of freedom.")
    return "<br><br>".join(parts)
