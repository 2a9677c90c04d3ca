"""Markdown reports from one-row summaries; tables are collected only up to a stated number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wording a methods section should not claim.
CLAIMS = ("proves", "proven", "definitively", "objective truth", "unbiased", "guarantees", "certainly", "undoubtedly", "fully validated", "perfectly", "always correct")


def table(df: DataFrame, rows: int = 50) -> str:
    """The first rows as a markdown table."""
    from ..sources.writers import flat

    page = flat(df).limit(rows).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in page])


def executive_summary(summary: DataFrame, frequencies: DataFrame, top: int = 5) -> str:
    """Headline figures and the codes by count (not by id)."""
    s = summary.first().asDict()
    best = frequencies.orderBy(F.desc("count"), "code_id").limit(top).collect()
    out = ["# Executive summary", "", f"- Responses: {s['n_responses']}", f"- Codes in use: {s['n_active']} of {s['n_codes']}", f"- Coverage: {s['coverage']:.1f} %", f"- Codes per response: {s['mean_codes']:.2f}", ""]
    if best:
        out += [f"Dominant theme: {best[0]['code_id']} ({best[0]['count']})", "", "## Most frequent codes", ""]
        out += [f"{i}. {r['code_id']}: {r['count']} ({r['percentage']:.1f} %)" for i, r in enumerate(best, 1)]
    return "\n".join(out)


def insights(summary: DataFrame, frequencies: DataFrame) -> list[str]:
    """Plain sentences from fixed thresholds."""
    s = summary.first().asDict()
    out = []
    if s["coverage"] >= 80:
        out.append(f"Coverage is high: {s['coverage']:.1f} % of the responses have a code.")
    elif s["coverage"] < 50:
        out.append(f"Coverage is low: only {s['coverage']:.1f} % of the responses have a code; consider more codes or a lower threshold.")
    if s["mean_codes"] > 2:
        out.append(f"Responses touch several themes: {s['mean_codes']:.2f} codes on average.")
    top = frequencies.orderBy(F.desc("count"), "code_id").limit(1).collect()
    if top and top[0]["percentage"] > 40:
        out.append(f"{top[0]['code_id']} dominates with {top[0]['percentage']:.1f} % of the responses.")
    if s["n_codes"] > s["n_active"]:
        out.append(f"{s['n_codes'] - s['n_active']} codes are not used.")
    return out


def recommendations(health: DataFrame) -> list[str]:
    h = health.first().asDict()
    rules = (
        (h["uncoded"] > 0.2, "Many responses have no code: lower the confidence threshold or add codes."),
        (h["unused"] > 0, "Some codes are never used: merge or remove them."),
        ((h["ratio"] or 0) > 10, "Code sizes are very unequal: split the largest codes."),
        ((h["p75"] if h["p75"] is not None else 1) < 0.5, "Confidences are low: review the keywords or the model."),
        (h["many"] > 0.3, "Many responses have three or more codes: codes may overlap."),
        (h["n"] < 20, "The sample is small: read the results with care."),
    )
    return [text for hit, text in rules if hit] or ["No issue was found by the fixed checks."]


def methods(parameters: dict, data: dict, quality: dict | None = None, steps: list[str] | None = None) -> str:
    """A methods section: data, steps, parameters, how quality was judged, reproduction, assumptions and limits, ethics."""
    lines = lambda d: [f"- {k}: {v}" for k, v in sorted(d.items())]
    out = ["# Methods", "", "## Data", "", *lines(data)]
    if steps:
        out += ["", "## Procedure", "", *(f"{i}. {s}" for i, s in enumerate(steps, 1))]
    out += ["", "## Parameters", "", "| parameter | value |", "|---|---|"] + [f"| {k} | {v} |" for k, v in sorted(parameters.items())]
    if quality:
        out += ["", "## Quality measures", "", *lines(quality)]
    seed = parameters.get("seed")
    return "\n".join([
        *out, "", "## Reproduction", "", f"- Random seed: {seed if seed is not None else 'none was set'}", "- The same input, parameters and versions give the same codes.",
        "", "## Assumptions", "", "- Answers that share words are taken to share meaning.", "- An answer may have several codes or none.",
        "", "## Limits", "", "- Codes are found by rule or by unsupervised models and need human review.", "- Measures of quality describe the fit to the text, not the truth of the codes.",
        "", "## Ethics", "", "- Answers may hold personal data; quotes should be checked before they are published.", "",
    ])


def parameter_log(entries: list[tuple[str, dict]]) -> str:
    """Steps with their parameters as JSON lines, in order."""
    import json

    return "\n".join(json.dumps({"order": i, "step": step, "parameters": p}, sort_keys=True, default=str) for i, (step, p) in enumerate(entries, 1))


def analysis_summary(summary: DataFrame, validity: DataFrame, health: DataFrame, frequencies: DataFrame) -> str:
    """The question-and-answer report of an analysis: figures, validity, health, insights, what to do."""
    v, h = validity.first().asDict(), health.first().asDict()
    shown = lambda d: [f"- {k.replace('_', ' ')}: {'-' if x is None else x}" for k, x in d.items()]
    out = [executive_summary(summary, frequencies), "", "## Validity", "", *shown(v), "", "## Health", "", *shown(h), "", "## Insights", "", *(f"- {x}" for x in insights(summary, frequencies))]
    return "\n".join([*out, "", "## What to do", "", *(f"- {x}" for x in recommendations(health)), ""])


def audit(text: str, around: int = 50) -> list[tuple[str, str]]:
    """Claims that should be reworded, with their surroundings."""
    low, out = text.lower(), []
    for claim in CLAIMS:
        at = low.find(claim)
        while at >= 0:
            out.append((claim, text[max(0, at - around) : at + len(claim) + around]))
            at = low.find(claim, at + 1)
    return out


def codebook_dict(book: DataFrame, examples: DataFrame | None = None, limit: int = 1000) -> dict:
    """The codebook as plain data; examples: (code, place, quote). A codebook has k rows; more than ``limit`` are refused."""
    rows = book.orderBy("code").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} codes")
    quotes: dict[str, list[str]] = {}
    if examples is not None:
        for r in examples.filter("place <= 5").orderBy("code", "place").collect():
            quotes.setdefault(r["code"], []).append(r["quote"][:200])
    return {r["code"]: {"label": r["label"], "keywords": list(r["keywords"] or []), "count": r["count"], "avg_confidence": r["avg_confidence"], "examples": quotes.get(r["code"], [])[:5]} for r in rows}


def codebook_markdown(codes: dict) -> str:
    out = ["# Codebook", ""]
    for code, c in codes.items():
        out += [f"## {code}: {c['label']}", "", f"- Responses: {c['count']}", f"- Top terms: {'; '.join(c['keywords'][:5])}", *(f"> {e}" for e in c["examples"]), ""]
    return "\n".join(out)


def codebook_csv(codes: dict) -> str:
    import csv
    import io

    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(("code", "label", "count", "avg_confidence", "top_terms", "examples"))
    for code, c in codes.items():
        w.writerow((code, c["label"], c["count"], c["avg_confidence"], "; ".join(c["keywords"][:5]), " | ".join(c["examples"])))
    return out.getvalue()


def stopword_report(candidates: DataFrame, form: str = "markdown", rows: int = 100) -> str:
    """The candidates as markdown or JSON."""
    import json

    found = [r.asDict() for r in candidates.limit(rows).collect()]
    if form == "json":
        return json.dumps({"candidates": found, "recommended": [c["term"] for c in found if c["recommended"]]}, indent=1)
    lines = ["# Stop-word candidates", "", "| term | texts | share | advice |", "|---|---|---|---|"]
    return "\n".join(lines + [f"| {c['term']} | {c['df']} | {c['ratio']} | {'remove' if c['recommended'] else 'keep'}: {c['reason']} |" for c in found])
