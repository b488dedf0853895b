"""Small results as text; the driver formats rows that are few by nature."""

from __future__ import annotations

from pyspark.sql import DataFrame

NO_RULE = "  Memory holds no rule about the remainder. That is an absence of evidence, not permission."
BRIEF = (
    ("decisions", "CURRENT DECISIONS", lambda r: f"  {r['subject']}: {r['object']}   (support {r['support']})"),
    ("constraints", "RULES THE PROJECT HOLDS", lambda r: f"  {r['subject']} must not use {r['object']}"),
    ("components", "MOST-REFERENCED COMPONENTS", lambda r: f"  {r['label']}   ({r['facts']} facts)"),
    ("superseded", "WHAT CHANGED (superseded decisions)", lambda r: f"  {r['subject']} used to be {r['object']}"),
    ("open_questions", "WHAT MEMORY IS UNSURE ABOUT", lambda r: f"  ! {r['question']}"),
)


def ingest_summary(source: str, produced: int, skipped: int) -> str:
    return f"{source}: {produced} artifact(s) ingested, {skipped} already known"


def compliance_summary(checked: int, violations: DataFrame, unknown: DataFrame) -> str:
    bad, rest = violations.collect(), unknown.count()
    lines = [f"checked {checked} relationship(s): {len(bad)} violation(s), {rest} with no applicable rule"]
    for r in bad:
        sources = ", ".join(a[:16] for a in r["established_by"] or []) or "no recorded artifact"
        when = f" ({r['established_at']})" if r["established_at"] else ""
        lines.append(f"  VIOLATION  {r['subject']} {r['predicate']} {r['object']} is forbidden by a constraint established in {sources}{when}")
    return "\n".join(lines + [NO_RULE] * bool(rest))


def brief_text(tables: dict[str, DataFrame]) -> str:
    parts = []
    for key, title, line in BRIEF:
        if rows := tables[key].collect():
            parts.append("\n".join([title, *map(line, rows)]))
    return "\n\n".join(parts) or "Memory is empty."


def pilot_text(results: DataFrame, summary: DataFrame) -> str:
    s = summary.first()
    lines = [f"questions           {s['total']}", f"correct             {s['correct']}", f"wrong               {s['wrong']}", f"declined            {s['declined']}"]
    lines += [f"coverage            {s['coverage']:.0%}", f"accuracy answered   {s['accuracy_when_answered']:.0%}", ""]
    marks = {"correct": "ok  ", "correctly_declined": "ok  ", "wrong": "WRONG", "declined": "  - "}
    lines += [f"  {marks[r['outcome']]} {r['ask']}  expected={r['expect']}  got={r['got']}" for r in results.collect()]
    return "\n".join(lines)


def score_text(scores: DataFrame) -> str:
    """Scores of cases by name, then the total."""
    rows = sorted(scores.collect(), key=lambda r: (r["case"] is None, r["case"] or ""))
    lines = []
    for r in rows:
        lines.append("TOTAL" if r["case"] is None else r["case"])
        lines.append(f"  overall    P={r['precision']:.0%}  R={r['recall']:.0%}  F1={r['f1']:.0%}   ({r['tp']} hit / {r['fp']} spurious / {r['fn']} missed)")
        lines.append(f"  reachable  P={r['reachable_precision']:.0%}  R={r['reachable_recall']:.0%}  F1={r['reachable_f1']:.0%}")
    return "\n".join(lines)
