"""Renderers: small results to text, on the driver."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable


def shortest_unique(paths: Iterable[str]) -> dict[str, str]:
    """The shortest suffix of whole parts that tells each path from the others."""
    paths = list(dict.fromkeys(paths))
    out = {}
    for p in paths:
        parts = p.split("/")
        for k in range(1, len(parts) + 1):
            tail = "/".join(parts[-k:])
            if k == len(parts) or sum(q == tail or q.endswith("/" + tail) for q in paths) == 1:
                out[p] = tail
                break
    return out


def compact(subject: str, sections: dict[str, list[dict]], summary: dict) -> str:
    """A few lines per subject: names only, with confidence where there is one."""
    short = shortest_unique([e["path"] for rows in sections.values() for e in rows])
    lines = [f"{subject} [{summary['blast_level']}] {summary['blast_detail']}"]
    for name in ("must_read", "likely_modify", "related", "tests"):
        rows = sections.get(name, [])
        if rows:
            lines.append(f"{name}: " + ", ".join(short[e["path"]] + (f" ({e['confidence']})" if e.get("confidence") else "") for e in rows))
    if summary.get("confidence_note"):
        lines.append(summary["confidence_note"])
    return "\n".join(lines)


def pretty(subject: str, sections: dict[str, list[dict]], summary: dict) -> str:
    lines = [subject, "=" * len(subject), f"blast radius: {summary['blast_level']} — {summary['blast_detail']}", f"confidence: {summary['confidence']:.2f}"]
    for name in ("must_read", "likely_modify", "related", "tests"):
        lines += ["", f"{name} ({len(sections.get(name, []))})"]
        lines += [f"  {k + 1}. {e['path']}" + (f"  [{', '.join(e['signals'])}]" if e.get("signals") else "") for k, e in enumerate(sections.get(name, []))]
    return "\n".join(lines)


def risk_badge(score: int, tier: str) -> str:
    return f"risk {score}/100 {tier}"


def triage(rows: list[dict]) -> str:
    order = {"CRITICAL": 0, "TEST": 1, "REVIEW": 2, "SAFE": 3}
    return "\n".join(f"{r['risk_tier']}: {r['n']} ({r['names']})" for r in sorted(rows, key=lambda r: order[r["risk_tier"]]))


def to_csv(rows: list[dict]) -> str:
    out = io.StringIO()
    if rows:
        w = csv.DictWriter(out, fieldnames=list(rows[0]), lineterminator="\n")
        w.writeheader()
        w.writerows(rows)
    return out.getvalue()


def dashboard(title: str, values: dict) -> str:
    width = max((len(k) for k in values), default=0)
    return "\n".join([title, *(f"  {k.ljust(width)}  {v}" for k, v in values.items())])
