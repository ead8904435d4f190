"""Text report and JSON results from the small evaluation frames."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame

from tremor.config import DetectorConfig

RULE = 80


def results(evaluation: dict[str, DataFrame], config: DetectorConfig) -> dict:
    """Config, aggregate and cases as plain values; one row per case comes to the driver."""
    whole = evaluation["aggregate"].first().asDict()
    for name, key in (("per_incident", "incident_type"), ("per_fault", "fault")):
        whole[name] = {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in evaluation[name].orderBy(key).collect()}
    cases = [r.asDict(recursive=True) for r in evaluation["cases"].orderBy("case_id").collect()]
    skipped = {r["case_id"]: r["flaw"] for r in evaluation["skipped"].collect()} if "skipped" in evaluation else {}
    return {"config": asdict(config), "aggregate": whole, "cases": cases, "skipped": skipped}


def _value(x, form: str) -> str:
    return "n/a" if x is None else format(x, form)


def format_report(found: dict) -> str:
    whole = found["aggregate"]
    sections = [
        ("GLOBAL SUMMARY", [("Total cases", "total_cases", "d"), ("Detected cases", "detected_cases", "d"), ("Detection rate", "detection_rate", ".2%"), ("Root cause detection", "root_cause_detection_rate", ".2%")]),
        ("CLASSIFICATION METRICS", [("True positives", "total_true_positives", "d"), ("False positives", "total_false_positives", "d"), ("Global precision", "global_precision", ".4f"), ("Global recall", "global_recall", ".4f"), ("Global F1 score", "global_f1_score", ".4f"), ("Recall per case", "avg_recall", ".4f"), ("Precision per case", "avg_precision", ".4f"), ("F1 per case", "avg_f1_score", ".4f")]),
        ("DETECTION DELAY", [("Mean seconds", "avg_delay_seconds", ".2f"), ("Median seconds", "median_delay_seconds", ".2f"), ("Max seconds", "max_delay_seconds", ".2f")]),
    ]
    lines = ["=" * RULE, "INCIDENT DETECTION REPORT".center(RULE).rstrip(), "=" * RULE, ""]
    for title, rows in sections:
        lines += [title, "-" * RULE, *(f"  {label + ':':<24}{_value(whole[key], form)}" for label, key, form in rows), ""]
    for title, name in (("PER INCIDENT TYPE", "per_incident"), ("PER FAULT", "per_fault")):
        lines += [title, "-" * RULE]
        for key, s in whole[name].items():
            lines.append(f"  {key or 'unknown'}: {s['detected']}/{s['total']} detected ({s['detection_rate']:.2%}), false positives {s['false_positives']}, mean delay {_value(s['avg_delay_seconds'], '.2f')} s")
        lines.append("")
    lines += ["CASES", "-" * RULE]
    for c in found["cases"]:
        lines.append(f"  {c['case_id']}: {'detected' if c['detected'] else 'missed'}, recall {c['recall']:.4f}, precision {c['precision']:.4f}, F1 {c['f1_score']:.4f}, delay {_value(c['delay_seconds'], '.2f')} s, services {', '.join(c['detected_services']) or '-'}")
    if found.get("skipped"):
        lines += ["", "SKIPPED", "-" * RULE, *(f"  {case}: {flaw}" for case, flaw in sorted(found["skipped"].items()))]
    return "\n".join(lines) + "\n"
