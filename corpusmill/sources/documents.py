"""Driver-side documents: configuration, plans, manifests and reports. Small by nature; never data."""

from __future__ import annotations

import hashlib
import html
import json
import math
import os
import re
import tempfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.encode import canonical_hash, canonical_json

try:
    import yaml
except ImportError:  # only YAML files need it
    yaml = None


def _yaml(text: str) -> object:
    if yaml is None:
        raise RuntimeError("reading YAML needs PyYAML")
    return yaml.safe_load(text)


def read_yaml(path: str | Path) -> dict:
    """A YAML mapping."""
    doc = _yaml(Path(path).read_text(encoding="utf-8"))
    if not isinstance(doc, dict):
        raise ValueError(f"{path} is not a mapping")
    return doc


def only_known(doc: dict, known: Iterable[str]) -> dict:
    """doc, if it has no other keys than the known ones."""
    if other := sorted(set(doc) - set(known)):
        raise ValueError(f"unknown keys: {', '.join(map(str, other))}")
    return doc


def read_plan(path: str | Path, known: Iterable[str]) -> dict:
    """The settings of a Markdown plan: its front matter, else its first YAML block, else its `key: value` lines.

    Unknown keys are an error, except among key-value lines, where they are prose.
    """
    text, known = Path(path).read_text(encoding="utf-8"), set(known)
    for pattern in (r"\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\Z)", r"```ya?ml[ \t]*\n(.*?)\n```"):
        if m := re.search(pattern, text, re.DOTALL | re.IGNORECASE):
            doc = _yaml(m.group(1)) or {}
            if not isinstance(doc, dict):
                raise ValueError("the settings are not a mapping")
            return only_known({str(k).replace("-", "_"): v for k, v in doc.items()}, known)
    pairs = re.findall(r"^[ \t]*[-*]?[ \t]*([A-Za-z_][\w-]*)[ \t]*:[ \t]*(\S.*?)[ \t]*$", re.sub(r"^(?:#|```).*$", "", text, flags=re.MULTILINE), re.MULTILINE)
    found = {k.replace("-", "_"): _yaml(v.strip("'\"")) for k, v in pairs if k.replace("-", "_") in known}
    if not found:
        raise ValueError("the plan has no settings")
    return found


def all_finite(value: object) -> bool:
    """Whether no number anywhere in value is NaN or infinite."""
    if isinstance(value, dict):
        return all(map(all_finite, value.values()))
    if isinstance(value, (list, tuple)):
        return all(map(all_finite, value))
    return not isinstance(value, float) or math.isfinite(value)


def file_sha256(path: str | Path, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while b := f.read(chunk):
            h.update(b)
    return h.hexdigest()


def write_text(path: str | Path, text: str) -> None:
    """Writes a file in full or not at all: beside it, flushed to disk, then renamed."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        Path(tmp).unlink(missing_ok=True)
        raise


def write_manifest(path: str | Path, body: dict) -> str:
    """A JSON document that carries the hash of the rest of itself; returns the hash."""
    digest = canonical_hash(body)
    write_text(path, canonical_json(body | {"sha256": digest}) + "\n")
    return digest


def read_manifest(path: str | Path) -> dict:
    doc = json.loads(Path(path).read_text(encoding="utf-8"))
    digest = doc.pop("sha256", None)
    if canonical_hash(doc) != digest:
        raise ValueError(f"{path} was changed since it was written")
    return doc


def append_json(df: DataFrame, path: str) -> None:
    """Appends rows to a JSON-lines log."""
    df.write.mode("append").json(path)


def report_markdown(title: str, sections: dict[str, object]) -> str:
    """A report as Markdown: a heading each, tables for lists of mappings, lists for mappings."""
    out = [f"# {title}", ""]
    for name, body in sections.items():
        out += [f"## {name}", ""]
        if isinstance(body, dict):
            out += [f"- {k}: {v}" for k, v in body.items()]
        elif isinstance(body, list) and body and isinstance(body[0], dict):
            cols = list(body[0])
            line = lambda xs: "| " + " | ".join(str(x).replace("|", "\\|") for x in xs) + " |"
            out += [line(cols), line("---" for _ in cols), *(line(r.get(c, "") for c in cols) for r in body)]
        else:
            out += [f"- {x}" for x in body] if isinstance(body, list) else [str(body)]
        out.append("")
    return "\n".join(out)


#: fixed values: the version of research reports
REPORT_VERSION = "1.1"


def check_report(report: dict) -> None:
    """Raises where a research report breaks a rule: version, a limitation, metrics and gates that are there and finite, no `keep` with a failed gate."""

    def finite(x: object) -> bool:
        if isinstance(x, dict):
            return all(map(finite, x.values()))
        if isinstance(x, (list, tuple)):
            return all(map(finite, x))
        return not isinstance(x, float) or math.isfinite(x)

    gates = report.get("gates") or []
    rules = {
        "unsupported report schema": report.get("schema_version", REPORT_VERSION) == REPORT_VERSION,
        "a report needs an identity": isinstance(report.get("identity"), dict),
        "a report must state a limitation": bool(report.get("limitations")),
        "a report needs metrics": isinstance(report.get("metrics"), dict) and bool(report["metrics"]),
        "a report needs a gate": bool(gates),
        "a gate needs a name and an explanation": all(str(g.get(k) or "").strip() for g in gates for k in ("name", "explanation")),
        "numbers must be finite": finite(report.get("metrics")) and all(finite(g) for g in gates),
        "a failed gate can't decide 'keep'": not (report.get("decision") == "keep" and any(g.get("status") == "fail" for g in gates)),
    }
    for fault, holds in rules.items():
        if not holds:
            raise ValueError(fault)


def research_sections(report: dict) -> tuple[str, dict[str, object]]:
    """(title, sections) of a research report, for report_markdown and report_html."""
    check_report(report)
    who = report["identity"]
    gates = [{"Gate": g["name"], "Status": g.get("status", "not_run"), "Metric": g.get("metric") or "—", "Observed": "—" if g.get("observed") is None else g["observed"], "Threshold": "—" if g.get("threshold") is None else g["threshold"], "Explanation": g["explanation"]} for g in report["gates"]]
    sections = {
        "Decision": {"Decision": report.get("decision", "not_decided"), "Evidence class": report.get("evidence_class"), "Created": who.get("created_at_utc")},
        "Limitations": report["limitations"],
        "Decision gates": gates,
        "Failures": report.get("failures") or ["None recorded."],
        "Provenance": {"Config hash": who.get("config_hash"), "Experiment hash": who.get("experiment_hash") or "n/a", "Git commit": who.get("git_commit") or "unavailable", "Command": " ".join(who.get("command") or [])},
        "Metrics": canonical_json(report["metrics"]),
        "Resolved configuration": canonical_json(report.get("resolved_config") or {}),
        "Environment": canonical_json({k: report.get(k) or {} for k in ("hardware", "software")}),
    }
    return f"Research report {who.get('run_id', '')}".strip(), sections


def old_sections(report: dict) -> tuple[str, dict[str, object]]:
    """(title, sections) of a report of the older form; fields it doesn't know are ignored, missing ones are blank."""
    metadata = {k: report.get(f, "") for k, f in {"Date": "date", "Git commit": "git_commit", "Device": "device", "Dtype": "dtype", "Seed": "seed", "Result type": "result_type"}.items()}
    sections = {"Metadata": metadata | {"Git commit": report.get("git_commit") or "unavailable"}, "Summary": report.get("summary", ""), "Raw metrics": canonical_json(report.get("raw_metrics") or {}), "Limitations": report.get("limitations") or ["None recorded."], "Recommendation": report.get("recommendation", "")}
    return report.get("name", ""), sections


def report_html(title: str, sections: dict[str, object]) -> str:
    """The same as one HTML page, everything escaped."""
    e = lambda x: html.escape(str(x))
    out = [f"<!doctype html><meta charset='utf-8'><title>{e(title)}</title><h1>{e(title)}</h1>"]
    for name, body in sections.items():
        out.append(f"<h2>{e(name)}</h2>")
        if isinstance(body, list) and body and isinstance(body[0], dict):
            out.append("<table><tr>" + "".join(f"<th>{e(c)}</th>" for c in body[0]) + "</tr>" + "".join("<tr>" + "".join(f"<td>{e(r.get(c, ''))}</td>" for c in body[0]) + "</tr>" for r in body) + "</table>")
        elif isinstance(body, (dict, list)):
            items = [f"{k}: {v}" for k, v in body.items()] if isinstance(body, dict) else body
            out.append("<ul>" + "".join(f"<li>{e(x)}</li>" for x in items) + "</ul>")
        else:
            out.append(f"<p>{e(body)}</p>")
    return "".join(out)


def register_reports(spark: SparkSession, path: str, log: str) -> DataFrame:
    """Report documents as registry rows (run_id, status, created_at, updated_at, decision, metrics_json, report_path), appended to the log."""
    from pyspark.sql import functions as F

    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), F.col("_metadata.file_path").alias("report_path"))
    get = lambda p, t: F.try_variant_get("v", f"$.{p}", t)
    rows = text.where("v is not null").select(
        get("run_id", "string").alias("run_id"), F.coalesce(get("status", "string"), F.lit("completed")).alias("status"), get("created_at", "double").alias("created_at"),
        F.coalesce(get("updated_at", "double"), get("created_at", "double")).alias("updated_at"), get("decision", "string").alias("decision"), F.to_json(F.variant_get("v", "$.metrics", "variant")).alias("metrics_json"), "report_path",
    )
    rows.write.mode("append").parquet(log)
    return rows
