"""Sinks: event streams, text and Markdown reports, report files with digests, envelopes."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import canonical_json, code_span, short_number, signed_number, signed_percent

INLINE_ROWS, SHOWN_ERRORS = 25, 20


def event_lines(files: DataFrame, configuration: dict, totals: DataFrame) -> DataFrame:
    """(path, error, result) -> (ord, line): start, configuration, per file file_start and file or error, totals (k01)."""
    spark = files.sparkSession
    head = spark.createDataFrame([("0", canonical_json({"event": "start"})), ("1", canonical_json({"event": "configuration", **configuration}))], "ord string, line string")
    began = files.select(F.concat(F.lit("2"), "path", F.lit("\x01")).alias("ord"), F.to_json(F.struct(F.lit("file_start").alias("event"), "path")).alias("line"))
    good = files.where("error is null").select(F.concat(F.lit("2"), "path", F.lit("\x02")), F.to_json(F.struct(F.lit("file").alias("event"), "path", "result")))
    bad = files.where("error is not null").select(F.concat(F.lit("2"), "path", F.lit("\x02")), F.to_json(F.struct(F.lit("error").alias("event"), "path", "error")))
    end = totals.select(F.lit("3"), F.to_json(F.struct(F.lit("totals").alias("event"), *totals.columns)))
    return head.union(began).union(good).union(bad).union(end)


def write_events(lines: DataFrame, path: str) -> None:
    """In order over the files written; each file in order."""
    lines.orderBy("ord").select("line").write.text(path)


def text_report(files: list[dict], totals: dict) -> str:
    """The terminal's report: files by score, with their hotspots (k02)."""
    out = []
    for f in sorted(files, key=lambda f: (-(f["tree_score"] or 0), f["path"])):
        out.append(f"{f['path']}: {short_number(f['tree_score'])} ({f['token_count']} tokens)")
        out += [f"  line {h['line']}: max {short_number(h['max_entropy'])}" for h in f.get("hotspots", [])]
    return "\n".join([*out, f"total: {short_number(totals['tree_score'])} in {totals['analyzed']} files", ""])


def markdown_table(rows: list[dict], most: int = INLINE_ROWS) -> str:
    """Changed files as a table, `most` at most, with how many are left out."""
    out = ["| File | Base | Head | Change | % |", "|-|-:|-:|-:|-:|"]
    for r in rows[:most]:
        percent = None if not r["base"] or r["absolute"] is None else 100 * r["absolute"] / r["base"]
        out.append(f"| {code_span(r['path'])} | {short_number(r['base'])} | {short_number(r['head'])} | {signed_number(r['absolute'])} | {signed_percent(percent)} |")
    return "\n".join([*out, *([f"\n{len(rows) - most} more."] if len(rows) > most else []), ""])


def fit_sections(sections: list[tuple[int, str]], budget: int) -> str:
    """Sections (priority, text) within a budget of bytes: the least important go first, then the last that stays is cut at a line (i08)."""
    kept = list(enumerate(sections))
    size = lambda: len("\n".join(t for _, (_, t) in kept).encode())
    while len(kept) > 1 and size() > budget:
        kept.remove(max(kept, key=lambda x: (x[1][0], x[0])))
    text = "\n".join(t for _, (_, t) in kept)
    if len(text.encode()) <= budget:
        return text
    cut = text.encode()[:budget].decode(errors="ignore")
    return cut[: cut.rfind("\n") + 1]


def write_report_files(folder: str | Path, parts: dict[str, str]) -> dict:
    """Writes each part and publication.json with their digests and sizes (k08)."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    listed = {}
    for name, body in sorted(parts.items()):
        raw = body.encode()
        (folder / name).write_bytes(raw)
        listed[name] = {"sha256": hashlib.sha256(raw).hexdigest(), "bytes": len(raw)}
    (folder / "publication.json").write_text(canonical_json({"files": listed}))
    return listed


def envelope(result: dict, stored_at: str) -> str:
    """A cache entry: its result, when it was stored, and the result's digest (k09)."""
    return canonical_json({"schema_version": 2, "stored_at": stored_at, "sha256": hashlib.sha256(canonical_json(result).encode()).hexdigest(), "result": result})


def open_envelope(text: str) -> dict | None:
    """The result, or None (a miss) if anything about the entry is wrong."""
    try:
        e = json.loads(text)
        ok = e["schema_version"] == 2 and e["sha256"] == hashlib.sha256(canonical_json(e["result"]).encode()).hexdigest()
        return e["result"] if ok else None
    except (ValueError, KeyError, TypeError):
        return None
