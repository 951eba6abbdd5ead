"""Results as text, JSON or Markdown. Works on the few rows a search returns."""

from __future__ import annotations

import json

from lakeseek.functions import values


def _place(r: dict) -> str:
    lines = f":{r['start_line']}-{r['end_line']}" if r.get("start_line") else ""
    return f"{r['path']}{lines}"


def _cut(text: str | None, length: int) -> str:
    text = text or ""
    return text if len(text) <= length else text[:length] + "..."


def results(rows: list[dict], form: str = "text", summary_length: int = 150, content_length: int = 300) -> str:
    if form == "json":
        return json.dumps([{k: (round(v, 4) if k == "score" else v) for k, v in r.items() if v is not None} for r in rows], ensure_ascii=False, default=str)
    if not rows:
        return "No results found."
    out = []
    for n, r in enumerate(rows, 1):
        label = " ".join(x for x in (values.SHORT_TYPES.get(r.get("chunk_type") or "", r.get("chunk_type")), r.get("name")) if x)
        body = _cut(r.get("content") or r.get("summary"), content_length if r.get("content") else summary_length)
        if form == "markdown":
            out.append(f"### {n}. `{_place(r)}` ({r['score']:.4f})\n{label}\n```{r.get('language') or ''}\n{body}\n```")
        else:
            out.append(f"{n}. [{r['score']:.4f}] {_place(r)} {label}\n{body}")
    return "\n\n".join(out)


def fused(rows: list[dict], form: str = "text", skipped: list[tuple[str, str]] | None = None) -> str:
    """A ranking over several corpora; ``skipped`` names those that could not be searched."""
    if form == "json":
        keep = [{"rank": n, "source": r["source"], "path": r["path"], "score": round(r["score"], 4), "rrf_score": round(r["rrf"], 6)} for n, r in enumerate(rows, 1)]
        return json.dumps({"results": keep, "skipped": [{"source": s, "error": e} for s, e in skipped or []]}, ensure_ascii=False)
    head = "- " if form == "markdown" else ""
    lines = [f"{head}{n}. {r['source']}: {_place(r)} (score {r['score']:.4f}, rrf {r['rrf']:.6f})" for n, r in enumerate(rows, 1)] or ["No results found."]
    return "\n".join([*lines, *[f"skipped {s}: {e}" for s, e in skipped or []]])


def index_message(counts: dict, languages: dict[str, int]) -> str:
    if not any(counts.values()):
        return ""
    return f"Indexed {counts.get('files', 0)} files, {counts.get('chunks', 0)} chunks, deleted {counts.get('deleted', 0)} ({', '.join(f'{k}: {v}' for k, v in sorted(languages.items()))})"
