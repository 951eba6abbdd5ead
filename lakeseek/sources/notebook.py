"""Notebooks as code: the code cells of an .ipynb, each under its number."""

from __future__ import annotations

import json


def _source(cell: dict) -> str:
    value = cell.get("source", cell.get("input", ""))
    return "".join(v for v in value if isinstance(v, str)) if isinstance(value, list) else value if isinstance(value, str) else ""


def code(raw: str) -> str:
    """The code cells joined by blank lines, each after ``# %% [cell N]`` with its
    number among all cells; empty if the notebook is malformed."""
    try:
        book = json.loads(raw)
    except (ValueError, RecursionError):
        return ""
    if not isinstance(book, dict):
        return ""
    cells = book.get("cells")
    if not isinstance(cells, list):
        sheets = book.get("worksheets")
        cells = [c for s in (sheets if isinstance(sheets, list) else []) if isinstance(s, dict) for c in (s.get("cells") or [])]
    parts = [f"# %% [cell {n}]\n{_source(c)}" for n, c in enumerate(cells, 1)
             if isinstance(c, dict) and c.get("cell_type") == "code" and _source(c).strip()]
    return "\n\n".join(parts)
