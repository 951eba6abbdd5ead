"""Ignore rules in gitignore syntax, one set per folder."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    negated: bool
    folders_only: bool


def _regex(glob: str, anchored: bool) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + 1
            while i < len(glob) and glob[i] == "*":
                i += 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inside = glob[i + 1:end]
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return ("" if anchored else "(?:.*/)?") + out


def rules(text: str) -> list[Rule]:
    """The rules of one ignore file, in order."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        folders_only = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        out.append(Rule(re.compile(_regex(line.lstrip("/"), anchored) + r"\Z"), negated, folders_only))
    return out


def verdict(own: list[Rule], path: str, is_folder: bool) -> bool | None:
    """True if the last rule that matches ignores the path, False if it takes it back in, null if none matches."""
    for rule in reversed(own):
        if (is_folder or not rule.folders_only) and rule.pattern.match(path):
            return not rule.negated
    return None


def ignored(by_folder: dict[str, list[Rule]], path: str, is_folder: bool = False) -> bool:
    """The deepest folder whose rules have an opinion decides. ``by_folder`` is keyed by folder, '' the root; paths are relative to the root."""
    parts = path.split("/")
    for n in range(len(parts) - 1, -1, -1):
        at = "/".join(parts[:n])
        found = verdict(by_folder.get(at, []), "/".join(parts[n:]), is_folder)
        if found is not None:
            return found
    return False
