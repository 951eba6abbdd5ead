"""The definitions of a source file: functions, methods, classes and the like, with what encloses them.

A file is cut into tokens once; comments, strings and bracketed parts are
replaced by short marks, so that the text of a block is flat: a header such as
``pub fn add(a: [u8; 4]) -> u8 {...}`` reads ``pub fn add() -> u8 {}`` there,
however deep its brackets nest, and one plain pattern recognises it. Blocks are
looked through from the outside in. Python's and Ruby's blocks are found by the
indentation and the openers of their flat lines. A bracket that is never closed
or opened spoils nothing but its own surroundings.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple


class Definition(NamedTuple):
    """``kind`` is function, class, interface, struct, enum, impl, module or type.
    ``start`` and ``end`` are offsets, ``head`` is where the header begins after
    decorators, ``body`` the span within the braces (null without), ``parents`` the
    indices of the enclosing definitions."""

    kind: str
    name: str | None
    start: int
    end: int
    head: int
    body: tuple[int, int] | None
    parents: tuple[int, ...]


_QUOTED = r'"(?:[^"\\\n]|\\[\s\S])*"?|\'(?:[^\'\\\n]|\\[\s\S])*\'?'
_SLASHES = r"/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|"
_BRACKETS = r"|[][(){}]"
_REGEX = r"(?:(?<=[=(,:;!&|?{}\[+\n])|(?<=return)|(?<==>))[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/"
_CLIKE = _SLASHES + _QUOTED + _BRACKETS
#: What is cut out of a file, by language: comments, strings, brackets.
_TOKENS = {k: re.compile(v, re.M) for k, v in {
    "python": r'#[^\n]*|[rRbBuUfFtT]{0,2}(?:"""(?:[^\\]|\\[\s\S])*?(?:"""|\Z)|\'\'\'(?:[^\\]|\\[\s\S])*?(?:\'\'\'|\Z))|' + _QUOTED + r"|\\\n|^(?=(?:async[ \t]+def|def|class)[ \t]+\w+[ \t]*[(:])" + _BRACKETS,
    "javascript": _SLASHES + _QUOTED + r"|`(?:[^`\\]|\\[\s\S])*`?|" + _REGEX + _BRACKETS,
    "go": _SLASHES + r"`[^`]*`?|" + _QUOTED + _BRACKETS,
    "rust": _SLASHES + r"b?r(#*)\"[\s\S]*?\"\1|\"(?:[^\"\\]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[^\n]{1,9}?)'" + _BRACKETS,
    "java": _SLASHES + r'"""[\s\S]*?(?:"""|\Z)|' + _QUOTED + _BRACKETS,
    "c": r"^[ \t]*#(?:[^\n\\]|\\[\s\S])*|" + r'R"\w*\([\s\S]*?\)\w*"|' + _CLIKE,
    "ruby": r"^=begin\b[\s\S]*?(?:^=end[^\n]*|\Z)|#(?!\{)[^\n]*|<<[~-]?([\"']?)([A-Z_]\w*)\1[^\n]*\n[\s\S]*?^[ \t]*\2$|" + _QUOTED + _BRACKETS,
    "bash": r"(?<![\w$}\"'{])#[^\n]*|\$\{[^}\n]*\}|\$[#(]?|\"(?:[^\"\\]|\\[\s\S])*\"?|'[^']*'?|\\[\s\S]" + _BRACKETS,
    "php": r"#[^\n]*|" + _CLIKE, "other": _CLIKE, "swift": r'"""[\s\S]*?(?:"""|\Z)|' + _CLIKE, "csharp": r'[$@]{0,2}"(?:[^"\\\n]|\\.|"")*"|' + _CLIKE,
}.items()}
_FAMILY = {"typescript": "javascript", "cpp": "c", "kotlin": "swift", "scala": "swift"}

#: Words before a parenthesis and a brace, or before a name, that make no function of it.
NOT_NAMES = frozenset("if for while switch catch function with return else do try new throw case typeof await yield match loop unsafe synchronized sizeof defined elif using "
                      "lock foreach super this delete instanceof in of until unless and or not goto co_return co_await co_yield throws assert import package".split())

_AT = ""
#: Where a definition may begin on flat text.
_STARTS = re.compile(r"(?:\A|[;{}\n,])[ \t]*(?=[\w@*#~\[$<])")
_RET = r"(?:\s*:\s*(?:[^{};=]|=>|\{\}(?=\s*(?:\{\}|[|&\[])))*?)?"
_FN = r"(?:async\s*)?(?:function\b\s*\*?\s*[\w$]*\s*\(\)" + _RET + r"\s*\{\}|(?:<[^;{}()]*>\s*)?(?:\(\)" + _RET + r"|[\w$]+)\s*=>\s*(?:\{\}|[^;\n]*))"
_JMODS = r"(?:(?:public|private|protected|internal|static|final|abstract|synchronized|native|default|strictfp|sealed|non-sealed|virtual|override|async|extern|unsafe|partial|new|readonly)\s+|@[\w.]+(?:\(\))?\s*|\[\]\s*)*"
_TYPE = r"(?P<t>[\w.$:]+(?:\s*<[^(){};]*>)?\??(?:\s*\[\])*)"
_PUB = r"(?:pub(?:\s*\(\))?\s+)?"
_CTRAIL = r"(?:\s*(?:const|noexcept(?:\(\))?|override|final|volatile|mutable|&&?|->\s*[\w:<>*&\s]+?|__attribute__\s*\(\)|[A-Z_]{4,}(?:\(\))?|try|requires[^{};]*))*"
_JS = [("class", _AT + r"(?:@[\w.$]+(?:\(\))?\s*)*(?:export\s+)?(?:default\s+)?(?P<at>(?:declare\s+)?(?:abstract\s+)?class(?:\s+(?P<n>(?!extends\b)[\w$]+))?[^{};]*?\{\})"),
       ("function", _AT + r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?P<at>(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)?\s*(?:<[^{}()]*>)?\s*\(\)" + _RET + r"\s*\{\})"),
       ("function", _AT + r"(?:export\s+)?(?P<at>(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=;\n]*(?:=>[^=;\n]*)?)?=\s*" + _FN + ")"),
       ("function", _AT + r"(?P<at>(?:[\w$]+\.)+(?P<n>[\w$]+)\s*=\s*" + _FN + ")"),
       ("function", _AT + r"(?P<at>(?P<n>[\w$]+)\s*:\s*" + _FN + ")"),
       ("function", _AT + r"(?P<at>(?:@[\w.$]+(?:\(\))?\s*)*(?:(?:public|private|protected|static|readonly|override|declare)\s+)*#?(?P<n>[\w$]+)\s*[?!]?\s*(?::[^=;\n]*(?:=>[^=;\n]*)?)?=\s*(?!\s*[\w$.]+\s*=>?\s*[\w$.]+\s*=)" + _FN + ")"),
       ("function", _AT + r"(?P<at>(?:@[\w.$]+(?:\(\))?\s*)*(?:(?:public|private|protected|static|readonly|abstract|override|async|get|set|declare)\s+)*(?:\*\s*)?#?(?P<n>[\w$]+|\[\])\s*\??(?:<[^{}();]*>)?\s*\(\)" + _RET + r"\s*\{\})")]
_TS = [*_JS, ("interface", _AT + r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?P<at>interface\s+(?P<n>[\w$]+)[^{};]*\{\})"),
       ("type", _AT + r"(?:export\s+)?(?:declare\s+)?(?P<at>type\s+(?P<n>[\w$]+)\s*(?:<[^=;]*>)?\s*=(?:[^;\n]|\n\s*[|&])*)"),
       ("method", _AT + r"(?P<at>(?:(?:public|private|protected|static|abstract|override|readonly|async)\s+)*(?P<n>[\w$]+)\s*\??(?:<[^{}();]*>)?\s*\(\)\s*:[^{};=\n]*(?:\{\})?(?=[;,\n]|\s*$))")]
_JAVA = [("class", _AT + r"(?P<at>" + _JMODS + r"class\s+(?P<n>\w+)[^{};]*\{\})"), ("interface", _AT + r"(?P<at>" + _JMODS + r"(?:@\s*)?interface\s+(?P<n>\w+)[^{};]*\{\})"),
         ("enum", _AT + r"(?P<at>" + _JMODS + r"enum\s+(?:class\s+)?(?P<n>\w+)[^{};]*\{\})"), ("record", _AT + r"(?P<at>" + _JMODS + r"record\s+(?P<n>\w+)[^{};]*\{\})"),
         ("function", _AT + r"(?P<at>" + _JMODS + r"(?:<[^(){};]*>\s*)?(?:" + _TYPE + r"\s+)?(?P<n>[A-Za-z_$][\w$]*)\s*(?:<[^(){};]*>\s*)?\(\)\s*(?:\[\]\s*)*(?:throws\s+[\w.,\s]+|where[^{};]*)?(?:\{\}|=>[^;]*;))"),
         ("method", _AT + r"(?P<at>" + _JMODS + r"(?:<[^(){};]*>\s*)?" + _TYPE + r"\s+(?P<n>[A-Za-z_$][\w$]*)\s*(?:<[^(){};]*>\s*)?\(\)\s*(?:throws\s+[\w.,\s]+|default\s+[^;]*)?;)")]
_CFN = _AT + r"(?P<at>(?:template\s*<[^{};]*>\s*)?(?:__attribute__\s*\(\)\s*|\[\]\s*)?(?P<t>(?:[A-Za-z_]\w*(?:::\w+)*(?:\s*<[^(){};]*>)?(?:\s*\[\])?[\s*&]+)+(?:__attribute__\s*\(\)\s*)?)?(?P<q>(?:\w+(?:<[^(){};]*>)?\s*::\s*)*)(?P<n>~?[A-Za-z_]\w*|operator\s*(?:\(\)|\[\]|[^\s\w(){};]+|[\w\s*&]+?))\s*\(\)"
_C = [("function", _CFN + _CTRAIL + r"(?:\s*:(?!:)[^;{}]*(?:\{\}\s*,[^;{}]*)*)?\s*\{\})"), ("struct", _AT + r"(?P<at>(?:typedef\s+)?(?:struct|union)\s+(?:__attribute__\s*\(\)\s*)?(?P<n>\w+)?[^{};()=]*\{\})"),
      ("enum", _AT + r"(?P<at>(?:typedef\s+)?enum\s+(?:class\s+|struct\s+)?(?P<n>\w+)?[^{};()=]*\{\})"), ("class", _AT + r"(?P<at>(?:template\s*<[^{};]*>\s*)?class\s+(?:\w+\s+)*?(?P<n>\w+)(?:\s*<[^{};()]*>)?(?:\s+final)?\s*(?::[^{};]*)?\{\})"),
      ("module", _AT + r"(?P<at>(?:inline\s+)?namespace(?:\s+(?P<n>[\w:]+))?\s*\{\})"), ("wrapper", _AT + r'(?P<at>extern\s*""\s*\{\})')]
#: Headers on flat text, by language: kind, pattern. ``n`` is the name, ``at`` the definition without what is not part of it.
_HEADERS = {
    "javascript": _JS, "typescript": _TS, "java": _JAVA, "c": _C, "cpp": _C, "csharp": [*_JAVA, ("struct", _AT + r"(?P<at>" + _JMODS + r"struct\s+(?P<n>\w+)[^{};]*\{\})"), ("module", _AT + r"(?P<at>namespace\s+(?P<n>[\w.]+)\s*\{\})")],
    "go": [("function", _AT + r"(?P<at>func\s+(?:\(\)\s*)?(?P<n>\w+)\s*(?:\[\])?\s*\(\)(?:[^{}\n]|\{\}(?=[^\n]*\{\}))*\{\})"), ("type", _AT + r"(?P<at>type\s+(?:(?P<n>\w+)[^\n]*|\(\)))"), ("method", _AT + r"(?P<at>(?P<n>[A-Za-z_]\w*)\s*\(\)[^\n={}]*(?=\n))")],
    "rust": [("function", _AT + r"(?P<at>" + _PUB + r"(?:(?:async|const|unsafe|default|safe|extern(?:\s*\"\")?)\s+)*fn\s+(?P<n>(?:r#)?\w+)[^;{}]*?\(\)[^;{}]*\{\})"), ("method", _AT + r"(?P<at>" + _PUB + r"(?:(?:async|const|unsafe)\s+)*fn\s+(?P<n>(?:r#)?\w+)[^;{}]*?\(\)[^;{}]*;)"),
             ("struct", _AT + r"(?P<at>" + _PUB + r"(?:struct|union)\s+(?P<n>\w+)[^;{}]*(?:\{\}|;))"), ("enum", _AT + r"(?P<at>" + _PUB + r"enum\s+(?P<n>\w+)[^;{}]*\{\})"),
             ("interface", _AT + r"(?P<at>" + _PUB + r"(?:unsafe\s+)?(?:auto\s+)?trait\s+(?P<n>\w+)[^;{}]*\{\})"), ("impl", _AT + r"(?P<at>(?:unsafe\s+)?impl\b\s*(?:<[^;{}]*?>\s*)?!?(?P<n>\w+)[^;{}]*\{\})"), ("module", _AT + r"(?P<at>" + _PUB + r"mod\s+(?P<n>\w+)\s*\{\})")],
    "php": [("function", _AT + r"(?P<at>(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(?P<n>\w+)\s*\(\)[^{};]*\{\})"), ("method", _AT + r"(?P<at>(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(?P<n>\w+)\s*\(\)[^{};]*;)"),
            ("class", _AT + r"(?P<at>(?:(?:abstract|final|readonly)\s+)*class\s+(?P<n>\w+)[^{};]*\{\})"), ("interface", _AT + r"(?P<at>(?:interface|trait)\s+(?P<n>\w+)[^{};]*\{\})"), ("module", _AT + r"(?P<at>namespace\s+(?P<n>[\w\\]+)\s*\{\})")],
    "kotlin": [("function", _AT + r"(?P<at>(?:@\w+(?:\(\))?\s*|[a-z]+\s+)*fun\s+(?:<[^(){}]*>\s*)?(?:[\w.<>?]+\.)?(?P<n>\w+)\s*\(\)[^{}\n=]*(?:\{\}|=[^\n]*(?:\{\})?)?)"), ("class", _AT + r"(?P<at>(?:@\w+(?:\(\))?\s*|[a-z]+\s+)*(?:class|object|interface)\s+(?P<n>\w+)[^{}\n]*(?:\{\})?)")],
    "swift": [("function", _AT + r"(?P<at>(?:@\w+(?:\(\))?\s*|[a-z]+(?:\(\))?\s+)*(?:func\s+(?P<n>[^\s(<]+)|(?P<n2>init)\b[?!]?)\s*(?:<[^(){}]*>)?\s*\(\)[^{}\n]*\{\})"), ("class", _AT + r"(?P<at>(?:@\w+(?:\(\))?\s*|[a-z]+(?:\(\))?\s+)*(?:class|struct|enum|actor|protocol|extension)\s+(?P<n>\w+)[^{}\n]*\{\})")],
    "scala": [("function", _AT + r"(?P<at>(?:[a-z]+(?:\[\])?\s+)*def\s+(?P<n>\S+?)\s*(?:\[\]\s*)?(?:\(\)\s*)*(?::[^={}\n]*)?(?:=\s*)?(?:\{\}|[^\n]*))"), ("class", _AT + r"(?P<at>(?:[a-z]+(?:\[\])?\s+)*(?:class|object|trait)\s+(?P<n>\w+)[^{}\n]*(?:\{\})?)")],
    "bash": [("function", r"(?P<at>(?:function[ \t]+(?P<n>[\w:.-]+)[ \t]*(?:\(\))?|(?P<n2>[\w:.-]+)[ \t]*\(\))\s*\{\})")],
}


def _combined(rules: list[tuple[str, str]]) -> tuple[re.Pattern, list[str]]:
    """All headers of a language as one pattern; the groups of rule k end in k."""
    parts = [re.sub(r"\(\?P<(\w+)>", rf"(?P<\g<1>_{k}>", p) for k, (_, p) in enumerate(rules)]
    return re.compile("|".join(parts), re.M), [kind for kind, _ in rules]


_COMPILED = {(language, methods): _combined([r for r in rules if methods or r[0] != "method"]) for language, rules in _HEADERS.items() for methods in (False, True)}
#: Languages whose functions have no word of their own before the name.
_BARE = frozenset(("javascript", "typescript", "java", "csharp", "c", "cpp", "bash"))
LANGUAGES = frozenset(_HEADERS) | {"python", "ruby"}
_PAIRS = {")": "(", "]": "[", "}": "{"}


class _Region:
    """A bracketed part: its span, its flat text, where pieces of that came from, and the parts within."""

    __slots__ = ("open", "close", "kind", "pieces", "size", "flat_at", "text_at", "inner", "text")

    def __init__(self, kind: str, at: int):
        self.kind, self.open, self.close = kind, at, None
        self.pieces, self.size, self.flat_at, self.text_at, self.inner, self.text = [], 0, [], [], {}, ""

    def add(self, piece: str, at: int) -> None:
        if piece:
            self.flat_at.append(self.size)
            self.text_at.append(at)
            self.pieces.append(piece)
            self.size += len(piece)

    def offset(self, flat: int) -> int:
        k = bisect_right(self.flat_at, flat) - 1
        return self.open + 1 if k < 0 else self.text_at[k] + flat - self.flat_at[k]


def _regions(text: str, language: str) -> _Region:
    family = _FAMILY.get(language, language if language in _TOKENS else "other")
    root = _Region("", -1)
    stack, at, end = [root], 0, len(text)

    def close(where: int) -> None:
        done = stack.pop()
        done.close, done.text = where, "".join(done.pieces)

    for m in _TOKENS[family].finditer(text):
        here = stack[-1]
        here.add(text[at:m.start()], at)
        token, at = m.group(), m.end()
        if not token:  # a definition at the left margin: what is still open was never closed
            if len(stack) > 1:
                while len(stack) > 1:
                    close(m.start() - 1)
                root.add("\n", m.start())
        elif token in "([{":
            inner = _Region(token, m.start())
            here.inner[here.size] = inner
            here.add(token + {"(": ")", "[": "]", "{": "}"}[token], m.start())
            stack.append(inner)
        elif token in ")]}":
            if here.kind == _PAIRS[token]:
                close(m.start())
            elif token == "}" and any(r.kind == "{" for r in stack):
                while stack[-1].kind != "{":
                    close(m.start())
                close(m.start())
        elif token[0] in "\"'`" or token[-1] in "\"'`" and len(token) > 1 and not token.startswith(("//", "/*", "#")):
            here.add('""' if len(token) > 1 else " ", m.start())
        elif token == "\\\n":
            here.add("  ", m.start())
        elif token.startswith("$"):
            here.add("_" * len(token), m.start())
        else:
            here.add(" ", m.start())
    stack[-1].add(text[at:], at)
    while stack:
        close(end)
    return root


def outline(text: str, language: str, methods: bool = False) -> list[Definition]:
    """The definitions in order of their start. ``methods`` adds those without a
    body: of interfaces, traits and abstract classes."""
    if language == "python":
        return _indented(text)
    if language == "ruby":
        return _ended(text)
    found: list[Definition] = []
    pattern, kinds = _COMPILED[language, methods]
    match, starts = pattern.match, _STARTS.search
    waiting = [(_regions(text, language), (), "")]
    while waiting:
        region, parents, inside = waiting.pop()
        flat, begin = region.text, 0
        while region.kind in ("", "{") and (at := starts(flat, begin)):
            begin = at.end()
            m = match(flat, begin)
            if not m:
                continue
            k = m.lastgroup.rpartition("_")[2]
            groups = m.groupdict()
            name, kind, words = groups[f"n_{k}"] or groups.get(f"n2_{k}"), kinds[int(k)], (groups.get(f"t_{k}") or "").split()
            if kind in ("function", "method") and (
                    language in _BARE and (name in NOT_NAMES or words and words[0] in NOT_NAMES)
                    or language in ("java", "csharp") and kind == "function" and not words and not (name or "")[:1].isupper()
                    or language in ("c", "cpp") and not words and not groups[f"q_{k}"] and not _constructs(name, inside)
                    or kind == "method" and language == "go" and inside != "interface"):
                continue
            start, stop = m.span(f"at_{k}")
            begin = max(begin, stop - 1)
            braces = [p for p in region.inner if start <= p < stop and region.inner[p].kind == "{"]
            body = region.inner[braces[-1]] if braces and region.text[:stop].rstrip().endswith("}") else None
            head = region.offset(start)
            end = min(len(text), body.close + 1) if body else min(len(text), region.offset(stop - 1) + 1)
            if name and name.startswith("operator"):
                name = "".join(name.split())
            kind = "interface" if language == "go" and kind == "type" and re.search(r"\binterface\s*\{\}", flat[start:stop]) else kind
            found.append(Definition("function" if kind == "method" else kind, name, head, end, head, (body.open + 1, body.close) if body else None, parents))
            own = (*parents, len(found) - 1) if kind != "wrapper" else parents
            for p in (p for p in region.inner if start <= p < stop):
                waiting.append((region.inner[p], own, _within(kind, name)))
            for p in [p for p in region.inner if start <= p < stop]:
                del region.inner[p]
        waiting += [(inner, parents, inside if inner.kind != "{" else "") for inner in region.inner.values()]
    return _ordered([d for d in found], drop="wrapper")


def _within(kind: str, name: str | None) -> str:
    return "interface" if kind == "interface" else f"class {name}" if kind in ("class", "struct") else kind


def _constructs(name: str, inside: str) -> bool:
    return inside == f"class {name.lstrip('~')}" or name.startswith("operator")


def _ordered(found: list[Definition], drop: str = "") -> list[Definition]:
    """By start, with the parents' indices to match."""
    order = sorted((i for i, d in enumerate(found) if d.kind != drop), key=lambda i: (found[i].start, -found[i].end))
    place = {old: new for new, old in enumerate(order)}
    return [found[i]._replace(parents=tuple(place[p] for p in found[i].parents if p in place)) for i in order]


_PY_HEAD = re.compile(r"([ \t]*)(?:(?:async[ \t]+)?(def)|(class))[ \t]+(\w+)")


def _indented(text: str) -> list[Definition]:
    region = _regions(text, "python")
    found, open_, decorated, at, last = [], [], None, 0, 0
    for line in region.text.split("\n"):
        begin, at = at, at + len(line) + 1
        bare = line.strip()
        if not bare:
            continue
        width = len(line[:len(line) - len(line.lstrip())].expandtabs(8))
        while open_ and width <= open_[-1][0]:
            _, k = open_.pop()
            found[k] = found[k]._replace(end=last)
        start = region.offset(begin + len(line) - len(line.lstrip()))
        if bare[0] == "@":
            decorated = decorated if decorated is not None and decorated[0] == width else (width, start)
        elif m := _PY_HEAD.match(line):
            first = decorated[1] if decorated is not None and decorated[0] == width else start
            found.append(Definition("function" if m.group(2) else "class", m.group(4), first, len(text), start, None, tuple(k for _, k in open_)))
            open_.append((width, len(found) - 1))
            decorated = None
        else:
            decorated = None
        last = min(len(text), _end_of(region, begin + len(line.rstrip()) - 1))
    for _, k in open_:
        found[k] = found[k]._replace(end=last)
    return found


def _end_of(region: _Region, flat: int) -> int:
    """The offset behind the character or mark at a place of the flat text."""
    k = bisect_right(region.flat_at, flat) - 1
    if region.text[flat] in ")]}" and flat - 1 in region.inner:
        return region.inner[flat - 1].close + 1
    if k + 1 < len(region.text_at) and region.pieces[k] == '""':
        return region.text_at[k + 1]
    if region.pieces[k] == '""':
        return 1 << 60
    return region.offset(flat) + 1


_RB_OPEN = re.compile(r"[ \t]*(?:[\w.@\[\]]+[ \t]*(?:\|\||&&|[-+*/])?=[ \t]*)?(?:(?:private|public|protected|module_function|private_class_method|memoize)[ \t]+)?(?:def|class|module|begin|if|unless|while|until|case|for)\b|.*\bdo[ \t]*(?:\|[^|\n]*\|)?[ \t]*$")
_RB_HEAD = re.compile(r"[ \t]*(?:(?:private|public|protected|module_function|private_class_method|memoize)[ \t]+)?(?:(?P<k>class|module)[ \t]+(?:<<[ \t]*\w+|(?:[A-Z]\w*(?:::))*(?P<c>[A-Z]\w*))|def[ \t]+(?:[A-Za-z_]\w*\.)?(?P<n>[A-Za-z_]\w*[?!=]?|\[\]=?|[-+*/%<>=!~&|^]{1,3}@?|`))")
_RB_ENDLESS = re.compile(r"[ \t]*def\b[^=\n]*(?:\(\))?[ \t]*=(?![=~>])")


def _ended(text: str) -> list[Definition]:
    region = _regions(text, "ruby")
    found, open_, at = [], [], 0
    for line in region.text.split("\n"):
        begin, at = at, at + len(line) + 1
        bare = line.strip()
        start = region.offset(begin + len(line) - len(line.lstrip())) if bare else 0
        stop = min(len(text), _end_of(region, begin + len(line.rstrip()) - 1)) if bare else 0
        head = _RB_HEAD.match(line)
        endless = head and head.group("n") and _RB_ENDLESS.match(line) and not head.group("n").endswith("=")
        one_line = re.search(r"\bend[ \t]*$", bare) and bare != "end"
        if head:
            kind = head.group("k") or "function"
            found.append(Definition(kind, head.group("n") or head.group("c"), start, stop if endless or one_line else len(text), start, None, tuple(k for k in open_ if k is not None)))
        if re.match(r"end\b", bare):
            if open_ and (k := open_.pop()) is not None:
                found[k] = found[k]._replace(end=min(len(text), start + 3))
        elif _RB_OPEN.match(line) and not endless and not one_line:
            open_.append(len(found) - 1 if head else None)
    return found
