"""Lexers: a file's text to one character a token, bracketed parts folded. Null means rejected."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from lakeseek.llm.syntax.gll import ERROR, NEWLINE, Grammar, Rejected
from lakeseek.llm.syntax.grammars import grammar

_CONFLICT = r"^(?:<{7}|>{7}|\|{7})(?=[ \n]|\Z)|^={7}$"
_NAME = r"[^\W\d]\w*"


def within(text: str, at: int) -> int:
    """Where the brace that is open before ``at`` closes, strings and nested braces passed over; -1 if it doesn't."""
    depth = 1
    for m in _NESTED.finditer(text, at):
        c = m.group()
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return m.start()
    return -1


_NESTED = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[{}]")


class Kinds(dict):
    """Token text to token characters; texts not seen before are classified once."""

    def __init__(self, known: dict, classify):
        super().__init__(known)
        self.known, self.classify = dict(known), classify

    def __missing__(self, token: str) -> str:
        kind = self.classify(token)
        if len(self) > 100_000:  # names are unbounded; forgetting them changes no result
            self.clear()
            self.update(self.known)
        self[token] = kind
        return kind


class Lexer:
    """The common case: one pattern for all tokens, then kinds by text."""

    def __init__(self, language: str, pattern: str, classify, lines: bool = False):
        self.grammar: Grammar = grammar(language)
        signs = sorted((t for t in self.grammar.tokens if not re.match(r"[\w#]", t)), key=len, reverse=True)
        # A sign that is one character, or '>' doubled, is left to the last alternative.
        longer = "|".join(re.escape(t) for t in signs if len(t) > 1)
        self.findall = re.compile(pattern.replace("SIGNS", longer or r"(?!)"), re.M).findall
        known = dict(self.grammar.tokens) | {c: c for c in "()[]{};"} | {"\n": NEWLINE if lines else "", " ": "", "\t": ""}
        self.kinds = Kinds(known, classify)

    def tokens(self, text: str) -> str | None:
        kinds = self.kinds
        out = "".join([kinds[t] for t in self.findall(text)])
        return None if ERROR in out else out


def _plain(token: str) -> str:
    """Kinds shared by the languages with C-like tokens."""
    c = token[0]
    if c.isspace():
        return ""
    if token.startswith(("//", "/*")):
        return NEWLINE if NEWLINE in token else ""
    if c.isalpha() or c in "_$":
        if token[-1] in "\"'" and len(token) > 2:
            return "S"
        return "I"
    if (c.isdigit() or c == "." and len(token) > 1) and not (len(token) > 1 and token[-1] in "!"):
        return "N"
    if c in "\"'" and len(token) > 1 and token[-1] == c:
        return "S"
    if c == "`" and len(token) > 1:
        return "T"
    return ERROR


_C_COMMENTS = r"/\*[\s\S]*?\*/|//[^\n]*"
_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_NUM = r"0[xXbBoO][\da-fA-F_]+\w*(?!\w)|\d[\d_]*(?:\.(?!\.)[\d_]*)?(?:[eE][+-]?\d[\d_]*)?{}(?![\w$])|\.\d[\d_]*(?:[eE][+-]?\d+)?{}(?![\w$])"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\})*`"
_REGEX = r"(?:=>|&&|\|\||[=(,:;!&|?{}\[\n]|\b(?:return|typeof|case))[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*(?!\w)"


def _script(language: str):
    def classify(token: str) -> str:
        if "/" in token and not token.startswith(("//", "/*", '"', "'", "`")):
            m = re.match(r"(=>|&&|\|\||[=(,:;!&|?{}\[\n]|return|typeof|case)[ \t]*/.+/", token)
            if m:
                return lexer.kinds[m.group(1)] + "R"
        if token[0] == "`" and "${" in token:
            return "T" if holes(token) else ERROR
        return _plain(token)

    def holes(token: str) -> bool:
        """Whether every ``${...}`` of a template holds an expression."""
        at = token.find("${")
        while at >= 0:
            if token[at - 1] != "\\" or (len(token[:at]) - len(token[:at].rstrip("\\"))) % 2 == 0:
                end = within(token, at + 2)
                if end < 0:
                    return False
                inner = lex(token[at + 2:end].replace("\n", " "))
                if inner is None or not lexer.grammar.accepts("Template", inner.strip(NEWLINE)):
                    return False
                at = end
            at = token.find("${", at + 1)
        return True

    lexer = Lexer(language, rf"{_CONFLICT}|[ \t\f\v\xa0﻿]+|{_C_COMMENTS}|{_DQ}|{_SQ}|{_TEMPLATE}|{_REGEX}|{_NUM.format('n?', '')}|(?:[^\W\d]|\$)[\w$]*|SIGNS|[\s\S]", classify, lines=True)
    t = lexer.grammar.tokens
    ends = "INSTR)]}" + "".join(t[w] for w in ("this", "null", "true", "false", "super", "return", "break", "continue", "yield", "++", "--", "debugger", "static") + tuple(lexer.grammar.tokens[w] and w for w in ("of", "async", "get", "set", "from", "as", "type", "let")))
    if language == "typescript":
        ends += "".join(t[w] for w in ("!", "?", ">", "void", "any", "is", "keyof") if w in t) + "".join(t[w] for w in ("declare", "abstract", "readonly", "module", "namespace", "enum", "unique"))
    joins = ".,)];:?({[T" + "".join(t[w] for w in (".", ",", ":", "?", "?.", "=>", "=", "==", "===", "!=", "!==", "<", "<=", ">", "&&", "||", "??", "+", "-", "*", "/", "%", "&", "|", "^", "**", "+=", "-=", "in", "instanceof", "of", "extends") if w in t) + "}"
    clauses = "".join(t[w] for w in ("else", "catch", "finally"))
    drop = re.compile(f"(?<![{re.escape(ends)}])\n|\n(?![^{re.escape(joins)}])|(?<=}})\n(?=[{clauses}])")

    def lex(text: str) -> str | None:
        out = lexer.tokens(re.sub(r"\A#![^\n]*", "", text))
        if out is None:
            return None
        return lexer.grammar.fold(drop.sub("", re.sub("\n+", "\n", out)))
    return lex


def _go():
    def classify(token: str) -> str:
        c = token[0]
        return "S" if c == "`" and len(token) > 1 else "C" if c == "'" and len(token) > 2 else ERROR if c == "$" else _plain(token)

    lexer = Lexer("go", rf"{_CONFLICT}|[ \t﻿]+|{_C_COMMENTS}|{_DQ}|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{{1,9}}?)'|{_NUM.format('i?', 'i?')}|{_NAME}|SIGNS|[\s\S]", classify, lines=True)
    t = lexer.grammar.tokens
    ends = "INSC)]}" + "".join(t[w] for w in ("return", "break", "continue", "fallthrough", "++", "--", "type"))
    insert = re.compile(f"(?<=[{re.escape(ends)}])\n")

    def lex(text: str) -> str | None:
        out = lexer.tokens(text + "\n")
        return None if out is None else lexer.grammar.fold(insert.sub(";", re.sub("\n+", "\n", out)).replace("\n", ""))
    return lex


def _java():
    def classify(token: str) -> str:
        return "C" if token[0] == "'" and len(token) > 2 else _plain(token)

    lexer = Lexer("java", rf'{_CONFLICT}|[ \t\f﻿]+|{_C_COMMENTS}|"""[\s\S]*?"""|{_DQ}|\'(?:[^\'\\\n]|\\[^\n]{{1,6}}?)\'|{_NUM.format("[lLfFdD]?", "[fFdD]?")}|non-sealed\b|(?:[^\W\d]|\$)[\w$]*|SIGNS|[\s\S]', classify)

    def lex(text: str) -> str | None:
        out = lexer.tokens(text)
        return None if out is None else lexer.grammar.fold(out.replace("\n", ""))
    return lex


def _rust():
    def classify(token: str) -> str:
        if token[0] == "'":
            return "C" if token[-1] == "'" and len(token) > 2 else "L" if len(token) > 1 else ERROR
        if token[:2] == "b'":
            return "C"
        if token.startswith("r#") and token[-1] not in "\"#":
            return "I"
        return "S" if token[-1] in "\"#" and len(token) > 1 and token[0] in "brc\"" else ERROR if token[0] in "$" else _plain(token)

    lexer = Lexer("rust", rf"{_CONFLICT}|[ \t﻿]+|{_C_COMMENTS}|[bc]?r\"[^\"]*\"|[bc]?r#\"[\s\S]*?\"#|[bc]?r##\"[\s\S]*?\"##|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:x..|u\{{[^}}\n]*\}}|[^\n]))'|'[^\W\d]\w*|r#{_NAME}"
                  r"|0[xXbBoO][\da-fA-F_]+\w*(?!\w)|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d[\d_]*)?(?:_?(?:[iu](?:8|16|32|64|128|size)|f32|f64))?(?!\w)" rf"|{_NAME}|SIGNS|[\s\S]", classify)
    lexer.kinds.known |= {"$": "O", "macro_rules": "I"}
    lexer.kinds.update(lexer.kinds.known)

    def lex(text: str) -> str | None:
        out = lexer.tokens(re.sub(r"\A#![^\[\n][^\n]*", "", text))
        return None if out is None else lexer.grammar.fold(out.replace("\n", ""))
    return lex


#: Preprocessor directives.
_DIRECTIVES = frozenset("include define undef if ifdef ifndef elif else endif error warning pragma line import include_next ident elifdef elifndef".split())


def _c():
    def classify(token: str) -> str:
        c = token[0]
        if c == "#" or c == "\n" and "#" in token:
            m = re.match(r"\s*#[ \t]*(\w*)", token)
            return "" if m.group(1) in _DIRECTIVES or not token.strip("# \t\n") else ERROR
        if token[-1] == "'" and len(token) > 2:
            return "C"
        return ERROR if c == "$" else _plain(token)

    lexer = Lexer("c", rf"{_CONFLICT}|[ \t\f\v﻿]+|/\*[\s\S]*?\*/|//(?:[^\n\\]|\\[\s\S])*|^[ \t]*#(?:[^\n\\/]|\\[\s\S]|/(?!\*)|/\*[\s\S]*?\*/)*|\\\n|(?:u8|[LuU])?{_DQ}|[LuU]?'(?:[^'\\\n]|\\[^\n])+'|{_NUM.format('[uUlLfF]*', '[fFlL]?')}|{_NAME}|SIGNS|[\s\S]", classify)
    lexer.kinds.known["\\\n"] = ""
    lexer.kinds.update(lexer.kinds.known)
    nested = re.compile(r"^[ \t]*#[ \t]*(if|ifdef|ifndef|endif)\b", re.M)

    def lex(text: str) -> str | None:
        depth = 0
        if "#if" in text or "#endif" in text:
            for word in nested.findall(text):
                depth += -1 if word == "endif" else 1
                if depth < 0:
                    return None
        if depth:
            return None
        out = lexer.tokens(text)
        return None if out is None else lexer.grammar.fold(out.replace("\n", ""))
    return lex


def _python():
    def classify(token: str) -> str:
        c = token[0]
        if c == "#" or token == "\\\n":
            return ""
        if c == "\n":
            return NEWLINE + chr(0x2000 + min(_width(token[token.rindex("\n") + 1:]), 0xFFF))
        if c == "!":
            return ERROR
        if (c in "\"'" or c in "rRbBuUfFtT" and token[-1] in "\"'") and len(token) > 1:
            return string(token)
        if c.isdigit() or c == "." and len(token) > 1 and token[1].isdigit():
            return "N" if number.fullmatch(token) else ERROR
        return ERROR if c in "$?`" else _plain(token)

    number = re.compile(r"0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][-+]?\d(?:_?\d)*)?[jJ]?"
                        r"|\d(?:_?\d)*[eE][-+]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ]|[1-9](?:_?\d)*|0(?:_?0)*")
    bad_escape = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![\da-fA-F]{2})|u(?![\da-fA-F]{4})|U(?!(?:0000|0001|000[2-9a-fA-F]|0010)[\da-fA-F]{4})|N(?!\{[^{}\n]+\}))")
    bad_byte = re.compile(r"(?<!\\)(?:\\\\)*\\x(?![\da-fA-F]{2})|[^\x00-\x7f]")
    prefixes = frozenset(("", "r", "u", "b", "f", "t", "br", "rb", "fr", "rf", "tr", "rt"))

    def named(name: str) -> bool:
        try:
            return bool(unicodedata.lookup(name))
        except KeyError:
            return False

    def string(token: str) -> str:
        start = re.match(r"[a-zA-Z]*", token).end()
        prefix = token[:start].lower()
        if prefix not in prefixes:
            return ERROR
        width = 3 if token[start:start + 3] in ('\"\"\"', "'''") and len(token) - start >= 6 else 1
        body = token[start + width:-width]
        if "b" in prefix:
            return ERROR if (bad_byte.search(body) if "r" not in prefix else not body.isascii()) else "Y"
        if "r" not in prefix and "\\" in body and (bad_escape.search(body) or not all(map(named, re.findall(r"(?<!\\)(?:\\\\)*\\N\{([^{}\n]+)\}", body)))):
            return ERROR
        if ("f" in prefix or "t" in prefix) and ("{" in body or "}" in body):
            return "S" if fields(body, "r" in prefix, width == 3) else ERROR
        return "S"

    def fields(body: str, raw: bool, long: bool, depth: int = 0) -> bool:
        """Whether braces are doubled or hold a replacement field: an expression, perhaps ``=``, a conversion, a format with fields of its own."""
        at = 0
        while at < len(body):
            c = body[at]
            if c == "\\" and not raw:
                named = re.compile(r"\\N\{[^{}]+\}").match(body, at)
                at = named.end() if named else at + (1 if body[at + 1:at + 2] in ("{", "}") else 2)
            elif c in "{}" and depth == 0 and body[at + 1:at + 2] == c:
                at += 2
            elif c == "}":
                return False
            elif c == "{":
                end = within(body, at + 1)
                if end < 0 or depth > 2 or not field(body[at + 1:end], raw, long, depth):
                    return False
                at = end + 1
            else:
                at += 1
        return True

    cut_at = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|lambda\b|[][(){}]|!=|:|!")

    def field(text: str, raw: bool, long: bool, depth: int) -> bool:
        level, format_ = 0, None
        for m in cut_at.finditer(text):
            t = m.group()
            if t in "([{":
                level += 1
            elif t in ")]}":
                level -= 1
            elif t == ":" and level == 0:
                text, format_ = text[:m.start()], text[m.start() + 1:]
                break
        conversion = re.search(r"!\s*([rsa])\s*$", text)
        if conversion:
            text = text[:conversion.start()]
        text = re.sub(r"(?<![=!<>:])=\s*$", "", text)
        if not text.strip() or "!" in text.replace("!=", ""):
            inner = re.sub(cut_at, lambda m: "" if m.group()[0] in "\"'" else m.group(), text)
            if not text.strip() or "!" in inner.replace("!=", ""):
                return False
        out = lexer.tokens(re.sub(r"\s*\n\s*", " ", text.strip()) if "#" not in text else text.strip())
        folded = None if out is None else fold(re.sub(NEWLINE + ".", "", out))
        if folded is None or not g.accepts("Field", folded):
            return False
        return format_ is None or fields(format_, raw, long, depth + 1)

    hole = r"\{(?:[^{}\"'\n]|\"[^\"\n]*\"|'[^'\n]*'|\{(?:[^{}\"'\n]|\"[^\"\n]*\"|'[^'\n]*')*\})*\}"
    formatted = rf"(?:[fFtT][rR]?|[rR][fFtT])(?:\"(?!\"\")(?:[^\"\\\n{{}}]|\\[\s\S]|\{{\{{|\}}\}}|{hole})*\"|'(?!'')(?:[^'\\\n{{}}]|\\[\s\S]|\{{\{{|\}}\}}|{hole})*')"
    long = r"[rRbBuUfFtT]{0,2}(?:\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*''')"
    short = r"[rRbBuUfFtT]{0,2}(?:\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'|\"\"(?!\")|''(?!'))"
    # A number may run straight into a keyword, as in `1if x else y`.
    lexer = Lexer("python", rf"{_CONFLICT}|\\\n|#[^\n]*|(?:\n[ \t\f]*)+|[ \t\f]+|{long}|{formatted}|{short}|0[xXbBoO][\da-fA-F_]+(?!\w)|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?(?!\w)|{_NAME}|SIGNS|[\s\S]", classify)
    del lexer.kinds["\n"], lexer.kinds.known["\n"]
    g = lexer.grammar
    again = "".join(g.tokens[w] for w in ("elif", "else", "except", "finally"))
    inner, at = re.compile(r"\(([^()\[\]{}]*)\)|\[([^()\[\]{}]*)\]|\{([^()\[\]{}]*)\}"), g.tokens["@"]

    def fold(text: str) -> str | None:
        def part(m: re.Match) -> str:
            kind = m.lastindex
            content = m.group(kind)
            if NEWLINE in content:
                content = re.sub("\n.", "", content)
            return g.group("PSB"[kind - 1], content)
        n = 1
        while n:
            text, n = inner.subn(part, text)
        return None if any(c in text for c in "()[]{}") else text

    def lex(text: str) -> str | None:
        text = text.lstrip("﻿")
        if re.search(r"[^\x09\x0a\x0c\x20-\x7e\x80-\U0010ffff]", text):
            return None
        out = lexer.tokens("\n" + text)
        if out is None or (out := fold(out)) is None:
            return None
        # Logical lines by indentation; a suite becomes one symbol in its header's line.
        stack: list[tuple[int, list[str]]] = [(0, [])]
        for line in out.split(NEWLINE):
            if len(line) < 2:
                continue
            width, body = ord(line[0]) - 0x2000, line[1:]
            if width > stack[-1][0]:
                if not stack[-1][1] or not stack[-1][1][-1].endswith(g.tokens[":"] + NEWLINE):
                    return None
                stack.append((width, []))
            while width < stack[-1][0]:
                _, lines = stack.pop()
                stack[-1][1][-1] = stack[-1][1][-1][:-1] + g.group("K", "".join(_joined(lines, again, at)))
            if width != stack[-1][0]:
                return None
            stack[-1][1].append(body + NEWLINE)
        while len(stack) > 1:
            _, lines = stack.pop()
            stack[-1][1][-1] = stack[-1][1][-1][:-1] + g.group("K", "".join(_joined(lines, again, at)))
        return "".join(_joined(stack[0][1], again, at))
    return lex


def _joined(lines: list[str], again: str, at: str) -> list[str]:
    """Close every statement with a newline; clauses stay with the statement they continue,
    so that the text may be cut at newlines."""
    out: list[str] = []
    for i, line in enumerate(lines):
        suite = line[-1] != NEWLINE
        follows = i + 1 < len(lines) and lines[i + 1][0] in again
        out.append(line + NEWLINE if suite and not follows else line)
    return out


def _width(space: str) -> int:
    return len(space.expandtabs(8).replace("\f", ""))


def _sql():
    def classify(token: str) -> str:
        c = token[0]
        if token.startswith("--"):
            return ""
        if c in "\"'`" and len(token) > 1:
            return "S"
        if c in "$:@?" and (len(token) > 1 or c == "?"):
            return "S" if token.startswith("$") and token.endswith("$") and len(token) > 2 else "$"
        if c.isalpha() or c == "_":
            return "S" if token[-1] == "'" else words.get(token.upper(), "I")
        return _plain(token)

    g = grammar("sql")
    words = {w: c for w, c in g.tokens.items() if re.match(r"[A-Z]", w)}
    lexer = Lexer("sql", rf"{_CONFLICT}|[ \t\f﻿]+|--[^\n]*|/\*[\s\S]*?\*/|[nNeExXbB]?'(?:[^'\\]|\\[\s\S]|'')*'|\"(?:[^\"\n]|\"\")*\"|`[^`\n]*`|\$(\w*)\$[\s\S]*?\$\1\$|{_NUM.format('', '')}|{_NAME}|[$@]+\w+|:[^\W\d]\w*|SIGNS|[\s\S]".replace(r"\$(\w*)\$[\s\S]*?\$\1\$", r"\$\$[\s\S]*?\$\$"), classify)

    def lex(text: str) -> str | None:
        out = lexer.tokens(text)
        return None if out is None else lexer.grammar.fold(out.replace("\n", ""))
    return lex


def _json():
    def classify(token: str) -> str:
        c = token[0]
        return "" if c in " \t\n" else "S" if c == '"' and len(token) > 1 else "N" if c == "-" and len(token) > 1 or c.isdigit() else ERROR

    lexer = Lexer("json", r'[ \t]+|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[a-z]+|[\s\S]', classify)

    def lex(text: str) -> str | None:
        out = lexer.tokens(text.lstrip("﻿"))
        if out is None:
            return None
        return lexer.grammar.fold(out.replace("\n", ""))
    return lex


def _ruby():
    g = grammar("ruby")
    t = g.tokens
    openers, loops = {"def", "class", "module", "begin", "case"}, {"while", "until", "for"}
    nested = r"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\)|\[(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*\]|\{(?:[^{}\\]|\\.|\{[^{}]*\})*\}|<[^<>]*>|([|!/^])(?:[^\\]|\\.)*?\1"
    token = re.compile(
        rf"{_CONFLICT}|^=begin\b[\s\S]*?^=end[^\n]*|^__END__$[\s\S]*|#[^\n]*|\\\n|\n|[ \t\r\f﻿]+|\"(?:[^\"\\#]|\\[\s\S]|#(?!\{{)|#\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*\"|'(?:[^'\\]|\\[\s\S])*'|`[^`\n]*`"
        rf"|%[wWiIqQrsx]?(?:{nested})[a-z]*|(?<=[=(,\[|&!~ \n])/(?![ =])(?:[^/\\\n]|\\.)+/[a-z]*(?!\w)|<<[~-]?[\"']?[A-Z_]+[\"']?|:(?:{_NAME}[?!=]?|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\[\]=?|[+*/<=>!~-]+)(?!:)|@@?{_NAME}|\$(?:{_NAME}|\d+|[!@&~0-9$?:\"/\\,;.<>_*-])"
        rf"|0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[ri]?(?!\w)|\?[A-Za-z](?!\w)|defined\?|{_NAME}[?!]?(?=:(?!:))|{_NAME}(?:[?!](?!=[^=~>]))?|" + "|".join(
            re.escape(s) for s in sorted((s for s in t if not re.match(r"\w", s)), key=len, reverse=True) if len(s) > 1) + r"|[\s\S]", re.M)
    enders = set("ISNYVR)]}T") | {t[w] for w in ("nil", "true", "false", "self", "__FILE__", "__method__")}

    def lex(text: str) -> str | None:
        # Here-documents: the body goes, the opening stands for a string.
        text = re.sub(r"<<([~-]?)([\"']?)([A-Z_]\w*)\2(.*)\n(?:[\s\S]*?\n)??[ \t]*\3(?=\n|\Z)", r'""\4', text)
        stack: list[tuple[str, list[str], bool]] = [("", [], False)]
        out = stack[-1][1]
        previous, awaiting_do, parens = "\n", [], 0
        for m in token.finditer(text):
            w = m.group()
            c = w[0]
            if c in " \t\r\f﻿" or c == "#" or w == "\\\n" or w.startswith("=begin") or w.startswith("__END__"):
                continue
            label = text[m.end():m.end() + 1] == ":" and text[m.end():m.end() + 2] != "::" and previous not in (t["?"],)
            after_dot = previous in (t["."], t["&."], t["::"], t["def"]) if "def" in t else False
            word = re.match(r"[^\W\d]", w)
            if c == "\n":
                if awaiting_do and awaiting_do[-1] == len(stack):
                    awaiting_do.pop()
                kind = NEWLINE
                if previous == NEWLINE:
                    continue
            elif word and (label or after_dot):
                kind = "I" + (t[w[-1]] if w[-1] in "?!" else "") if w not in t or re.match(r"\w+[?!]$", w) else t[w]
                kind = kind[0] if label else kind
            elif w in loops | openers | {"if", "unless", "do", "end", "rescue"}:
                starts = previous not in enders and previous not in ("K",)
                if w == "end":
                    if stack[-1][0] != "K":
                        return None
                    content = "".join(stack.pop()[1])
                    out = stack[-1][1]
                    kind = g.group("K", content)
                    out.append(kind)
                    previous = "I" if False else ")"
                    continue
                if w == "do":
                    if awaiting_do and awaiting_do[-1] == len(stack):
                        awaiting_do.pop()
                        kind = t["do"]
                    else:
                        stack.append(("K", [t["do"]], False))
                        out = stack[-1][1]
                        previous = NEWLINE
                        continue
                elif w == "rescue":
                    kind = t["rescue"] if previous in (NEWLINE, ";") or not out else t["rescue_mod"]
                elif w in ("if", "unless", "while", "until") and not starts:
                    kind = t[w + "_mod"]
                else:
                    stack.append(("K", [t[w]], False))
                    if w in loops:
                        awaiting_do.append(len(stack))
                    out = stack[-1][1]
                    previous = t[w]
                    continue
            elif word:
                kind = t.get(w) or "I" + (t[w[-1]] if w[-1] in "?!" else "")
            elif w in "([{":
                stack.append(({"(": "P", "[": "S", "{": "B"}[w], [], False))
                out = stack[-1][1]
                previous = w
                continue
            elif w in ")]}":
                if stack[-1][0] != {")": "P", "]": "S", "}": "B"}[w]:
                    return None
                k, inside, _ = stack.pop()
                content = "".join(inside)
                if k == "S" or k == "P" and ";" not in content and content.count(NEWLINE) < 2:
                    content = content.replace(NEWLINE, "")
                out = stack[-1][1]
                out.append(g.group(k, content))
                previous = w
                continue
            elif c in "\"'`" and len(w) > 1 or c == "?" and len(w) == 2:
                if c == '"' and "#{" in w and not holes(w):
                    return None
                kind = "S"
            elif c == "%" and len(w) > 2:
                kind = "R" if w[1] == "r" else "S"
            elif c == "/" and len(w) > 2:
                kind = "R"
            elif c == ":" and len(w) > 1 and w != "::":
                kind = "Y"
            elif c in "@$" and len(w) > 1:
                kind = "V"
            elif c.isdigit():
                kind = "N"
            elif w in t:
                kind = t[w]
            else:
                return None
            out.append(kind)
            previous = kind[-1]
        if len(stack) != 1:
            return None
        return _ruby_lines("".join(stack[0][1]))

    def holes(text: str) -> bool:
        """Whether every ``#{...}`` of a string holds statements."""
        for m in re.finditer(r"(?<!\\)(?:\\\\)*#\{", text):
            end = within(text, m.end())
            if end < 0:
                return False
            inner = lex(text[m.end():end])
            if inner is None or not g.accepts("File", inner):
                return False
        return True

    joins = "".join(t[w] for w in (",", ".", "&.", "::", "||", "&&", "+", "*", "=", "=>", "|", "+=", "-=", "||=", "?", "==", "<<", "and", "or", "not") if w in t)
    drop = re.compile(f"(?<=[{re.escape(joins)}])\n|\n(?=[{re.escape(t['.'] + t['&.'])}])")

    def _ruby_lines(top: str) -> str:
        return drop.sub("", top)

    # Parts are folded as they close; lines that go on are joined there too.
    plain_group = g.group
    g.group = lambda kind, content: plain_group(kind, drop.sub("", content).strip(NEWLINE) if kind in "PB" else drop.sub("", content))
    return lex


def _bash():
    g = grammar("bash")
    t = g.tokens
    sub = r"\$\((?:[^()'\"]|'[^']*'|\"(?:[^\"\\]|\\[\s\S])*\"|\((?:[^()]|\([^()]*\))*\))*\)"
    piece = rf"(?:\\[\s\S]|\"(?:[^\"\\$`]|\\[\s\S]|{sub}|\$(?!\()|`[^`]*`)*\"|\$?'(?:[^'\\]|\\.|\\\n)*'|{sub}|\$\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}}|`[^`]*`|\$\w*|\$[@*#?$!-]|[<>]\((?:[^()]|\([^()]*\))*\)|[^\s\"'`$\;&|()<>{{}}]|\{{(?=[^\s{{}}]*\}})[^\s{{}}]*\}}|(?<=[^\s;&|()<>])[{{}}]+)"
    token = re.compile(rf"{_CONFLICT}|[ \t]+|\\\n|(?<![^\s;&|()])#[^\n]*|\n|\[\[(?=\s)[^\n]*?\s\]\]|\(\((?:[^()\n]|\((?:[^()]|\([^()]*\))*\))*\)\)|\d?(?:<<<|<<-?|<&|>&|>>|<>|>\||&>>|&>|<|>)(?:[\d-]+(?=\s|;|$))?|;;&|;;|;&|&&|\|\||\|&|[;&|(){{}}]|{piece}+|[\s\S]")
    reserved = frozenset(("if", "then", "elif", "else", "fi", "for", "while", "until", "do", "done", "case", "esac", "select", "function", "time", "!"))
    assign = re.compile(r"[A-Za-z_]\w*(?:\[[^\]\s]*\])?\+?=")
    operand = r"(?:\"(?:[^\"\\]|\\[\s\S])*\"|'[^']*'|\$\{(?:[^{}]|\{[^{}]*\})*\}|\$\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)|`[^`]*`|\$?[\w@#]+|\$[*?!$-])+"
    arithmetic = re.compile(rf"\s+|\\\n|(?:<<|>>|[-+*/%&|^])=|\+\+|--|\*\*|==|!=|<=|>=|<<|>>|&&|\|\||=|{operand}|[\s\S]")
    binary = r"=~|==|!=|=|-(?:eq|ne|lt|le|gt|ge|nt|ot|ef)(?=\s)"
    condition = re.compile(rf"[ \t]+|\n|&&|\|\||!(?=\s)|{binary}|-[a-zA-Z](?=\s)|[()<>]|(?:\\[\s\S]|{operand}|[^\s()<>&|\"'$`])+|[\s\S]")

    def summed(text: str) -> bool:
        """Whether a text is an arithmetic expression, or a list of them."""
        out = []
        for m in arithmetic.finditer(text):
            w = m.group()
            if w.isspace() or w == "\\\n":
                continue
            if w in ("++", "--"):
                out.append(t["A++"])
            elif len(w) > 1 and w[-1] == "=" and w not in ("==", "!=", "<=", ">=") or w == "=":
                out.append(t["A="])
            elif w in ("**", "==", "!=", "<=", ">=", "<<", ">>"):
                out.append(t["A" + w])
            elif w in "()[]":
                out.append(w)
            elif w in t and not w[0].isalpha():
                out.append(t[w])
            elif re.match(r"[\w\"'$`@#]", w):
                out.append("W")
            else:
                return False
        try:
            folded = g.fold("".join(out))
        except Rejected:
            return False
        return folded is not None and g.accepts("Sum", folded)

    def tested(text: str) -> bool:
        """Whether a text is a conditional expression."""
        out, at = [], 0
        while at < len(text):
            m = condition.match(text, at)
            w, at = m.group(), m.end()
            if not w.strip(" \t"):
                continue
            if w == "\n":
                out.append(NEWLINE)
            elif w == "=~":
                pattern_ = re.compile(r"\s+(?:\\[\s\S]|\"[^\"]*\"|'[^']*'|\((?:[^()]|\([^()]*\))*\)|\[[^\]]*\]|\$\{[^}]*\}|[^\s()&]|&(?!&))+").match(text, at)
                if not pattern_:
                    return False
                out.append(t["T2"] + "W")
                at = pattern_.end()
            elif re.fullmatch(binary.replace(r"(?=\s)", ""), w):
                out.append(t["T2"])
            elif re.fullmatch(r"-[a-zA-Z]", w):
                out.append(t["T1"])
            elif w in ("&&", "||", "!", "(", ")", "<", ">"):
                out.append(w if w in "()" else t[w])
            elif w in "&|":
                return False
            else:
                out.append("W")
        try:
            folded = g.fold("".join(out))
        except Rejected:
            return False
        return folded is not None and g.accepts("Test", folded)

    opened = re.compile(r"\\[\s\S]|\$\(\(|\$\(|[\"'()`]")

    def closing(text: str, at: int) -> int:
        """Where the parenthesis that is open before ``at`` closes; -1 if that can't be told."""
        depth, quoted = 1, False
        for m in re.compile(r"\\[\s\S]|'[^']*'|[\"()]").finditer(text, at):
            c = m.group()[0]
            if c == '"':
                quoted = not quoted
            elif not quoted and c in "()":
                depth += 1 if c == "(" else -1
                if not depth:
                    return m.start()
        return -1

    def substituted(word: str) -> bool:
        """Whether every command substitution of a word holds commands, every arithmetic one a sum."""
        at, quoted = 0, False
        while m := opened.search(word, at):
            w, at = m.group(), m.end()
            if w == '"':
                quoted = not quoted
            elif w == "'" and not quoted:
                at = word.find("'", at) + 1 or len(word)
            elif w == "`":
                at = word.find("`", at) + 1 or len(word)
            elif w in ("$(", "$(("):
                end = closing(word, m.start() + 2)
                if end < 0:
                    return True
                inner = word[m.start() + 2:end]
                if inner.startswith("(") and inner.endswith(")") and closing(inner, 1) == len(inner) - 1:
                    if not summed(inner[1:-1]):
                        return False
                elif "case" not in inner and "<<" not in inner:
                    out = lex(inner)
                    if out is None or not g.accepts("File", out):
                        return False
                at = end + 1
        return True

    pattern = re.compile(r"[ \t\n]*(?:#[^\n]*\n[ \t\n]*)*\(?[ \t]*((?:[^\s()\"'\;&<>]|\\.|\"[^\"\n]*\"|'[^'\n]*'|[ \t]*\|[ \t]*)+)[ \t]*\)")

    def lex(text: str) -> str | None:
        text = text.lstrip("﻿")
        if re.search(r"[\x00-\x08\x0e-\x1f]", text):
            return None
        text = re.sub(r"<<-?[ \t]*([\"']?)(\w+)\1([^\n]*)\n(?:[\s\S]*?\n)??[\t ]*\2(?=\n|\Z)", r"<<<x\3", text)
        stack: list[list] = [["", []]]
        out = stack[-1][1]
        start, at, word_no, head = True, 0, 0, ""
        while at < len(text):
            if stack[-1][0] == "case" and start:
                m = re.compile(r"[ \t\n;]*(?:#[^\n]*\n[ \t\n]*)*esac\b").match(text, at)
                if not m and (m := pattern.match(text, at)):
                    out.append("U")
                    at = m.end()
                    stack.append(["item", out])
                    start = True
                    continue
            m = token.match(text, at)
            w = m.group()
            at = m.end()
            c = w[0]
            if c in " \t" or w == "\\\n" or c == "#" and w.startswith("#"):
                continue
            if len(w) == 7 and w in ("<" * 7, ">" * 7, "|" * 7):
                return None
            if w == "\n":
                if not out or out[-1] != NEWLINE:
                    out.append(NEWLINE)
                start = True
                continue
            if w in (";;", ";&", ";;&"):
                if stack[-1][0] != "item":
                    return None
                stack.pop()
                out.append(t[w])
                start = True
                continue
            if start and w in reserved or w == "in" and head in ("for", "case", "select") or w == "do" and start:
                head_before, head = head, w
                if w in ("if", "for", "while", "until", "case", "select"):
                    stack.append([w, [t[w]]])
                    out = stack[-1][1]
                    start = w in ("if", "while", "until")
                    continue
                if w in ("fi", "done", "esac"):
                    if w == "esac" and stack[-1][0] == "item":
                        stack.pop()
                    want = {"fi": ("if",), "done": ("for", "while", "until", "select"), "esac": ("case",)}[w]
                    if stack[-1][0] not in want:
                        return None
                    content = "".join(stack.pop()[1])
                    out = stack[-1][1]
                    out.append(g.group("K", content))
                    start, head = False, ""
                    continue
                out.append(t[w])
                start = w in ("then", "elif", "else", "do", "!", "time") or (w == "in" and head_before == "case")
                if w == "in":
                    head = ""
                continue
            if w == "(":
                stack.append(["(", []])
                out = stack[-1][1]
                start, head = True, ""
                continue
            if w == ")":
                if stack[-1][0] != "(":
                    return None
                content = "".join(stack.pop()[1])
                out = stack[-1][1]
                out.append(g.group("P", content))
                start = True if out[:-1] and out[-2:-1] == ["W"] and not content else False
                head = ""
                continue
            if w == "{":
                if not start and not (out and (out[-1] == "W" and len(out) > 1 and out[-2] == t["function"])):
                    out.append("W")
                    continue
                stack.append(["{", []])
                out = stack[-1][1]
                start, head = True, ""
                continue
            if w == "}":
                if stack[-1][0] != "{":
                    return None
                if not start:
                    out.append("W")
                    continue
                content = "".join(stack.pop()[1])
                out = stack[-1][1]
                out.append(g.group("B", content))
                start, head = False, ""
                continue
            if w in (";", "&", "&&", "||", "|", "|&"):
                out.append(t[w])
                start = True
                continue
            if w.startswith("[[") and len(w) > 3:
                if not tested(w[2:-2]):
                    return None
                out.append("Q")
            elif w.startswith("((") and len(w) > 3:
                if not all(map(summed, w[2:-2].split(";"))):
                    return None
                out.append(g.group("P", g.group("P", "")))
                start = False
                continue
            elif re.match(r"\d?[<>]|&>", w) and not re.match(r"[<>]\(", w):
                out.append("D")
                if w[-1].isdigit() or w[-1] == "-" and "&" in w:
                    out.append("W")
                continue
            elif "$(" in w and not substituted(w):
                return None
            elif assign.match(w) and (start or text[at:at + 1] == "("):
                out.append("A")
                continue
            elif w in "\"'`$" or ord(c) < 32:
                return None
            else:
                out.append("W")
            start = False
        if len(stack) != 1:
            return None
        return "".join(out)
    return lex


def _yaml():
    g = grammar("yaml")
    t = g.tokens
    key = re.compile(r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'\"%@`][^\n]*?|[-?:](?=\S)[^\n]*?|[&*!]\S+(?:[ \t]+[^\s#][^\n]*?)?|<<)[ \t]*:(?=[ \t]|$)")
    scalar = re.compile(r"(\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*')[ \t]*(#.*)?$")
    flow = re.compile(r"[ \t\n]+|#[^\n]*|\"(?:[^\"\\]|\\[\s\S])*\"(?=\s*:)|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*'|[\[\]{},]|:(?=[\s,\[\]{}]|$)|[&!]\S*|\*[^\s,\]}]+|[^\s,\[\]{}#&*!|>'\"%@`:](?:[^,\[\]{}\n:#]|:(?=[^\s,\[\]{}])|(?<=\S)#)*|[\s\S]")

    def flowed(text: str) -> str | None:
        out = []
        for m in flow.finditer(text):
            w = m.group()
            c = w[0]
            if c in " \t\n" or c == "#":
                continue
            if c in "\"'" and len(w) > 1:
                out.append("S")
            elif w in "[]{}":
                out.append(w)
            elif w in t:
                out.append(t[w])
            elif c in "&!":
                out.append("G")
            elif c == "*" and len(w) > 1:
                out.append("A")
            elif c in "\"'`@%|>":
                return None
            else:
                out.append("X")
        return g.fold("".join(out))

    def lex(text: str) -> str | None:
        text = text.lstrip("﻿")
        if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", text) or re.search(r"(?m)^(?:<{7}|>{7}|\|{7})(?: |$)", text):
            return None
        lines = text.split("\n")
        rows: list[tuple[int, str]] = []
        i = 0
        while i < len(lines):
            line = lines[i]
            i += 1
            body = line.strip(" \t\r")
            if not body or body[0] == "#":
                continue
            if line.startswith("%") and not rows:
                continue
            if re.match(r"---(?:\s|$)|\.\.\.\s*$", line):
                rows.append((0, "doc" + line[:3]))
                rest = line[3:].strip()
                if not rest or rest[0] == "#":
                    continue
                body, indent = rest, 4
            else:
                indent = len(line) - len(line.lstrip(" "))
                if line[indent:indent + 1] == "\t":
                    return None
            if re.match(r"={7}$", line):
                return None
            # Dashes and question marks open lines of their own.
            while m := re.match(r"-[ \t]+(?=\S)|-$", body):
                rows.append((indent, "-"))
                if m.end() >= len(body):
                    body = ""
                    break
                indent += m.end()
                body = body[m.end():]
            if not body or body[0] == "#":
                continue
            m = key.match(body)
            value = body
            k = ""
            if m and not (body[0] in "\"'" and not re.match(r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*')[ \t]*:", body)):
                k, value = "Y", body[m.end():].strip()
            got = ""
            while g_m := re.match(r"(?:&\S+|!\S*)(?:[ \t]+|$)", value):
                got += "G"
                value = value[g_m.end():]
            if not value or value[0] == "#":
                pass
            elif re.match(r"[|>][+-]?\d?[+-]?[ \t]*(?:#.*)?$", value):
                got += "B"
                while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" ")) > (indent if k or not rows or rows[-1][1] != "-" else rows[-1][0])):
                    i += 1
            elif value[0] in "[{" or value[0] in "\"'":
                whole = value
                while (_open(whole) if value[0] in "[{" else not scalar.match(whole)) and i < len(lines):
                    if value[0] in "\"'" and re.match(r"\S", lines[i]) and k:
                        return None
                    whole += "\n" + lines[i]
                    i += 1
                if value[0] in "[{":
                    folded = flowed(whole)
                    if folded is None or len(folded) != 1:
                        return None
                    got += folded
                elif not scalar.match(whole):
                    return None
                else:
                    got += "S"
            elif re.match(r"\*[^\s,\[\]{}]+[ \t]*(?:#.*)?$", value):
                got += "A"
            elif value[0] in "]},%@`&*" or value[0] in "|>" or re.match(r"[-?:](?:\s|$)", value):
                return None
            else:
                plain = re.sub(r"[ \t]#.*$", "", value)
                if re.search(r":(?:[ \t]|$)", plain):
                    return None
                got += "X"
            rows.append((indent, "=" + k + got))
        return structure(rows)

    def _open(text: str) -> bool:
        depth = 0
        for m in flow.finditer(text):
            w = m.group()
            depth += (w in "[{") - (w in "]}") if len(w) == 1 else 0
        return depth > 0

    def structure(rows: list[tuple[int, str]]) -> str | None:
        stack: list[tuple[int, list[str]]] = [(-1, [])]

        def close() -> None:
            _, inside = stack.pop()
            last = stack[-1][1]
            folded = g.group("K", "".join(inside))
            if last and last[-1] == NEWLINE:
                last.append(folded)
            else:
                last.append(folded)

        for indent, what in rows:
            if what.startswith("doc"):
                while len(stack) > 1:
                    close()
                stack[-1][1].append(t[what[3:]])
                continue
            while stack[-1][0] > indent:
                close()
            if stack[-1][0] < indent:
                if stack[-1][0] == -1:
                    stack[-1] = (indent, stack[-1][1])
                else:
                    stack.append((indent, []))
            out = stack[-1][1]
            out.append(t["-"] + NEWLINE if what == "-" else what[1:] + NEWLINE)
        while len(stack) > 1:
            close()
        return "".join(stack[0][1])
    return lex


@lru_cache(maxsize=None)
def lexer(language: str):
    """The lexing function of a language, made once per worker."""
    return {"javascript": lambda: _script("javascript"), "typescript": lambda: _script("typescript"), "go": _go, "java": _java, "rust": _rust,
            "c": _c, "python": _python, "ruby": _ruby, "bash": _bash, "sql": _sql, "json": _json, "yaml": _yaml}[language]()
