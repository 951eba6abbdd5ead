"""A generalised LL recogniser with a graph-structured stack.

Grammars are text: one rule a line, ``Name: alternatives``, with ``|  ( )  ?  *
+``, quoted tokens, upper-case token classes, ``END`` for the end of the text at
hand, and bracketed parts as ``P[X]`` (round), ``S[X]`` (square), ``B[X]``
(curly) and ``K[X]`` (keyword blocks or indented suites): one symbol whose
content has to derive ``X``. ``Name |= alternatives`` extends a rule.

A file is a string with one character a token. Bracketed parts are replaced
from the inside out by one character each, which stands for the set of rules
that the part derives: whatever a grammar asks of a part, parts with the same
set are alike. All rules that may be asked, and all dialects of a language, are
roots of one run over one graph-structured stack, so what they have in common
is recognised once. Texts that differ only in names, values or the insides of
brackets become equal, and each of them is parsed once a worker.

Two forms of rule need no parse of the whole, as each follows from the rule
itself: a rule declared by ``%seq`` is a repetition, so a text may be cut after
given tokens, and if every piece derives the rule, so does the whole; a rule
one of whose alternatives is a list, as ``X (',' X)* ','?``, derives every text
whose parts between the separators derive ``X``. If a piece fails, the whole is
parsed as one.
"""

from __future__ import annotations

import re

ERROR, NEWLINE = "\x00", "\n"
#: Where the characters of bracketed parts begin, by kind; 65,536 of each.
BASES = {"P": 0x30000, "S": 0x40000, "B": 0x50000, "K": 0x60000}
_GROUPS = {base >> 16: kind + "[" for kind, base in BASES.items()}
_INNER = re.compile(r"\(([^()\[\]{}]*)\)|\[([^()\[\]{}]*)\]|\{([^()\[\]{}]*)\}")
#: The alternatives that are lists: element, separator, and whether one may stand at the end.
_LIST = re.compile(r"\(?(\w+) \('([^']+)' \1\)\*( '\2'\?)?(?:\)\??)?$")
_RULE_TOKEN = re.compile(r"\s*(?:'([^']+)'|([PSBK])\[(\w+)\]|(\w+)|([|()?*+]))")


class Rejected(Exception):
    """A part of the file derives no rule that any bracketed part may derive."""


class Slot:
    """A place in the body of an alternative: what to match next, and what follows."""

    __slots__ = ("kind", "chars", "rule", "group", "next")

    def __init__(self, kind: str, chars=None, rule=None, group=None, following=None):
        self.kind, self.chars, self.rule, self.group, self.next = kind, chars, rule, group, following


class Rule:
    """``nullable``: it can match nothing, perhaps only at the end of the text; ``empty``: anywhere."""

    __slots__ = ("name", "bodies", "slots", "first", "nullable", "empty", "number", "ahead")

    def __init__(self, name: str):
        self.name, self.bodies, self.slots, self.first, self.nullable, self.empty = name, [], [], set(), False, False
        self.ahead = Ahead(self)


class Ahead(dict):
    """The next token to the alternatives that can match there, none if the rule
    can't; null if all it can match there is nothing. The end of the text is null."""

    def __init__(self, rule: Rule):
        self.rule = rule

    def __missing__(self, kind: str | None) -> tuple | None:
        slots = tuple(slot for slot, first in self.rule.slots if kind in first)
        nothing = self.rule.empty if kind is not None else self.rule.nullable
        found = self[kind] = (*slots, _NOTHING) if slots and nothing else None if nothing else slots
        return found


_NOTHING = Slot("done")


class Grammar:
    """The grammar of one language with the token characters it needs."""

    def __init__(self, text: str, classes: dict[str, str], soft: str = "", keyword_names: bool = True):
        """``classes`` maps class names to token characters; ``soft`` lists
        keywords that also are of class ID; the class NAME is ID and, with
        ``keyword_names``, every word token."""
        self.rules: dict[str, Rule] = {}
        self.tokens: dict[str, str] = {}
        self.sequences: dict[str, str] = {}
        self.lists: dict[str, list[tuple[str, str, bool]]] = {}
        lines = [line for line in text.strip().split("\n") if line.strip()]
        merged: list[str] = []
        for line in lines:
            if line[0].isspace():
                merged[-1] += " " + line.strip()
            else:
                merged.append(line)
        for literal in re.findall(r"'([^']+)'", text) + soft.split():
            if literal not in self.tokens:
                self.tokens[literal] = literal if literal in "()[]{};" else chr(0x100 + len(self.tokens))
        ids = classes["ID"] + "".join(self.tokens[w] for w in soft.split())
        words = "".join(c for w, c in self.tokens.items() if re.match(r"[^\W\d]", w))
        self.classes = {k: frozenset(v) for k, v in (classes | {"ID": ids, "NAME": ids + words if keyword_names else ids}).items()}
        for line in merged:
            if line.startswith("%seq"):
                _, name, *cuts = line.split()
                self.sequences[name] = "".join({"NL": NEWLINE, "B": "B"}.get(c) or self.tokens[c.strip("'")] for c in cuts)
                continue
            name, extends, body = re.match(r"(\w+)\s*(\|?)[:=]\s*(.*)$", line).groups()
            rule = self._rule(name)
            if not extends:
                rule.bodies, self.lists[name] = [], []
            for m in filter(None, map(_LIST.match, _alternatives(body))):
                self.lists.setdefault(name, []).append((m.group(1), self.tokens[m.group(2)], bool(m.group(3))))
            self._tokens, self._at = _RULE_TOKEN.findall(body + " "), 0
            rule.bodies += self._alternatives()
        self._finish()
        self.reset()

    def _rule(self, name: str) -> Rule:
        if name not in self.rules:
            self.rules[name] = Rule(name)
        return self.rules[name]

    # -- reading rules

    def _alternatives(self) -> list[list[tuple]]:
        bodies, body = [], []
        while self._at < len(self._tokens):
            literal, group, inner, word, sign = self._tokens[self._at]
            if sign == ")":
                break
            self._at += 1
            if sign == "|":
                bodies.append(body)
                body = []
                continue
            if sign == "(":
                item = ("rule", self._auxiliary(self._alternatives()))
                self._at += 1
            elif literal:
                item = ("chars", frozenset(self.tokens[literal]))
            elif group:
                item = ("group", group, inner)
            elif word == "END":
                item = ("end",)
            elif word in self.classes:
                item = ("chars", self.classes[word])
            else:
                item = ("rule", word)
            while self._at < len(self._tokens) and self._tokens[self._at][4] in ("?", "*", "+") and self._tokens[self._at][4]:
                sign = self._tokens[self._at][4]
                self._at += 1
                if sign == "?":
                    item = ("rule", self._auxiliary([[item], []]))
                else:
                    star = self._auxiliary([])
                    self.rules[star].bodies = [[item, ("loop",)], []]
                    item = ("rule", star) if sign == "*" else ("rule", self._auxiliary([[item, ("rule", star)]]))
            body.append(item)
        bodies.append(body)
        return bodies

    def _auxiliary(self, bodies: list) -> str:
        name = f"_{len(self.rules)}"
        self._rule(name).bodies = bodies
        return name

    def _finish(self) -> None:
        for rule in list(self.rules.values()):
            for body in rule.bodies:
                for item in body:
                    named = item[1] if item[0] == "rule" else item[2] if item[0] == "group" else None
                    if named and named not in self.rules:
                        raise ValueError(f"no rule {named}, used in {rule.name}")
        self.lists = {name: kept for name, own in self.lists.items() if (kept := [x for x in own if x[0] in self.rules])}
        for n, rule in enumerate(self.rules.values()):
            rule.number = n
            rule.slots = []
            for body in rule.bodies:
                slot = Slot("done")
                for item in reversed(body):
                    if item[0] == "chars":
                        slot = Slot("chars", chars=item[1], following=slot)
                    elif item[0] == "group":
                        slot = Slot("group", group=item[1] + "[", rule=self.rules[item[2]], following=slot)
                    elif item[0] == "end":
                        slot = Slot("end", following=slot)
                    elif item[0] == "loop":
                        slot = Slot("loop", rule=rule)
                    else:
                        slot = Slot("rule", rule=self.rules[item[1]], following=slot)
                rule.slots.append(slot)
        changed = True
        while changed:
            changed = False
            for rule in self.rules.values():
                for slot in rule.slots:
                    first, nullable, empty = self._first(slot)
                    if not first <= rule.first or nullable and not rule.nullable or empty and not rule.empty:
                        rule.first |= first
                        rule.nullable |= nullable
                        rule.empty |= empty
                        changed = True
        for rule in self.rules.values():
            rule.slots = [(slot, self._first(slot)[0]) for slot in rule.slots]
        self.asked: dict[str, list[Rule]] = {k: [] for k in BASES}
        for rule in self.rules.values():
            for item in (i for body in rule.bodies for i in body if i[0] == "group"):
                if self.rules[item[2]] not in self.asked[item[1]]:
                    self.asked[item[1]].append(self.rules[item[2]])

    @staticmethod
    def _first(slot: Slot) -> tuple[set, bool, bool]:
        """The tokens a text matched from ``slot`` can begin with, and whether it can be empty, at the end and anywhere."""
        first: set = set()
        empty = True
        while True:
            if slot.kind == "chars":
                return first | slot.chars, False, False
            if slot.kind == "group":
                return first | {slot.group}, False, False
            if slot.kind == "rule":
                first |= slot.rule.first
                if not slot.rule.nullable:
                    return first, False, False
                empty &= slot.rule.empty
            elif slot.kind == "end":
                empty = False
            else:
                return first, True, empty
            slot = slot.next

    # -- bracketed parts

    def reset(self) -> None:
        """Forget all parts; they hold no state that a result depends on."""
        self.part: dict[tuple[str, str], str] = {}
        self.alike: dict[tuple[str, frozenset], str] = {}
        self.derived: dict[str, frozenset] = {}
        self.known: dict[tuple[int, str], bool] = {}

    def full(self) -> bool:
        return len(self.part) > 100_000 or len(self.known) > 200_000 or len(self.alike) > 30_000

    def group(self, kind: str, content: str) -> str:
        """The character of a bracketed part."""
        key = (kind, content)
        char = self.part.get(key)
        if char is None:
            rules = frozenset(rule.number for rule in self.deriving(self.asked[kind], content))
            if not rules:
                raise Rejected
            char = self.alike.get((kind, rules))
            if char is None:
                char = self.alike[kind, rules] = chr(BASES[kind] + sum(k == kind for k, _ in self.alike))
                self.derived[char] = rules
            self.part[key] = char
        return char

    def fold(self, text: str) -> str | None:
        """Replace round, square and curly parts from the inside out; null if brackets don't match."""
        def part(m: re.Match) -> str:
            kind = m.lastindex
            content = m.group(kind)
            if kind < 3 and NEWLINE in content:
                content = content.replace(NEWLINE, "")
            return self.group("PSB"[kind - 1], content)
        n = 1
        while n:
            text, n = _INNER.subn(part, text)
        return None if any(c in text for c in "()[]{}") else text

    # -- recognising

    def deriving(self, rules: list[Rule], text: str) -> list[Rule]:
        """The rules from which the whole text derives; what is not known yet is found in one run."""
        open_, found = [], []
        for rule in rules:
            known = self.known.get((rule.number, text))
            if known is None and self._by_parts(rule, text):
                known = self.known[rule.number, text] = True
            if known is None:
                open_.append(rule)
            elif known:
                found.append(rule)
        if open_:
            derive = self._parse(open_, text)
            for rule in open_:
                self.known[rule.number, text] = rule.number in derive
            found += [rule for rule in open_ if rule.number in derive]
        return found

    def derives(self, rule: Rule, text: str) -> bool:
        return bool(self.deriving([rule], text))

    def _by_parts(self, rule: Rule, text: str) -> bool:
        """Whether the parts of a repetition or list show that the whole derives."""
        cuts = self.sequences.get(rule.name)
        if cuts:
            pieces = self._pieces(text, cuts)
            if len(pieces) > 1 and all(self.derives(rule, p) for p in dict.fromkeys(pieces)):
                return True
        for element, separator, ends in self.lists.get(rule.name, ()):
            if separator in text:
                pieces = text.split(separator)
                if ends and not pieces[-1]:
                    pieces.pop()
                if all(self.derives(self.rules[element], p) for p in dict.fromkeys(pieces)):
                    return True
        return False

    @staticmethod
    def _pieces(text: str, cuts: str) -> list[str]:
        """Cut after each of the given tokens, and after curly parts if ``B`` is among them."""
        pieces, start, curly = [], 0, "B" in cuts
        for i, c in enumerate(text):
            if c in cuts and c != "B" or curly and 0x50000 <= ord(c) < 0x60000:
                pieces.append(text[start:i + 1])
                start = i + 1
        if start < len(text):
            pieces.append(text[start:])
        return pieces

    def accepts(self, starts: str | list[str], text: str) -> bool:
        """Whether the text derives from one of the start rules, all tried together.
        Where they are repetitions with the same cuts, the dialects that every
        piece derives from decide."""
        rules = [self.rules[s] for s in ([starts] if isinstance(starts, str) else starts)]
        cuts = {self.sequences.get(rule.name) for rule in rules}
        if len(cuts) == 1 and None not in cuts:
            left = rules
            for piece in dict.fromkeys(self._pieces(text, cuts.pop())):
                left = self.deriving(left, piece)
                if not left:
                    break
            if left:
                return True
        return bool(self.deriving(rules, text))

    def _parse(self, rules: list[Rule], text: str) -> set[int]:
        """GLL: the numbers of the rules that derive the whole text. Descriptors
        (slot, stack node, position) are worked off in any order; a stack node is
        a rule called at a position, with edges to where calls return and the
        ends found so far, which are replayed to later callers. A repetition stays
        in its node: each end of it is where the next round begins."""
        size = len(text)
        kinds: list[str | None] = [_GROUPS[ord(c) >> 16] if c >= "\U00030000" else c for c in text]
        kinds.append(None)
        derived, width = self.derived, size + 1
        nodes: dict[int, tuple[set, set]] = {}
        seen: set = set()
        work: list = []
        whole: set[int] = set()
        missing = set()
        for rule in rules:
            slots = rule.ahead[kinds[0]]
            if slots:
                node = rule.number * width
                nodes[node] = set(), set()
                missing.add(node)
                work += [(slot, node, 0) for slot in slots]
            elif slots is None and not size:
                whole.add(rule.number)
        while work and missing:
            slot, node, at = work.pop()
            while True:
                kind = slot.kind
                if kind == "chars":
                    if kinds[at] in slot.chars:
                        at += 1
                        slot = slot.next
                        continue
                    break
                if kind == "rule":
                    called = slot.rule
                    slots = called.ahead[kinds[at]]
                    if slots is None:
                        slot = slot.next
                        continue
                    if not slots:
                        break
                    inner = called.number * width + at
                    back = (slot.next, node)
                    if inner not in nodes:
                        nodes[inner] = {back}, set()
                        for slot in slots:
                            work.append((slot, inner, at))
                        break
                    edges, ends = nodes[inner]
                    if back not in edges:
                        edges.add(back)
                        for end in ends:
                            item = (*back, end)
                            if item not in seen:
                                seen.add(item)
                                work.append(item)
                    break
                if kind == "group":
                    if kinds[at] == slot.group and slot.rule.number in derived[text[at]]:
                        at += 1
                        slot = slot.next
                        continue
                    break
                if kind == "end":
                    if at == size:
                        slot = slot.next
                        continue
                    break
                edges, ends = nodes[node]
                if at not in ends:
                    if at == size and node in missing:
                        missing.remove(node)
                        whole.add(node // width)
                    ends.add(at)
                    for back in edges:
                        item = (*back, at)
                        if item not in seen:
                            seen.add(item)
                            work.append(item)
                    if kind == "loop":
                        for following in slot.rule.ahead[kinds[at]] or ():
                            work.append((following, node, at))
                break
        return whole


def _alternatives(body: str) -> list[str]:
    """The alternatives of a rule as text: cut at bars outside of parentheses and quotes."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(body):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                out.append(body[start:i].strip())
                start = i + 1
    return [*out, body[start:].strip()]
