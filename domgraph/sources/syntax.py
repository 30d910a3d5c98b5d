"""Facts of Swift source files: a tokenizer and a brace-aware walk over declarations, closures and awaits.

The walk reads what the facts need and no more: it follows braces and the starts of statements, not expressions. A file becomes
events in source order (types entered and left, members, closures, awaits); rows are made from them once the whole file
is known, since a conformance may name a protocol that is declared further down.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

PLACEHOLDER = "syntactic:"

#: Names of operating systems in conditions by platform, and modules that only some platforms have.
PLATFORM_NAMES = {"iOS": ("ios",), "macOS": ("macos", "osx"), "tvOS": ("tvos",), "watchOS": ("watchos",)}
PLATFORM_MODULES = {
    "AppKit": ("macOS",),
    "Cocoa": ("macOS",),
    "IOKit": ("macOS",),
    "CoreWLAN": ("macOS",),
    "ScriptingBridge": ("macOS",),
    "PreferencePanes": ("macOS",),
    "InstallerPlugins": ("macOS",),
    "UIKit": ("iOS", "tvOS"),
    "WatchKit": ("watchOS",),
    "TVUIKit": ("tvOS",),
}
_LANGUAGE = (6, 0)

_MODIFIERS = frozenset(
    "public private fileprivate internal open package static class final override mutating nonmutating nonisolated isolated lazy weak unowned"
    " required convenience dynamic optional indirect prefix postfix infix distributed consuming borrowing async".split()
)
_TYPES = ("actor", "class", "struct", "enum", "extension", "protocol")
_ACCESSORS = frozenset("get set willSet didSet _read _modify unsafeAddress unsafeMutableAddress init".split())
_BLOCKS = frozenset("if guard while for switch catch".split())
_OPERATOR = "=-+!*%<>&|^~?/"
_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<text>\#*\"\"\"|\#*\")|(?P<name>`[^`\n]+`|[$#@]?[^\W\d][\w\u0300-\u036f]*|\$\d+)|(?P<number>\d[\w.]*(?<!\.))"
    r"|(?P<operator>->|\.\.[.<]|[=\-+!*%<>&|^~?/]+)|(?P<mark>.)",
    re.DOTALL,
)


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    at: int
    end: int
    first: bool = False


def tokens(source: str) -> list[Token]:
    """Words, operators, marks and string literals; what a literal interpolates comes as tokens in parentheses behind it."""
    out: list[Token] = []
    _tokens(source, 0, len(source), out)
    line_of = 0
    for t in out:
        t.first = "\n" in source[line_of : t.at]
        line_of = t.end
    if out:
        out[0].first = True
    return out


def _tokens(source: str, at: int, stop: int, out: list[Token]) -> None:
    while at < stop:
        m = _TOKEN.match(source, at, stop)
        kind = m.lastgroup
        if kind == "block":
            depth, at = 1, at + 2
            while at < stop and depth:
                two = source[at : at + 2]
                depth += (two == "/*") - (two == "*/")
                at += 2 if two in ("/*", "*/") else 1
            continue
        if kind == "text":
            at = _literal(source, at, stop, out)
            continue
        if kind == "name" and m[0][0] == "@":
            out += [Token("mark", "@", at, at + 1), Token("name", m[0][1:], at + 1, m.end())]
        elif kind not in ("space", "line"):
            # Angle brackets and optional marks stand alone, so that types can be read.
            text = m[0]
            if kind == "operator" and set(text) <= set("<>?!&"):
                out += [Token("operator", c, at + k, at + k + 1) for k, c in enumerate(text)] if text not in ("&&", "??") else [Token("operator", text, at, m.end())]
            else:
                out.append(Token(kind, text.strip("`") if kind == "name" else text, at, m.end()))
        at = m.end()


def _literal(source: str, at: int, stop: int, out: list[Token]) -> int:
    hashes = re.match("#*", source[at:])[0]
    quote = '"""' if source.startswith('"""', at + len(hashes)) else '"'
    token = Token("text", "", at, at)
    out.append(token)
    at += len(hashes) + len(quote)
    escape, close = "\\" + hashes, quote + hashes
    while at < stop:
        if source.startswith(close, at):
            at += len(close)
            break
        if source.startswith(escape + "(", at):
            depth, start = 1, at + len(escape)
            end = start + 1
            while end < stop and depth:
                if source[end] == '"':
                    end = _literal(source, end, stop, [])
                    continue
                depth += (source[end] == "(") - (source[end] == ")")
                end += 1
            out.append(Token("mark", "(", start, start + 1))
            _tokens(source, start + 1, end - 1, out)
            out.append(Token("mark", ")", end - 1, end))
            at = end
        elif source.startswith(escape, at):
            at += len(escape) + 1
        elif quote == '"' and source[at] == "\n":
            break
        else:
            at += 1
    token.text, token.end = quote, at
    return at


class Condition:
    """A condition of conditional compilation; what it doesn't know of it takes to hold."""

    def __init__(self, given: list[Token], platform: str):
        self.given, self.at, self.platform = given, 0, platform

    def _next(self) -> str:
        return self.given[self.at].text if self.at < len(self.given) else ""

    def holds(self) -> bool:
        value = self._all()
        while self._next() == "||":
            self.at += 1
            value = self._all() or value
        return value

    def _all(self) -> bool:
        value = self._one()
        while self._next() == "&&":
            self.at += 1
            value = self._one() and value
        return value

    def _one(self) -> bool:
        word = self._next()
        self.at += 1
        if word == "!":
            return not self._one()
        if word == "(":
            value = self.holds()
            self.at += 1
            return value
        if self._next() != "(":
            return word != "false"
        self.at += 1
        inside = []
        while self._next() not in (")", ""):
            inside.append(self._next())
            self.at += 1
        self.at += 1
        if word == "os":
            return inside[0].lower() in PLATFORM_NAMES.get(self.platform, (inside[0].lower(),))
        if word == "canImport":
            return self.platform in PLATFORM_MODULES.get(inside[0], (self.platform,))
        if word in ("swift", "compiler"):
            version = tuple(int(x) for x in re.findall(r"\d+", "".join(inside[1:])))
            sign = "".join(x for x in inside if x in "<>=" or x in ("<=", ">="))
            return _LANGUAGE < version if sign == "<" else _LANGUAGE >= version
        return True


def active(found: list[Token], platform: str | None) -> list[Token]:
    """The tokens of the clauses that hold for a platform; of all clauses without one."""
    out: list[Token] = []
    stack: list[list[bool]] = []  # for each open directive: whether its clause counts, and whether one before did
    k = 0
    while k < len(found):
        t = found[k]
        if t.text in ("#if", "#elseif", "#else", "#endif"):
            line = [k + 1]
            while line[-1] < len(found) and not found[line[-1]].first:
                line.append(line[-1] + 1)
            condition = found[k + 1 : line[-1]]
            if t.text == "#if":
                holds = platform is None or Condition(condition, platform).holds()
                stack.append([holds, holds])
            elif t.text == "#endif":
                stack.pop() if stack else None
            elif stack and platform is not None:
                holds = not stack[-1][1] and (t.text == "#else" or Condition(condition, platform).holds())
                stack[-1] = [holds, stack[-1][1] or holds]
            k = line[-1]
            continue
        if all(s[0] for s in stack):
            out.append(t)
        k += 1
    return out


@dataclass
class Event:
    """What the walk meets: enter and leave of a scope, member, closure, await."""

    kind: str
    name: str = ""
    at: int = 0
    start: int = 0
    what: str = ""
    attributes: list[str] = field(default_factory=list)
    modifiers: list[str] = field(default_factory=list)
    inherits: list[str] = field(default_factory=list)
    end: int = 0
    call: tuple[str, str] | None = None
    direct: bool = False


def inherited_name(found: list[Token], source: str) -> str | None:
    """the bare name of an entry of an inheritance clause; None for a suppression."""
    k = 0
    while k < len(found) and (found[k].text == "@" or found[k].text in ("nonisolated", "isolated", "consuming", "borrowing", "sending")):
        if found[k].text == "@":
            k += 2
            while k < len(found) and found[k].text == ".":
                k += 2
            if k < len(found) and found[k].text == "(" and found[k].at == found[k - 1].end:
                k = _closing(found, k) + 1
        else:
            k += 1
    found = found[k:]
    if not found or found[0].text == "~":
        return None
    name, k = None, 0
    while k < len(found) and found[k].kind == "name":
        name, k = found[k].text, k + 1
        if k < len(found) and found[k].text == "<":
            k = _closing(found, k) + 1
        if k == len(found):
            return name
        if found[k].text != ".":
            break
        k += 1
    return source[found[0].at : found[-1].end]


_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}


def _closing(found: list[Token], at: int) -> int:
    """Where the bracket that opens at `at` closes."""
    opening, closing, depth = found[at].text, _PAIRS[found[at].text], 0
    for k in range(at, len(found)):
        depth += (found[k].text == opening) - (found[k].text == closing)
        if not depth:
            return k
    return len(found) - 1


def _opening(found: list[Token], at: int) -> int:
    closing = found[at].text
    opening, depth = {v: k for k, v in _PAIRS.items()}[closing], 0
    for k in range(at, -1, -1):
        depth += (found[k].text == closing) - (found[k].text == opening)
        if not depth:
            return k
    return 0


class Walk:
    """One pass over a file's tokens that lists its events."""

    def __init__(self, source: str, found: list[Token]):
        self.source, self.t = source, found
        self.events: list[Event] = []
        #: Open braces and parentheses: what each is, and whether a block is awaited in it.
        self.stack: list[dict] = [{"what": "file", "block": None, "var": None}]

    def run(self) -> list[Event]:
        k = 0
        while k < len(self.t):
            k = self._step(k)
        return self.events

    def _text(self, k: int) -> str:
        return self.t[k].text if 0 <= k < len(self.t) else ""

    def _starts(self, k: int) -> bool:
        """Whether a statement or declaration may start here."""
        before = self._text(k - 1) if k else "{"
        if before in ("{", "}", ";", ":", "in") or before == ")" and self.t[k].first:
            return True
        p = self.t[k - 1]
        return self.t[k].first and before not in (",", "(", "[", ".", "&&", "||", "@", "if", "guard", "while", "case", "for", "=") and p.kind != "operator" or self.t[k].first and before in ("?", "!", ">")

    def _step(self, k: int) -> int:
        text, top = self._text(k), self.stack[-1]
        if self.t[k].first and top["var"] and text not in ("{", "=", ".", ":") and self._text(k - 1) not in ("=", ",", ":", ".") and self.t[k].kind != "operator":
            top["var"] = None
        if self._starts(k):
            after = self._declaration(k)
            if after is not None:
                return after
        if text in _BLOCKS and self._text(k - 1) != ".":
            if not (text == "while" and top.get("closed") == "repeat" and self._text(k - 1) == "}"):
                top["block"] = "block"
        elif text in ("else", "do", "defer", "repeat"):
            top["block"] = "repeat" if text == "repeat" else "block"
        elif text == "=" and top["var"]:
            top["var"] = "value"
        elif text == "await" and self._text(k - 1) != "for" and not (self._text(k - 1) == "try" and self._text(k - 2) == "for"):
            self.events.append(Event("await", at=self.t[k].at, end=self.t[self._operand(k + 1)].end))
        if text in ("(", "["):
            self.stack.append({"what": text, "block": None, "var": None})
        elif text in (")", "]"):
            if len(self.stack) > 1 and self.stack[-1]["what"] in ("(", "["):
                self.stack.pop()
        elif text == "{":
            self._open(k)
        elif text == "}":
            self._close(k)
        return k + 1

    def _open(self, k: int) -> None:
        top, inner = self.stack[-1], {"what": "block", "block": None, "var": None}
        if top["var"] and self._accessors(k):
            inner["what"], top["var"] = "accessors", None
        elif top["var"] == "type":
            top["var"] = None
        elif top["block"]:
            inner["what"] = top["block"]
            top["block"] = None
        elif top["what"] == "accessors":
            pass
        else:
            end = self.t[_closing(self.t, k)].end
            self.events.append(Event("closure", at=self.t[k].at, end=end, attributes=self._signature(k), call=self._caller(k)))
            inner["what"] = "closure"
        self.stack.append(inner)

    def _close(self, k: int) -> None:
        while len(self.stack) > 1 and self.stack[-1]["what"] in ("(", "["):
            self.stack.pop()
        if len(self.stack) > 1:
            left = self.stack.pop()
            if left["what"] in _TYPES:
                self.events.append(Event("leave", what=left["what"]))
            self.stack[-1]["closed"] = left["what"]

    def _accessors(self, k: int) -> bool:
        """Whether the brace at k opens a list of accessors."""
        k += 1
        while self._text(k) == "@" or self._text(k) in ("mutating", "nonmutating", "nonisolated"):
            k += 1 if self._text(k) != "@" else 2
            if self._text(k) == "(" and self.t[k].at == self.t[k - 1].end:
                k = _closing(self.t, k) + 1
        after = self._text(k + 1)
        return self._text(k) in _ACCESSORS and (after in ("{", "}", "(", "async", "throws", "@") or after in _ACCESSORS)

    def _signature(self, k: int) -> list[str]:
        """The attributes of a closure's signature."""
        found, depth, k = [], 0, k + 1
        while k < len(self.t):
            text = self._text(k)
            if depth == 0 and text == "in":
                return found
            if text == "@" and not depth:
                name, k = self._attribute(k)
                found.append(name)
                continue
            depth += (text in ("(", "[")) - (text in (")", "]"))
            if depth < 0 or text in ("{", "}", ";", "=") or not depth and text in ("let", "var", "if", "for", "return"):
                return []
            k += 1
        return []

    def _attribute(self, k: int) -> tuple[str, int]:
        """Name of the attribute at k, and the place after it."""
        start = k + 1
        k += 2
        while self._text(k) == "." and self.t[k].at == self.t[k - 1].end:
            k += 2
        name = self.source[self.t[start].at : self.t[k - 1].end] if start < len(self.t) else ""
        if self._text(k) == "(" and self.t[k].at == self.t[k - 1].end:
            k = _closing(self.t, k) + 1
        return name, k

    def _caller(self, k: int) -> tuple[str, str] | None:
        """Receiver and member of the call whose trailing closure, or argument `execute`, opens at k."""
        k -= 1
        if self._text(k) == ":" and self._text(k - 1) == "execute":
            depth = 0
            while k >= 0:
                depth += (self._text(k) in (")", "]", "}")) - (self._text(k) in ("(", "[", "{"))
                if depth < 0:
                    break
                k -= 1
            if self._text(k) != "(":
                return None
            k -= 1
        elif self._text(k) == ")":
            k = _opening(self.t, k) - 1
        if k < 2 or self.t[k].kind != "name" or self._text(k - 1) != ".":
            return None
        member, end = self._text(k), k - 2
        start = self._expression_start(end)
        if start is None:
            return None
        return self.source[self.t[start].at : self.t[end].end], member

    def _expression_start(self, k: int) -> int | None:
        """Where the postfix expression that ends at k begins; None if there is none."""
        start = None
        while k >= 0:
            while self._text(k) in ("?", "!") and self.t[k].at == self.t[k - 1].end:
                k -= 1
            if self._text(k) in (")", "]", "}"):
                start = k = _opening(self.t, k)
                if k and (self.t[k - 1].kind == "name" or self._text(k - 1) in (")", "]", "}", "?", "!")) and not self.t[k].first:
                    k -= 1
                    continue
            elif self.t[k].kind in ("name", "text", "number"):
                start = k
            else:
                return start
            if k and self._text(k - 1) == ".":
                if k > 1 and (self.t[k - 2].kind in ("name", "text", "number") or self._text(k - 2) in (")", "]", "}", "?", "!")):
                    k -= 2
                    continue
                return k - 1
            return start
        return start

    def _operand(self, k: int) -> int:
        """The last token of the postfix expression that starts at k."""
        while self._text(k) in ("try", "await", "consume", "copy", "any") or self.t[k].kind == "operator" and k + 1 < len(self.t) if k < len(self.t) else False:
            k += 1
            while self._text(k) in ("?", "!") and k + 1 < len(self.t):
                k += 1
        if k >= len(self.t):
            return len(self.t) - 1
        if self._text(k) == "." and k + 1 < len(self.t):
            k += 1
        if self._text(k) in ("(", "[", "{"):
            k = _closing(self.t, k)
        elif self.t[k].kind == "text":
            while self._text(k + 1) == "(" and self.t[k + 1].at < self.t[k].end:
                k = k + 1
                k = _closing(self.t, k)
        while k + 1 < len(self.t):
            n = self.t[k + 1]
            close = n.at == self.t[k].end
            if n.text == "." and k + 2 < len(self.t):
                k += 2
            elif n.text in ("(", "[") and not n.first:
                k = _closing(self.t, k + 1)
            elif n.text in ("?", "!") and close:
                k += 1
            elif n.text == "<" and close and (end := _closing(self.t, k + 1)) + 1 < len(self.t) and self._text(end + 1) in ("(", ".", "{"):
                k = end
            elif n.text == "{" and not self.stack[-1]["block"] and not n.first:
                k = _closing(self.t, k + 1)
            else:
                break
        return k

    def _declaration(self, k: int) -> int | None:
        """Events of the declaration that starts at k, and where the walk goes on; None if none does."""
        start, attributes, modifiers = k, [], []
        while k < len(self.t):
            text = self._text(k)
            if text == "@":
                name, k = self._attribute(k)
                attributes.append(name)
            elif text in _MODIFIERS and not (text == "class" and self._is_type(k)):
                modifiers.append(text)
                k += 1
                if self._text(k) == "(" and self.t[k].at == self.t[k - 1].end:
                    k = _closing(self.t, k) + 1
            else:
                break
        if k >= len(self.t):
            return None
        text, top = self._text(k), self.stack[-1]
        member = Event("member", start=self.t[start].at, attributes=attributes, modifiers=modifiers, direct=top["what"] == "protocol")
        if text in _TYPES and self._is_type(k):
            return self._type(k, start, attributes, modifiers)
        if top["what"] == "accessors" and text in _ACCESSORS:
            self._member(member, "accessor", text, k)
            top["block"] = "block" if self._has_body(k + 1) else None
            return k + 1
        if text in ("let", "var") and (k == start or self._text(k - 1) != "case"):
            return self._variable(k, member)
        if text == "func":
            self._member(member, "function", self._function_name(k + 1), k + 1)
            top["block"], top["var"] = "block", None
            return k + 2
        if text in ("init", "deinit", "subscript") and self._text(k - 1) != ".":
            after = self._text(k + 1)
            if text == "deinit" or after in ("(", "<") or text == "init" and after in ("?", "!"):
                self._member(member, {"init": "initializer"}.get(text, text), text, k)
                top["block"], top["var"] = (None, "type") if text == "subscript" else ("block", None)
                return k + 1
        if text == "typealias":
            self._member(member, "typealias", self._text(k + 1), k + 1)
            return k + 2
        if text == "case" and top["what"] == "enum":
            return self._cases(k + 1, member)
        return k if k > start and text not in ("{", "}") else None

    def _has_body(self, k: int) -> bool:
        while k < len(self.t) and (self._text(k) in ("async", "throws", "rethrows") or self._text(k) == "("):
            k = _closing(self.t, k) + 1 if self._text(k) == "(" else k + 1
        return self._text(k) == "{"

    def _member(self, event: Event, what: str, name: str, k: int) -> None:
        event.what, event.name, event.at = what, name, self.t[min(k, len(self.t) - 1)].at
        self.events.append(event)

    def _function_name(self, k: int) -> str:
        """A function's name; that of an operator may be several tokens."""
        if k < len(self.t) and self.t[k].kind == "operator":
            end = k
            while self.t[end].kind == "operator" and end + 1 < len(self.t) and self.t[end + 1].at == self.t[end].end and self.t[end + 1].kind == "operator":
                end += 1
            return self.source[self.t[k].at : self.t[end].end]
        return self._text(k)

    def _is_type(self, k: int) -> bool:
        if k + 1 >= len(self.t) or self.t[k + 1].kind != "name":
            return False
        if self._text(k) == "class":
            return self._text(k + 1) not in ("func", "var", "let", "subscript", "init") and self._text(k + 1) not in _MODIFIERS
        return self._text(k) != "actor" or self._text(k + 2) in ("{", ":", "<", "where")

    def _type(self, k: int, start: int, attributes: list[str], modifiers: list[str]) -> int:
        what, name = self._text(k), k + 1
        k = name + 1
        if what == "extension":
            while k < len(self.t) and self._text(k) not in ("{", ":", "where"):
                k += 1
        elif self._text(k) == "<":
            k = _closing(self.t, k) + 1
        text = self.source[self.t[name].at : self.t[k - 1].end] if what == "extension" else self._text(name)
        inherits: list[str] = []
        if self._text(k) == ":":
            entry: list[Token] = []
            k, depth = k + 1, 0
            while k < len(self.t) and (depth or self._text(k) not in ("{", "where")):
                depth += (self._text(k) in ("(", "[", "<")) - (self._text(k) in (")", "]", ">"))
                if self._text(k) == "," and not depth:
                    inherits.append(inherited_name(entry, self.source))
                    entry = []
                else:
                    entry.append(self.t[k])
                k += 1
            inherits.append(inherited_name(entry, self.source))
        while k < len(self.t) and self._text(k) != "{":
            k += 1
        event = Event("enter", text, self.t[name].at, self.t[start].at, what, attributes, modifiers, [x for x in inherits if x])
        self.events.append(event)
        self.stack.append({"what": what, "block": None, "var": None})
        return k + 1

    def _variable(self, k: int, member: Event) -> int:
        """Every binding of a variable: its pattern stands after the keyword or a comma outside brackets."""
        what, immutable = self._text(k), self._text(k) == "let"
        self.stack[-1]["var"] = "type"
        self.stack[-1]["block"] = None
        at, k = k + 1, k + 1
        while at < len(self.t):
            end = _closing(self.t, at) if self._text(at) in ("(", "[") else at
            name = self.source[self.t[at].at : self.t[end].end].strip("`")
            modifiers = [*member.modifiers, what] if immutable else member.modifiers
            self.events.append(Event("member", name, self.t[at].at, self.t[at].at, "variable", member.attributes, modifiers, direct=member.direct))
            depth, at = 0, end + 1
            while at < len(self.t):
                text, t = self._text(at), self.t[at]
                if text in ("(", "[", "{"):
                    at = _closing(self.t, at)
                elif text in (")", "]", "}", ";"):
                    return k
                elif text == "<" and self._text(end + 1) == ":" and t.at == self.t[at - 1].end:
                    at = _closing(self.t, at)
                elif t.first and not depth and self._text(at - 1) not in ("=", ",", ":", ".") and self.t[at - 1].kind != "operator" and t.kind != "operator" and text not in (".", "=", ":"):
                    return k
                elif text == ",":
                    break
                at += 1
            at += 1
        return k

    def _cases(self, k: int, member: Event) -> int:
        while k < len(self.t) and self.t[k].kind == "name":
            self.events.append(Event("member", self._text(k), self.t[k].at, self.t[k].at, "enum_case"))
            k += 1
            if self._text(k) == "(":
                k = _closing(self.t, k) + 1
            if self._text(k) == "=":
                k += 1
                while k < len(self.t) and self._text(k) not in (",", "}", ";") and not self.t[k].first:
                    k += 1
            if self._text(k) != ",":
                break
            k += 1
        return k


@dataclass
class _Type:
    what: str = ""
    primary: bool = False
    nested: str | None = None
    explicit: str | None = None
    superclass: str | None = None
    conforms: set[str] = field(default_factory=set)
    stated: set[str] = field(default_factory=set)
    at: int | None = None


class File:
    """The rows of one file, by relation."""

    def __init__(self, source: str, name: str, platform: str | None = None):
        self.name = name
        self.events = Walk(source, active(tokens(source), platform)).run()
        self.lines = [0] + [m.end() for m in re.finditer("\n", source)]
        self.source = source
        # Places count bytes of UTF-8.
        self.plain = source.isascii()
        named = [e for e in self.events if e.kind == "enter"]
        self.actors = {"MainActor"} | {
            e.name for e in named if "globalActor" in e.attributes and (e.what in ("actor", "struct", "enum") or e.what == "class" and "final" in e.modifiers)
        }
        self.protocols = {e.name for e in named if e.what == "protocol"}
        self.rows: dict[str, list[tuple]] = {k: [] for k in ("declaration", "conformance", "protocol_actor", "protocol_requirement_actor", "protocol_parent", "global_actor_name", "closure_literal", "awaited_range")}
        self.types: dict[str, _Type] = {}
        self._index()
        self._emit()
        self._ranges()

    def _bytes(self, a: int, b: int) -> int:
        return b - a if self.plain else len(self.source[a:b].encode("utf-8", "surrogatepass"))

    def place(self, at: int) -> tuple[int, int]:
        """Line and column of a place, both from 1 on."""
        line = bisect_right(self.lines, at)
        return line, self._bytes(self.lines[line - 1], at) + 1

    def _actor(self, attributes: list[str]) -> str | None:
        return next((a for a in attributes if a in self.actors), None)

    def _explicit(self, e: Event) -> str | None:
        if "nonisolated" in e.modifiers:
            return "nonisolated"
        actor = self._actor(e.attributes)
        return actor and f"globalActor({actor})"

    def _index(self) -> None:
        """What the whole file tells of each type and protocol."""
        path: list[list[str]] = []
        protocol = None
        self.whole: dict[str, str] = {}
        self.single: dict[tuple[str, str], str] = {}
        for e in self.events:
            here = ".".join(x for p in path for x in p)
            if e.kind == "enter" and e.what == "extension":
                known = self.types.setdefault(e.name, _Type())
                known.conforms |= set(e.inherits)
                path.append(e.name.split("."))
            elif e.kind == "enter":
                known = self.types.setdefault(f"{here}.{e.name}" if here else e.name, _Type())
                known.what, known.primary, known.at = e.what, True, e.at
                known.nested = here or None
                known.explicit = self._explicit(e)
                for k, name in enumerate(e.inherits):
                    if k == 0 and e.what == "class" and name not in self.protocols:
                        known.superclass = name
                    else:
                        known.conforms.add(name)
                        known.stated.add(name)
                if e.what == "protocol":
                    protocol = e.name
                    if actor := self._actor(e.attributes):
                        self.whole[e.name] = actor
                    self.rows["protocol_parent"] += [(e.name, x) for x in sorted(set(e.inherits))]
                path.append([e.name] if e.what != "protocol" else [])
            elif e.kind == "leave":
                path.pop()
            elif e.kind == "member" and e.direct and e.what in ("function", "variable") and (actor := self._actor(e.attributes)):
                self.single[protocol, e.name] = actor
        self.rows["protocol_actor"] = sorted((k, v, self.name) for k, v in self.whole.items())
        self.rows["protocol_requirement_actor"] = sorted((*k, v, self.name) for k, v in self.single.items())
        self.rows["global_actor_name"] = [(a,) for a in sorted(self.actors)]

    def _declared(self, usr: str, name: str, at: int | None, conformances: list[tuple], **facts) -> None:
        line, col = self.place(at) if at is not None else (None, None)
        flags = {"explicit": None, "actor": False, "container": None, "static": False, "superclass": None, "eligible": True, "extension": None, "nested": False} | facts
        n = len(self.rows["declaration"])
        self.rows["declaration"].append(
            (usr, name, *(flags[k] for k in ("explicit", "actor", "container", "static", "superclass", "eligible", "extension", "nested")),
             None if at is None else self.name, line, col, flags.get("immutable", False), flags.get("initializer", False), n)
        )
        self.rows["conformance"] += [(usr, n, k, *c) for k, c in enumerate(conformances)]

    def _emit_type(self, name: str, emitted: set[str]) -> None:
        known = self.types.get(name)
        if known is None or name in emitted:
            return
        emitted.add(name)
        conformances = [(PLACEHOLDER + p, self.whole.get(p), known.primary and p in known.stated, False) for p in sorted(known.conforms)]
        self._declared(
            PLACEHOLDER + name, name.rsplit(".", 1)[-1], known.at, conformances, explicit=known.explicit, actor=known.what == "actor",
            container=known.nested and PLACEHOLDER + known.nested, superclass=known.superclass and PLACEHOLDER + known.superclass,
            eligible=not known.stated & {"Sendable", "SendableMetatype"}, nested=bool(known.nested),
        )

    def _emit(self) -> None:
        """Types once each (W6) and members, in source order."""
        scopes: list[tuple[list[str], str | None, set[str]]] = []
        emitted: set[str] = set()
        for e in self.events:
            here = ".".join(x for s in scopes for x in s[0])
            if e.kind == "enter":
                self._emit_type(e.name if e.what == "extension" or not here else f"{here}.{e.name}", emitted)
                if e.what == "protocol":
                    # A protocol is no scope of its own: its requirements are seen in what is around it.
                    scopes.append(([], scopes[-1][1] if scopes else None, scopes[-1][2] if scopes else set()))
                elif e.what == "extension":
                    scopes.append((e.name.split("."), self._explicit(e), set(e.inherits)))
                else:
                    scopes.append(([e.name], None, set(e.inherits)))
            elif e.kind == "leave":
                scopes.pop()
            elif e.kind == "member":
                self._emit_member(e, here, scopes[-1] if scopes else ([], None, set()))

    def _emit_member(self, e: Event, here: str, scope: tuple) -> None:
        offset = self._bytes(0, e.start)
        mark = f"{offset}" if here else f"{re.sub('[./]', '_', self.name)}_{offset}"
        in_actor = here in self.types and self.types[here].what == "actor"
        conformances = [(PLACEHOLDER + p, self.whole.get(p) or self.single.get((p, e.name)), False, True) for p in sorted(scope[2])]
        plain = Event("member", attributes=e.attributes) if e.what == "accessor" else e
        self._declared(
            f"{PLACEHOLDER}{here}.{e.name}#{mark}", e.name, e.at, conformances, explicit=self._explicit(plain), container=PLACEHOLDER + here,
            static=bool({"static", "class"} & set(plain.modifiers)), eligible=e.what not in ("typealias", "enum_case", "accessor") and not in_actor,
            extension=scope[1], immutable=e.what == "variable" and "let" in e.modifiers, initializer=e.what == "initializer" and in_actor,
        )

    def _ranges(self) -> None:
        for e in self.events:
            if e.kind in ("closure", "await"):
                bounds = (self.name, *self.place(e.at), *self.place(e.end))
                if e.kind == "await":
                    self.rows["awaited_range"].append(bounds)
                else:
                    call = e.call or (None, None)
                    self.rows["closure_literal"].append((*bounds, e.attributes[0] if e.attributes else None, *call, len(self.rows["closure_literal"])))
