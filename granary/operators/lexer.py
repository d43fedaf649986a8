"""Sources as trees of brackets: one pass gives names, literals, operators and nested groups; comments are left out.

Literals with holes (templates, interpolated strings) push their holes as groups, so that code inside them is found
too. A bracket that is never closed ends with the text; a closing one that fits no open one counts as an operator.
"""

from __future__ import annotations

import re
from collections.abc import Iterator


class Node:
    """Part of a source. kind: name, number, string, built (a literal with or for holes), regex, op or group."""

    __slots__ = ("kind", "start", "end", "children", "open")

    def __init__(self, kind: str, start: int, end: int, opened: str = "") -> None:
        self.kind, self.start, self.end, self.open = kind, start, end, opened
        self.children: list[Node] = []

    def said(self, text: str) -> str:
        return text[self.start : self.end]


_NAME = r"(?P<name>[^\W\d][\w$]*|[$@][^\W\d][\w$]*|\$)"
_NUMBER = r"(?P<number>\d(?:[\w.]*\w)?)"
_OP = r"(?P<op>\?\.|=>|->|::|:=|\.\.\.|[^\s\w])"
_SLASHES = r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"
_QUOTED = r'"(?:\\.|[^"\\\n])*"?'
_SINGLE = r"'(?:\\.|[^'\\\n])*'?"
#: Openers of literals with holes: what ends the literal, what opens a hole, and the plain text before either.
HOLES = {
    "`": ("`", "${", re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*", re.S)),
    '$"': ('"', "{", re.compile(r'(?:\\.|\{\{|[^"\\{\n])*')),
    '$@"': ('"', "{", re.compile(r'(?:""|\{\{|[^"{])*', re.S)),
    '@$"': ('"', "{", re.compile(r'(?:""|\{\{|[^"{])*', re.S)),
}
#: Per language: what a token is, the first alternative that fits.
TOKENS = {
    "go": re.compile("|".join((_SLASHES, rf"(?P<string>{_QUOTED}|`[^`]*`?|{_SINGLE})", _NAME, _NUMBER, _OP)), re.S),
    "typescript": re.compile("|".join((_SLASHES, rf"(?P<string>{_QUOTED}|{_SINGLE})", r"(?P<built>`)", _NAME, _NUMBER, _OP)), re.S),
    "csharp": re.compile("|".join((_SLASHES, r"(?P<line>(?<![^\n])[ \t]*\#[^\n]*)", r'(?P<built>\$@?"|@\$")', rf'(?P<string>"""(?:.*?)(?:"""|\Z)|@"(?:""|[^"])*"?|{_QUOTED}|{_SINGLE})', _NAME, _NUMBER, _OP)), re.S),
    "python": re.compile("|".join((r"(?P<skip>\s+|\#[^\n]*|\\\n)", rf"(?P<string>(?:\b[rRbBuUfF]{{1,2}})?(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|{_QUOTED}|{_SINGLE}))", _NAME, _NUMBER, _OP)), re.S),
}
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "await", "yield")
_CLOSERS = {"(": ")", "[": "]", "{": "}"}


def tree(text: str, language: str) -> Node:
    """The root group of a source in one of the languages of TOKENS."""
    root = Node("group", 0, len(text))
    stack: list[tuple[Node, str]] = [(root, "")]  # open groups and literals, and what closes each
    at, size, token = 0, len(text), TOKENS[language]
    while at < size:
        top, close = stack[-1]
        if top.kind == "built":
            end, hole, plain = HOLES[top.open]
            at = plain.match(text, at).end()
            if text.startswith(hole, at):
                group = Node("group", at, size, "{")
                top.children.append(group)
                stack.append((group, "}"))
                at += len(hole)
            else:
                at += text.startswith(end, at)
                top.end = at
                stack.pop()
            continue
        m = token.match(text, at)
        kind, start, at = m.lastgroup, at, m.end()
        if kind in ("skip", "line"):
            continue
        if kind == "built":
            top.children.append(Node("built", start, size, m[0]))
            stack.append((top.children[-1], ""))
            continue
        said = m[0]
        if kind == "op" and said in _CLOSERS:
            top.children.append(Node("group", start, size, said))
            stack.append((top.children[-1], _CLOSERS[said]))
            continue
        if kind == "op" and said in ")]}":
            depth = len(stack) - 1
            while depth and stack[depth][1] != said and stack[depth - 1][0].kind != "built":
                depth -= 1
            if depth and stack[depth][1] == said:
                for group, _ in stack[depth:]:
                    group.end = at if group is stack[depth][0] else start
                del stack[depth:]
                continue
        if said == "/" and language == "typescript" and (r := _REGEX.match(text, start)):
            before = top.children[-1] if top.children else None
            if before is None or before.kind == "op" or before.kind == "name" and before.said(text) in _BEFORE_REGEX:
                kind, at = "regex", r.end()
        top.children.append(Node(kind, start, at))
    for node, _ in stack[1:]:
        node.end = size
    return root


def groups(root: Node) -> Iterator[Node]:
    """The groups that hold something, outer ones before inner ones, in order of the text."""
    work = [root]
    while work:
        node = work.pop()
        if node.kind == "group":
            yield node
        work.extend(reversed([c for c in node.children if c.children]))


def parts(group: Node, text: str) -> list[list[Node]]:
    """A group's children between commas; a last part without any is left out."""
    out: list[list[Node]] = [[]]
    for c in group.children:
        if c.kind == "op" and c.said(text) == ",":
            out.append([])
        else:
            out[-1].append(c)
    return out if out[-1] else out[:-1]


#: Words before a bracket that make no call of it.
_NO_CALLEE = {"func", "function", "if", "for", "foreach", "while", "switch", "catch", "return", "new", "using", "lock", "def"}


def calls(root: Node, text: str, language: str) -> Iterator[tuple[int, str | None, str, Node]]:
    """(start, receiver or None, name, arguments) of each call, type arguments aside."""
    for group in groups(root):
        own = group.children
        for k in range(1, len(own)):
            if own[k].kind != "group" or own[k].open != "(":
                continue
            j = k - 1
            if own[j].kind == "op" and own[j].said(text) == ">" and language in ("typescript", "csharp"):
                depth = 0
                while j >= 0:
                    said = own[j].said(text) if own[j].kind == "op" else ""
                    depth += (said == ">") - (said == "<")
                    j -= 1
                    if not depth:
                        break
            if j < 0 or own[j].kind != "name" or own[j].said(text) in _NO_CALLEE:
                continue
            name, dot = own[j].said(text), lambda i: i > 0 and own[i].kind == "op" and own[i].said(text) in (".", "?.")  # noqa: B023
            if not dot(j - 1):
                if j and own[j - 1].kind == "name" and own[j - 1].said(text) in ("func", "function", "new", "def", "class"):
                    continue
                yield own[j].start, None, name, own[k]
                continue
            first = j - 2
            while first >= 0:
                while first > 0 and own[first].kind == "group" and own[first].open in "([" and own[first - 1].kind in ("name", "group"):
                    first -= 1
                if dot(first - 1) and first > 1:
                    first -= 2
                else:
                    break
            yield own[first].start, text[own[first].start : own[j - 2].end], name, own[k]


def statements(group: Node, text: str) -> list[list[Node]]:
    """A group's children in runs that begin on a new line, or after a semicolon, or where a bracket of braces ended."""
    out: list[list[Node]] = []
    for k, c in enumerate(group.children):
        last = group.children[k - 1] if k else None
        if last is None or "\n" in text[last.end : c.start] or last.kind == "op" and last.said(text) == ";":
            out.append([])
        out[-1].append(c)
    return out
