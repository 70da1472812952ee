"""SQL tokens and their bracket structure."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<string>[xX]?'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
    |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<word>@{0,2}[^\W\d]\w*\$?\w*)
    |(?P<symbol><=>|<>|!=|<=|>=|\|\||::|[-+*/%<>=(),.;?:\[\]{}!&|^~@])""",
    re.X | re.S,
)


class SqlError(ValueError):
    """Text that is no statement the engine knows."""


@dataclass
class Token:
    kind: str
    text: str

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text if self.kind == "symbol" else ""


@dataclass
class Group:
    """What stands between two round brackets."""

    items: list[Token | Group] = field(default_factory=list)
    kind: str = "group"
    up: str = "()"


Item = Token | Group


def tokenize(sql: str) -> list[Token]:
    """Tokens without white space and comments."""
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"cannot read the statement at: {sql[at : at + 30]!r}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0]))
        at = m.end()
    return out


def nest(tokens: list[Token]) -> list[Item]:
    stack: list[list[Item]] = [[]]
    for t in tokens:
        if t.up == "(":
            stack.append([])
        elif t.up == ")":
            if len(stack) == 1:
                raise SqlError("closing bracket without an opening one")
            inner = stack.pop()
            stack[-1].append(Group(inner))
        else:
            stack[-1].append(t)
    if len(stack) > 1:
        raise SqlError("opening bracket without a closing one")
    return stack[0]


def parse(sql: str) -> list[Item]:
    return nest(tokenize(sql))


def statements(sql: str) -> list[list[Item]]:
    """Statements of a script; BEGIN ... END bodies of routines and triggers stay whole."""
    out: list[list[Item]] = [[]]
    depth = 0
    for item in parse(sql):
        first = [x.up for x in out[-1][:2]]
        routine = first and first[0] == "CREATE" and any(x.up in ("FUNCTION", "PROCEDURE", "TRIGGER") for x in out[-1])
        if routine or depth:
            if item.up in ("BEGIN", "CASE", "LOOP", "REPEAT") and not (out[-1] and out[-1][-1].up == "END"):
                depth += 1
            elif item.up in ("IF", "WHILE") and not (out[-1] and out[-1][-1].up == "END") and depth:
                depth += 1
            elif item.up == "END":
                depth -= 1
        if item.up == ";" and depth <= 0:
            out.append([])
            depth = 0
        else:
            out[-1].append(item)
    return [s for s in out if s]


def split(items: list[Item], on: str = ",") -> list[list[Item]]:
    parts: list[list[Item]] = [[]]
    for x in items:
        if x.up == on and x.kind == "symbol":
            parts.append([])
        else:
            parts[-1].append(x)
    return parts if parts != [[]] else []


def name_of(item: Item) -> str:
    """Identifier text, lower-cased unless delimited."""
    if item.kind == "quoted":
        q = item.text[0]
        return item.text[1:-1].replace(q * 2, q)
    if item.kind != "word":
        raise SqlError(f"a name is expected at {text_of([item])!r}")
    return item.text.lower()


def string_of(item: Item) -> str:
    if item.kind != "string":
        raise SqlError(f"a string is expected at {text_of([item])!r}")
    return item.text[1:-1].replace("''", "'")


def text_of(items: list[Item]) -> str:
    """Text that reads the same; dots and calls are not spaced."""
    out = ""
    for k, x in enumerate(items):
        s = f"({text_of(x.items)})" if isinstance(x, Group) else x.text
        tight = not out or s == "." or out.endswith(".") or s == "," or (isinstance(x, Group) and k and items[k - 1].kind == "word" and items[k - 1].up not in SPACED)
        out += s if tight else f" {s}"
    return out


#: Keywords before a bracket that is no call.
SPACED = frozenset("IN AND OR NOT ON WHERE SELECT FROM JOIN AS VALUES OVER EXISTS ALL ANY SOME WHEN THEN ELSE HAVING BY UNION INTERSECT EXCEPT BETWEEN LIKE SET USING DISTINCT CASE CHECK KEY LIMIT OFFSET RETURN IF WHILE UNTIL INTO UNIQUE REFERENCES".split())
