"""SQL functions and procedures.

A function is folded into one expression, a Spark SQL function usable anywhere. Procedures run on the driver: control
flow here, data in the statements they run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from lathe.dialect import Rewriter
from lathe.engine import Engine, literal
from lathe.lexer import Group, Item, SqlError, name_of, parse, split, text_of

MOST_LOOPS, MOST_CALLS = 1_000_000, 100


@dataclass
class Procedure:
    parameters: list[tuple[str, str, str]]  # mode, name, type
    body: list[Item]


class _Leave(Exception):
    def __init__(self, label: str | None, again: bool):
        self.label, self.again = label, again


class _Return(Exception):
    pass


def define(engine: Engine, kind: str, items: list[Item], i: int, replace: bool) -> None:
    name, group = name_of(items[i]), items[i + 1]
    state = engine.catalog.state
    store = state.functions if kind == "FUNCTION" else state.procedures
    if name in store and not replace:
        raise SqlError(f"{kind.lower()} {name} exists")
    parts = split(group.items)
    if kind == "PROCEDURE":
        parameters = []
        for p in parts:
            mode = p[0].up if p[0].up in ("IN", "OUT", "INOUT") else "IN"
            p = p[1:] if p[0].up in ("IN", "OUT", "INOUT") else p
            parameters.append((mode, name_of(p[0]), engine._type(p[1:])))
        store[name] = Procedure(parameters, items[i + 2 :])
        return
    at = next(k for k, x in enumerate(items) if x.up == "RETURNS")
    body = next(k for k, x in enumerate(items) if x.up in ("BEGIN", "RETURN") and k > at)
    returns = engine._type([x for x in items[at + 1 : body] if x.up not in ("DETERMINISTIC", "READS", "SQL", "DATA", "NO", "CONTAINS", "NOT")])
    inner = items[body + 1 : -1] if items[body].up == "BEGIN" else items[body:]
    expression = _fold(inner, {})
    if expression is None:
        raise SqlError("a function without RETURN")
    arguments = ", ".join(f"{name_of(p[0])} {engine._type(p[1:])}" for p in parts)
    text = f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {Rewriter(engine.variables).text(expression)}"
    engine.spark.sql(text)
    store[name] = text


def _fold(items: list[Item], bound: dict[str, list[Item]]) -> list[Item] | None:
    """The value of a function's statements as one expression; None if they end without RETURN.

    DECLARE and SET are put into what follows. IF becomes CASE: each branch is taken together with the
    statements after END IF, so that variables a branch sets are seen there.
    """

    def put(items: list[Item]) -> list[Item]:
        return [Group(put(x.items)) if isinstance(x, Group) else Group(bound[x.text.lower()]) if x.kind == "word" and x.text.lower() in bound else x for x in items]

    i = 0
    while i < len(items):
        if items[i].up == ";":
            i += 1
            continue
        if items[i].up == "IF":
            end = _Runner.end(items, i)
            rest = next((k for k in range(end, len(items)) if items[k].up == ";"), len(items))
            parts, other = [], None
            for condition, body in _branches(items[i + 1 : end]):
                value = _fold([*body, *parse(";"), *items[rest:]], dict(bound))
                value = "NULL" if value is None else text_of(value)
                if condition is None:
                    other = value
                else:
                    parts.append(f"WHEN ({text_of(put(condition))}) THEN ({value})")
            if other is None:
                after = _fold(items[rest:], dict(bound))
                other = "NULL" if after is None else text_of(after)
            return parse(f"CASE {' '.join(parts)} ELSE ({other}) END")
        end = next((k for k in range(i, len(items)) if items[k].up == ";"), len(items))
        s, i = items[i:end], end
        if s[0].up == "DECLARE":
            at = next((k for k, x in enumerate(s) if x.up == "DEFAULT"), None)
            bound[name_of(s[1])] = put(s[at + 1 :]) if at is not None else parse("NULL")
        elif s[0].up == "SET":
            bound[name_of(s[1])] = put(s[3:])
        elif s[0].up == "RETURN":
            return put(s[1:])
        else:
            raise SqlError("a function's body may DECLARE, SET, IF and RETURN; use a procedure for loops")
    return None


def _branches(items: list[Item]) -> list[tuple[list[Item] | None, list[Item]]]:
    """(condition, statements) of what stands between IF and END; the condition of ELSE is None."""
    out: list[tuple[list[Item] | None, list[Item]]] = []
    condition: list[Item] | None = []
    at = depth = 0
    for k, x in enumerate(items):
        if depth == 0 and x.up == "THEN":
            condition, at = items[at:k], k + 1
        elif depth == 0 and x.up in ("ELSEIF", "ELSE"):
            out.append((condition, items[at:k]))
            condition, at = None, k + 1
        elif x.up in _Runner.OPEN and not (k and items[k - 1].up == "END"):
            depth += 1
        elif x.up == "END":
            depth -= 1
    return [*out, (condition, items[at:])]


def call(engine: Engine, items: list[Item]) -> DataFrame | None:
    name = name_of(items[1])
    procedure = engine.catalog.state.procedures.get(name)
    if procedure is None:
        raise SqlError(f"there is no procedure {name}")
    arguments = split(items[2].items) if len(items) > 2 else []
    if len(arguments) != len(procedure.parameters):
        raise SqlError(f"{name} takes {len(procedure.parameters)} arguments")
    engine._calls = getattr(engine, "_calls", 0) + 1
    if engine._calls > MOST_CALLS:
        raise SqlError(f"calls nest deeper than {MOST_CALLS}")
    values = {p: "NULL" if mode == "OUT" else literal(engine.value(a) if not _unset(engine, a) else None) for (mode, p, _), a in zip(procedure.parameters, arguments, strict=True)}
    outer, engine._locals = engine._locals, values
    result = None
    try:
        result = _Runner(engine).block(procedure.body)
    except _Return:
        pass
    finally:
        inner, engine._locals = engine._locals, outer
        engine._calls -= 1
    for (mode, p, _), a in zip(procedure.parameters, arguments, strict=True):
        if mode != "IN":
            engine._assign(a[0].text.lower(), inner[p])
    return result


def _unset(engine: Engine, argument: list[Item]) -> bool:
    return len(argument) == 1 and argument[0].kind == "word" and argument[0].text.startswith("@") and argument[0].text.lower() not in engine.variables


class _Runner:
    """Walks a body; blocks are found by their END."""

    OPEN = ("BEGIN", "IF", "WHILE", "LOOP", "REPEAT", "CASE")

    def __init__(self, engine: Engine):
        self.engine, self.result = engine, None

    def block(self, items: list[Item]) -> DataFrame | None:
        i = 0
        while i < len(items):
            i = self.step(items, i)
        return self.result

    @staticmethod
    def end(items: list[Item], i: int) -> int:
        """Index of the END that closes the construct at i."""
        depth = 0
        for k in range(i, len(items)):
            if items[k].up in _Runner.OPEN and not (k and items[k - 1].up == "END"):
                depth += 1
            elif items[k].up == "END":
                depth -= 1
                if not depth:
                    return k
        raise SqlError(f"{items[i].up} without END")

    def _true(self, items: list[Item]) -> bool:
        return bool(self.engine.value(items))

    def step(self, items: list[Item], i: int) -> int:
        x = items[i]
        if x.up == ";":
            return i + 1
        label = None
        if i + 1 < len(items) and items[i + 1].up == ":" and x.kind == "word":
            label, i = x.text.lower(), i + 2
            x = items[i]
        if x.up in self.OPEN and x.up != "CASE":
            end = self.end(items, i)
            after = end + 1
            while after < len(items) and items[after].up != ";":
                after += 1
            getattr(self, f"do_{x.up.lower()}")(items[i + 1 : end], label)
            return after
        end = next((k for k in range(i, len(items)) if items[k].up == ";"), len(items))
        self.simple(items[i:end])
        return end

    def simple(self, s: list[Item]) -> None:
        engine, up = self.engine, s[0].up
        if up == "DECLARE":
            at = next((k for k, x in enumerate(s) if x.up == "DEFAULT"), None)
            value = literal(engine.value(s[at + 1 :])) if at is not None else "NULL"
            kinds = at or len(s)
            for part in split(s[1 : kinds - 1]) or [s[1:2]]:
                engine._locals[name_of(part[0])] = value
        elif up == "RETURN":
            raise _Return
        elif up in ("LEAVE", "ITERATE"):
            raise _Leave(name_of(s[1]) if len(s) > 1 else None, up == "ITERATE")
        elif up in ("SELECT", "WITH"):
            into = next((k for k, x in enumerate(s) if x.up == "INTO"), None)
            out = engine.statement(engine.bind(s) if into is None else s[: into + 1] and _bind_around(engine, s, into))
            self.result = out if out is not None else self.result
        elif up == "CALL":
            engine.statement(s)
        else:
            engine.statement(s)

    def do_begin(self, body: list[Item], label: str | None) -> None:
        try:
            self.block(body)
        except _Leave as e:
            if e.again or e.label != label:
                raise

    def do_if(self, body: list[Item], label: str | None) -> None:
        for condition, branch in self._branches(body):
            if condition is None or self._true(condition):
                self.block(branch)
                return

    def _branches(self, body: list[Item]) -> list[tuple[list[Item] | None, list[Item]]]:
        cuts, depth = [], 0
        for k, x in enumerate(body):
            if x.up in self.OPEN and not (k and body[k - 1].up == "END"):
                depth += 1
            elif x.up == "END":
                depth -= 1
            elif not depth and x.up in ("THEN", "ELSEIF", "ELSIF", "ELSE"):
                cuts.append((k, x.up))
        out, condition, start = [], body[: cuts[0][0]], cuts[0][0] + 1
        for (_, word), (nxt, then) in zip(cuts, [*cuts[1:], (len(body), "END")], strict=True):
            if word == "THEN":
                out.append((condition, body[start:nxt]))
            elif word == "ELSE":
                out.append((None, body[start:nxt]))
            else:
                condition = body[start:nxt]
            start = nxt + 1
        return out

    def _loop(self, label: str | None, before, body: list[Item], after) -> None:
        for _ in range(MOST_LOOPS):
            if not before():
                return
            try:
                self.block(body)
            except _Leave as e:
                if e.label not in (label, None):
                    raise
                if not e.again:
                    return
            if after():
                return
        raise SqlError(f"a loop ran {MOST_LOOPS} times")

    def do_while(self, body: list[Item], label: str | None) -> None:
        at = next(k for k, x in enumerate(body) if x.up == "DO")
        self._loop(label, lambda: self._true(body[:at]), body[at + 1 :], lambda: False)

    def do_loop(self, body: list[Item], label: str | None) -> None:
        self._loop(label, lambda: True, body, lambda: False)

    def do_repeat(self, body: list[Item], label: str | None) -> None:
        at = max(k for k, x in enumerate(body) if x.up == "UNTIL")
        self._loop(label, lambda: True, body[:at], lambda: self._true(body[at + 1 :]))


def _bind_around(engine: Engine, s: list[Item], into: int) -> list[Item]:
    """Variables bound everywhere but in the INTO list."""
    end = next((k for k in range(into + 1, len(s)) if s[k].up == "FROM"), len(s))
    return [*engine.bind(s[:into]), *s[into:end], *engine.bind(s[end:])]


__all__ = ["Procedure", "call", "define", "text_of"]
