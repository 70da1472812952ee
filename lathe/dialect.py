"""Rewrites of standard, MySQL and SQLite spellings into Spark SQL.

Spark's parser does the parsing; only what it rejects or reads differently is touched. Text is lexed into
tokens nested by brackets, so literals, delimited names and comments stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from lathe.functions import fulltext, masks
from lathe.lexer import SPACED, Group, Item, SqlError, Token, parse, split, string_of, text_of

#: Tokens that end an operand to the left of a comparison.
_STARTS = frozenset("WHERE AND OR NOT ON HAVING SELECT WHEN THEN ELSE CASE BY DISTINCT ALL AS RETURN SET IF WHILE UNTIL VALUES , ;".split())
_CLAUSE_ENDS = frozenset("LIMIT OFFSET FETCH UNION INTERSECT EXCEPT ROWS RANGE FOR INTO ;".split())
_SET_OPS = ("UNION", "INTERSECT", "EXCEPT")
_COMPARE = frozenset("= <> != < <= > >=".split())
_FRAMED = frozenset("SUM COUNT AVG MIN MAX".split())
UNITS = {u: u for u in "YEAR QUARTER MONTH WEEK DAY HOUR MINUTE SECOND MICROSECOND".split()}


def word(text: str) -> Token:
    return Token("word", text)


def sym(text: str) -> Token:
    return Token("symbol", text)


class Rewriter:
    """Rewrites one statement. variables: values of @name and @@name as SQL text."""

    def __init__(self, variables: dict[str, str] | None = None):
        self.variables = variables or {}

    def sql(self, text: str) -> str:
        return self.text(parse(text))

    def text(self, items: list[Item]) -> str:
        return text_of(self.query(items))

    # Queries ------------------------------------------------------------------------------------

    def query(self, items: list[Item]) -> list[Item]:
        """A statement or the inside of brackets: set operations, derived column lists, then clauses and expressions."""
        items = self._left_nested(items)
        items = self._derived_columns(items)
        items = self._window_keys(items)
        items = self._null_order(items)
        return self.expression(items)

    def _left_nested(self, items: list[Item]) -> list[Item]:
        """A UNION B INTERSECT C -> (A UNION B) INTERSECT C."""
        at = [i for i, x in enumerate(items) if x.kind == "word" and x.up in _SET_OPS]
        if len(at) < 2 or not any(items[i].up == "INTERSECT" for i in at[1:]):
            return items
        begin = 0
        if items[0].up == "WITH":
            begin = next(i for i, x in enumerate(items) if x.up == "SELECT" or isinstance(x, Group) and i and items[i - 1].up not in ("AS",) and x.items and x.items[0].up == "SELECT")
        left = items[begin : at[0]]
        for k, i in enumerate(at):
            end = at[k + 1] if k + 1 < len(at) else len(items)
            op_end = i + 2 if items[i + 1].up in ("ALL", "DISTINCT") else i + 1
            right = items[op_end:end]
            if k + 1 == len(at):
                return [*items[:begin], *left, *items[i:op_end], *right]
            left = [Group([*left, *items[i:op_end], *right])]
        return items

    @staticmethod
    def _derived_columns(items: list[Item]) -> list[Item]:
        """SELECT * AS (a, b) FROM ... -> a derived table with those columns."""
        if len(items) > 3 and items[0].up == "SELECT":
            k = 1
            while k < len(items) and (items[k].up in ("*", ".") or items[k].kind in ("word", "quoted") and k + 1 < len(items) and items[k + 1].up == "."):
                k += 1
            if k > 1 and items[k - 1].up == "*" and k + 1 < len(items) and items[k].up == "AS" and isinstance(items[k + 1], Group):
                return [word("SELECT"), sym("*"), word("FROM"), Group([*items[:k], *items[k + 2 :]]), word("AS"), word("derived"), items[k + 1]]
        return items

    @staticmethod
    def _window_keys(items: list[Item]) -> list[Item]:
        """Window functions in a query's ORDER BY become hidden columns, which Spark can sort by."""
        order = next((i for i, x in enumerate(items) if x.up == "ORDER" and i + 1 < len(items) and items[i + 1].up == "BY"), None)
        source = next((i for i, x in enumerate(items) if x.up == "FROM"), None)
        if order is None or source is None or source > order or items[0].up != "SELECT":
            return items
        end = next((j for j in range(order + 2, len(items)) if items[j].up in _CLAUSE_ENDS), len(items))
        hidden: list[Item] = []
        keys: list[Item] = []
        names: list[Item] = []
        for k, key in enumerate(split(items[order + 2 : end])):
            keys += [sym(",")] * bool(k)
            if any(x.up == "OVER" for x in key):
                rule = next((j for j, x in enumerate(key) if x.up in ("ASC", "DESC", "NULLS")), len(key))
                name = word(f"sort_key_{k}")
                hidden += [sym(","), *key[:rule], word("AS"), name]
                names += [sym(",")] * bool(names) + [name]
                keys += [name, *key[rule:]]
            else:
                keys += key
        if not hidden:
            return items
        inner = Group([*items[:source], *hidden, *items[source:order]])
        return [word("SELECT"), sym("*"), word("EXCEPT"), Group(names), word("FROM"), inner, *items[order : order + 2], *keys, *items[end:]]

    @staticmethod
    def _null_order(items: list[Item]) -> list[Item]:
        """NULLS LAST for each key of a query's ORDER BY without its own rule."""
        out, i = [], 0
        while i < len(items):
            if items[i].up == "ORDER" and i + 1 < len(items) and items[i + 1].up == "BY":
                end = next((j for j in range(i + 2, len(items)) if items[j].up in _CLAUSE_ENDS), len(items))
                out += items[i : i + 2]
                for k, key in enumerate(split(items[i + 2 : end])):
                    out += [sym(",")] * bool(k) + key
                    if not any(x.up == "NULLS" for x in key):
                        out += [word("NULLS"), word("LAST")]
                i = end
            else:
                out.append(items[i])
                i += 1
        return out

    # Expressions --------------------------------------------------------------------------------

    def expression(self, items: list[Item]) -> list[Item]:
        out: list[Item] = []
        i = 0
        in_select = False
        while i < len(items):
            x = items[i]
            nxt = items[i + 1] if i + 1 < len(items) else None
            if x.up == "SELECT":
                in_select = True
            elif x.up in ("FROM", "WHERE", "HAVING"):
                in_select = False
            if isinstance(x, Group):
                out.append(Group(self.query(x.items)))
                i += 1
            elif x.kind == "quoted":
                out.append(Token("quoted", "`" + x.text[1:-1].replace(x.text[0] * 2, x.text[0]).replace("`", "``") + "`"))
                i += 1
            elif x.kind == "string":
                like = out and out[-1].up == "LIKE"
                out.append(Token("string", x.text.replace("\\", "\\\\\\\\" if like else "\\\\")))
                i += 1
            elif x.kind == "word" and x.text.startswith("@"):
                name = x.text.lower()
                if name not in self.variables:
                    raise SqlError(f"unknown variable {x.text}")
                out.append(Token("raw", self.variables[name]))
                i += 1
            elif x.up in ("/", "%"):
                right, i = self._primary(items, i + 1)
                out += [x, word("nullif"), Group([*right, sym(","), Token("number", "0")])]
            elif x.up == "BETWEEN" and nxt is not None and nxt.up == "SYMMETRIC":
                a, i = self._additive(items, i + 2)
                if items[i].up != "AND":
                    raise SqlError("BETWEEN SYMMETRIC without AND")
                b, i = self._additive(items, i + 1)
                a, b = text_of(a), text_of(b)
                known = f"CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN"
                out.append(Token("raw", f"BETWEEN ({known} least({a}, {b}) END) AND ({known} greatest({a}, {b}) END)"))
            elif x.up in _COMPARE and nxt is not None and nxt.up in ("ALL", "ANY", "SOME") and i + 2 < len(items) and isinstance(items[i + 2], Group):
                left = self._left(out)
                out.append(Token("raw", quantified(text_of(left), x.up, nxt.up, self.text(items[i + 2].items))))
                i += 3
            elif x.up in ("IN", "NOT") and (hit := self._membership(items, i, out, in_select)):
                i = hit
            elif x.up == "MATCH" and isinstance(nxt, Group) and i + 2 < len(items) and items[i + 2].up == "AGAINST":
                columns = [text_of(self.expression(c)) for c in split(nxt.items)]
                against = items[i + 3].items
                query = None if against[0].up == "NULL" else string_of(against[0])
                out.append(Token("raw", fulltext.match_sql(columns, query, text_of(against[1:]))))
                i += 4
            elif x.kind == "word" and isinstance(nxt, Group) and x.up not in SPACED and not (out and out[-1].up == "."):
                call, i = self._call(items, i)
                out += call
            elif x.up in _CONSTANTS and not (out and out[-1].up == "."):
                out.append(Token("raw", _CONSTANTS[x.up]))
                i += 1
            else:
                out.append(x)
                i += 1
        return out

    def _membership(self, items: list[Item], i: int, out: list[Item], in_select: bool) -> int:
        """Empty IN lists, and NOT IN (subquery) in a select list, which needs its three values spelled out."""
        negated = items[i].up == "NOT"
        at = i + negated
        if at + 1 >= len(items) or items[at].up != "IN" or not isinstance(items[at + 1], Group):
            return 0
        inner = items[at + 1].items
        if not inner:
            self._left(out)
            out.append(Token("raw", "true" if negated else "false"))
            return at + 2
        if negated and in_select and inner[0].up in ("SELECT", "WITH"):
            left = text_of(self._left(out))
            out.append(Token("raw", quantified(left, "<>", "ALL", self.text(inner))))
            return at + 2
        return 0

    def _left(self, out: list[Item]) -> list[Item]:
        """Take the operand that ends out: back to a keyword that cannot be part of it; a CASE goes with its END."""
        k = len(out)
        while k and out[k - 1].up not in _STARTS and out[k - 1].up not in _COMPARE:
            k -= 1
            depth = int(out[k].up == "END")
            while depth:
                k -= 1
                if k < 0:
                    raise SqlError("END without CASE")
                depth += {"END": 1, "CASE": -1}.get(out[k].up, 0)
        left = out[k:]
        del out[k:]
        if not left:
            raise SqlError("a comparison without a left operand")
        return left

    def _primary(self, items: list[Item], i: int) -> tuple[list[Item], int]:
        """A sign, then a literal, name, call, CASE or bracket, rewritten; and where it ends."""
        start = i
        while items[i].up in ("-", "+"):
            i += 1
        x = items[i]
        if x.up == "CASE":
            depth, i = 1, i + 1
            while depth:
                depth += {"CASE": 1, "END": -1}.get(items[i].up, 0)
                i += 1
        elif x.up in ("DATE", "TIME", "TIMESTAMP", "INTERVAL") and i + 1 < len(items) and items[i + 1].kind in ("string", "number"):
            i += 3 if x.up == "INTERVAL" else 2
        else:
            i += 1
            while i < len(items) and (items[i].up == "." or items[i - 1].up == "."):
                i += 1
            if x.kind in ("word", "quoted") and i < len(items) and isinstance(items[i], Group):
                i += 1
                if i < len(items) and items[i].up == "OVER":
                    i += 2
        return self.expression(items[start:i]), i

    def _additive(self, items: list[Item], i: int) -> tuple[list[Item], int]:
        start = i
        _, i = self._primary(items, i)
        while i < len(items) and items[i].up in ("+", "-", "*", "/", "%", "||", "DIV"):
            _, i = self._primary(items, i + 1)
        return self.expression(items[start:i]), i

    # Calls --------------------------------------------------------------------------------------

    def _call(self, items: list[Item], i: int) -> tuple[list[Item], int]:
        name, group = items[i].up, items[i + 1]
        end = i + 2
        window = None
        if end + 1 < len(items) and items[end].up == "OVER":
            window, end = items[end + 1], end + 2
        if window is not None:
            return self._window(name, items[i], group, window), end
        made = self._function(name, group)
        return ([Token("raw", made)] if made is not None else [items[i], Group(self.query(group.items))]), end

    def _window(self, name: str, head: Token, group: Group, window: Item) -> list[Item]:
        args = self.expression(group.items)
        if not isinstance(window, Group):
            return [head, Group(args), word("OVER"), window]
        spec = self.expression(window.items)
        frame = next((k for k, x in enumerate(spec) if x.up in ("ROWS", "RANGE")), None)
        ordered = any(x.up == "ORDER" for x in spec)
        whole = Token("raw", "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")
        if name in ("RANK", "DENSE_RANK") and not ordered:
            return [Token("raw", "CAST(1 AS INT)")]
        if name in ("FIRST_VALUE", "LAST_VALUE"):
            spec = [*spec[:frame], whole] if ordered else spec[:frame]
        elif name in _FRAMED and ordered and frame is None:
            spec = [*spec, Token("raw", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")]
        call = [head, Group(args), word("OVER"), Group(spec)]
        return [word("CAST"), Group([*call, word("AS"), word("DOUBLE")])] if name == "SUM" else call

    def _function(self, name: str, group: Group) -> str | None:
        if name == "TRIM":
            return self._trim(group.items)
        if name in ("SUBSTRING", "SUBSTR"):
            return self._substring(group.items)
        if name in ("CHAR_LENGTH", "CHARACTER_LENGTH"):
            using = next((k for k, x in enumerate(group.items) if x.up == "USING"), None)
            octets = using is not None and group.items[using + 1].up == "OCTETS"
            return f"{'octet_length' if octets else 'char_length'}({self._arg(group.items[:using])})"
        if name == "CAST" and not any(x.up == "AS" for x in group.items):
            value, kind = split(group.items)
            return f"CAST({self._arg(value)} AS {cast_type(string_of(kind[0]))})"
        if name == "CAST":
            at = max(k for k, x in enumerate(group.items) if x.up == "AS")
            return f"CAST({self._arg(group.items[:at])} AS {cast_type(text_of(group.items[at + 1 :]))})"
        if name == "EXTRACT" and not any(x.up == "FROM" for x in group.items):
            unit, value = split(group.items)
            return f"extract({string_of(unit[0])} FROM {self._arg(value)})"
        make = FUNCTIONS.get(name)
        if make is None:
            return None
        args = split(group.items)
        if name in ("DATE_ADD", "ADDDATE", "DATE_SUB", "SUBDATE") and len(args) == 2 and not (args[1] and args[1][0].up == "INTERVAL"):
            return None
        return make(*[self._arg(a) for a in args])

    def _arg(self, items: list[Item]) -> str:
        return text_of(self.query(items))

    def _trim(self, items: list[Item]) -> str:
        side = items[0].up if items and items[0].up in ("BOTH", "LEADING", "TRAILING") else "BOTH"
        rest = items[1:] if items and items[0].up in ("BOTH", "LEADING", "TRAILING") else items
        at = next((k for k, x in enumerate(rest) if x.up == "FROM"), None)
        value = self._arg(rest[at + 1 :] if at is not None else rest)
        if not at:
            return f"trim({side} FROM {value})"
        if rest[0].kind == "string" and len(string_of(rest[0])) == 1:
            return f"trim({side} {self._arg(rest[:at])} FROM {value})"
        # A longer text is taken off as a whole, as often as it occurs; an empty one takes nothing off.
        c = self._arg(rest[:at])
        quoted = f"concat('\\\\Q', {c}, '\\\\E')"
        for mark, put in (("LEADING", f"concat('^(', {quoted}, ')+')"), ("TRAILING", f"concat('(', {quoted}, ')+$')")):
            if side in (mark, "BOTH"):
                value = f"regexp_replace({value}, {put}, '')"
        return value

    def _substring(self, items: list[Item]) -> str:
        if any(x.up == "FROM" for x in items):
            at = next(k for k, x in enumerate(items) if x.up == "FROM")
            size = next((k for k, x in enumerate(items) if x.up == "FOR"), None)
            parts = [items[:at], items[at + 1 : size]] + ([items[size + 1 :]] if size is not None else [])
        else:
            parts = split(items)
        args = [self._arg(p) for p in parts]
        length = f", greatest({args[2]}, 0)" if len(args) > 2 else ""
        null = " OR ".join(f"({a}) IS NULL" for a in args[1:])
        return f"CASE WHEN {null} THEN NULL ELSE substring({args[0]}, greatest({args[1]}, 1){length}) END"


def quantified(left: str, op: str, which: str, query: str) -> str:
    """x op ALL/ANY (subquery) by the count, nulls, least and greatest value of the subquery; three-valued."""
    op = "<>" if op == "!=" else op
    if op == "=" and which != "ALL":
        return f"({left} IN ({query}))"
    stat = lambda s: f"(SELECT {s} FROM ({query}) AS q(v))"
    n, nulls = stat("count(*)"), stat("count(*) - count(v)")
    if which == "ALL":
        false = {"=": f"({left}) <> {stat('min(v)')} OR ({left}) <> {stat('max(v)')}", "<>": f"({left}) IN (SELECT v FROM ({query}) AS q(v) WHERE v IS NOT NULL)", "<": f"({left}) >= {stat('min(v)')}", "<=": f"({left}) > {stat('min(v)')}", ">": f"({left}) <= {stat('max(v)')}", ">=": f"({left}) < {stat('max(v)')}"}[op]
        return f"(CASE WHEN {n} = 0 THEN true WHEN {false} THEN false WHEN ({left}) IS NULL OR {nulls} > 0 THEN CAST(NULL AS BOOLEAN) ELSE true END)"
    true = {"<>": f"({left}) <> {stat('min(v)')} OR ({left}) <> {stat('max(v)')}", "<": f"({left}) < {stat('max(v)')}", "<=": f"({left}) <= {stat('max(v)')}", ">": f"({left}) > {stat('min(v)')}", ">=": f"({left}) >= {stat('min(v)')}"}[op]
    return f"(CASE WHEN {n} = 0 THEN false WHEN {true} THEN true WHEN ({left}) IS NULL OR {nulls} > 0 THEN CAST(NULL AS BOOLEAN) ELSE false END)"


def cast_type(text: str) -> str:
    """Type names that Spark does not know, by their meaning."""
    up = " ".join(text.upper().split())
    head = up.partition("(")[0].strip()
    if head in ("SIGNED", "INTEGER", "INT", "LONG", "SIGNED INTEGER"):
        return "BIGINT"
    if head == "UNSIGNED":
        return "DECIMAL(20,0)"
    if head in ("NUMERIC", "DECIMAL", "DEC", "DOUBLE PRECISION", "DOUBLE") or head == "FLOAT":
        return "DOUBLE"
    if head in ("TEXT", "CLOB", "NAME", "CHARACTER LARGE OBJECT"):
        return "STRING"
    if head in ("CHARACTER VARYING", "CHAR VARYING", "NVARCHAR", "NATIONAL CHARACTER VARYING"):
        return up.replace(head, "VARCHAR", 1) if "(" in up else "STRING"
    if head == "VARCHAR" and "(" not in up:
        return "STRING"
    if head in ("CHARACTER", "NCHAR", "NATIONAL CHAR", "NATIONAL CHARACTER", "CHAR"):
        return up.replace(head, "CHAR", 1) if "(" in up else "CHAR(1)"
    if head == "DATETIME":
        return "TIMESTAMP"
    if head in ("BLOB", "BINARY LARGE OBJECT", "VARBINARY"):
        return "BINARY"
    return up


def _guard(condition: str, message: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN raise_error('{message}') ELSE {value} END"


def _text(arg: str) -> str:
    return arg[1:-1].replace("''", "'").replace("\\\\", "\\")


def _to_char(value: str, mask: str) -> str:
    m = _text(mask)
    if masks.is_number_mask(m):
        return masks.number_text(value, m)
    out = f"date_format({value}, '{masks.java_pattern(m).replace(chr(39), chr(39) * 2)}')"
    return f"replace(replace({out}, 'AM', 'am'), 'PM', 'pm')" if "am" in m or "pm" in m else out


def _shift(sign: str) -> Callable[..., str]:
    def make(value: str, amount: str, unit: str | None = None) -> str:
        if unit is None:  # an INTERVAL
            return f"({value} {sign} {amount})"
        u = _text(unit).upper()
        n = amount if sign == "+" else f"-({amount})"
        months = {"YEAR": 12, "QUARTER": 3, "MONTH": 1}.get(u)
        if months:
            return f"add_months({value}, {months} * ({n}))"
        days = {"WEEK": 7, "DAY": 1}.get(u)
        if days:
            return f"date_add({value}, CAST({days} * ({n}) AS INT))"
        part = {"HOUR": "hours", "MINUTE": "mins", "SECOND": "secs"}[u]
        moved = {"hours": f"make_dt_interval(0, {n}, 0, 0)", "mins": f"make_dt_interval(0, 0, {n}, 0)", "secs": f"make_dt_interval(0, 0, 0, {n})"}[part]
        return f"CASE WHEN typeof({value}) = 'date' THEN CAST({value} AS TIMESTAMP) ELSE CAST({value} AS TIMESTAMP) + {moved} END"

    return make


def _age(later: str, earlier: str | None = None) -> str:
    """Years, months and days between two dates as text; a day borrowed comes from the month before the later date."""
    a, b = (f"CAST({later} AS DATE)", f"CAST({earlier} AS DATE)") if earlier else ("current_date()", f"CAST({later} AS DATE)")
    hi, lo = f"greatest({a}, {b})", f"least({a}, {b})"
    borrow = f"(day({hi}) < day({lo}))"
    months = f"((year({hi}) - year({lo})) * 12 + month({hi}) - month({lo}) - CAST({borrow} AS INT))"
    days = f"(day({hi}) - day({lo}) + CASE WHEN {borrow} THEN day(last_day(add_months({hi}, -1))) ELSE 0 END)"
    part = lambda n, unit: f"CASE WHEN {n} <> 0 THEN concat({n}, ' {unit}', CASE WHEN {n} = 1 THEN '' ELSE 's' END) END"
    joined = f"concat_ws(' ', {part(f'({months} DIV 12)', 'year')}, {part(f'({months} % 12)', 'month')}, {part(days, 'day')})"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE concat(CASE WHEN {a} < {b} THEN '-' ELSE '' END, CASE WHEN {joined} = '' THEN '0 days' ELSE {joined} END) END"


def _truncate(x: str, d: str = "0") -> str:
    return f"(signum({x}) * floor(abs({x}) * power(10, {d})) / power(10, {d}))"


#: Calls whose name or meaning differs, by upper-case name.
FUNCTIONS: dict[str, Callable[..., str]] = {
    "LENGTH": lambda s: f"octet_length({s})",
    "LOCATE": lambda sub, s, start="1": f"locate({sub}, {s}, greatest({start}, 1))",
    "LEFT": lambda s, n: f"left({s}, CAST(greatest({n}, 0) AS INT))",
    "RIGHT": lambda s, n: f"right({s}, CAST(greatest({n}, 0) AS INT))",
    "MOD": lambda a, b: f"try_mod({a}, {b})",
    "SIGN": lambda x: f"CAST(signum({x}) AS INT)",
    "TRUNCATE": _truncate,
    "FLOOR": lambda x: f"CAST(floor({x}) AS DOUBLE)",
    "CEIL": lambda x: f"CAST(ceil({x}) AS DOUBLE)",
    "CEILING": lambda x: f"CAST(ceil({x}) AS DOUBLE)",
    "SQRT": lambda x: _guard(f"({x}) < 0", "SQRT of a negative number", f"sqrt({x})"),
    "LN": lambda x: _guard(f"({x}) <= 0", "LN of a number that is not positive", f"ln({x})"),
    "LOG": lambda x: _guard(f"({x}) <= 0", "LOG of a number that is not positive", f"ln({x})"),
    "LOG10": lambda x: _guard(f"({x}) <= 0", "LOG10 of a number that is not positive", f"log10({x})"),
    "ASIN": lambda x: _guard(f"abs({x}) > 1", "ASIN outside of -1 to 1", f"asin({x})"),
    "ACOS": lambda x: _guard(f"abs({x}) > 1", "ACOS outside of -1 to 1", f"acos({x})"),
    "FORMAT": lambda x, d: f"format_number({x}, CAST(greatest({d}, 0) AS INT))",
    "CURDATE": lambda: "current_date()",
    "CURTIME": lambda p="0": f"current_time({p})",
    "CURRENT_TIME": lambda p="0": f"current_time(least({p}, 6))" if not p.isdigit() else f"current_time({min(int(p), 6)})",
    "CURRENT_TIMESTAMP": lambda p="6": "current_timestamp()",
    "NOW": lambda p="6": "current_timestamp()",
    "DATETIME": lambda s: "current_timestamp()" if s.lower() == "'now'" else f"to_timestamp({s})",
    "DATE_ADD": _shift("+"), "ADDDATE": _shift("+"), "DATE_SUB": _shift("-"), "SUBDATE": _shift("-"),
    "AGE": _age,
    "TO_NUMBER": lambda s: f"CAST(replace({s}, ',', '') AS DOUBLE)",
    "TO_DATE": lambda s, f="'YYYY-MM-DD'": f"to_date({s}, '{masks.java_pattern(_text(f)).replace(chr(39), chr(39) * 2)}')",
    "TO_TIMESTAMP": lambda s, f="'YYYY-MM-DD HH24:MI:SS'": f"to_timestamp({s}, '{masks.java_pattern(_text(f)).replace(chr(39), chr(39) * 2)}')",
    "TO_CHAR": _to_char,
    "DATABASE": lambda: "current_database()",
    "SCHEMA": lambda: "current_database()",
    "USER": lambda: "current_user()",
}

#: Words that are values without brackets.
_CONSTANTS = {"CURDATE": "current_date()", "CURTIME": "current_time()"}


def rewrite(sql: str, variables: dict[str, str] | None = None) -> str:
    """Spark SQL of a query in the engine's dialect."""
    return Rewriter(variables).sql(sql)


def booleans(sql: str) -> str:
    """Conditions of WHERE and HAVING cast to BOOLEAN: numbers count as true unless zero, NULL as unknown."""
    def walk(items: list[Item]) -> list[Item]:
        out, i = [], 0
        while i < len(items):
            x = items[i]
            if x.up in ("WHERE", "HAVING"):
                end = next((j for j in range(i + 1, len(items)) if items[j].up in ("GROUP", "ORDER", "HAVING", "WINDOW", *_CLAUSE_ENDS)), len(items))
                out += [x, word("CAST"), Group([Group(walk(items[i + 1 : end])), word("AS"), word("BOOLEAN")])]
                i = end
            else:
                out.append(Group(walk(x.items)) if isinstance(x, Group) else x)
                i += 1
        return out

    return text_of(walk(parse(sql)))
