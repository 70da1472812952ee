"""Full-text predicates: MATCH (...) AGAINST (...) as plan-time expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words.
STOPWORDS = (
    "a about after all am an and any are as at be been before being by can could did do does doing down during each even for from further "
    "had has have having he her here hers herself him himself his how i if in into is it its itself just me might my myself no nor not "
    "of off on once only or other out over own same should so some than that the their theirs them themselves then there these they this those through to too "
    "under until up very was we were what when where which while who whom why with would you your yours yourself yourselves"
).split()
_SPLIT = r"[^\p{L}\p{N}*]+"


def query_tokens(query: str) -> list[str]:
    words = re.split(r"[^\w*]+|_+", query.lower())
    return [w for w in words if len(w.encode()) >= 3 and w not in STOPWORDS]


def text_tokens(text: Column) -> Column:
    """Lower-cased words of at least three bytes that are no stop words."""
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: (F.octet_length(w) >= 3) & ~w.isin(STOPWORDS))


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "''") + "'"


def natural_sql(columns: list[str], query: str) -> str:
    """True if any word of the query is a word of any text; a query without words is true if there is text."""
    words = query_tokens(query)
    some = " OR ".join(f"length(coalesce({c}, '')) > 0" for c in columns)
    if not words:
        return f"({some})"
    wanted = f"array({', '.join(map(_literal, words))})"
    pattern = _literal(_SPLIT)
    return "(" + " OR ".join(f"coalesce(arrays_overlap(split(lower({c}), {pattern}), {wanted}), false)" for c in columns) + ")"


def boolean_terms(query: str) -> tuple[list[str], list[str], list[str]]:
    """(required, excluded, optional) lower-cased parts: +word -word word "phrase"."""
    required, excluded, optional = [], [], []
    for sign, phrase, word in re.findall(r'([+-]?)(?:"([^"]*)"|([^\s"]+))', query.lower()):
        term = (phrase or word).strip()
        if term:
            (required if sign == "+" else excluded if sign == "-" else optional).append(term)
    return required, excluded, optional


def boolean_sql(columns: list[str], query: str) -> str:
    """All required and no excluded part occurs as a substring; without required parts, one of the optional ones does."""
    required, excluded, optional = boolean_terms(query)
    joined = f"lower(concat_ws(' ', {', '.join(columns)}))"
    has = lambda t: f"contains({joined}, {_literal(t)})"
    parts = [has(t) for t in required] + [f"NOT {has(t)}" for t in excluded]
    if optional and not required:
        parts.append("(" + " OR ".join(map(has, optional)) + ")")
    some = " OR ".join(f"length(coalesce({c}, '')) > 0" for c in columns)
    return f"(({some}) AND {' AND '.join(parts)})" if parts else f"({some})"


def match_sql(columns: list[str], query: str | None, mode: str = "") -> str:
    """SQL text of a full-text predicate; a NULL query is false. Query expansion is natural language mode."""
    if query is None:
        return "false"
    return boolean_sql(columns, query) if "BOOLEAN" in mode.upper() else natural_sql(columns, query)


def match(columns: list[str], query: str | None, mode: str = "") -> Column:
    return F.expr(match_sql(columns, query, mode))
