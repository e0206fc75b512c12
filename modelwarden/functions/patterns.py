"""Glob patterns on dotted names, as regular expressions built by Spark."""

from __future__ import annotations

import re
from re import _parser as regex_parser

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKENS = r"(\[!?\]?[^\]]*\]|(?s:.))"


def needed_texts(pattern: str) -> list[str]:
    """Strings of which every match of a regular expression holds one; empty if none can be told.

    A test for these is far cheaper than the expression, which then runs on few texts only.
    """
    try:
        parsed = regex_parser.parse(pattern)
    except re.error:  # an expression of Java alone
        return []
    return [] if parsed.state.flags & (re.IGNORECASE | re.VERBOSE) or "(?" in pattern else _needed(parsed)


def _needed(tokens) -> list[str]:
    best: list[str] = []
    run = ""
    for kind, value in [*tokens, (None, None)]:
        if str(kind) == "LITERAL":
            run += chr(value)
            continue
        found = [[run]] if run else []
        run = ""
        if str(kind) == "SUBPATTERN":
            found.append(_needed(value[-1]))
        elif str(kind) == "BRANCH":
            each = [_needed(way) for way in value[1]]
            found.append([x for way in each for x in way] if all(each) else [])
        elif str(kind) in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            found.append(_needed(value[2]))
        best = max([best, *found], key=lambda texts: min(map(len, texts), default=0))
    return best


def glob_tokens(pattern: Column) -> Column:
    """The pattern in parts: `*`, `?`, a set in brackets, or one character."""
    return F.regexp_extract_all(pattern, F.lit(_TOKENS), F.lit(0))


def glob_regex(pattern: Column) -> Column:
    """Regex text for a glob: `*` and `?` cross dots, `[seq]` and `[!seq]` are sets, the match is full.

    A literal pattern folds to a constant; a pattern column is translated per row of the (small) pattern table.
    """

    def token(t: Column) -> Column:
        negated = F.substring(t, 2, 1) == "!"
        inner = F.when(negated, F.substr(t, F.lit(3), F.length(t) - 3)).otherwise(F.substr(t, F.lit(2), F.length(t) - 2))
        escaped = F.regexp_replace(inner, r"([\[\]\\^&])", r"\\$1")
        return (
            F.when(t == "*", F.lit(".*"))
            .when(t == "?", F.lit("."))
            .when(
                (F.length(t) > 1) & t.startswith("["),
                F.concat(F.lit("["), F.when(negated, F.lit("^")).otherwise(F.lit("")), escaped, F.lit("]")),
            )
            .otherwise(F.regexp_replace(t, r"([^A-Za-z0-9_])", r"\\$1"))
        )

    return F.concat(F.lit(r"\A(?s:"), F.array_join(F.transform(glob_tokens(pattern), token), ""), F.lit(r")\z"))


def glob_match(name: Column, pattern: Column | str) -> Column:
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.regexp_like(name, glob_regex(p))


def scope_match(action: Column, scope: Column) -> Column:
    """Exact name, or `prefix.**` (the prefix itself or anything below it), or a glob with `*`."""
    prefix = F.substr(scope, F.lit(1), F.length(scope) - 3)
    deep = scope.endswith(".**")
    return (
        (scope == action)
        | (deep & ((action == prefix) | F.startswith(action, F.concat(prefix, F.lit(".")))))
        | (~deep & F.contains(scope, F.lit("*")) & F.regexp_like(action, glob_regex(scope)))
    )


def scope_allows(action: Column, scopes: list[str]) -> Column:
    """Authority test against a plan-time scope list; an empty list allows everything."""
    allowed = F.lit(not scopes)
    for s in scopes:
        allowed = allowed | scope_match(action, F.lit(s))
    return allowed
