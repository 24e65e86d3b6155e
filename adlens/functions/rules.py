"""First-match rules over a text, from a table: LIKE patterns with priorities and labels.

A CASE with a LIKE per rule grows with the rules, in the plan and in generated code.
Here the rules are one regular expression, an ordered alternation, evaluated once a row:
regular expressions try alternatives in their order, so the first rule that matches
wins, as in the CASE form. What the winning alternative captures is its own number, from a
list of the numbers that is appended to the text behind a NUL (which no pattern's
wildcard crosses), and the label is looked up by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ANY = r"[^\x00]"


def like_regex(pattern: str) -> str:
    """The regular expression of a LIKE pattern (``%``, ``_``, ``\\`` escapes) over texts without NUL."""
    out, chars = [], iter(pattern)
    for ch in chars:
        if ch == "%":
            out.append(_ANY + "*")
        elif ch == "_":
            out.append(_ANY)
        else:
            if ch == "\\":
                ch = next(chars, "\\")
            out.append(ch if ch.isalnum() or ord(ch) > 127 else f"\\x{ord(ch):02x}")
    return "".join(out)


def first_match(text: Column | str, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first (pattern, label) that ``text`` is LIKE; ``default`` if there is none or for a null
    text. A NUL inside a text counts as U+0001."""
    if not rules:
        return F.lit(default)
    text = F.translate(F.col(text) if isinstance(text, str) else text, "\x00", "\x01")
    numbers = "\x00;" + ";".join(map(str, range(len(rules)))) + ";"
    tries = "|".join(rf"(?={like_regex(p)}\x00).*;(?={i};)" for i, (p, _) in enumerate(rules))
    number = F.regexp_extract(F.concat(text, F.lit(numbers)), f"(?s)^(?:{tries})([0-9]+)", 1)
    label = F.get(F.lit([label for _, label in rules]), F.when(number != "", number).cast("int"))
    return F.coalesce(label, F.lit(default)) if default is not None else label


def rules_from(table: DataFrame, pattern: str = "pattern", label: str = "label", priority: str = "priority",
               max_rules: int = 10_000) -> list[tuple[str, str]]:
    """The rules of a table in their order (priority, then pattern; a rule without a pattern is none). They become
    part of the plan, so more than ``max_rules`` are an error."""
    rows = (table.where(F.col(pattern).isNotNull()).select(pattern, label).orderBy(F.col(priority).asc_nulls_last(), pattern, label)
            .limit(max_rules + 1).collect())
    if len(rows) > max_rules:
        raise ValueError(f"more than {max_rules} rules")
    return [(r[0], r[1]) for r in rows]
