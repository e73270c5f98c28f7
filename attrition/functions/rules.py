"""Ordered LIKE rules folded into Column expressions.

A rule set is data: an ordered list of ``(pattern, code)`` pairs.  ``classify``
turns it into one searched CASE (first match wins); ``exclude`` turns a list of
patterns into one conjunction of ``NOT LIKE`` predicates.  Both stay native
Catalyst expressions, so they are constant-folded, code-generated and, on a
plain column, can reach the scan.

LIKE semantics are the SQL ones Spark implements: case-sensitive, ``%`` is any
run of characters, ``_`` is exactly one character, ``[`` is a literal.  A NULL
input makes every ``LIKE`` NULL, so ``classify`` falls through to the default
and ``exclude`` drops the row (three-valued logic, nothing special-cased).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values.  These patterns, codes and labels must equal the source
# dashboard's for the results to match; they are listed as-is, in rule order.
# ---------------------------------------------------------------------------

# Module of a product line: first match wins, else "base".
MODULE_RULES: list[tuple[str, str]] = [
    ("%[KIDS]%", "kids"),
    ("%[JORNADA]%", "jornada"),
    ("%[LOJAINTELIGENTE]%", "loja_inteligente"),
    ("%[LOJAINTELIGENTE_INC]%", "loja_inteligente"),
]
MODULE_DEFAULT = "base"

# Display names used by the detail dataset for the same module rules.
MODULE_DISPLAY: dict[str, str] = {
    "kids": "Kids",
    "jornada": "Jornada",
    "loja_inteligente": "Loja Inteligente",
    "base": "Base",
}

# Base plan of a product line: first match wins, else "outros".
PLAN_RULES: list[tuple[str, str]] = [
    ("%[PRO]%", "pro"),
    ("%[LITE]%", "lite"),
    ("%[STARTER]%", "starter"),
    ("%[FILHA]%", "filha"),
    ("%[BASIC]%", "basic"),
    ("%0 - 9 Igrejas%", "pro"),
    ("%10+ Igrejas%", "pro"),
    ("%App Lite%", "lite"),
    ("%App da Igreja%", "starter"),
    ("%Squad as a Service%", "squad"),
]
PLAN_DEFAULT = "outros"

# One-off items that never count as a loss.
ONE_OFF_PATTERNS: list[str] = ["%Setup%", "%[PRO-RATA]%"]

# Add-on module lines, removed from every plan-level dataset: any of the
# single patterns, or all patterns of one group together.
MODULE_EXCLUDE_PATTERNS: list[str] = [
    "%[KIDS]%",
    "%[JORNADA]%",
    "%[LOJAINTELIGENTE]%",
    "%[LOJAINTELIGENTE_INC]%",
    "%[TOTEM]%",
    "%[V_DEOS]%",
]
MODULE_EXCLUDE_GROUPS: list[tuple[str, ...]] = [("%[STARTER]%", "%Módulo%")]

# Chart labels, in display order (order is significant: series and strips
# follow it).  "base" is deliberately absent from the module labels.
MODULE_LABELS: list[tuple[str, str]] = [
    ("kids", "Kids"),
    ("jornada", "Jornada"),
    ("loja_inteligente", "Loja Inteligente"),
]
PLAN_LABELS: list[tuple[str, str]] = [
    ("pro", "PRO"),
    ("lite", "LITE"),
    ("starter", "STARTER"),
    ("basic", "BASIC"),
    ("filha", "FILHA"),
    ("squad", "Squad as a Service"),
    ("outros", "Outros"),
]

# ---------------------------------------------------------------------------


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def classify(col: Column | str, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Searched CASE over ordered ``(pattern, code)`` rules; first match wins."""
    col = _as_col(col)
    if not rules:
        return F.lit(default)
    (first_pat, first_code), *rest = rules
    case = reduce(
        lambda acc, rule: acc.when(col.like(rule[0]), F.lit(rule[1])),
        rest,
        F.when(col.like(first_pat), F.lit(first_code)),
    )
    return case.otherwise(F.lit(default))


def exclude(
    col: Column | str,
    patterns: Sequence[str],
    groups: Sequence[Sequence[str]] = (),
) -> Column:
    """``col NOT LIKE p`` for every pattern, and ``NOT (all of group)`` per group."""
    col = _as_col(col)
    terms = [~col.like(p) for p in patterns]
    terms += [~reduce(lambda a, b: a & b, [col.like(p) for p in g]) for g in groups]
    if not terms:
        return F.lit(True)
    return reduce(lambda a, b: a & b, terms)


def module_of(product: Column | str) -> Column:
    return classify(product, MODULE_RULES, MODULE_DEFAULT)


def module_display_of(product: Column | str) -> Column:
    display = [(p, MODULE_DISPLAY[c]) for p, c in MODULE_RULES]
    return classify(product, display, MODULE_DISPLAY[MODULE_DEFAULT])


def plan_of(product: Column | str) -> Column:
    return classify(product, PLAN_RULES, PLAN_DEFAULT)


def is_recurring(product: Column | str) -> Column:
    """False/NULL for one-off items (setup fees, pro-rata adjustments)."""
    return exclude(product, ONE_OFF_PATTERNS)


def is_base_plan_line(product: Column | str) -> Column:
    """False/NULL for add-on module lines (plan-level datasets keep only True)."""
    return exclude(product, MODULE_EXCLUDE_PATTERNS, MODULE_EXCLUDE_GROUPS)
