"""Confidence and routing of a resolution, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------
AUTO, REVIEW, AGREED, CLEAR, AMBIGUOUS = 0.93, 0.70, 0.88, 0.08, 0.05
# -------------------------------------------------------------------------------------------------


def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def confidence(has_candidate: Column, name: Column, code: Column, agreement: Column, margin: Column, quality: Column | None = None) -> Column:
    """Score of a resolution; ``agreement`` is null where no code speaks for or against it."""
    name, code = _unit(name), _unit(code)
    c = name * (0.85 + 0.15 * _unit(quality if quality is not None else F.lit(1.0)))
    c = c + F.when(agreement, 0.15 * code).otherwise(0.0)
    c = c + F.when(margin > 0.15, 0.05).when(margin < 0.05, -0.15).otherwise(0.0)
    return F.when(~has_candidate, F.lit(0.0)).when(~agreement, 0.45 * name).otherwise(_unit(c))


def _rules(has_candidate: Column, confidence: Column, agreement: Column, margin: Column, auto, review, agreed_at) -> list[tuple[Column, str, str]]:
    agreed = F.coalesce(agreement, F.lit(False))
    return [
        (~has_candidate, "unmatched", "no candidate"), (F.coalesce(~agreement, F.lit(False)), "manual", "name and code disagree"), ((confidence >= auto) & (margin >= CLEAR), "auto", "sure and clear"),
        (agreed & (confidence >= agreed_at), "auto", "name and code agree"), (margin < AMBIGUOUS, "manual", "ambiguous"), (confidence >= review, "pending", "likely"),
    ]


def decision(has_candidate: Column, confidence: Column, agreement: Column, margin: Column, auto=AUTO, review=REVIEW, agreed_at=AGREED) -> Column:
    """The first rule that holds; the thresholds may be columns (sweeps)."""
    out = F
    for when, what, _ in _rules(has_candidate, confidence, agreement, margin, auto, review, agreed_at):
        out = out.when(when, what)
    return out.otherwise("manual")


def reason(has_candidate: Column, confidence: Column, agreement: Column, margin: Column, auto=AUTO, review=REVIEW, agreed_at=AGREED) -> Column:
    """Why: the rule by which ``decision`` decided."""
    out = F
    for when, _, why in _rules(has_candidate, confidence, agreement, margin, auto, review, agreed_at):
        out = out.when(when, why)
    return out.otherwise("unsure")


def downgrade(decision: Column, has_print: Column, has_rarity: Column, no_auto: bool = False, need_set: bool = True, need_rarity: bool = False) -> Column:
    """Policy after the decision: automatic acceptance may be off, or need a resolved print or rarity."""
    bad = F.lit(no_auto)
    if need_set:
        bad = bad | ~has_print
    if need_rarity:
        bad = bad | (~has_print & ~has_rarity)
    return F.when((decision == "auto") & bad, "pending").otherwise(decision)
