"""A compiler from rule tables to columns: score, level and reasons, without any UDF."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Branch:
    """Adds ``points``, and ``reason`` if it has one, where ``test`` (SQL) holds."""

    test: str
    points: int
    reason: str | None = None


@dataclass(frozen=True)
class Scorecard:
    """Groups of branches; in a group the first that holds wins. ``levels``: (least score, name), highest first, then the rest."""

    name: str
    groups: tuple[tuple[Branch, ...], ...]
    levels: tuple[tuple[int, str], ...]
    rest: str
    base: int = 0
    clamp: tuple[int, int] | None = None
    defaults: dict = field(default_factory=dict)

    def score(self) -> Column:
        total = F.lit(self.base)
        for group in self.groups:
            total = total + _chain(group, lambda b: F.lit(b.points), F.lit(0))
        return F.greatest(F.lit(self.clamp[0]), F.least(F.lit(self.clamp[1]), total)) if self.clamp else total

    def reasons(self) -> Column:
        each = [_chain(group, lambda b: F.lit(b.reason), F.lit(None)).cast("string") for group in self.groups]
        return F.filter(F.array(*each), lambda r: r.isNotNull())

    def level(self, score: Column) -> Column:
        out = F.when(score >= self.levels[0][0], self.levels[0][1])
        for least, name in self.levels[1:]:
            out = out.when(score >= least, name)
        return out.otherwise(self.rest)


def _chain(group: tuple[Branch, ...], value, rest: Column) -> Column:
    out = F.when(F.expr(group[0].test), value(group[0]))
    for branch in group[1:]:
        out = out.when(F.expr(branch.test), value(branch))
    return out.otherwise(rest)


def scored(rows: DataFrame, card: Scorecard) -> DataFrame:
    """``rows`` with <name>_score, <name>_level and <name>_reasons.

    Where an optional column is null or absent its default is judged; an input that
    fits no branch adds nothing. A missing mandatory column is an error at plan time.
    """
    columns = rows.columns
    judged = rows.withColumns({c: F.coalesce(F.col(c), F.lit(d)) if c in columns else F.lit(d) for c, d in card.defaults.items()}) if card.defaults else rows
    with_score = judged.withColumns({f"{card.name}_score": card.score(), f"{card.name}_reasons": card.reasons()})
    out = with_score.withColumn(f"{card.name}_level", card.level(F.col(f"{card.name}_score")))
    return out
