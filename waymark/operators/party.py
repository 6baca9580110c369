"""Who leads a party: candidates in order, and the incumbent that only a clearly better one replaces.

Defined results: members without a device or an id are no candidates; a missing battery counts as half full, what
isn't a number from 0 to 1 as the nearest of these; members are taken in order of joining, then by id; repeated
rows change nothing; a party without candidates has no row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import half_up
from .folds import Step, fold
from .ops import latest

# What battery, signal, network and performance weigh, and the battery steps that a challenger must be ahead.
WEIGHTS = {"battery": 1e12, "signal": 1e9, "network": 1e6, "performance": 1e3}
LAST_TO_JOIN, STEAL_STEPS = 1_000_000, 5


def candidate_score(battery: Column, join_order: Column, signal: Column | None = None, network: Column | None = None, performance: Column | None = None) -> Column:
    """The weighed hundredths of what is known, and at last who joined first."""
    share = lambda v: half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(~F.isnan(v), v), F.lit(0.0)))) * 100) / 100
    known = {"battery": battery, "signal": signal, "network": network, "performance": performance}
    out = 1 / (1 + F.coalesce(F.when(join_order >= 0, F.floor(join_order)), F.lit(LAST_TO_JOIN)))
    for name, value in known.items():
        if value is not None:
            out = out + WEIGHTS[name] * share(value.cast("double"))
    return out


def ranked(members: DataFrame, score: str) -> list[Column]:
    """The total order of candidates: score, then who joined first, then the id."""
    return [F.desc(score), F.asc(F.coalesce("join_order", F.lit(LAST_TO_JOIN))), F.asc("id")]


def _incumbent() -> Step:
    def step(state, row):
        best = state or (row["leader"], row["leader_score"], row["leader_order"])
        own = (row["id"], row["score"], row["own_order"])
        ahead = own[1] > best[1] or own[1] == best[1] and (own[2] < best[2] or own[2] == best[2] and own[0] < (best[0] or ""))
        if ahead and own[1] - best[1] >= STEAL_STEPS * WEIGHTS["battery"] / 100:
            best = own
        return best, best[0]

    return step


def better_hosts(members: DataFrame) -> DataFrame:
    """party and host: who should lead instead of the leader; parties whose leader stays have no row.

    members has party, id, leader, battery, join_order and device_less.  Each candidate in turn takes over from the
    best so far where it is STEAL_STEPS hundredths of battery ahead; a leader who isn't a candidate scores nothing.
    """
    able = members.where(F.col("id").isNotNull() & ~F.coalesce(F.col("device_less"), F.lit(False)))
    order = F.coalesce(F.when(F.col("join_order") >= 0, F.col("join_order")), F.lit(LAST_TO_JOIN)).cast("double")
    rows = able.select("party", F.col("id").cast("string").alias("id"), F.col("leader").cast("string").alias("leader"), order.alias("own_order"), candidate_score(F.coalesce("battery", F.lit(0.5)), F.col("join_order")).alias("score"))
    leaders = latest(rows.where("id = leader"), ["party"], [F.asc("own_order")]).select(F.col("party").alias("of_party"), F.col("score").alias("leader_score"), F.col("own_order").alias("leader_order"))
    known = rows.join(leaders, F.col("party").eqNullSafe(F.col("of_party")), "left").drop("of_party")
    known = known.withColumns({"leader_score": F.coalesce("leader_score", F.lit(0.0)), "leader_order": F.coalesce("leader_order", F.lit(float(LAST_TO_JOIN)))})
    told = fold(known, ["party"], ["own_order", "id"], _incumbent(), "host", "string")
    last = latest(told, ["party"], [F.desc("own_order"), F.desc("id")])
    return last.where(~F.col("host").eqNullSafe(F.col("leader"))).select("party", "host")
