"""Leaders of parties against a plain pass over the members."""

import math
import random

from __spark_entry__ import queries
from waymark.operators import party


def test_incumbents_yield_to_clearly_better_members(spark):
    rng = random.Random(1)
    rows = []
    for p in range(60):
        members = [f"m{k}" for k in range(rng.randint(0, 7))]
        leader = rng.choice([*members, "gone"])
        rows += [(p, m, leader, rng.choice([None, 0.5, 0.52, 0.55, 0.9, 1.4, float("nan"), rng.random()]), rng.choice([None, k, k, -1]), rng.choice([None, False, False, True])) for k, m in enumerate(members)]
    rows += [(None, "x", "y", 0.9, 1, False), (99, None, "y", 0.9, 1, False)]
    want = {}
    for p in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == p and r[1] is not None and not r[5]]
        share = lambda v: math.floor(max(0.0, min(1.0, 0.5 if v is None else 0.0 if v != v else v)) * 100 + 0.5) / 100
        order = lambda r: r[4] if r[4] is not None and r[4] >= 0 else 1_000_000
        claim = lambda r: (r[1], 1 / (1 + order(r)) + 1e12 * share(r[3]), order(r))
        if not own:
            continue
        leader = own[0][2]
        best = next((claim(r) for r in own if r[1] == leader), (leader, 0.0, 1_000_000))
        for r in sorted(own, key=lambda r: (order(r), r[1])):
            c = claim(r)
            if (c[1] > best[1] or c[1] == best[1] and (c[2], c[0]) < (best[2], best[0])) and c[1] - best[1] >= 5e10:
                best = c
        if best[0] != leader:
            want[p] = best[0]
    df = spark.createDataFrame(rows, "party long, id string, leader string, battery double, join_order int, device_less boolean").repartition(3)
    assert {r.party: r.host for r in party.better_hosts(df).collect()} == want and len(want) > 10
    assert party.better_hosts(df.limit(0)).count() == 0


def test_a_large_number_outweighs_a_hundredth_of_balance(spark, tmp_path):
    rows = [(5, 1, 10.00), (20_005, 1, 10.01), (7, 2, 3.0), (400_000, 2, 3.5), (9, 3, None), (12, 3, -4.0), (13, 4, None), (10_000, 5, 2.0), (20_000, 5, 2.01)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.party: (r.members, r.next_order, r.leader) for r in queries()["party_roster"](spark, str(tmp_path)).collect()}
    assert got == {1: (2, 20_006, 5), 2: (2, 400_001, 400_000), 3: (2, 13, 12), 4: (1, 14, None), 5: (2, 20_001, 10_000)}
