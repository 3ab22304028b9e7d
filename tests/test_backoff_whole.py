"""The whole backoff lookup against a loop over signatures."""

from collections import defaultdict

from seqlens.operators import refdist as D
from seqlens.plans import queries as Q

DATA = "/root/testdata/sf0.01"


def test_every_step_is_asked_in_both_directions(spark):
    levels = D.with_levels(D.signatures(Q._chain_rows(spark, DATA))).withColumn("entity", D.entity()).collect()
    keys = defaultdict(set)
    for r in levels:
        if r.entity is not None:
            keys[int(r.chain_id) % 2].add((r.level, r.key))
    want = {}
    for r in levels:
        known = (r.level, r.key) in keys[1 - int(r.chain_id) % 2]
        want[r.chain_id, r.idx] = min(want.get((r.chain_id, r.idx), 3), r.level if known else 3)
    got = Q.backoff_lookup(spark, DATA).collect()
    assert len(got) == len(want) and {(r.chain_id, r.idx): r.level for r in got} == want
    assert {int(r.chain_id) % 2 for r in got} == {0, 1} and set(want.values()) == {0, 1, 2, 3}
