import itertools
import random

from plateworks import fixed
from plateworks.operators import stages


def model(statuses):
    """Independent statement of inheritance: walk the graph in order, copy staleness down."""
    now = dict(statuses)
    for stage in (*fixed.REQUIRED_STAGES, *fixed.ADVISORY_STAGES, "publication"):
        if now[stage] in ("missing", "not_applicable"):
            continue
        if any(now[d] not in ("current", "not_applicable") for d in fixed.DEPENDS_ON[stage]):
            now[stage] = "stale"
    return now


def test_propagation_matches_the_graph(spark):
    values = ("current", "stale", "missing", "failed", "not_applicable")
    rng = random.Random(7)
    cases = [dict(zip(stages.STAGES, combo)) for combo in itertools.islice(itertools.product(values, repeat=2), 25) for combo in [combo + tuple(rng.choice(values) for _ in range(len(stages.STAGES) - 2))]]
    rows = [(i, *[c[s] for s in stages.STAGES], *[None] * len(stages.STAGES)) for i, c in enumerate(cases)]
    schema = "asset_id int, " + ", ".join(f"{s}_status string" for s in stages.STAGES) + ", " + ", ".join(f"{s}_reason string" for s in stages.STAGES)
    done = stages.propagate(spark.createDataFrame(rows, schema)).collect()
    assert len(done) == len(cases)
    for row in done:
        assert {s: row[f"{s}_status"] for s in stages.STAGES} == model(cases[row["asset_id"]])
