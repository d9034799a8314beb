import random

import pytest
from pyspark.sql import functions as F

from plateworks.operators.paging import Listing, matching, page

KEYS = sorted(random.Random(2).sample(range(100_000), 3000))


@pytest.fixture(scope="module")
def listing(spark):
    rows = spark.createDataFrame([(k, f"n{k}") for k in random.Random(3).sample(KEYS, len(KEYS))], "asset_id bigint, name string").repartition(5)
    return Listing(rows, per_range=250)


@pytest.mark.parametrize("limit, offset", [(50, 0), (1, 0), (500, 2400), (7, 2995), (50, 2999), (50, 3000), (50, 10 ** 12), (500, 130)])
def test_pages_by_number(listing, limit, offset):
    got = listing.page(limit, offset).collect()
    assert [r.asset_id for r in got] == KEYS[offset:offset + limit] and all(r.total == 3000 and r.name == f"n{r.asset_id}" for r in got)


@pytest.mark.parametrize("key, limit", [(-1, 50), (KEYS[0], 10), (KEYS[1234], 500), (KEYS[1234] - 1, 3), (KEYS[-2], 50), (KEYS[-1], 50), (10 ** 9, 5)])
def test_pages_behind_a_key(listing, key, limit):
    assert [r.asset_id for r in listing.after(key, limit).collect()] == [k for k in KEYS if k > key][:limit]


def test_a_page_reads_the_ranges_it_lies_in(listing):
    assert len(listing.index) >= 10 and sum(r.rows for r in listing.index) == listing.total == 3000
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (listing.page(50, 2900), listing.after(KEYS[2000], 50)):
        files = df.select(F.input_file_name().alias("f"), "asset_id").select("f").distinct().count()
        assert files <= 2 and "PartitionFilters: [" in plan(df) and "range_no#" in plan(df).split("PartitionFilters: ")[1].split("PushedFilters")[0]
    far = next(r for r in listing.index if r.before <= 2900 < r.before + r.rows)
    assert len([r for r in listing.index if r.before < 2950 and r.before + r.rows > 2900]) <= 2 and far.least <= KEYS[2900] <= far.greatest


def test_walking_from_page_to_page_meets_every_row_once(listing):
    seen, last = [], -1
    while rows := listing.after(last, 450).collect():
        seen += [r.asset_id for r in rows]
        last = seen[-1]
    assert seen == KEYS


def test_limits_and_empty_lists(spark, listing):
    for limit, offset in ((0, 0), (501, 0), (5, -1)):
        with pytest.raises(ValueError):
            listing.page(limit, offset)
    none = spark.createDataFrame([], "asset_id bigint, state string")
    assert Listing(none).page().count() == 0 and Listing(none).after(3).count() == 0
    rows = spark.createDataFrame([(2, "a"), (1, "b"), (3, "a")], "asset_id bigint, state string")
    assert [(r.asset_id, r.total) for r in page(matching(rows, state="a", other=None), 1, 1).collect()] == [(3, 2)]
