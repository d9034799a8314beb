"""Pictures too small for a metric don't stop the others."""

from plateworks.operators import images


def test_narrow_and_small_pictures(spark):
    rows = [(1, y, [float(y)]) for y in range(40)] + [(2, y, [float(x * y % 7) for x in range(5)]) for y in range(5)] + [(3, y, [float((x * 3 + y) % 11) for x in range(64)]) for y in range(64)] + [(4, 0, [1.0, 2.0])]
    lines = spark.createDataFrame(rows, "asset_id bigint, y bigint, px array<double>")
    got = {name: {r[0]: r[1] for r in getattr(images, name)(lines).collect()} for name in ("noise_sigma", "laplacian_variance", "detail_ratio", "blockiness", "sharpness")}
    assert set(got["sharpness"]) == {1, 2, 3, 4} and got["sharpness"][1] == 0.0
    assert 3 in got["noise_sigma"] and 2 in got["noise_sigma"] and set(got["laplacian_variance"]) == {2, 3} and 3 in got["detail_ratio"] and 3 in got["blockiness"]
    tiles = {r.asset_id for r in images.tile_variances(lines, 32).collect()}
    assert tiles == {2, 3}
    assert {r[0] for r in images.crop_medians(lines, 32).collect()} == {3}
