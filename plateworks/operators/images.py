"""Image quality on scanline tables: one row per image line, ``(asset_id, y, px array)``.

Lines stay arrays; neighbours are ``lag``/``lead`` over y inside a block of lines, so that one very tall image is
worked on by many tasks. Each block also carries the two lines around it (``halo``), and metrics are sums per block
combined per image (variance from n, sum and sum of squares), never a list of pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions.arrays import codes, compact, first_match, flag

BLOCK = 64  # lines per task unit
Q = fixed.QC_RULES


def gray(red: Column, green: Column, blue: Column) -> Column:
    """Luma of three channel arrays."""
    rgb = F.arrays_zip(red.alias("r"), green.alias("g"), blue.alias("b"))
    return F.transform(rgb, lambda p: (p["r"] * 299 + p["g"] * 587 + p["b"] * 114) / 1000)


def with_neighbours(lines: DataFrame) -> DataFrame:
    """Adds the lines above and below (``up``, ``down``) without ordering a whole image in one task."""
    block = F.floor(F.col("y") / BLOCK)
    tagged = lines.withColumn("block", block)
    # a border line is also sent to the neighbouring block, marked as halo
    spread = tagged.withColumn("in_block", F.explode(F.array_compact(F.array(
        F.col("block"), F.when(F.pmod("y", F.lit(BLOCK)) == 0, F.col("block") - 1), F.when(F.pmod("y", F.lit(BLOCK)) == BLOCK - 1, F.col("block") + 1)))))
    order = Window.partitionBy("asset_id", "in_block").orderBy("y")
    near = spread.withColumns({"up": F.lag("px").over(order), "up_y": F.lag("y").over(order), "down": F.lead("px").over(order), "down_y": F.lead("y").over(order)})
    return near.filter(F.col("in_block") == F.col("block")).withColumns({
        "up": F.when(F.col("up_y") == F.col("y") - 1, F.col("up")), "down": F.when(F.col("down_y") == F.col("y") + 1, F.col("down"))}).drop("in_block", "block", "up_y", "down_y")


def pair(a: Column, b: Column, f) -> Column:
    """Element-wise combination of two lines."""
    return F.zip_with(a, b, f)


def inner(px: Column, shift: int = 0) -> Column:
    """Line without its first and last pixel, shifted by -1, 0 or 1; empty where the line has one or two."""
    return F.slice(px, F.lit(2 + shift), F.greatest(F.size(px) - 2, F.lit(0)))


def moments(values: Column) -> Column:
    """struct<n, s, q> of an array: what a population variance needs."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    return F.aggregate(values, zero, lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))


def variance(n: Column, s: Column, q: Column) -> Column:
    return q / n - (s / n) * (s / n)


def variance_of(rows: DataFrame, values: Column, name: str, *keys: str) -> DataFrame:
    """Population variance of line arrays per key, combined map-side from moments."""
    keys = keys or ("asset_id",)
    m = rows.filter(values.isNotNull()).select(*keys, moments(values).alias("m"))
    total = m.groupBy(*keys).agg(F.sum("m.n").alias("n"), F.sum("m.s").alias("s"), F.sum("m.q").alias("q"))
    return total.filter("n > 0").select(*keys, variance(F.col("n"), F.col("s"), F.col("q")).alias(name))


def steps_across(px: Column) -> Column:
    return F.zip_with(F.slice(px, F.lit(2), F.size(px) - 1), F.slice(px, F.lit(1), F.size(px) - 1), lambda b, a: b - a)


def sharpness(lines: DataFrame) -> DataFrame:
    """Variance of horizontal steps plus variance of vertical steps."""
    near = with_neighbours(lines).select("asset_id", moments(steps_across(F.col("px"))).alias("h"),
                                         moments(F.when(F.col("up").isNotNull(), pair(F.col("px"), F.col("up"), lambda a, b: a - b)).otherwise(F.array().cast("array<double>"))).alias("v"))
    total = near.groupBy("asset_id").agg(*[F.sum(f"{d}.{k}").alias(f"{d}{k}") for d in "hv" for k in "nsq"])

    def var(d: str) -> Column:
        return F.when(F.col(f"{d}n") > 0, variance(F.col(f"{d}n"), F.col(f"{d}s"), F.col(f"{d}q"))).otherwise(0.0)
    return total.select("asset_id", (var("h") + var("v")).alias("sharpness"))


def extreme_ratio(lines: DataFrame) -> DataFrame:
    """Shares of nearly black and nearly white pixels."""
    dark, bright = F.size(F.filter("px", lambda v: v <= Q["dark_level"])), F.size(F.filter("px", lambda v: v >= Q["bright_level"]))
    t = lines.groupBy("asset_id").agg(F.sum(dark).alias("d"), F.sum(bright).alias("b"), F.sum(F.size("px")).alias("n"))
    return t.select("asset_id", (F.col("d") / F.col("n")).alias("dark_ratio"), (F.col("b") / F.col("n")).alias("bright_ratio"))


def laplacian(rows: DataFrame) -> Column:
    """4-neighbour Laplacian of the inner pixels of a line; null on the first and last line."""
    vertical = pair(inner(F.col("up")), inner(F.col("down")), lambda a, b: a + b)
    horizontal = pair(inner(F.col("px"), -1), inner(F.col("px"), 1), lambda a, b: a + b)
    around = pair(vertical, horizontal, lambda a, b: a + b)
    return F.when(F.col("up").isNotNull() & F.col("down").isNotNull(), pair(inner(F.col("px")), around, lambda c, s: 4 * c - s))


def laplacian_variance(lines: DataFrame, name: str = "sharpness") -> DataFrame:
    near = with_neighbours(lines)
    return variance_of(near, laplacian(near), name)


def _second_difference(px: Column) -> Column:
    outer = pair(inner(px, -1), inner(px, 1), lambda a, b: a + b)
    return pair(outer, inner(px), lambda o, c: o - 2 * c)


def noise_sigma(lines: DataFrame) -> DataFrame:
    """Noise estimate from second differences on the flattest 30 % of the inner pixels.

    Gradients are counted per rounded value first; the exact interpolated percentile is then taken over
    (value, count) pairs, not over all pixels of an image.
    """
    near = with_neighbours(lines).filter(F.col("up").isNotNull() & F.col("down").isNotNull())
    rows_sum = pair(_second_difference(F.col("up")), _second_difference(F.col("down")), lambda a, b: a + b)
    residual = pair(rows_sum, _second_difference(F.col("px")), lambda s, c: s - 2 * c)
    gradient = pair(pair(inner(F.col("px"), 1), inner(F.col("px"), -1), lambda a, b: F.abs(a - b)), pair(inner(F.col("down")), inner(F.col("up")), lambda a, b: F.abs(a - b)), lambda a, b: a + b)
    pixels = near.select("asset_id", F.explode(F.arrays_zip(residual.alias("r"), gradient.alias("g"))).alias("p")).select("asset_id", F.abs("p.r").alias("r"), F.round("p.g", 6).alias("g"))
    per_value = pixels.groupBy("asset_id", "g").agg(F.count("*").alias("n"), F.sum("r").alias("r"))
    limits = per_value.groupBy("asset_id").agg(F.expr(f"percentile(g, {fixed.FLAT_PERCENTILE}, n)").alias("limit"))
    flat = per_value.join(limits, "asset_id").filter(F.col("g") <= F.col("limit")).groupBy("asset_id").agg((F.sum("r") / F.sum("n")).alias("mean"))
    return flat.select("asset_id", (F.sqrt(F.lit(3.141592653589793 / 2)) / 6 * F.col("mean")).alias("noise_sigma"))


def blockiness(lines: DataFrame) -> DataFrame:
    """Mean step at 8x8 block borders over the mean step in the middle of the blocks."""
    near = with_neighbours(lines)
    across = near.select("asset_id", F.posexplode(steps_across(F.col("px"))).alias("i", "d")).select("asset_id", F.lit("x").alias("axis"), (F.col("i") % 8).alias("phase"), F.abs("d").alias("d"), F.lit(1).alias("n"))
    down = near.filter(F.col("up").isNotNull()).select("asset_id", F.lit("y").alias("axis"), ((F.col("y") - 1) % 8).cast("int").alias("phase"), F.aggregate(pair(F.col("px"), F.col("up"), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x).alias("d"), F.size("px").alias("n"))
    means = across.unionByName(down).filter(F.col("phase").isin(3, 7)).groupBy("asset_id", "axis", "phase").agg((F.sum("d") / F.sum("n")).alias("m"))
    total = means.groupBy("asset_id").agg(F.sum(F.when(F.col("phase") == 7, F.col("m"))).alias("border"), F.sum(F.when(F.col("phase") == 3, F.col("m"))).alias("middle"))
    return total.select("asset_id", (F.col("border") / (F.col("middle") + 1e-6)).alias("blockiness"))


def half_size(lines: DataFrame) -> DataFrame:
    """Lines of the half-size image by 2x2 means (full pairs only)."""
    def pairs(px: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(px) / 2).cast("int") - 1), lambda i: F.get(px, 2 * i) + F.get(px, 2 * i + 1))
    cells = lines.filter(F.size("px") >= 2).select("asset_id", F.floor(F.col("y") / 2).alias("y"), F.col("y").alias("source_y"), pairs(F.col("px")).alias("px"))
    both = cells.groupBy("asset_id", "y").agg(F.max_by("px", "source_y").alias("a"), F.min_by("px", "source_y").alias("b"), F.count("*").alias("n"))
    return both.filter("n = 2").select("asset_id", "y", pair(F.col("a"), F.col("b"), lambda p, q: (p + q) / 4).alias("px"))


def detail_ratio(lines: DataFrame) -> DataFrame:
    full, half = laplacian_variance(lines, "full"), laplacian_variance(half_size(lines), "half")
    return full.join(half, "asset_id").select("asset_id", (F.col("full") / (F.col("half") + 1e-6)).alias("detail_ratio"))


def tile_variances(lines: DataFrame, tile: int) -> DataFrame:
    """Laplacian variance of every full tile: (asset_id, tile, tx, ty, v). A picture smaller than a tile shrinks it to its
    smaller side; one of less than three pixels has no tile. Moments per tile are taken inside the line."""
    sizes = lines.groupBy("asset_id").agg(F.least(F.lit(tile), F.max(F.size("px")), F.max("y") + 1).cast("int").alias("tile")).filter("tile >= 3")
    near = with_neighbours(lines).join(sizes, "asset_id")
    side, within = F.col("tile"), F.col("y") % F.col("tile")
    lap = near.filter((within > 0) & (within < side - 1)).select("asset_id", "tile", F.floor(F.col("y") / side).alias("ty"), F.size("px").alias("width"), laplacian(near).alias("lap")).filter(F.col("lap").isNotNull())
    across = F.sequence(F.lit(0), F.floor(F.col("width") / side).cast("int") - 1)
    pieces = F.transform(across, lambda tx: F.struct(tx.alias("tx"), moments(F.slice("lap", tx * side + 1, side - 2)).alias("m")))
    values = lap.select("asset_id", "tile", "ty", F.inline(pieces))
    tiles = values.groupBy("asset_id", "tile", "tx", "ty").agg(F.sum("m.n").alias("n"), F.sum("m.s").alias("s"), F.sum("m.q").alias("q"), F.count("*").alias("rows"))
    return tiles.filter((F.col("rows") == side - 2) & (F.col("n") > 0)).select("asset_id", "tile", "tx", "ty", variance(F.col("n"), F.col("s"), F.col("q")).alias("v"))


def tile_summary(tiles: DataFrame, sharp: float = fixed.SHARP_TILE) -> DataFrame:
    """Peak (mean of the sharpest tenth, at least three), share of sharp tiles, centre of the sharpest tile.

    Tiles of an image are few (pixels / tile area), so ranking them per image is bounded by the image size. Values are
    ranked as rounded, so that the noise of a sum's order doesn't decide between equal tiles.
    """
    order = Window.partitionBy("asset_id").orderBy(F.desc(F.round("v", 6)), F.desc("tx"), F.desc("ty"))
    ranked = tiles.withColumns({"rank": F.row_number().over(order), "count": F.count("*").over(Window.partitionBy("asset_id"))})
    top = F.col("rank") <= F.greatest(F.lit(fixed.PEAK_MIN_TILES), F.floor(F.col("count") * fixed.PEAK_SHARE))
    return ranked.groupBy("asset_id").agg(
        F.avg(F.when(top, F.col("v"))).alias("sharpness_peak"), F.avg(F.when(F.col("v") >= sharp, 1.0).otherwise(0.0)).alias("sharp_tile_ratio"),
        F.max(F.when(F.col("rank") == 1, F.col("tx") * F.col("tile") + F.col("tile") / 2)).alias("sharpest_x"), F.max(F.when(F.col("rank") == 1, F.col("ty") * F.col("tile") + F.col("tile") / 2)).alias("sharpest_y"))


def crops(sizes: DataFrame, crop: int = fixed.CROP) -> DataFrame:
    """sizes(asset_id, width, height) -> five crops (centre and a 1/5, 3/5 grid) aligned to 8 pixels."""
    w, h = F.col("width"), F.col("height")
    side = (F.floor(F.least(F.lit(crop), w, h) / 8) * 8).cast("int")
    points = [(F.floor((w - side) / 2), F.floor((h - side) / 2))] + [(F.floor(i * w / 5), F.floor(j * h / 5)) for i in (1, 3) for j in (1, 3)]

    def aligned(v: Column, limit: Column) -> Column:
        return (F.floor(F.least(v, limit) / 8) * 8).cast("int")
    boxes = F.array(*[F.struct(F.lit(k).alias("crop"), aligned(x, w - side).alias("x0"), aligned(y, h - side).alias("y0"), side.alias("side")) for k, (x, y) in enumerate(points)])
    return sizes.select("asset_id", F.inline(boxes))


def crop_lines(lines: DataFrame, crop: int = fixed.CROP) -> DataFrame:
    """Lines of the five crops; ``asset_id`` becomes the crop's own image key."""
    sizes = lines.groupBy("asset_id").agg(F.max(F.size("px")).alias("width"), (F.max("y") + 1).alias("height"))
    boxes = crops(sizes, crop)
    cut = lines.join(boxes, "asset_id").filter((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + F.col("side")))
    return cut.select(F.struct("asset_id", "crop").alias("asset_id"), (F.col("y") - F.col("y0")).alias("y"), F.slice("px", F.col("x0") + 1, F.col("side")).alias("px"))


def crop_medians(lines: DataFrame, crop: int = fixed.CROP) -> DataFrame:
    """Median over the five crops of noise, blockiness and detail ratio."""
    cut = crop_lines(lines, crop)
    metrics = noise_sigma(cut).join(blockiness(cut), "asset_id").join(detail_ratio(cut), "asset_id")
    return metrics.groupBy(F.col("asset_id.asset_id").alias("asset_id")).agg(*[F.median(m).alias(m) for m in ("noise_sigma", "blockiness", "detail_ratio")])


def edge_border(lines: DataFrame) -> DataFrame:
    """Dark bands at the four edges: (asset_id, side, width, share)."""
    sizes = lines.groupBy("asset_id").agg(F.max(F.size("px")).alias("w"), (F.max("y") + 1).alias("h"))
    rows = lines.join(sizes, "asset_id")
    limit_y, limit_x = F.floor(F.col("h") * Q["edge_max_width_ratio"]), F.floor(F.col("w") * Q["edge_max_width_ratio"])
    depth = Q["edge_inner_offset"] + Q["edge_inner_lines"]
    # horizontal sides: only the few lines at the edge are exploded; vertical sides: one short slice per line
    bottom = F.col("h") - 1 - F.col("y")
    side = F.array_compact(F.array(F.when(F.col("y") < limit_y + depth, F.struct(F.lit("top").alias("side"), F.col("y").cast("bigint").alias("line"))), F.when(bottom < limit_y + depth, F.struct(F.lit("bottom").alias("side"), bottom.cast("bigint").alias("line")))))
    flat = rows.withColumn("s", F.explode(side)).select("asset_id", "s.side", "s.line", limit_y.alias("limit"), F.posexplode("px").alias("at", "v"))
    left = F.slice("px", 1, (limit_x + depth).cast("int"))
    right = F.slice(F.reverse("px"), 1, (limit_x + depth).cast("int"))
    upright = rows.withColumn("s", F.explode(F.array(F.struct(F.lit("left").alias("side"), left.alias("v")), F.struct(F.lit("right").alias("side"), right.alias("v"))))) \
        .select("asset_id", "s.side", F.col("y").alias("at"), limit_x.alias("limit"), F.posexplode("s.v").alias("line", "v"))
    cells = flat.select("asset_id", "side", "at", "line", "limit", "v").unionByName(upright.select("asset_id", "side", F.col("at").cast("int").alias("at"), F.col("line").cast("bigint").alias("line"), "limit", "v")).filter("limit >= 1")
    runs = cells.groupBy("asset_id", "side", "at", "limit").agg(F.min(F.when((F.col("v") > Q["edge_dark"]) & (F.col("line") < F.col("limit")), F.col("line"))).alias("first"),
                                                                  F.array_sort(F.collect_list(F.struct("line", "v"))).alias("cells"))  # limit + depth cells per column
    r = F.coalesce("first", "limit")
    lo, hi = r + Q["edge_inner_offset"], F.least(r + Q["edge_inner_offset"] + Q["edge_inner_lines"], F.size("cells"))

    def mean(start: Column, end: Column) -> Column:
        part = F.slice("cells", (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
        return F.aggregate(part, F.lit(0.0), lambda a, c: a + c["v"]) / F.greatest(end - start, F.lit(1))
    outer_n = F.greatest(F.least(r, F.lit(Q["edge_outer_lines"])), F.lit(1))
    outer, deep = mean(F.lit(0), outer_n), mean(lo, hi)
    banded = (r >= 1) & (r < F.col("limit")) & (hi > lo) & (outer <= Q["edge_dark"]) & (deep - outer >= Q["edge_diff"])
    columns = runs.select("asset_id", "side", r.alias("r"), banded.alias("banded"))
    widths = columns.groupBy("asset_id", "side").agg(F.floor(F.expr("median(CASE WHEN banded THEN r END)")).cast("bigint").alias("width"))
    near = columns.join(widths, ["asset_id", "side"])
    consistent = F.col("banded") & (F.abs(F.col("r") - F.col("width")) <= F.greatest(F.lit(float(Q["edge_consistency_px"])), Q["edge_consistency_ratio"] * F.col("width")))
    share = near.groupBy("asset_id", "side").agg(F.max("width").alias("width"), F.avg(F.coalesce(consistent, F.lit(False)).cast("double")).alias("share"))
    return share.filter(F.col("share") >= Q["edge_share"]).select("asset_id", "side", "width", F.round("share", 4).alias("share"))


# --- decisions over metrics ------------------------------------------------------------------

def qc_result(rows: DataFrame) -> DataFrame:
    """rows(exists, file_size, width, height, dark_ratio, bright_ratio, borders) -> passed, errors, warnings."""
    megapixels = F.col("width").cast("double") * F.col("height") / 1_000_000
    errors = F.when(~F.col("exists"), F.array(F.lit("FILE_NOT_FOUND"))).otherwise(codes(
        (F.col("file_size") < Q["min_file_size"], "FILE_TOO_SMALL"), (F.col("file_size") > Q["max_file_size"], "FILE_TOO_LARGE"), (megapixels < Q["min_megapixels"], "RESOLUTION_TOO_LOW")))
    warnings = codes((F.col("exists") & (megapixels >= Q["min_megapixels"]) & (megapixels < Q["recommended_megapixels"]), "RESOLUTION_BELOW_RECOMMENDED"),
                     (F.col("exists") & (F.col("dark_ratio") > Q["extreme_ratio"]), "HIGH_DARK_PIXEL_RATIO"), (F.col("exists") & (F.col("bright_ratio") > Q["extreme_ratio"]), "HIGH_BRIGHT_PIXEL_RATIO"),
                     (F.col("exists") & (F.col("borders") > 0), "EDGE_BORDER"))
    return rows.withColumns({"errors": errors, "warnings": warnings}).withColumn("passed", F.size("errors") == 0)


def level(value: Column, higher: bool, ok: float, borderline: float, issue: float) -> Column:
    if higher:
        return first_match([(value >= ok, "ok"), (value >= borderline, "borderline"), (value >= issue, "issue")], "severe")
    return first_match([(value < ok, "ok"), (value < borderline, "borderline"), (value < issue, "issue")], "severe")


def findings() -> Column:
    """array<struct<reason, level, operation>> in threshold order; a known JPEG quality replaces blockiness."""
    items = []
    for metric, reason, higher, ok, borderline, issue, operation in fixed.ENHANCEMENT_THRESHOLDS:
        value = level(F.col(metric), higher, ok, borderline, issue)
        if reason == "artifacts":
            value = F.when(F.col("jpeg_quality").isNotNull(), level(F.col("jpeg_quality"), True, *fixed.JPEG_QUALITY_BOUNDS)).otherwise(value)
        items.append(F.struct(F.lit(reason).alias("reason"), value.alias("level"), F.lit(operation).alias("operation")))
    return F.array(*items)


def notes() -> Column:
    peak_ok = fixed.ENHANCEMENT_THRESHOLDS[0][3]
    return compact(flag(F.col("detail_ratio") < fixed.SOFT_DETAIL_RATIO, "SOFT_AT_NATIVE_RESOLUTION"),
                   flag((F.col("sharp_tile_ratio") < fixed.ISOLATED_SUBJECT_RATIO) & (F.col("sharpness_peak") >= peak_ok), "ISOLATED_SUBJECT"))


def decide(found: Column) -> Column:
    """struct<decision, disputed, reasons, operations> of the findings."""
    def of(name: str) -> Column:
        return F.filter(found, lambda f: f["level"] == name)
    severe, issue, border = of("severe"), of("issue"), of("borderline")
    decision = first_match([(F.size(severe) > 0, "enhancement_risky"), (F.size(issue) > 0, "enhancement_recommended"), (F.size(border) > 0, F.lit(None).cast("string"))], "enhancement_not_needed")
    disputed = (F.size(severe) == 0) & (F.size(issue) == 0) & (F.size(border) > 0)
    reasons = F.when(F.size(severe) > 0, F.concat(severe, issue)).when(F.size(issue) > 0, issue).otherwise(border)
    operations = F.when((F.size(severe) == 0) & (F.size(issue) > 0), F.transform(issue, lambda f: f["operation"])).otherwise(F.expr("cast(array() as array<string>)"))
    return F.struct(decision.alias("decision"), disputed.alias("disputed"), F.transform(reasons, lambda f: F.concat_ws(":", f["reason"], f["level"])).alias("reasons"), operations.alias("operations"))
