"""Queries of image metrics on scanlines shaped from the embeddings, and of quality decisions over parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions.arrays import joined
from plateworks.operators import images
from plateworks.plans.bindings import Tables, sql_view
from plateworks.plans.registry import query

TILE, CROP, SHARP = 16, 64, 60000.0  # image sizes of the binding are small: tiles and crops scale with them


def lines(t: Tables):
    """128 vectors make an image of 128 lines; a line is a vector and its mirror image, the top two lines are dark."""
    level = F.transform("embedding", lambda e: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(e.cast("double") * 600 + 128).cast("double"))))
    rows = t.embeddings.select(F.floor(F.col("vec_id") / 128).alias("asset_id"), (F.col("vec_id") % 128).alias("y"), level.alias("half"))
    dimmed = F.when(F.col("y") < 2, F.transform("half", lambda v: F.floor(v / 12).cast("double"))).otherwise(F.col("half"))
    return rows.withColumn("half", dimmed).select("asset_id", "y", F.concat("half", F.reverse("half")).alias("px"))


_HALF = "list_transform(embedding, lambda e: least(255.0::DOUBLE, greatest(0.0::DOUBLE, floor(e::DOUBLE * 600 + 128))))"
sql_view("b_lines", f"""
SELECT asset_id, y, list_concat(half, list_reverse(half)) AS px FROM (SELECT asset_id, y, CASE WHEN y < 2 THEN list_transform(half, lambda v: floor(v / 12)) ELSE half END AS half
FROM (SELECT vec_id // 128 AS asset_id, vec_id % 128 AS y, {_HALF} AS half FROM embeddings))""")
sql_view("b_px", "SELECT asset_id, y, x - 1 AS x, v FROM (SELECT asset_id, y, unnest(px) AS v, generate_subscripts(px, 1) AS x FROM b_lines)")
_X, _Y = "(PARTITION BY asset_id, y ORDER BY x)", "(PARTITION BY asset_id, x ORDER BY y)"


def _near(src: str, key: str = "asset_id") -> str:
    wx, wy = f"(PARTITION BY {key}, y ORDER BY x)", f"(PARTITION BY {key}, x ORDER BY y)"
    return f"SELECT *, lag(v) OVER {wx} AS l, lead(v) OVER {wx} AS r, lag(v) OVER {wy} AS u, lead(v) OVER {wy} AS d FROM {src}"


def _noise(src: str, key: str) -> str:
    wy = f"(PARTITION BY {key}, x ORDER BY y)"
    return f"""WITH n AS ({_near(src, key)}), s AS (SELECT *, l - 2 * v + r AS sd, abs(r - l) + abs(d - u) AS g FROM n), q AS (SELECT *, lag(sd) OVER {wy} - 2 * sd + lead(sd) OVER {wy} AS res FROM s),
k AS (SELECT {key}, quantile_cont(round(g, 6), 0.3) AS lim FROM q WHERE res IS NOT NULL AND g IS NOT NULL GROUP BY {key}) SELECT {key}, sqrt(3.141592653589793 / 2) / 6 * avg(abs(res)) AS noise_sigma FROM q JOIN k USING ({key}) WHERE res IS NOT NULL AND round(g, 6) <= lim GROUP BY {key}"""


def _block(src: str, key: str) -> str:
    return f"""WITH n AS ({_near(src, key)}), e AS (SELECT {key}, 'x' AS axis, (x - 1) % 8 AS phase, abs(v - l) AS dd FROM n WHERE l IS NOT NULL UNION ALL SELECT {key}, 'y', (y - 1) % 8, abs(v - u) FROM n WHERE u IS NOT NULL),
m AS (SELECT {key}, axis, phase, avg(dd) AS m FROM e GROUP BY ALL) SELECT {key}, sum(m) FILTER (WHERE phase = 7) / (sum(m) FILTER (WHERE phase = 3) + 1e-6) AS blockiness FROM m GROUP BY {key}"""


def _lapvar(src: str, key: str) -> str:
    return f"SELECT {key}, var_pop(4 * v - l - r - u - d) AS lv FROM ({_near(src, key)}) GROUP BY {key}"


def _detail(src: str, key: str) -> str:
    half = f"(SELECT {key}, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM {src} GROUP BY {key}, y // 2, x // 2 HAVING count(*) = 4)"
    return f"SELECT {key}, f.lv / (h.lv + 1e-6) AS detail_ratio FROM ({_lapvar(src, key)}) f JOIN ({_lapvar(half, key)}) h USING ({key})"


@query("img_gray", "SELECT asset_id, y, round(list_sum(list_transform(px, lambda v, i: (299 * v + 587 * px[len(px) - i + 1] + 114 * px[1]) / 1000)), 4) AS luma FROM b_lines")
def img_gray(t: Tables):
    first = F.transform("px", lambda v: F.get("px", 0))
    luma = images.gray(F.col("px"), F.reverse("px"), first)
    return lines(t).select("asset_id", "y", F.round(F.aggregate(luma, F.lit(0.0), lambda a, x: a + x), 4).alias("luma"))


@query("img_sharpness", f"SELECT asset_id, round(var_pop(v - l) + var_pop(v - u), 4) AS sharpness FROM ({_near('b_px')}) GROUP BY asset_id")
def img_sharpness(t: Tables):
    return images.sharpness(lines(t)).withColumn("sharpness", F.round("sharpness", 4))


@query("img_extreme_ratio", "SELECT asset_id, round(avg(CAST(v <= 5 AS INT)), 6) AS dark_ratio, round(avg(CAST(v >= 250 AS INT)), 6) AS bright_ratio FROM b_px GROUP BY asset_id")
def img_extreme_ratio(t: Tables):
    return images.extreme_ratio(lines(t)).withColumns({c: F.round(c, 6) for c in ("dark_ratio", "bright_ratio")})


@query("img_laplacian_var", f"SELECT asset_id, round(lv, 4) AS sharpness FROM ({_lapvar('b_px', 'asset_id')})")
def img_laplacian_var(t: Tables):
    return images.laplacian_variance(lines(t)).withColumn("sharpness", F.round("sharpness", 4))


@query("img_noise_sigma", f"SELECT asset_id, round(noise_sigma, 4) AS noise_sigma FROM ({_noise('b_px', 'asset_id')})")
def img_noise_sigma(t: Tables):
    return images.noise_sigma(lines(t)).withColumn("noise_sigma", F.round("noise_sigma", 4))


@query("img_blockiness", f"SELECT asset_id, round(blockiness, 5) AS blockiness FROM ({_block('b_px', 'asset_id')})")
def img_blockiness(t: Tables):
    return images.blockiness(lines(t)).withColumn("blockiness", F.round("blockiness", 5))


@query("img_detail_ratio", f"SELECT asset_id, round(detail_ratio, 5) AS detail_ratio FROM ({_detail('b_px', 'asset_id')})")
def img_detail_ratio(t: Tables):
    return images.detail_ratio(lines(t)).withColumn("detail_ratio", F.round("detail_ratio", 5))


sql_view("b_tiles", f"""
SELECT asset_id, tile, x // tile AS tx, y // tile AS ty, var_pop(4 * v - l - r - u - d) AS v FROM ({_near('b_px')}) JOIN (SELECT asset_id, least({TILE}, max(x) + 1, max(y) + 1) AS tile FROM b_px GROUP BY asset_id) USING (asset_id)
WHERE x % tile BETWEEN 1 AND tile - 2 AND y % tile BETWEEN 1 AND tile - 2 GROUP BY ALL HAVING count(4 * v - l - r - u - d) = (tile - 2) * (tile - 2)""")
sql_view("b_tile_rank", "SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY round(v, 6) DESC, tx DESC, ty DESC) AS rank, count(*) OVER (PARTITION BY asset_id) AS n FROM b_tiles")


@query("img_tile_sharpness", f"""
SELECT asset_id, round(avg(v) FILTER (WHERE rank <= greatest(3, floor(n * 0.1))), 3) AS sharpness_peak, round(avg(CAST(v >= {SHARP} AS INT)), 6) AS sharp_tile_ratio, max(tx * tile + tile / 2::DOUBLE) FILTER (WHERE rank = 1) AS sharpest_x, max(ty * tile + tile / 2::DOUBLE) FILTER (WHERE rank = 1) AS sharpest_y
FROM b_tile_rank GROUP BY asset_id""")
def img_tile_sharpness(t: Tables):
    done = images.tile_summary(images.tile_variances(lines(t), TILE), SHARP)
    return done.withColumns({"sharpness_peak": F.round("sharpness_peak", 3), "sharp_tile_ratio": F.round("sharp_tile_ratio", 6)})


@query("win_tile_topk", "SELECT asset_id, count(*) AS tiles, count(*) FILTER (WHERE rank <= greatest(3, floor(n * 0.1))) AS counted, round(avg(v) FILTER (WHERE rank <= greatest(3, floor(n * 0.1))), 3) AS peak FROM b_tile_rank GROUP BY asset_id")
def win_tile_topk(t: Tables):
    tiles = images.tile_variances(lines(t), TILE)
    done = images.tile_summary(tiles, SHARP).select("asset_id", F.round("sharpness_peak", 3).alias("peak"))
    counts = tiles.groupBy("asset_id").agg(F.count("*").alias("tiles"))
    return counts.join(done, "asset_id").select("asset_id", "tiles", F.least("tiles", F.greatest(F.lit(3).cast("bigint"), F.floor(F.col("tiles") * fixed.PEAK_SHARE))).alias("counted"), "peak")


_CROPS = f"""SELECT asset_id, k, least(gx, w - side) // 8 * 8 AS x0, least(gy, h - side) // 8 * 8 AS y0, side FROM (SELECT *, least({CROP}, w, h) // 8 * 8 AS side FROM (SELECT asset_id, max(x) + 1 AS w, max(y) + 1 AS h FROM b_px GROUP BY 1)) s,
 LATERAL (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest([(w - side) // 2, w // 5, w // 5, 3 * w // 5, 3 * w // 5]) AS gx, unnest([(h - side) // 2, h // 5, 3 * h // 5, h // 5, 3 * h // 5]) AS gy) c"""
sql_view("b_crop_px", f"SELECT p.asset_id * 10 + k AS crop_id, y - y0 AS y, x - x0 AS x, v FROM b_px p JOIN ({_CROPS}) c ON c.asset_id = p.asset_id AND x >= x0 AND x < x0 + side AND y >= y0 AND y < y0 + side")


@query("img_crop_median", f"""
SELECT crop_id // 10 AS asset_id, round(median(noise_sigma), 4) AS noise_sigma, round(median(blockiness), 5) AS blockiness, round(median(detail_ratio), 5) AS detail_ratio FROM ({_noise('b_crop_px', 'crop_id')}) JOIN ({_block('b_crop_px', 'crop_id')}) USING (crop_id) JOIN ({_detail('b_crop_px', 'crop_id')}) USING (crop_id) GROUP BY 1""")
def img_crop_median(t: Tables):
    done = images.crop_medians(lines(t), CROP)
    return done.select("asset_id", F.round("noise_sigma", 4).alias("noise_sigma"), F.round("blockiness", 5).alias("blockiness"), F.round("detail_ratio", 5).alias("detail_ratio"))


@query("img_edge_border", """
WITH sz AS (SELECT asset_id, max(x) + 1 AS w, max(y) + 1 AS h FROM b_px GROUP BY 1),
c AS (SELECT p.asset_id, s.side, CASE WHEN s.side IN ('top', 'bottom') THEN x ELSE y END AS pos, CASE s.side WHEN 'top' THEN y WHEN 'bottom' THEN h - 1 - y WHEN 'left' THEN x ELSE w - 1 - x END AS line, CASE WHEN s.side IN ('top', 'bottom') THEN CAST(floor(h * 0.03) AS BIGINT) ELSE CAST(floor(w * 0.03) AS BIGINT) END AS lim, v
 FROM b_px p JOIN sz USING (asset_id), (VALUES ('top'), ('bottom'), ('left'), ('right')) s(side)),
e AS (SELECT * FROM c WHERE lim >= 1 AND line < lim + 10),
r AS (SELECT asset_id, side, pos, lim, coalesce(min(line) FILTER (WHERE v > 25 AND line < lim), max(lim)) AS r, list(v ORDER BY line) AS vs FROM e GROUP BY asset_id, side, pos, lim),
m AS (SELECT *, list_avg(vs[1:greatest(least(r, 8), 1)]) AS outer_mean, r + 2 AS lo, least(r + 10, len(vs)) AS hi FROM r),
b AS (SELECT *, coalesce(r >= 1 AND r < lim AND hi > lo AND outer_mean <= 25 AND list_avg(vs[lo + 1:hi]) - outer_mean >= 20, FALSE) AS banded FROM m),
wd AS (SELECT asset_id, side, CAST(floor(median(r) FILTER (WHERE banded)) AS BIGINT) AS width FROM b GROUP BY asset_id, side),
ok AS (SELECT asset_id, side, width, CAST(coalesce(banded AND abs(r - width) <= greatest(3, 0.25 * width), FALSE) AS INT) AS consistent FROM b JOIN wd USING (asset_id, side))
SELECT asset_id, side, max(width) AS width, round(avg(consistent), 4) AS share FROM ok GROUP BY asset_id, side HAVING avg(consistent) >= 0.4""")
def img_edge_border(t: Tables):
    return images.edge_border(lines(t))


# decisions over metrics: parts lend sizes and metric values
_METRICS = {"sharpness_peak": "p_size * 5.0", "noise_sigma": "(p_retailprice - 900) / 6", "blockiness": "1 + p_size / 20.0", "megapixels": "(50 - p_size) / 4.0", "detail_ratio": "p_size / 100.0", "sharp_tile_ratio": "(p_retailprice - 900) / 200"}


def _metrics(t: Tables):
    quality = F.when(F.col("p_type") == "SMALL", F.col("p_size") * 2)
    return t.part.select(F.col("p_partkey").alias("asset_id"), *[F.expr(e).cast("double").alias(k) for k, e in _METRICS.items()], quality.alias("jpeg_quality"))


def _level_sql(value: str, higher: bool, ok: float, border: float, issue: float) -> str:
    op = ">=" if higher else "<"
    return f"CASE WHEN {value} {op} {ok} THEN 'ok' WHEN {value} {op} {border} THEN 'borderline' WHEN {value} {op} {issue} THEN 'issue' ELSE 'severe' END"


_LEVELS = {}
for _m, _r, _h, _a, _b, _c, _o in fixed.ENHANCEMENT_THRESHOLDS:
    _LEVELS[_r] = _level_sql(_m, _h, _a, _b, _c)
_LEVELS["artifacts"] = f"CASE WHEN jpeg_quality IS NOT NULL THEN {_level_sql('jpeg_quality', True, *fixed.JPEG_QUALITY_BOUNDS)} ELSE {_LEVELS['artifacts']} END"
sql_view("b_metrics", "SELECT p_partkey AS asset_id, " + ", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in _METRICS.items()) + ", CASE WHEN p_type = 'SMALL' THEN p_size * 2 END AS jpeg_quality FROM part")
_OPS = {r: o for _, r, *_rest, o in fixed.ENHANCEMENT_THRESHOLDS}
sql_view("b_findings", "SELECT *, [" + ", ".join(f"{{'reason': '{r}', 'level': {e}, 'operation': '{_OPS[r]}'}}" for r, e in _LEVELS.items()) + "] AS f FROM b_metrics")


@query("img_levels", "SELECT asset_id, array_to_string(list_transform(f, lambda x: x.reason || ':' || x.level), ',') AS levels FROM b_findings")
def img_levels(t: Tables):
    return _metrics(t).select("asset_id", joined(F.transform(images.findings(), lambda f: F.concat_ws(":", f["reason"], f["level"]))).alias("levels"))


@query("img_notes", "SELECT asset_id, array_to_string(list_filter([CASE WHEN detail_ratio < 0.2 THEN 'SOFT_AT_NATIVE_RESOLUTION' END, CASE WHEN sharp_tile_ratio < 0.15 AND sharpness_peak >= 120 THEN 'ISOLATED_SUBJECT' END], lambda x: x IS NOT NULL), ',') AS notes FROM b_metrics")
def img_notes(t: Tables):
    return _metrics(t).select("asset_id", joined(images.notes()).alias("notes"))


def _of(level: str) -> str:
    return f"list_filter(f, lambda x: x.level = '{level}')"


@query("img_decide", f"""
SELECT asset_id, CASE WHEN len({_of('severe')}) > 0 THEN 'enhancement_risky' WHEN len({_of('issue')}) > 0 THEN 'enhancement_recommended' WHEN len({_of('borderline')}) > 0 THEN NULL ELSE 'enhancement_not_needed' END AS decision,
 len({_of('severe')}) = 0 AND len({_of('issue')}) = 0 AND len({_of('borderline')}) > 0 AS disputed, array_to_string(list_transform(CASE WHEN len({_of('severe')}) > 0 THEN list_concat({_of('severe')}, {_of('issue')}) WHEN len({_of('issue')}) > 0 THEN {_of('issue')} ELSE {_of('borderline')} END, lambda x: x.reason || ':' || x.level), ',') AS reasons,
 CASE WHEN len({_of('severe')}) = 0 THEN array_to_string(list_transform({_of('issue')}, lambda x: x.operation), ',') ELSE '' END AS operations FROM b_findings""")
def img_decide(t: Tables):
    rows = _metrics(t).withColumn("found", images.findings()).withColumn("d", images.decide(F.col("found")))
    return rows.select("asset_id", "d.decision", "d.disputed", joined(F.col("d.reasons")).alias("reasons"), joined(F.col("d.operations")).alias("operations"))


@query("img_qc_result", """
SELECT asset_id, passed, array_to_string(errors, ',') AS errors, array_to_string(warnings, ',') AS warnings FROM (SELECT *, len(errors) = 0 AS passed FROM (SELECT asset_id,
 CASE WHEN source_status = 'changed' THEN ['FILE_NOT_FOUND'] ELSE list_filter([CASE WHEN file_size < 102400 THEN 'FILE_TOO_SMALL' END, CASE WHEN file_size > 47185920 THEN 'FILE_TOO_LARGE' END, CASE WHEN width * height / 1000000.0 < 4 THEN 'RESOLUTION_TOO_LOW' END], lambda x: x IS NOT NULL) END AS errors,
 CASE WHEN source_status = 'changed' THEN [] ELSE list_filter([CASE WHEN width * height / 1000000.0 >= 4 AND width * height / 1000000.0 < 12 THEN 'RESOLUTION_BELOW_RECOMMENDED' END, CASE WHEN file_size / 100000000.0 > 0.2 THEN 'HIGH_DARK_PIXEL_RATIO' END, CASE WHEN coalesce(jpeg_quality, 0) / 400.0 > 0.2 THEN 'HIGH_BRIGHT_PIXEL_RATIO' END,
  CASE WHEN c2pa THEN 'EDGE_BORDER' END], lambda x: x IS NOT NULL) END AS warnings FROM b_facts))""")
def img_qc_result(t: Tables):
    rows = t.b_facts.withColumns({"exists": F.col("source_status") != "changed", "dark_ratio": F.col("file_size") / 100000000.0, "bright_ratio": F.coalesce("jpeg_quality", F.lit(0)) / 400.0, "borders": F.col("c2pa").cast("int")})
    return images.qc_result(rows).select("asset_id", "passed", joined(F.col("errors")).alias("errors"), joined(F.col("warnings")).alias("warnings"))
