import struct
import zlib

from pyspark.sql import functions as F

from plateworks.operators import images
from plateworks.sources.files import list_files
from plateworks.sources.images import scanlines


def png(path, width, height, pixel):
    raw = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_listing_by_suffix_with_content_facts(spark, tmp_path):
    png(tmp_path / "A.PNG", 4, 3, lambda x, y: (x, y, 0))
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8\xff\xe0rest")
    rows = {r["extension"]: r for r in list_files(spark, str(tmp_path), with_hash=True).collect()}
    assert set(rows) == {".png", ".jpg"} and rows[".png"]["container"] == "PNG" and rows[".jpg"]["container"] == "JPEG"


def test_real_image_metrics(spark, tmp_path):
    png(tmp_path / "edge.png", 120, 130, lambda x, y: (0, 0, 0) if y < 2 else (100 + (x * 37 + y * 91) % 60,) * 3)
    lines = scanlines(spark, str(tmp_path)).withColumn("asset_id", F.lit(1))
    assert lines.count() == 130
    border = images.edge_border(lines).collect()
    assert [(b["side"], b["width"], b["share"]) for b in border] == [("top", 2, 1.0)]
    assert abs(images.extreme_ratio(lines).first()["dark_ratio"] - 2 / 130) < 1e-9
    assert images.sharpness(lines).first()["sharpness"] > 0


def test_small_grey_alpha_and_broken_pictures_stay(spark, tmp_path):
    png(tmp_path / "small.png", 10, 40, lambda x, y: ((x * y * 7) % 200,) * 3)
    raw = b"".join(b"\0" + bytes((x * 3) % 250 for x in range(12)) for _ in range(9))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    (tmp_path / "grey.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 12, 9, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nrest")
    rows = scanlines(spark, str(tmp_path)).withColumn("name", F.element_at(F.split("path", "/"), -1)).cache()
    found = {(r["name"], r["problem"]): r["n"] for r in rows.groupBy("name", "problem").agg(F.count("*").alias("n")).collect()}
    assert found == {("small.png", None): 40, ("grey.png", None): 9, ("broken.png", "UNDECODABLE"): 1}
    assert rows.filter("name = 'grey.png' AND y = 2").first()["px"] == [float((x * 3) % 250) for x in range(12)]
    lines = rows.filter("problem IS NULL").withColumn("asset_id", F.col("name"))
    tiles = images.tile_variances(lines, 16)
    assert {(r["asset_id"], r["tile"], r["n"]) for r in tiles.groupBy("asset_id", "tile").agg(F.count("*").alias("n")).collect()} == {("small.png", 10, 4), ("grey.png", 9, 1)}
    assert images.tile_summary(tiles).count() == 2
