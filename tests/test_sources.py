"""Files: lists, folders, archives, rasters, sinks and streams."""

import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrel.sources import config, files, png, scratch, sinks, tiff
from rastrel.streaming import runlog


def test_lists(spark, tmp_path):
    (tmp_path / "pairs.csv").write_text("a.png,b.png\nc.png,d.png\n")
    assert [tuple(r) for r in files.pair_list(spark, str(tmp_path / "pairs.csv")).collect()] == [("a.png", "b.png"), ("c.png", "d.png")]
    (tmp_path / "list.txt").write_text(" cat/1.png \n\ndog/2.png\ncat/3.png\n")
    assert files.file_list(spark, str(tmp_path / "list.txt")).count() == 3
    assert {(r["path"], r["class_id"]) for r in files.labelled_list(spark, str(tmp_path / "list.txt")).collect()} == {("cat/1.png", 0), ("dog/2.png", 1), ("cat/3.png", 0)}


def test_folders(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "n.txt", ".h.tif", "x_tile_1.tif", "y.TIFF", "sub/c.ppm"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    base = lambda frame: [r["path"].rsplit("/", 1)[1] for r in frame.collect()]
    assert base(files.images(spark, str(tmp_path))) == ["a.jpg", "b.PNG", "c.ppm"]
    assert base(files.tiffs(spark, str(tmp_path))) == ["x_tile_1.tif", "y.TIFF"]
    assert base(files.tiffs(spark, str(tmp_path), True)) == ["x_tile_1.tif"]
    assert base(files.one_or_all(spark, str(tmp_path), "y.TIFF")) == ["y.TIFF"]
    with pytest.raises(ValueError):
        files.one_or_all(spark, str(tmp_path), "z.tif")
    (tmp_path / "none").mkdir()
    (tmp_path / "none/a.txt").write_text("x")
    with pytest.raises(ValueError):
        files.images(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("dtype", ["u1", "u2", "i4", "f4", "f8"])
def test_tiff_round_trip(dtype):
    values = np.arange(24).reshape(2, 3, 4).astype(dtype)
    back = tiff.decode(tiff.encode(tiff.Raster(values, (500.0, 0.5, 0.1, 700.0, 0.0, -0.5), "EPSG:32632")))
    assert np.array_equal(back.values, values) and back.values.dtype == values.dtype
    assert back.gt == (500.0, 0.5, 0.1, 700.0, 0.0, -0.5) and back.crs == "EPSG:32632"


def test_tiff_errors():
    with pytest.raises(ValueError):
        tiff.decode(b"GIF89a--")


def test_read_and_unpack(spark, tmp_path):
    data = tiff.encode(tiff.Raster(np.ones((1, 2, 3), "f4"), (0.0, 1.0, 0.0, 0.0, 0.0, -1.0), None))
    (tmp_path / "a.tif").write_bytes(data)
    with zipfile.ZipFile(tmp_path / "b.bin", "w") as z:
        z.writestr("in/one.tif", data)
        z.writestr("in/read.me", b"no")
    row = tiff.read(spark, str(tmp_path)).first()
    assert (row["width"], row["height"], row["n_bands"], row["dtype"]) == (3, 2, 1, "f4") and row["bands"] == [[1.0] * 6]
    assert tiff.read(spark, str(tmp_path), False).first()["bands"] is None
    got = {(r["member"], bytes(r["content"]) == data) for r in files.unpacked(spark, str(tmp_path)).collect()}
    assert got == {(None, True), ("in/one.tif", True)}


def test_encoded(spark):
    frame = spark.sql("SELECT 'a.tif' AS name, 2 AS height, 2 AS width, 'f4' AS dtype, named_struct('x0', 1D, 'dx', 1D, 'rx', 0D, 'y0', 2D, 'ry', 0D, 'dy', -1D) AS gt, 'EPSG:4326' AS crs, array(array(1D, 2D, 3D, 4D)) AS bands")
    back = tiff.decode(bytes(tiff.encoded(frame).first()["content"]))
    assert back.values.ravel().tolist() == [1, 2, 3, 4] and back.gt[0] == 1.0


def test_sinks(spark, tmp_path):
    sinks.manifests(spark.sql("SELECT 7 AS tile_id, 'train' AS split UNION ALL SELECT 12345, 'test'"), str(tmp_path / "m"))
    assert {(r["split"], r["value"]) for r in spark.read.text(str(tmp_path / "m")).collect()} == {("train", "0007"), ("test", "12345")}
    sinks.tiles(spark.range(4).select("id", (F.col("id") % 2).alias("raster_id")), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    sinks.logs(spark.range(2), str(tmp_path / "l"))
    sinks.texts(spark.range(2), str(tmp_path / "x"), "iter %d", "id")
    assert spark.read.json(str(tmp_path / "l")).count() == spark.read.text(str(tmp_path / "x")).count() == 2


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id * 20) AS ts, id % 2 AS user_id, 'm' AS event_type, CAST(id AS DOUBLE) AS value, '' AS props FROM range(60)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    events = runlog.source(spark, str(tmp_path / "in"))
    runlog.run(runlog.window_means(events), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() >= 18 and done.agg(F.max("n")).first()[0] == 3
    runlog.run(runlog.sessions(events), str(tmp_path / "out2"), str(tmp_path / "cp2")).awaitTermination()
    query = runlog.totals(events).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT n, total FROM totals").first()["n"] == 60


def packed(values, order="<", tile=None, packing=1, predictor=1, apart=False):
    """A TIFF file of values (bands, rows, columns) in a given layout, written out by the format's definition."""
    bands, height, width = values.shape
    high, wide = tile or (2, width)
    kind = values.dtype.newbyteorder(order)
    blocks = []
    for group in [values[k : k + 1] for k in range(bands)] if apart else [values]:
        for r in range(0, height, high):
            for c in range(0, width, wide):
                part = group[:, r : r + high, c : c + wide].transpose(1, 2, 0)
                if tile:
                    part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], 1)
                raw = part.astype(kind).tobytes()
                if predictor == 3:
                    planes = np.frombuffer(part.astype(kind.newbyteorder(">")).tobytes(), np.uint8).reshape(part.shape[0], -1, kind.itemsize).transpose(0, 2, 1)
                    planes = planes.reshape(part.shape[0], -1, part.shape[2])
                    raw = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], 1).tobytes()
                blocks.append({1: bytes, 5: lzw, 8: zlib.compress}[packing](raw))
    tags = {256: (4, [width]), 257: (4, [height]), 258: (3, [kind.itemsize * 8] * bands), 259: (3, [packing]), 277: (3, [bands]), 284: (3, [2 if apart else 1]), 317: (3, [predictor]), 339: (3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * bands)}
    tags |= {322: (4, [wide]), 323: (4, [high])} if tile else {278: (4, [high])}
    at, body, offsets = 8, b"", []
    for b in blocks:
        offsets.append(at + len(body))
        body += b
    tags |= {324 if tile else 273: (4, offsets), 325 if tile else 279: (4, [len(b) for b in blocks])}
    entries, extra, extra_at = b"", b"", at + len(body)
    for tag, (code, numbers) in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(numbers)}{'HI'[code == 4]}", *numbers)
        if len(raw) > 4:
            entries += struct.pack(order + "HHII", tag, code, len(numbers), extra_at + len(extra))
            extra += raw
        else:
            entries += struct.pack(order + "HHI", tag, code, len(numbers)) + raw.ljust(4, b"\0")
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", extra_at + len(extra)) + body + extra + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4


def lzw(data):
    bits, table, width, last = "", {bytes([k]): k for k in range(256)}, 9, b""
    bits += f"{256:09b}"
    n = 258
    for k in range(len(data)):
        if last + data[k : k + 1] in table:
            last += data[k : k + 1]
            continue
        bits += f"{table[last]:0{width}b}"
        table[last + data[k : k + 1]] = n
        n += 1
        width = max(9, n.bit_length()) if n < 4095 else 12
        last = data[k : k + 1]
        if n == 4094:
            bits += f"{table[last]:0{width}b}" + f"{256:012b}"
            table, width, last, n = {bytes([j]): j for j in range(256)}, 9, b"", 258
    bits += (f"{table[last]:0{width}b}" if last else "") + f"{257:0{max(width, max(9, (n + 1).bit_length()))}b}"
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


@pytest.mark.parametrize("dtype,packing,predictor", [("u1", 1, 1), ("u2", 8, 2), ("u1", 8, 2), ("f4", 8, 3), ("f8", 8, 3), ("i2", 5, 1), ("u2", 5, 2)])
def test_tiff_layouts(dtype, packing, predictor):
    values = (np.random.default_rng(3).normal(size=(3, 7, 5)) * 50 + 100).astype(dtype)
    for order in "<>":
        for tile in (None, (4, 4)):
            for apart in (False, True):
                got = tiff.decode(packed(values, order, tile, packing, predictor, apart))
                assert (got.values == values).all(), (order, tile, apart)


def test_tiff_lzw_code_widths():
    values = np.random.default_rng(6).integers(0, 256, (1, 90, 100)).astype("u1")
    assert (tiff.decode(packed(values, tile=(90, 100), packing=5)).values == values).all()
    flat = np.zeros((1, 300, 400), "u1")
    assert (tiff.decode(packed(flat, tile=(300, 400), packing=5)).values == flat).all()


def test_tiff_errors_and_tiles(spark, tmp_path):
    values = np.arange(12.0).reshape(1, 3, 4)
    raster = tiff.Raster(values, (10.0, 1.0, 0.0, 20.0, 0.0, -1.0), "EPSG:32632", -9999.0)
    assert tiff.decode(tiff.encode(raster)).no_data == -9999.0
    (tmp_path / "a.tif").write_bytes(tiff.encode(raster))
    (tmp_path / "b.tif").write_bytes(tiff.encode(raster)[:60])
    (tmp_path / "c.tif").write_bytes(b"nothing")
    (tmp_path / "d.tif").write_bytes(packed(values.astype("u1"), packing=1).replace(struct.pack("<HHII", 259, 3, 1, 1), struct.pack("<HHII", 259, 3, 1, 7)))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in tiff.read(spark, str(tmp_path)).collect()}
    assert rows["a.tif"]["error"] is None and rows["a.tif"]["bands"] == [values.ravel().tolist()] and rows["a.tif"]["no_data"] == -9999.0
    assert all(rows[f]["error"] and rows[f]["width"] is None for f in ("b.tif", "c.tif", "d.tif"))
    tiles = tiff.read(spark, str(tmp_path)).where("error is null").select(F.lit("t_0.tif").alias("name"), "height", "width", "dtype", "gt", "crs", "bands")
    assert tiff.write(tiles, str(tmp_path / "out")) == 1
    again = tiff.read(spark, str(tmp_path / "out")).first()
    assert again["bands"] == rows["a.tif"]["bands"] and again["gt"] == rows["a.tif"]["gt"] and again["crs"] == "EPSG:32632"


def test_images(spark, tmp_path):
    pixels = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 8, 7])
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = b"".join(b"\0" + pixels[k : k + 6] for k in (0, 6))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    (tmp_path / "x.png").write_bytes(png)
    (tmp_path / "y.jpg").write_bytes(b"no image")
    (row,) = tiff.read_images(spark, str(tmp_path)).collect()
    assert (row["width"], row["height"], row["n_bands"]) == (2, 2, 3) and row["bands"] == [[255.0, 0.0, 0.0, 9.0], [0.0, 255.0, 0.0, 8.0], [0.0, 0.0, 255.0, 7.0]]


def test_bytes_split_and_rejoined(spark):
    rows = [("a", bytes(range(256)) * 5), ("b", b""), ("c", None), ("d", b"x" * 100)]
    parts = sinks.split_bytes(spark.createDataFrame(rows, "name string, content binary"), 100)
    assert {r.name: r.n for r in parts.groupBy("name").count().toDF("name", "n").collect()} == {"a": 13, "b": 1, "c": 1, "d": 1}
    whole = {r.name: bytes(r.content) for r in sinks.rejoined(parts.orderBy(parts.part.desc())).collect()}
    assert whole == {n: c or b"" for n, c in rows}
    gaps = {r.name: r.content for r in sinks.rejoined(parts.where("part <> 12")).collect()}
    assert gaps["a"] is None and gaps["d"] is not None
    twice = {r.name: r.content for r in sinks.rejoined(parts.union(parts.where("name = 'd'"))).collect()}
    assert twice["d"] is None and twice["a"] is not None


def test_logs_by_trial(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5), (1, 0.25), (2, 1.0)], "trial int, loss double")
    sinks.logs(rows, f"{tmp_path}/logs", "trial")
    assert spark.read.json(f"{tmp_path}/logs/trial=1").count() == 2


def test_png(spark, tmp_path):
    rows = [("a/x.png", 2, 3, [[0.0, 1.9, 300.0, -4.0, float("nan"), 255.0]]), ("y.png", 1, 1, [[1.0], [2.0], [3.0]])]
    assert sinks.files(png.encoded(spark.createDataFrame(rows, "name string, height int, width int, bands array<array<double>>")), str(tmp_path)) == 2
    (wide,) = tiff.read_images(spark, str(tmp_path / "a")).collect()
    assert (wide["width"], wide["height"], wide["n_bands"], wide["bands"]) == (3, 2, 1, [[0.0, 1.0, 255.0, 0.0, 0.0, 255.0]])
    (colour,) = tiff.read_images(spark, str(tmp_path / "y.png")).collect()
    assert colour["bands"] == [[1.0], [2.0], [3.0]]
    again = spark.createDataFrame([("y.png", b"new"), ("y.png", b"new")], "name string, content binary").coalesce(1)
    assert sinks.files(again, str(tmp_path)) == 2 and (tmp_path / "y.png").read_bytes() == b"new"
    with pytest.raises(ValueError):
        png.encode(np.zeros((2, 4, 4), np.uint8))
    assert sinks.files(spark.createDataFrame([], "name string, content binary"), str(tmp_path / "none")) == 0


def test_contact_sheet():
    tiles = np.arange(1, 6, dtype=np.uint8)[:, None, None, None] * np.ones((1, 1, 2, 2), np.uint8)
    made = png.sheet(tiles, 3, 1)
    assert made.shape == (1, 7, 10) and made[0, 1, [1, 4, 7]].tolist() == [1, 2, 3] and made[0, 4, [1, 4, 7]].tolist() == [4, 5, 0]
    assert not made[0, [0, 3, 6]].any() and png.sheet(tiles[:1], 8, 0).shape == (1, 2, 2)


def test_settings():
    assert config.settings('{"lr": 0.5, "steps": [1, 2]}') == {"lr": 0.5, "steps": [1, 2]} and config.settings("") == {}
    for text in ("[1, 2]", '{"a": ', "3"):
        with pytest.raises(ValueError):
            config.settings(text)


def test_scratch_folders_differ(spark):
    assert scratch.folder(spark, "x") != scratch.folder(spark, "x")
