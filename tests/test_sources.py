"""Readers and writers: round trips, layouts of files, and errors."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.catalogue import FrameCatalogue, RpcCatalogue
from terralith.errors import CrsError, CrsMissingError, ParamError, TerralithWarning
from terralith.functions import crs as C
from terralith.operators import catalog as J
from terralith.sources import exterior as E
from terralith.sources import files, params, store, tiff, yamls

XYZ_OPK = "filename,x,y,z,omega,phi,kappa\nim_1.tif,-55000.5,-3727000.25,5258.3,-0.349216,0.298484,-179.086702\nim_2.tif,-55100.5,-3727100.25,5258.4,-0.3,0.2,-179.0\n"
PRJ = "+proj=tmerc +lat_0=0 +lon_0=25 +k=1 +x_0=0 +y_0=0 +datum=WGS84 +units=m +no_defs=True"
LLA_RPY = 'filename latitude longitude altitude roll pitch yaw camera other\nim_1.tif 24.68 120.95 186.5 0.0 30.0 92.9 "cam one" x\nim_2.tif 24.69 120.96 187.5 1.0 31.0 -175.8 "cam one" x\n'


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int16", "float32", "float64"])
@pytest.mark.parametrize("tile", [None, 16])
def test_tiff_round_trip(dtype, tile):
    a = (np.random.default_rng(0).random((3, 17, 23)) * 200).astype(dtype)
    b = tiff.write(a, [2.0, 0, 100, 0, -2.0, 500], 32734, -1.0, tile)
    h = tiff.head_of(b)
    assert (tiff.read_pixels(b) == a).all() and (h.width, h.height, h.bands, h.epsg, h.nodata, h.transform[2]) == (23, 17, 3, 32734, -1.0, 100)


def _plain(pixels: np.ndarray, way: int, predictor: int, pack, order: str) -> bytes:
    """A chunky TIFF of one strip in either byte order."""
    rows, cols, bands = pixels.shape
    code = next(k for k, v in tiff.SAMPLES.items() if np.dtype(v) == pixels.dtype)
    body = pack(pixels)
    tags = [(256, cols), (257, rows), (258, code[1]), (259, way), (273, 8), (277, bands), (278, rows), (279, len(body)), (317, predictor), (339, code[0])]
    at = 8 + len(body)
    out = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, at) + body + struct.pack(order + "H", len(tags))
    return out + b"".join(struct.pack(order + "HHII", t, 4, 1, v) for t, v in tags) + b"\0\0\0\0"


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_predictors_and_packing(order):
    a = (np.random.default_rng(1).random((6, 7, 3)) * 60000).astype("u2")
    diff = np.diff(a, axis=1, prepend=np.zeros((6, 1, 3), "u2")).astype("u2")
    import zlib

    assert (tiff.read_pixels(_plain(a, 8, 2, lambda p: zlib.compress(diff.astype(order + "u2").tobytes()), order)) == a.transpose(2, 0, 1)).all()
    f = np.random.default_rng(2).random((6, 7, 1)).astype("f4")
    lines = f.reshape(6, 7).astype(">f4").view(np.uint8).reshape(6, 7, 4).transpose(0, 2, 1).reshape(6, 28)
    coded = np.diff(lines, axis=1, prepend=np.zeros((6, 1), np.uint8)).astype(np.uint8)
    assert (tiff.read_pixels(_plain(f, 8, 3, lambda p: zlib.compress(coded.tobytes()), order))[0] == f[..., 0]).all()
    assert tiff.unpacked_bits(b"\x02abc\xfdx\x80\x00y") == b"abcxxxxy"
    # codes 256, 97, 98, 258, 257 of nine bits: a, b, ab
    bits = "".join(f"{c:09b}" for c in (256, 97, 98, 258, 257))
    assert tiff.unlzw(int(bits.ljust(48, "0"), 2).to_bytes(6, "big")) == b"abab"


def test_raster_scan(spark, tmp_path):
    a = np.arange(2 * 5 * 4, dtype=np.uint16).reshape(2, 5, 4)
    for k in range(3):
        (tmp_path / f"im{k}.tif").write_bytes(tiff.write(a + k, nodata=7))
    rows = files.pixels_of(files.read_rasters(spark, f"{tmp_path}/*.tif"))
    assert rows.count() == 3 * a.size - 3
    got = rows.where(F.col("path").endswith("im2.tif") & (F.col("band") == 2)).orderBy("i", "j").collect()
    assert [r.v for r in got] == (a[1] + 2).ravel().tolist()
    with pytest.raises(Exception, match="bands"):
        files.read_rasters(spark, f"{tmp_path}/im0.tif", [3]).count()


def test_paths(spark, tmp_path):
    for n in ("b.tif", "a.tif", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    got = [r.path.rsplit("/", 1)[1] for r in files.paths(spark, [f"{tmp_path}/c.txt", f"{tmp_path}/*.tif"]).orderBy("ord").collect()]
    assert got == ["c.txt", "a.tif", "b.tif"]
    with pytest.raises(FileNotFoundError):
        files.paths(spark, f"{tmp_path}/none*.tif")


def test_overwrite_guard(spark, tmp_path):
    store.write_text(spark, f"{tmp_path}/a.txt", ["x", "é"])
    with pytest.raises(FileExistsError):
        store.write_text(spark, f"{tmp_path}/a.txt", ["y"])
    store.write_text(spark, f"{tmp_path}/a.txt", ["y"], overwrite=True)
    assert store.read_text(spark, f"{tmp_path}/a.txt") == "y" and store.exists(spark, f"{tmp_path}/a.txt")


def test_interior_yaml(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("cam one:\n  type: brown\n  im_size: [200, 150]\n  focal_len: 5\n  sensor_size: [6, 4.5]\n  cx: -0.01\n  k1: -0.25\n  p2: 0.01\n")
    (tmp_path / "b.yaml").write_text("name: flat\ntype: pinhole\nim_size: [10, 20]\nfocal_len: [1.5, 1.6]\n")
    (tmp_path / "c.yaml").write_text("camera:\n  name: old\n  type: OpenCV\n  im_size: [10, 20]\n  focal_len: 2\n  tx: 0.1\n  s4: 0.2\n")
    got = {r.camera: r for r in yamls.read_interior(spark, f"{tmp_path}/*.yaml").collect()}
    assert got["cam one"].sensor_size == [6.0, 4.5] and got["cam one"].k1 == -0.25 and got["cam one"].p2 == 0.01
    assert got["flat"].kind == "pinhole" and got["flat"].cx is None and got["flat"].focal_len == [1.5, 1.6]
    assert (got["old"].t1, got["old"].s4, got["old"].kind) == (0.1, 0.2, "opencv")


@pytest.mark.parametrize("text", ["x:\n  type: brown\n", "type: pinhole\nim_size: [1, 2]\nfocal_len: 1\ntypo: 2\n", "type: pinhole\nim_size: [1, 2]\nfocal_len: 1\nk1: 2\n", "type: rpc\nim_size: [1, 2]\nfocal_len: 1\n", "type: brown\nim_size: [1, 2]\nfocal_len: a\n", "[1, 2", "3", ""])
def test_wrong_interior_yaml(text):
    with pytest.raises(ParamError):
        yamls.interior_rows(text)


def test_wrong_rpc_yaml():
    rpc = {k: 1.0 for k in yamls.RPC_NUMBERS} | {k: [0.0] * 20 for k in yamls.RPC_LISTS}
    assert yamls.rpc_rows(yamls._dumped({"a.tif": {"im_size": [2, 3], "rpc": rpc}}))[0]["im_size"] == [2, 3]
    for bad in (rpc | {"samp_num_coeff": [0.0] * 19}, rpc | {"lat_off": "x"}, {k: v for k, v in rpc.items() if k != "line_off"}):
        with pytest.raises(ParamError):
            yamls.rpc_rows(yamls._dumped({"a.tif": {"im_size": [2, 3], "rpc": bad}}))


def test_dataset_images(spark, tmp_path):
    (tmp_path / "images").mkdir()
    for n in ("a.JPG", "b.tif", "c.txt"):
        (tmp_path / "images" / n).write_bytes(b"x")
    assert files.odm_images(spark, str(tmp_path)).count() == 2


def test_table_layouts():
    assert E.layout_of(XYZ_OPK)[:1] + E.layout_of(XYZ_OPK)[2:] == (",", True, ("filename", "x", "y", "z", "omega", "phi", "kappa"), "xyz", "opk")
    lla = E.layout_of(LLA_RPY)
    assert (lla.delimiter, lla.header, lla.place, lla.turn) == (" ", True, "lla", "rpy")
    quoted = E.layout_of("'filename' 'x' 'y' 'z' 'omega' 'phi' 'kappa' 'camera'\n'im 1' 1.5 2.5 3.5 1.0 2.0 3.0 'a b'\n'im 2' 1.5 2.5 3.5 1.0 2.0 3.0 'a b'\n")
    assert quoted.quote == "'" and quoted.fields[-1] == "camera"
    for fields in (("x", "y", "z", "omega", "phi", "kappa"), ("filename", "x", "y", "omega", "phi", "kappa"), ("filename", "x", "y", "z", "omega", "phi")):
        with pytest.raises(ParamError):
            E.format_of(fields)


def test_read_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text(XYZ_OPK + "folder/im_2.tif,1.0,2.0,3.0,0.0,0.0,90.0\n")
    plain = E.read_table(spark, f"{tmp_path}/a.csv")
    rows = {r.filename: r for r in plain.rows.collect()}
    assert plain.crs is None and rows["im_2.tif"].x == 1.0 and rows["im_2.tif"].kappa == pytest.approx(math.pi / 2) and rows["im_1.tif"].camera is None
    (tmp_path / "a.prj").write_text(PRJ)
    assert E.read_table(spark, f"{tmp_path}/a.csv").crs.lon0 == 25
    (tmp_path / "a.prj").write_text("EPSG:4326")
    with pytest.raises(ParamError):
        E.read_table(spark, f"{tmp_path}/a.csv")
    (tmp_path / "b.txt").write_text(LLA_RPY)
    found = E.read_table(spark, f"{tmp_path}/b.txt")
    row = found.rows.where("filename = 'im_1.tif'").first()
    assert found.crs.epsg() == 32651 and row.camera == "cam one" and row.z == 186.5 and 250_000 < row.x < 350_000
    (tmp_path / "c.csv").write_text(XYZ_OPK.replace("omega,phi,kappa", "roll,pitch,yaw"))
    with pytest.raises(CrsMissingError):
        E.read_table(spark, f"{tmp_path}/c.csv")
    (tmp_path / "d.csv").write_text(LLA_RPY.replace("roll pitch yaw", "omega phi kappa"))
    with pytest.raises(CrsMissingError):
        E.read_table(spark, f"{tmp_path}/d.csv")
    with pytest.raises(CrsError):
        E.read_table(spark, f"{tmp_path}/d.csv", crs="EPSG:4326")
    assert E.read_table(spark, f"{tmp_path}/d.csv", crs="EPSG:32651").rows.count() == 2


def test_meridian_and_systems():
    a, b = C.parse_crs("+proj=tmerc +lat_0=-30 +lon_0=25 +k=1"), C.parse_crs("+proj=tmerc +lon_0=25 +k=1")
    assert a.y0 - b.y0 == pytest.approx(3320113.398, abs=0.01)
    assert C.utm_of(-33.5, 25).epsg() == 32735 and C.utm_of(51.0, -0.1).epsg() == 32630
    for bad in ("EPSG:9999", "nonsense", "+proj=lcc"):
        with pytest.raises(CrsError):
            C.parse_crs(bad)
    with pytest.raises(CrsError):
        C.geographic("EPSG:3857")


def test_tags_to_catalogue(spark, tmp_path):
    """Images whose tags alone say where and how they were taken, through to files and back."""
    dji = "http://www.dji.com/drone-dji/1.0/"
    for k in range(3):
        xmp = f'<x:xmpmeta xmlns:x="adobe:ns:meta/" xmlns:d="{dji}"><x:D d:GimbalRollDegree="+0.00" d:GimbalPitchDegree="-90.0" d:GimbalYawDegree="{10 * k}"/></x:xmpmeta>'
        gps = {1: (2, [b"S\0"]), 2: (5, [[33, 1], [30, 1], [k, 1]]), 3: (2, [b"E\0"]), 4: (5, [[25, 1], [0, 1], [0, 1]]), 5: (1, [0]), 6: (5, [[1005, 10]])}
        exif = {37386: (5, [[88, 10]]), 40962: (4, [4000]), 40963: (4, [3000]), 41486: (5, [[3000, 1]]), 41487: (5, [[3000, 1]]), 41488: (3, [3])}
        (tmp_path / f"im{k}.jpg").write_bytes(tiff.jpeg_head(4000, 3000, {271: (2, [b"DJI\0"]), 272: (2, [b"FC\0"]), tiff.EXIF_AT: (4, exif), tiff.GPS_AT: (4, gps)}, xmp))
    cat = FrameCatalogue.from_images(spark, f"{tmp_path}/*.jpg")
    cam = cat.interior.first()
    assert (cam.camera, cam.kind, cam.focal_len[0]) == ("dji fc", "pinhole", pytest.approx(8.8)) and cam.sensor_size[0] == pytest.approx(40000 / 3000)
    rows = {r.filename: r for r in cat.exterior.collect()}
    assert cat.crs.epsg() == 32735 and rows["im0.jpg"].z == 100.5 and rows["im0.jpg"].omega == pytest.approx(0, abs=1e-9) and rows["im0.jpg"].phi == pytest.approx(0, abs=1e-9)
    assert rows["im0.jpg"].kappa - rows["im1.jpg"].kappa == pytest.approx(math.radians(10), abs=1e-6)
    cat.write(f"{tmp_path}/out")
    with pytest.raises(FileExistsError):
        cat.write(f"{tmp_path}/out")
    back = FrameCatalogue.read(spark, f"{tmp_path}/out/int_param.yaml", f"{tmp_path}/out/ext_param.geojson")
    again = {r.filename: r for r in back.exterior.collect()}
    assert again.keys() == rows.keys() and again["im2.jpg"].x == pytest.approx(rows["im2.jpg"].x) and back.crs.lon0 == 27
    found = back.cameras(spark.createDataFrame([("a/im1.jpg",), ("a/im1.jpg",), ("none.jpg",)], "path string"))
    got = found.orderBy("path").collect()
    assert len(got) == 3 and got[0].focal_len[0] == pytest.approx(8.8) and got[0].reason is None and "none.jpg" in got[2].reason
    with pytest.raises(ParamError, match="none.jpg"):
        J.check(found)
    with pytest.raises(ParamError):
        FrameCatalogue.read(spark, "a.txt", "b.csv")


def test_catalogue_of_models(spark, tmp_path):
    values = [0.0, 0.0, 50.0, 60.0, -33.0, 25.0, 500.0, 50.0, 60.0, 0.5, 0.5, 500.0, *([0.0, 0.0, -1.0] + [0.0] * 17), *([1.0] + [0.0] * 19), *([0.0, 1.0] + [0.0] * 18), *([1.0] + [0.0] * 19)]
    for n in ("a.tif", "b.tif"):
        (tmp_path / n).write_bytes(tiff.write(np.zeros((1, 3, 4), np.uint8), extra={tiff.RPC: (12, values)}))
    cat = RpcCatalogue.from_images(spark, f"{tmp_path}/*.tif")
    gcps = spark.createDataFrame([("a", k, 60.0 + 60 * x + 3, 50.0 - 50 * y - 2, 25 + 0.5 * x, -33 + 0.5 * y, 500.0) for k, (x, y) in enumerate([(0.1, 0.2), (-0.3, 0.4), (0.5, -0.6)])], "filename string, ord int, j double, i double, lon double, lat double, h double")
    with pytest.warns(TerralithWarning, match="1 models"):
        new = cat.refine(gcps)
    rpc = {r.filename: r.rpc for r in new.models.collect()}
    assert rpc["a.tif"].samp_num_coeff[0] == pytest.approx(3 / 60) and rpc["a.tif"].line_num_coeff[0] == pytest.approx(-2 / 50) and rpc["b.tif"].samp_num_coeff[0] == 0
    new.write(f"{tmp_path}/out")
    assert RpcCatalogue.read(spark, f"{tmp_path}/out/rpc_param.yaml").models.count() == 2
    assert params.read_gcps(files.texts(spark, f"{tmp_path}/out/gcps.geojson")).count() == 3
    with pytest.raises(ParamError):
        cat.refine(gcps.limit(1), "shift-drift")
