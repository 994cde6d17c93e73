"""The command line from files to files, on small images."""

import json
import math

import numpy as np
import pytest

from terralith import cli
from terralith.errors import ParamError, TerralithError
from terralith.sources import tiff, yamls

YAML = "cam:\n  type: brown\n  im_size: [60, 40]\n  focal_len: 0.8\n  k1: -0.05\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two images whose values are ground coordinates, above a plane at 10 m, taken from 110 m."""
    d = tmp_path_factory.mktemp("cli")
    fx = 0.8 * 60
    rows = ["filename,x,y,z,omega,phi,kappa,camera"]
    for n, x in enumerate((500100.0, 500120.0)):
        u, v = np.meshgrid((np.arange(60) - 29.5) / fx, (np.arange(40) - 19.5) / fx)
        a, b = u.copy(), v.copy()
        for _ in range(50):
            a, b = (w / (1 - 0.05 * (a * a + b * b)) for w in (u, v))
        ground = np.stack([x + 100 * a - 500000, 6300050 - 100 * b - 6300000]).astype("f4")
        (d / f"im{n}.tif").write_bytes(tiff.write(ground))
        rows.append(f"im{n},{x},6300050.0,110.0,0.0,0.0,0.0,cam")
    (d / "shots.csv").write_text("\n".join(rows) + "\n")
    (d / "shots.prj").write_text("EPSG:32735")
    (d / "cam.yaml").write_text(YAML)
    dem = np.full((1, 60, 60), 10.0, "f4")
    (d / "dem.tif").write_bytes(tiff.write(dem, [5.0, 0, 499960.0, 0, -5.0, 6300200.0], 32735, -1.0))
    return d


def test_frame(spark, folder):
    files = cli.run(spark, ["frame", "--int-param", f"{folder}/cam.yaml", "--ext-param", f"{folder}/shots.csv", "--dem", f"{folder}/dem.tif", "--resolution", "2", "--interp", "bilinear", "--dtype", "float64", "--out-dir", f"{folder}/out", f"{folder}/im*.tif"]).collect()
    assert {r.image for r in files} == {"im0.tif", "im1.tif"}
    for r in files:
        data = open(r.path.removeprefix("file:"), "rb").read()
        a, h = tiff.read_pixels(data), tiff.head_of(data)
        assert h.epsg == 32735 and h.bands == 2
        i, j = np.nonzero(~np.isnan(a[0]))
        assert len(i) > 500
        # each cell holds the place that it lies at, which the image's pixels say
        assert np.allclose(a[0, i, j], h.transform[2] + 2 * (j + 0.5) - 500000, atol=0.05)
        assert np.allclose(a[1, i, j], h.transform[5] - 2 * (i + 0.5) - 6300000, atol=0.05)
    with pytest.raises(FileExistsError):
        cli.run(spark, ["frame", "--int-param", f"{folder}/cam.yaml", "--ext-param", f"{folder}/shots.csv", "--dem", f"{folder}/dem.tif", "--out-dir", f"{folder}/out", f"{folder}/im*.tif"])


def test_frame_errors(spark, folder):
    base = ["frame", "--int-param", f"{folder}/cam.yaml", "--ext-param", f"{folder}/shots.csv", "--out-dir", f"{folder}/no"]
    with pytest.raises(ParamError, match="--dem"):
        cli.run(spark, [*base, f"{folder}/im0.tif"])
    with pytest.raises(TerralithError, match="bands"):
        cli.run(spark, [*base, "--dem", f"{folder}/dem.tif", "--dem-band", "3", f"{folder}/im0.tif"])
    with pytest.raises(FileNotFoundError):
        cli.run(spark, [*base, "--dem", f"{folder}/dem.tif", f"{folder}/none*.tif"])
    assert cli.main([*base, f"{folder}/im0.tif"]) == 1


def test_export(spark, folder):
    cli.run(spark, ["frame", "--int-param", f"{folder}/cam.yaml", "--ext-param", f"{folder}/shots.csv", "--export-params", "--out-dir", f"{folder}/exported", f"{folder}/im0.tif"])
    doc = json.loads((folder / "exported" / "ext_param.geojson").read_text())
    assert len(doc["features"]) == 2 and doc["features"][0]["properties"]["xyz"][2] == 110
    assert yamls.read_interior(spark, f"{folder}/exported/int_param.yaml").first().k1 == -0.05


def test_rpc(spark, folder):
    """An image whose model maps longitude and latitude to pixels evenly."""
    values = [0.0, 0.0, 29.5, 39.5, -33.0, 27.0, 0.0, 30.0, 40.0, 0.003, 0.004, 500.0, *([0.0, 0.0, -1.0] + [0.0] * 17), *([1.0] + [0.0] * 19), *([0.0, 1.0] + [0.0] * 18), *([1.0] + [0.0] * 19)]
    a = np.stack([np.broadcast_to(np.arange(80.0), (60, 80))]).astype("f4")
    (folder / "sat.tif").write_bytes(tiff.write(a, extra={tiff.RPC: (12, values)}))
    from terralith.functions.crs import meridian

    y = 1e7 - 0.9996 * meridian(33.0)
    dem = np.full((1, 60, 60), 10.0, "f4")
    (folder / "dem2.tif").write_bytes(tiff.write(dem, [50.0, 0, 500000.0 - 1500, 0, -50.0, y + 1500], 32735))
    files = cli.run(spark, ["rpc", "--dem", f"{folder}/dem2.tif", "--crs", "EPSG:32735", "--resolution", "20", "--interp", "bilinear", "--out-dir", f"{folder}/rpc", f"{folder}/sat.tif"]).collect()
    data = open(files[0].path.removeprefix("file:"), "rb").read()
    out, h = tiff.read_pixels(data)[0], tiff.head_of(data)
    i, j = np.nonzero(~np.isnan(out))
    lon = (h.transform[2] + 20 * (j + 0.5) - 500000) / (math.radians(1) * 6378137 * 0.9996 * math.cos(math.radians(33)) / math.sqrt(1 - 0.00669438 * math.sin(math.radians(33)) ** 2))
    assert len(i) > 500 and np.allclose(out[i, j], 39.5 + 40 * lon / 0.004, atol=0.1)


def test_sharpen(spark, folder):
    rng = np.random.default_rng(0)
    ms = rng.random((3, 20, 24)) * 50 + 10
    pan = np.kron((np.array([0.5, 0.3, 0.2])[:, None, None] * ms).sum(0), np.ones((2, 2))) + rng.random((40, 48))
    (folder / "ms.tif").write_bytes(tiff.write(ms, [4.0, 0, 0, 0, -4.0, 80.0], 32735))
    (folder / "pan.tif").write_bytes(tiff.write(pan[None], [2.0, 0, 0, 0, -2.0, 80.0], 32735))
    files = cli.run(spark, ["sharpen", "--pan", f"{folder}/pan.tif", "--multispectral", f"{folder}/ms.tif", "--interp", "bilinear", "--dtype", "float64", "--out-dir", f"{folder}/sharp"]).collect()
    a = tiff.read_pixels(open(files[0].path.removeprefix("file:"), "rb").read())
    ok = ~np.isnan(a[0])
    assert a.shape == (3, 40, 48) and ok.sum() == 38 * 46
    assert np.corrcoef(a[0][ok], np.kron(ms[0], np.ones((2, 2)))[ok])[0, 1] > 0.6
    with pytest.raises(ParamError):
        cli.run(spark, ["sharpen", "--pan", f"{folder}/pan.tif", "--multispectral", f"{folder}/ms.tif", "--weight", "1", "--out-dir", f"{folder}/sharp2"])


def test_odm(spark, tmp_path):
    """A dataset folder: images, elevation, and a reconstruction with one shot that looks down from 100 m above its reference."""
    from terralith.functions.crs import meridian

    (tmp_path / "images").mkdir()
    (tmp_path / "opensfm").mkdir()
    (tmp_path / "odm_dem").mkdir()
    camera = {"projection_type": "brown", "width": 60, "height": 40, "focal_x": 0.8, "focal_y": 0.8, "c_x": 0.0, "c_y": 0.0, "k1": 0.0}
    shot = {"rotation": [math.pi, 0.0, 0.0], "translation": [0.0, 0.0, 100.0], "camera": "v2 cam"}
    doc = [{"cameras": {"v2 cam": camera}, "shots": {"a.tif": shot}, "reference_lla": {"latitude": -33.0, "longitude": 27.0, "altitude": 10.0}}]
    (tmp_path / "opensfm" / "reconstruction.json").write_text(json.dumps(doc))
    y = 1e7 - 0.9996 * meridian(33.0)
    east = 100 * (np.arange(60) - 29.5) / 48
    (tmp_path / "images" / "a.tif").write_bytes(tiff.write(np.broadcast_to(east, (1, 40, 60)).astype("f4")))
    (tmp_path / "odm_dem" / "dsm.tif").write_bytes(tiff.write(np.full((1, 60, 60), 10.0, "f4"), [5.0, 0, 500000.0 - 150, 0, -5.0, y + 150], 32735))
    files = cli.run(spark, ["odm", "--dataset-dir", str(tmp_path), "--resolution", "4", "--interp", "bilinear", "--out-dir", f"{tmp_path}/out"]).collect()
    data = open(files[0].path.removeprefix("file:"), "rb").read()
    a, h = tiff.read_pixels(data)[0], tiff.head_of(data)
    i, j = np.nonzero(~np.isnan(a))
    assert len(i) > 300 and np.allclose(a[i, j], h.transform[2] + 4 * (j + 0.5) - 500000, atol=0.05)
    for bad in ({"projection_type": "dual"}, {"k9": 1.0}):
        (tmp_path / "opensfm" / "reconstruction.json").write_text(json.dumps([doc[0] | {"cameras": {"v2 cam": camera | bad}}]))
        with pytest.raises(ParamError):
            cli.run(spark, ["odm", "--dataset-dir", str(tmp_path), "--out-dir", f"{tmp_path}/no"])


def test_values_of_options():
    assert cli.options(["TILED = yes", "NoData=None", "level=6"]) == {"tiled": True, "nodata": None, "level": 6}
    assert cli.resolution(None) is None and cli.resolution([2.0]) == (2.0, 2.0) and cli.resolution([2.0, 3.0]) == (2.0, 3.0)
    for bad in ([1.0, 2.0, 3.0], [0.0]):
        with pytest.raises(ParamError):
            cli.resolution(bad)
    with pytest.raises(ParamError):
        cli.options(["x"])
