"""Large files are written by executors and read in blocks, with the same rows as a file that is read whole."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SF

from terralith.plans import tags
from terralith.plans import views as V
from terralith.sources import files, params, store, yamls


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture
def small_blocks(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1000"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def test_gcps_in_blocks(spark, tmp_path, small_blocks):
    path = f"file://{tmp_path}/gcps.geojson"
    params.write_gcp_file(V.gcps(spark, SF), path)
    doc = json.load(open(f"{tmp_path}/gcps.geojson"))
    assert [f["properties"]["filename"] for f in doc["features"]] == sorted(f["properties"]["filename"] for f in doc["features"])
    assert not list(tmp_path.glob("_parts*"))
    with pytest.raises(FileExistsError):
        params.write_gcp_file(V.gcps(spark, SF), path)
    got = params.read_gcp_file(spark, path, least=0)
    assert files.lines(spark, path).select("start").distinct().count() > 3 and "wholetext" not in got._jdf.queryExecution().toString().lower()
    assert rows(got) == rows(params.read_gcps(files.texts(spark, path)))


@pytest.mark.parametrize("text", ['{"type": "FeatureCollection", "features": [\n%s, %s,\n%s\n]}', '{"type": "FeatureCollection", "features": [%s,\n%s,\n%s\n]}', '{"type": "FeatureCollection",\n "features": [\n%s,\n%s,\n%s\n]}'])
def test_other_layouts_are_read_whole(spark, tmp_path, text):
    one = lambda k: json.dumps({"type": "Feature", "properties": {"filename": "a", "ji": [k, k], "id": str(k)}, "geometry": {"type": "Point", "coordinates": [k, k, k]}})
    (tmp_path / "a b.geojson").write_text(text % (one(1), one(2), one(3)))
    got = params.read_gcp_file(spark, f"file://{tmp_path}/*.geojson", least=0)
    assert [(r["ord"], r["id"]) for r in got.orderBy("ord").collect()] == [(0, "1"), (1, "2"), (2, "3")]


def test_no_rows(spark, tmp_path):
    params.write_gcp_file(V.gcps(spark, SF).where("false"), f"file://{tmp_path}/none.geojson")
    assert json.load(open(f"{tmp_path}/none.geojson"))["features"] == []
    store.write_rows(spark.range(3).select(F.col("id").cast("string").alias("value")), f"file://{tmp_path}/three.txt")
    assert (tmp_path / "three.txt").read_text() == "0\n1\n2\n"


def test_models_in_blocks(spark, tmp_path, small_blocks):
    path = f"file://{tmp_path}/rpc.yaml"
    yamls.write_rpc(tags.rpc_models(spark, SF), path)
    got = yamls.read_rpc(spark, path, least=0)
    assert files.lines(spark, path).select("start").distinct().count() > 3
    want = yamls.read_rpc(spark, path)
    assert got.count() == tags.rpc_models(spark, SF).count() and rows(got) == rows(want)


@pytest.mark.parametrize("change", [lambda t: t.replace("img_1.tif", '"img_1.tif"'), lambda t: "# models\n" + t, lambda t: t + t, lambda t: t.replace(", 0.0", ",\n            0.0")])
def test_models_in_other_layouts(spark, tmp_path, change):
    yamls.write_rpc(tags.rpc_models(spark, SF).where("filename like 'img_1%'").limit(5), f"file://{tmp_path}/a.yaml")
    (tmp_path / "b.yaml").write_text(change((tmp_path / "a.yaml").read_text()))
    assert rows(yamls.read_rpc(spark, f"file://{tmp_path}/b.yaml", least=0)) == rows(yamls.read_rpc(spark, f"file://{tmp_path}/b.yaml"))


def test_text_of_a_model():
    rpc = {k: -1e-05 for k in yamls.RPC_NUMBERS} | {k: [1e22, 0.1] * 10 for k in yamls.RPC_LISTS}
    for name in ("img_1.tif", "no", "1", "a: b", "é", "x y"):
        text = yamls.rpc_text(name, [900, 660], rpc)
        assert yamls.loaded(text) == {name: {"im_size": [900, 660], "rpc": rpc}}
        assert yamls._models_of(text) == yamls.rpc_rows(text)
