"""Queries that write files to the shared folder and read them: texts, tables, YAML, images and their heads."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions import crs as C
from terralith.functions.num import shown
from terralith.plans import tags as G
from terralith.plans import views as V
from terralith.plans.catalog import query
from terralith.sources import exterior as E
from terralith.sources import files, params, store, tiff, yamls


@query("scan_text", "select n_nationkey::integer as n_nationkey, n_name from nation")
def scan_text(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written as text files, and read again as whole texts."""
    folder = store.scratch(spark)
    V.table(spark, sf, "nation").select(F.to_json(F.struct("*")).alias("value")).write.text(folder)
    lines = files.texts(spark, folder).select(F.explode(F.split("value", "\n")).alias("value")).where("value <> ''")
    return lines.select(F.from_json("value", "n_nationkey int, n_name string").alias("r")).select("r.*")


def _write_rasters(spark: SparkSession, sf: str) -> str:
    """Two georeferenced images a label of the raster table's rows, one in tiles and one in strips."""
    folder = store.scratch(spark)
    rows = V.table(spark, sf, "embeddings").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows")).toLocalIterator()
    for r in rows:
        a = np.array([x["embedding"] for x in r["rows"]], np.float32)
        b = np.stack([a, a * 2])
        store.write_bytes(spark, f"{folder}/a{r['label']}.tif", tiff.write(b, [4.0, 0.0, 19880.0, 0.0, -4.0, 30120.0], 32735, -9999.0, 32))
        store.write_bytes(spark, f"{folder}/b{r['label']}.tif", tiff.write(np.rint(b * 100 + 300).clip(0, 60000).astype(np.uint16)))
    return folder


@query("scan_raster", "with x as (select label, embedding[p]::double as v from embeddings, unnest(range(1, 65)) as t(p)) select 'a' || label || '.tif' as filename, band::integer as band, count(*)::bigint as n, round(sum(v * band), 3) + 0.0 as total from x, (values (1), (2)) as b(band) group by label, band")
def scan_raster(spark: SparkSession, sf: str) -> DataFrame:
    """Images read in bands and lines, by a wildcard."""
    folder = _write_rasters(spark, sf)
    p = files.pixels_of(files.read_rasters(spark, f"{folder}/a*.tif"))
    return p.groupBy(F.substring_index("path", "/", -1).alias("filename"), "band").agg(F.count("*").alias("n"), shown(F.sum("v"), 3).alias("total"))


@query("scan_heads", "with x as (select label, count(*) as n from embeddings group by label) select 'a' || label || '.tif' as filename, 64::integer as width, n::integer as height, 'f4' as dtype, 32735::integer as epsg, 19880.0::double as x0 from x union all select 'b' || label || '.tif', 64, n, 'u2', 0, 0 from x")
def scan_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes, types and georeferencing of images, without their pixels."""
    h = files.read_heads(spark, f"{_write_rasters(spark, sf)}/*.tif")
    return h.select("filename", "width", "height", "dtype", F.coalesce(F.col("epsg").cast("int"), F.lit(0)).alias("epsg"), F.coalesce(F.col("transform")[2], F.lit(0.0)).alias("x0"))


@query("scan_glob", "select distinct 'a' || label || '.tif' as filename from embeddings")
def scan_glob(spark: SparkSession, sf: str) -> DataFrame:
    return files.paths(spark, f"{_write_rasters(spark, sf)}/a*.tif").select(F.substring_index("path", "/", -1).alias("filename"))


@query("odm_scan", "select 'im' || n_nationkey || case n_nationkey % 3 when 0 then '.JPG' else '.tif' end as filename from nation where n_nationkey % 3 <> 2")
def odm_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The images of a dataset's folder: other files aren't taken."""
    folder = store.scratch(spark)
    for r in V.table(spark, sf, "nation").select("n_nationkey").collect():  # 25 rows at all scales
        k = r["n_nationkey"]
        store.write_bytes(spark, f"{folder}/images/im{k}{('.JPG', '.tif', '.txt')[k % 3]}", b"x")
    return files.odm_images(spark, folder).select(F.substring_index("path", "/", -1).alias("filename"))


def _cameras(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    lens = {c: F.lit(None).cast("double") for c in yamls.LENS} | {"k1": (k % 9 - 4) * 0.01, "p1": F.when(k % 2 == 0, 0.001 * k)}
    rows = V.table(spark, sf, "nation").select(F.concat(F.lit("cam "), k.cast("string")).alias("camera"), F.when(k % 2 == 0, "brown").otherwise("fisheye").alias("kind"), F.array(F.lit(200), F.lit(150)).alias("im_size"), F.when(k % 3 == 0, F.array(F.lit(5.0), F.lit(5.5))).otherwise(F.array(0.5 + k)).alias("focal_len"), F.when(k % 4 != 0, F.array(F.lit(6.0), F.lit(4.5))).alias("sensor_size"), F.when(k % 5 == 0, -0.01).alias("cx"), F.lit(0.02).alias("cy"), *(v.alias(c) for c, v in lens.items()))
    return rows


CAMERAS = "select 'cam ' || n_nationkey as camera, case when n_nationkey % 2 = 0 then 'brown' else 'fisheye' end as kind, round(case when n_nationkey % 3 = 0 then 5 else 0.5::double + n_nationkey end, 6) as fx, case when n_nationkey % 3 = 0 then 2 else 1 end::integer as focals, n_nationkey % 4 <> 0 as sensor, round((n_nationkey % 9 - 4) * 0.01::double, 6) + 0.0 as k1, round(case when n_nationkey % 2 = 0 then 0.001::double * n_nationkey else 0 end, 6) as p1 from nation"


@query("int_param_yaml", CAMERAS)
def int_param_yaml(spark: SparkSession, sf: str) -> DataFrame:
    """Cameras with distortion written as YAML and read again."""
    path = f"{store.scratch(spark)}/int_param.yaml"
    yamls.write_interior(_cameras(spark, sf), path)
    got = yamls.read_interior(spark, path)
    return got.select("camera", "kind", F.round(F.col("focal_len")[0], 6).alias("fx"), F.size("focal_len").alias("focals"), F.col("sensor_size").isNotNull().alias("sensor"), shown(F.col("k1")).alias("k1"), F.round(F.coalesce("p1", F.lit(0.0)), 6).alias("p1"))


@query("rpc_yaml", "select 'img_' || c_custkey || '.tif' as filename, 900::integer as width, round((c_custkey % 7) * 0.01::double, 9) as j0, 0.002::double as den, 24.5::double as long_off from customer")
def rpc_yaml(spark: SparkSession, sf: str) -> DataFrame:
    """Rational polynomial models written as YAML and read again."""
    path = f"{store.scratch(spark)}/rpc_param.yaml"
    yamls.write_rpc(G.rpc_models(spark, sf), path)
    return yamls.read_rpc(spark, path).select("filename", F.col("im_size")[0].alias("width"), F.round(F.col("rpc.samp_num_coeff")[0], 9).alias("j0"), F.col("rpc.samp_den_coeff")[2].alias("den"), "rpc.long_off")


@query("write_gcps", V.sql("select filename, count(*)::bigint as n, round(sum(j), 4) as j, round(sum(lon), 6) as lon from v_gcp group by filename", "v_gcp"))
def write_gcps(spark: SparkSession, sf: str) -> DataFrame:
    """All control points in one GeoJSON file, read again."""
    path = f"{store.scratch(spark)}/gcps.geojson"
    params.write_gcp_file(V.gcps(spark, sf), path)
    return params.read_gcp_file(spark, path).groupBy("filename").agg(F.count("*").alias("n"), F.round(F.sum("j"), 4).alias("j"), F.round(F.sum("lon"), 6).alias("lon"))


def _write_tagged(spark: SparkSession, sf: str) -> str:
    """An image a nation with a model and control points in its tags."""
    folder = store.scratch(spark)
    for r in V.table(spark, sf, "nation").collect():  # 25 rows at all scales
        k = float(r["n_nationkey"])
        model = [-1.0, -1.0, 300.0 + k, 400.0, -33.0, 25.0, 500.0, 300.0, 400.0, 0.5, 0.5, 500.0, *np.arange(80) * 0.01 + k]
        points = [v for m in range(4) for v in (10.0 * m, 20.0 * m + k, 0.0, 25.0 + 0.01 * m, -33.0 - 0.001 * k, 100.0 + m)]
        keys = [1, 1, 0, 1, 2048, 0, 1, 4326]
        store.write_bytes(spark, f"{folder}/t{int(k)}.tif", tiff.write(np.zeros((1, 4, 5), np.uint8), extra={tiff.RPC: (12, model), tiff.TIEPOINTS: (12, points), tiff.KEYS: (3, keys)}))
    return folder


@query("rpc_tags", "select 't' || n_nationkey || '.tif' as filename, 5::integer as width, 300.0::double + n_nationkey as line_off, round(0.41::double + n_nationkey, 9) as second from nation")
def rpc_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Models from images' tags."""
    m = params.rpc_of_heads(files.read_heads(spark, f"{_write_tagged(spark, sf)}/*.tif"))
    return m.select("filename", F.col("im_size")[0].alias("width"), "rpc.line_off", F.round(F.col("rpc.samp_num_coeff")[1], 9).alias("second"))


@query("gcp_tags", "select 't' || n_nationkey || '.tif' as filename, m::integer as ord, 10.0::double * m as j, 20.0::double * m + n_nationkey as i, round(25 + 0.01::double * m, 9) as lon, round(-33 - 0.001::double * n_nationkey, 9) as lat, 100.0::double + m as h from nation, unnest(range(0, 4)) as t(m)")
def gcp_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Control points from images' tags."""
    g = params.gcps_of_heads(files.read_heads(spark, f"{_write_tagged(spark, sf)}/*.tif"))
    return g.select("filename", F.col("ord").cast("int").alias("ord"), "j", "i", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "h")


@query("crs_prj", V.sql("select filename, 25.0::double as lon0 from v_shot", "v_shot"))
def crs_prj(spark: SparkSession, sf: str) -> DataFrame:
    """A table in a file whose coordinate system a file beside it holds."""
    folder = store.scratch(spark)
    rows = V.shots(spark, sf).select(*(F.round(c, 4).alias(c) if c in ("omega", "phi", "kappa") else F.col(c) for c in ("filename", "x", "y", "z", "omega", "phi", "kappa")))
    rows.write.option("header", "true").csv(f"{folder}/shots.csv")
    store.write_text(spark, f"{folder}/shots.prj", ["+proj=tmerc +lat_0=0 +lon_0=25 +k=1 +x_0=0 +y_0=0 +datum=WGS84 +units=m +no_defs"])
    system = E.sidecar(spark, f"{folder}/shots.csv")
    one = spark.read.option("header", "true").csv(f"{folder}/shots.csv")
    return one.select("filename", F.lit(system.lon0).alias("lon0"))


@query("crs_parse", "select * from (values ('EPSG:32735', true, 27.0::double, 32735::integer), ('EPSG:32601', true, -177.0, 32601), ('EPSG:3857', true, 0.0, 3857), ('EPSG:4326', false, 0.0, 4326), ('+proj=tmerc +lon_0=25 +k=1', true, 25.0, 0), ('+proj=utm +zone=10 +south', true, -123.0, 32710)) as t(text, projected, lon0, epsg)")
def crs_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinate systems from texts, written and read once more."""
    texts = ("EPSG:32735", "EPSG:32601", "EPSG:3857", "EPSG:4326", "+proj=tmerc +lon_0=25 +k=1", "+proj=utm +zone=10 +south")
    rows = [(t, c.projected, c.lon0, c.epsg() or 0) for t in texts for c in [C.parse_crs(C.parse_crs(t).text())]]
    return spark.createDataFrame(rows, "text string, projected boolean, lon0 double, epsg int")


@query("xmp_flat", "select event_id::bigint as id, 'b' || event_id as attr, 'last' || event_id % 7 as text from events")
def xmp_flat(spark: SparkSession, sf: str) -> DataFrame:
    """XML as a flat map of texts and attributes by their qualified names: the last of equal names counts."""
    e = F.col("event_id").cast("string")
    text = F.concat(F.lit('<x:r xmlns:x="u:1" x:a="b'), e, F.lit('"><x:t>first</x:t><x:t>last'), (F.col("event_id") % 7).cast("string"), F.lit("</x:t></x:r>"))

    @F.pandas_udf("map<string,string>")
    def flat(s):
        return s.map(tiff.xmp_of)

    rows = V.table(spark, sf, "events").select(F.col("event_id").cast("long").alias("id"), flat(text).alias("m"))
    return rows.select("id", F.col("m")["{u:1}a"].alias("attr"), F.col("m")["{u:1}t"].alias("text"))
