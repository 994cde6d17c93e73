"""Queries on pan-sharpening: statistics, weights, coefficients and the transform."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions.checks import too_coarse
from terralith.functions.num import shown
from terralith.operators import pansharp as P
from terralith.plans import views as V
from terralith.plans.catalog import query

BANDS = ["b1", "b2", "b3"]
NAMES = ["pan", *BANDS]
MEANS = "select " + ", ".join(f"round(avg({c}), 6) + 0.0 as mean_{c}" for c in NAMES) + " from v_panms"
COV = "select " + ", ".join(f"covar_samp({a}, {b}) as {a}_{b}" for a in NAMES for b in NAMES) + ", " + ", ".join(f"avg({c}) as m_{c}" for c in NAMES) + " from v_panms"
C3 = {"p": "b1", "q": "b2", "r": "b3"}


def _det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a}*({e}*{i}-{f}*{h})-{b}*({d}*{i}-{f}*{g})+{c}*({d}*{h}-{e}*{g}))"


M = [[f"{a}_{b}" for b in BANDS] for a in BANDS]
Y = [f"pan_{b}" for b in BANDS]
SOLVED = "select *, " + ", ".join(f"{_det([[Y[i] if j == k else M[i][j] for j in range(3)] for i in range(3)])}/{_det(M)} as x{k + 1}" for k in range(3)) + " from cov"
WEIGHTS = "select *, " + ", ".join(f"greatest(x{k}, 0)/(greatest(x1,0)+greatest(x2,0)+greatest(x3,0)) as w{k}" for k in (1, 2, 3)) + " from solved"
#: Variance of the simulated pan band and the first coefficient of each band.
PHI = "select *, " + "+".join(f"w{i + 1}*w{j + 1}*{M[i][j]}" for i in range(3) for j in range(3)) + " as vs from wts"
PHI2 = "select *, " + ", ".join(f"(w1*{M[0][k]}+w2*{M[1][k]}+w3*{M[2][k]})/vs as f{k + 1}" for k in range(3)) + ", sqrt(vs/pan_pan) as gain, w1*m_b1+w2*m_b2+w3*m_b3-sqrt(vs/pan_pan)*m_pan as bias from phi"
PARTS = {"cov": COV, "solved": SOLVED, "wts": WEIGHTS, "phi": PHI, "fin": PHI2}


def parts(last: str) -> dict[str, str]:
    out = {}
    for k, v in PARTS.items():
        out[k] = v
        if k == last:
            break
    return out


@query("gs_means", V.sql(MEANS, "v_panms"))
def gs_means(spark: SparkSession, sf: str) -> DataFrame:
    return P.statistics(V.panms(spark, sf), "pan", BANDS).select(*(shown(F.col(f"mean_{c}")).alias(f"mean_{c}") for c in NAMES))


@query("gs_cov", V.sql("select " + ", ".join(f"round({a}_{b}, 5) + 0.0 as cov_{a}_{b}" for a in NAMES for b in NAMES) + " from cov", "v_panms", cov=COV))
def gs_cov(spark: SparkSession, sf: str) -> DataFrame:
    return P.statistics(V.panms(spark, sf), "pan", BANDS).select(*(shown(F.col(f"cov_{a}_{b}"), 5).alias(f"cov_{a}_{b}") for a in NAMES for b in NAMES))


TILE = "select l_suppkey % 8 as tile, {} from lineitem".format("0.5::double * l_quantity + 0.3::double * (l_discount * 1000) + 0.2::double * (l_tax * 1000) + l_extendedprice / 50000 as pan, l_quantity as b1")


@query("gs_tile_stats", V.sql("select tile::bigint as tile, count(*)::bigint as n, round(avg(pan), 6) + 0.0 as mean_pan, round(avg(b1), 6) + 0.0 as mean_b1, round(covar_pop(pan, b1) * count(*), 3) + 0.0 as prod_pan_b1 from t group by tile", t=TILE))
def gs_tile_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Mergeable statistics by tile."""
    q, d, t, e = (F.col(f"l_{c}") for c in ("quantity", "discount", "tax", "extendedprice"))
    tiles = V.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 8).alias("tile"), (0.5 * q + 0.3 * (d * 1000) + 0.2 * (t * 1000) + e / 50000).alias("pan"), q.alias("b1"))
    return P.tile_statistics(tiles, "tile", ["pan", "b1"]).select(F.col("tile").cast("long").alias("tile"), "n", shown(F.col("mean_pan")).alias("mean_pan"), shown(F.col("mean_b1")).alias("mean_b1"), shown(F.col("prod_pan_b1"), 3).alias("prod_pan_b1"))


@query("gs_merge", V.sql("select count(*)::bigint as n, round(avg(pan), 6) + 0.0 as mean_pan, round(covar_samp(pan, b1), 5) + 0.0 as cov_pan_b1 from t", t=TILE))
def gs_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The tiles' statistics merged by their co-moments."""
    q, d, t, e = (F.col(f"l_{c}") for c in ("quantity", "discount", "tax", "extendedprice"))
    tiles = V.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 8).alias("tile"), (0.5 * q + 0.3 * (d * 1000) + 0.2 * (t * 1000) + e / 50000).alias("pan"), q.alias("b1"))
    out = P.merged_statistics(P.tile_statistics(tiles, "tile", ["pan", "b1"]), ["pan", "b1"])
    return out.select("n", shown(F.col("mean_pan")).alias("mean_pan"), shown(F.col("cov_pan_b1"), 5).alias("cov_pan_b1"))


@query("gs_weights", V.sql("select " + ", ".join(f"round(w{k}, 8) + 0.0 as w{k}" for k in (1, 2, 3)) + " from wts", "v_panms", **parts("wts")))
def gs_weights(spark: SparkSession, sf: str) -> DataFrame:
    p = P.parameters(V.panms(spark, sf), "pan", BANDS)
    return spark.createDataFrame([tuple(p.weights)], "w1 double, w2 double, w3 double").select(*(shown(F.col(f"w{k}"), 8).alias(f"w{k}") for k in (1, 2, 3)))


def _pair(k: int) -> list[str]:
    """Weights of least squares without one band, whose own is 0."""
    p, q = (n for n in range(3) if n != k)
    det = f"({M[p][p]}*{M[q][q]}-{M[p][q]}*{M[p][q]})"
    out = ["0.0::double"] * 3
    out[p], out[q] = f"({Y[p]}*{M[q][q]}-{Y[q]}*{M[p][q]})/{det}", f"({Y[q]}*{M[p][p]}-{Y[p]}*{M[p][q]})/{det}"
    return out


#: Where one weight is negative the others are fitted again; should one of them be negative then, the first fit stands.
REFIT = "select *, " + ", ".join("case " + " ".join(f"when x{k + 1} < 0 and least({', '.join(_pair(k))}) >= 0 then {_pair(k)[n]}" for k in range(3)) + f" else x{n + 1} end as z{n + 1}" for n in range(3)) + " from solved"


@query("gs_weights_raw", V.sql("select " + ", ".join(f"round(greatest(z{k}, 0)/(greatest(z1,0)+greatest(z2,0)+greatest(z3,0)), 6) + 0.0 as w{k}" for k in (1, 2, 3)) + " from refit", "v_panms_raw", cov=COV.replace("v_panms", "v_panms_raw"), solved=SOLVED, refit=REFIT))
def gs_weights_raw(spark: SparkSession, sf: str) -> DataFrame:
    """A pan band whose weights include a negative one, which is fitted again without."""
    p = P.parameters(V.panms_raw(spark, sf), "pan", BANDS)
    return spark.createDataFrame([tuple(p.weights)], "w1 double, w2 double, w3 double").select(*(shown(F.col(f"w{k}"), 6).alias(f"w{k}") for k in (1, 2, 3)))


@query("gs_coeffs", V.sql("select " + ", ".join(f"round(f{k}, 7) + 0.0 as phi_{k - 1}_0" for k in (1, 2, 3)) + " from fin", "v_panms", **PARTS))
def gs_coeffs(spark: SparkSession, sf: str) -> DataFrame:
    """What each band shares with the simulated pan band."""
    p = P.parameters(V.panms(spark, sf), "pan", BANDS)
    return spark.createDataFrame([tuple(float(p.phi[k][0]) for k in range(3))], "phi_0_0 double, phi_1_0 double, phi_2_0 double").select(*(shown(F.col(f"phi_{k}_0"), 7).alias(f"phi_{k}_0") for k in range(3)))


@query("gs_pan_norm", V.sql("select round(gain, 7) + 0.0 as gain, round(bias, 5) + 0.0 as bias from fin", "v_panms", **PARTS))
def gs_pan_norm(spark: SparkSession, sf: str) -> DataFrame:
    p = P.parameters(V.panms(spark, sf), "pan", BANDS)
    return spark.createDataFrame([(p.gain, p.bias)], "gain double, bias double").select(shown(F.col("gain"), 7).alias("gain"), shown(F.col("bias"), 5).alias("bias"))


#: Pixels with a key, for the transforms.
KEYED = "select event_id as id, value as pan, value * 0.5::double + (event_id % 7) as b1, value * 0.3::double + (event_id % 11) as b2, value * 0.2::double + (event_id % 5) as b3 from events"
FIXED = {"weights": [0.5, 0.3, 0.2], "means": [20.0, 15.0, 10.0], "phi": [[0.9], [0.7, 0.1], [0.4, 0.2, 0.05]], "gain": 1.1, "bias": 2.0}
FORWARD = "select id, 0.5::double*b1+0.3::double*b2+0.2::double*b3 as g0, pan, b1, b2, b3 from k"
G1 = "select *, b1-20-0.9::double*g0 as g1 from f0"
G2 = "select *, b2-15-0.7::double*g0-0.1::double*g1 as g2 from f1"
G3 = "select *, b3-10-0.4::double*g0-0.2::double*g1-0.05::double*g2 as g3 from f2"
STEPS = {"k": KEYED, "f0": FORWARD, "f1": G1, "f2": G2, "f3": G3}


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    return V.table(spark, sf, "events").select(e.cast("long").alias("id"), v.alias("pan"), (v * 0.5 + e % 7).alias("b1"), (v * 0.3 + e % 11).alias("b2"), (v * 0.2 + e % 5).alias("b3"))


def fixed() -> P.Parameters:
    return P.Parameters(**FIXED)


@query("gs_forward", V.sql("select id::bigint as id, " + ", ".join(f"round(g{k}, 9) + 0.0 as g{k}" for k in range(4)) + " from f3", **STEPS))
def gs_forward(spark: SparkSession, sf: str) -> DataFrame:
    return P.forward(keyed(spark, sf), BANDS, fixed()).select("id", *(shown(F.col(f"g{k}"), 9).alias(f"g{k}") for k in range(4)))


@query("gs_reverse", V.sql("select id::bigint as id, round(g1+20+0.9::double*p, 6) + 0.0 as b1, round(g2+15+0.7::double*p+0.1::double*g1, 6) + 0.0 as b2, round(g3+10+0.4::double*p+0.2::double*g1+0.05::double*g2, 6) + 0.0 as b3 from (select *, 1.1::double*pan+2 as p from f3)", **STEPS))
def gs_reverse(spark: SparkSession, sf: str) -> DataFrame:
    out = P.reverse(P.forward(keyed(spark, sf), BANDS, fixed()), "pan", BANDS, fixed())
    return out.select("id", *(shown(F.col(b)).alias(b) for b in BANDS))


@query("pan_sharpen", V.sql("select l_orderkey::bigint as id, l_linenumber::integer as line, " + ", ".join(f"round({b} + f{k}*(gain*pan+bias-(w1*b1+w2*b2+w3*b3)), 4) + 0.0 as s{k}" for k, b in enumerate(BANDS, 1)) + " from keyed_panms, fin", "v_panms", **PARTS, keyed_panms="select l_orderkey, l_linenumber, " + V.SQL["v_panms"].removeprefix("select ")))
def pan_sharpen(spark: SparkSession, sf: str) -> DataFrame:
    """Every pixel sharpened, by weights, coefficients and gain that the pixels give."""
    rows = V.panms(spark, sf, "l_orderkey", "l_linenumber")
    out = P.sharpen(rows, "pan", BANDS)
    return out.select(F.col("l_orderkey").cast("long").alias("id"), F.col("l_linenumber").cast("int").alias("line"), *(shown(F.col(b), 4).alias(f"s{k}") for k, b in enumerate(BANDS, 1)))


#: Three bands on the raster's pixels, and a pan image of twice as many rows and columns over them.
MS3 = "select a.i, a.j, 100 * a.v as b1, 100 * b.v as b2, 100 * c.v as b3 from v_raster a join v_raster b on b.i = a.i and b.j = 63 - a.j join v_raster c on c.i = a.i and c.j = (a.j * 5) % 64"
PAN2 = "select 2 * i + di as i, 2 * j + dj as j, 0.5::double * b1 + 0.3::double * b2 + 0.2::double * b3 + (((2 * i + di) * 7 + (2 * j + dj) * 3) % 11 - 5) * 0.5::double as pan from ms3, (select unnest(range(0, 2)) as di), (select unnest(range(0, 2)) as dj)"
MEET = "select m.i, m.j, b1, b2, b3, pan from ms3 m join (select i // 2 as i, j // 2 as j, avg(pan) as pan from pan2 group by 1, 2) p on p.i = m.i and p.j = m.j"
FINE = "select p.i, p.j, pan, " + ", ".join(f"sum({b} * w) as {b}" for b in BANDS) + " from (select t.i, t.j, pan, b1, b2, b3, greatest(0, 1 - abs(t.y - m.i)) * greatest(0, 1 - abs(t.x - m.j)) as w from (select *, floor(y)::bigint + di as mi, floor(x)::bigint + dj as mj from (select i, j, pan, (i + 0.5::double) / 2 - 0.5 as y, (j + 0.5::double) / 2 - 0.5 as x from pan2), (select unnest(range(0, 2)) as di), (select unnest(range(0, 2)) as dj)) t join ms3 m on m.i = t.mi and m.j = t.mj) p group by 1, 2, 3 having count(*) = 4"
GRIDDED = {"ms3": MS3, "pan2": PAN2, "meet": MEET} | {k: v.replace("v_panms", "meet") for k, v in PARTS.items()} | {"fine": FINE}


def gridded(spark: SparkSession, sf: str) -> tuple[DataFrame, P.Raster, DataFrame, P.Raster]:
    """A pan image (i, j, v) and three bands (band, i, j, v) with their places."""
    r = V.raster(spark, sf)
    b2, b3 = (r.select("i", j.alias("j"), (100 * F.col("v")).alias(n)) for j, n in ((63 - F.col("j"), "b2"), ((F.col("j") * 13) % 64, "b3")))
    wide = r.select("i", "j", (100 * F.col("v")).alias("b1")).join(b2, ["i", "j"]).join(b3, ["i", "j"])
    quad = F.explode(F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in range(2) for b in range(2))))
    pan = wide.withColumn("q", quad).select((2 * F.col("i") + F.col("q.di")).alias("i"), (2 * F.col("j") + F.col("q.dj")).alias("j"), (0.5 * F.col("b1") + 0.3 * F.col("b2") + 0.2 * F.col("b3")).alias("p"))
    pan = pan.select("i", "j", (F.col("p") + ((F.col("i") * 7 + F.col("j") * 3) % 11 - 5) * 0.5).alias("v"))
    bands = wide.select("i", "j", F.explode(F.array(*(F.struct(F.lit(k).alias("band"), F.col(f"b{k}").alias("v")) for k in (1, 2, 3)))).alias("b")).select("b.band", "i", "j", "b.v")
    n = r.agg(F.max("i") + 1).first()[0]
    return pan, P.Raster(500.0, 900.0, 1.0, -1.0, 2 * n, 128), bands, P.Raster(500.0, 900.0, 2.0, -2.0, n, 64)


@query("sharpen_images", V.sql("select i::bigint as i, j::bigint as j, " + ", ".join(f"round({b} + f{k}*(gain*pan+bias-(w1*b1+w2*b2+w3*b3)), 5) + 0.0 as {b}" for k, b in enumerate(BANDS, 1)) + " from fine, fin", "v_raster", **GRIDDED))
def sharpen_images(spark: SparkSession, sf: str) -> DataFrame:
    """Bands of an image sharpened by a pan image of twice the resolution, from end to end."""
    out = P.sharpen_images(*gridded(spark, sf), [1, 2, 3], "bilinear")
    return out.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), *(shown(F.col(b), 5).alias(b) for b in BANDS))


@query("pan_ms_grid", "select * from (values ('shared', 25::integer, 0::integer, 100::integer, 50::integer, 0::integer, 0::integer, 38::integer, 25::integer), ('apart', -1, -1, -1, -1, -1, -1, -1, -1), ('coarse', -2, -2, -2, -2, -2, -2, -2, -2)) as t(pair, pj0, pi0, pj1, pi1, mj0, mi0, mj1, mi1)")
def pan_ms_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of whole pixels that two rasters share; none that lie apart, or where the pan image is the coarser."""
    pan, rows = P.Raster(0.0, 100.0, 1.0, -1.0, 50, 100), []
    for name, other in (("shared", P.Raster(25.0, 100.0, 2.0, -2.0, 60, 60)), ("apart", P.Raster(500.0, 100.0, 2.0, -2.0, 60, 60)), ("coarse", P.Raster(0.0, 100.0, 0.5, -0.5, 60, 60))):
        try:
            a, b = P.check_rasters(pan, other)
            rows.append((name, *a, *b))
        except P.TerralithError as e:
            rows.append((name, *[-2 if "coarser" in str(e) else -1] * 8))
    return spark.createDataFrame(rows, "pair string, pj0 int, pi0 int, pj1 int, pi1 int, mj0 int, mi0 int, mj1 int, mi1 int")


@query("pan_sharpen_pixels", V.sql("select id::bigint as id, " + ", ".join(f"round({b} + {f}::double*(1.1::double*pan+2-(0.5::double*b1+0.3::double*b2+0.2::double*b3)), 6) + 0.0 as {b}" for b, f in zip(BANDS, (0.9, 0.7, 0.4), strict=True)) + " from k", k=KEYED))
def pan_sharpen_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """One affine step a band gives what the forward and reverse transforms give, as only the pan component changes."""
    out = P.apply(keyed(spark, sf), "pan", BANDS, P.Parameters(**(FIXED | {"phi": [[0.9], [0.7], [0.4]]})))
    return out.select("id", *(shown(F.col(b)).alias(b) for b in BANDS))


@query("pan_ms_align", "select p.vec_id::bigint as i, (2 * k)::bigint as j, p.embedding[2 * k + 1]::double as pan, m.embedding[k + 1]::double as ms from embeddings p join embeddings m on p.vec_id = 2 * m.vec_id, unnest(range(0, 32)) as t(k)")
def pan_ms_align(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of two rasters at the same place."""
    r = V.raster(spark, sf)
    ms = r.select((F.col("i") * 2).alias("i"), (F.col("j") * 2).alias("j"), F.col("v").alias("ms"))
    return r.withColumnRenamed("v", "pan").join(ms, ["i", "j"]).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "pan", "ms")


@query("sharp_mask", V.sql("select id::bigint as id from k where pan > 20 and b1 > 15 and b2 < 40", k=KEYED))
def sharp_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels valid in the pan band and all others."""
    masked = keyed(spark, sf).select("id", F.when(F.col("pan") > 20, F.col("pan")).alias("pan"), F.when(F.col("b1") > 15, F.col("b1")).alias("b1"), F.when(F.col("b2") < 40, F.col("b2")).alias("b2"))
    return P.valid(masked, ["pan", "b1", "b2"]).select("id")


RECTS = "select event_id as id, (event_id % 100)::double as x0, (event_id % 100 + event_id % 17)::double as x1, (event_id % 90)::double as y0, (event_id % 90 + event_id % 13)::double as y1 from events"


@query("bounds_overlap", V.sql("select id::bigint as id, x0 < 60 and x1 > 40 and y0 < 50 and y1 > 20 as overlaps from r", r=RECTS))
def bounds_overlap(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    r = V.table(spark, sf, "events").select(e.cast("long").alias("id"), (e % 100).alias("x0"), (e % 100 + e % 17).alias("x1"), (e % 90).alias("y0"), (e % 90 + e % 13).alias("y1"))
    return r.select("id", P.overlap(r, (40, 20, 60, 50)).alias("overlaps"))


@query("pan_res_check", "select event_id::bigint as id, event_id % 10 + 1 > event_id % 7 + 1 as coarser from events")
def pan_res_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the pan band is coarser than the others, which is an error."""
    e = F.col("event_id")
    return V.table(spark, sf, "events").select(e.cast("long").alias("id"), too_coarse(e % 10 + 1, e % 7 + 1).alias("coarser"))
