"""Queries on angles, coordinate systems and affine transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions import angles as A
from terralith.functions import checks as K
from terralith.functions import crs as X
from terralith.functions.num import same, shown
from terralith.plans import views as V
from terralith.plans.catalog import query

ANGLES = "select filename, omega as a, phi as b, kappa - 2 as c from v_shot"


def _angles(spark: SparkSession, sf: str) -> DataFrame:
    return V.shots(spark, sf).select("filename", F.col("omega").alias("a"), F.col("phi").alias("b"), (F.col("kappa") - 2).alias("c"))


def _matrix(m) -> list:
    return [shown(m[i][j], 12).alias(f"r{i}{j}") for i in range(3) for j in range(3)]


def _matrix_sql(cells: list[str]) -> str:
    return ", ".join(f"round({e}, 12) + 0.0 as r{k // 3}{k % 3}" for k, e in enumerate(cells))


RPY = ["cos(c)*cos(b)", "cos(c)*sin(b)*sin(a)-sin(c)*cos(a)", "cos(c)*sin(b)*cos(a)+sin(c)*sin(a)", "sin(c)*cos(b)", "sin(c)*sin(b)*sin(a)+cos(c)*cos(a)", "sin(c)*sin(b)*cos(a)-cos(c)*sin(a)", "-sin(b)", "cos(b)*sin(a)", "cos(b)*cos(a)"]
OPK = ["cos(b)*cos(c)", "-cos(b)*sin(c)", "sin(b)", "cos(a)*sin(c)+sin(a)*sin(b)*cos(c)", "cos(a)*cos(c)-sin(a)*sin(b)*sin(c)", "-sin(a)*cos(b)", "sin(a)*sin(c)-cos(a)*sin(b)*cos(c)", "sin(a)*cos(c)+cos(a)*sin(b)*sin(c)", "cos(a)*cos(b)"]


@query("rpy_rot", V.sql(f"select filename, {_matrix_sql(RPY)} from g", "v_shot", g=ANGLES))
def rpy_rot(spark: SparkSession, sf: str) -> DataFrame:
    return _angles(spark, sf).select("filename", *_matrix(A.rpy_rotation(F.col("a"), F.col("b"), F.col("c"))))


@query("opk_rot", V.sql(f"select filename, {_matrix_sql(OPK)} from g", "v_shot", g=ANGLES))
def opk_rot(spark: SparkSession, sf: str) -> DataFrame:
    return _angles(spark, sf).select("filename", *_matrix(A.opk_rotation(F.col("a"), F.col("b"), F.col("c"))))


@query("rot_opk", V.sql(f"select filename, round(atan2(-r12, r22), 9) + 0.0 as omega, round(asin(greatest(-1, least(1, r02))), 9) + 0.0 as phi, round(atan2(-r01, r00), 9) + 0.0 as kappa from (select filename, {', '.join(f'{e} as r{k // 3}{k % 3}' for k, e in enumerate(RPY))} from g)", "v_shot", g=ANGLES))
def rot_opk(spark: SparkSession, sf: str) -> DataFrame:
    out = A.rotation_opk(A.rpy_rotation(F.col("a"), F.col("b"), F.col("c")))
    return _angles(spark, sf).select("filename", *(shown(v, 9).alias(n) for v, n in zip(out, ("omega", "phi", "kappa"), strict=True)))


AA = "select filename, a as x, b as y, c as z, sqrt(a*a+b*b+c*c) as t from g"
AA2 = "select filename, x, y, z, cos(t) as ct, sin(t)/t as s, (1-cos(t))/(t*t) as k from q"


@query("aa_opk", V.sql("select filename, round(atan2(k*z*y+s*x, -(ct+k*z*z)), 9) + 0.0 as omega, round(asin(greatest(-1, least(1, -(k*x*z-s*y)))), 9) + 0.0 as phi, round(atan2(k*x*y+s*z, ct+k*x*x), 9) + 0.0 as kappa from w", "v_shot", g=ANGLES, q=AA, w=AA2))
def aa_opk(spark: SparkSession, sf: str) -> DataFrame:
    out = A.angle_axis_opk(F.col("a"), F.col("b"), F.col("c"))
    return _angles(spark, sf).select("filename", *(shown(v, 9).alias(n) for v, n in zip(out, ("omega", "phi", "kappa"), strict=True)))


def _series(names: str, coefficients, first: str, second: str, sin1: str, fn2: str) -> str:
    return "+".join(f"({c!r}::double)*{sin1}({2 * (m + 1)}*{first})*{fn2}({2 * (m + 1)}*{second})" for m, c in enumerate(coefficients))


E1, RA = repr(X.ECCENTRICITY), repr(X.RECTIFYING)
PLACES = "select id, lat, lon, floor((lon + 180) / 6) * 6 - 177 as lon0, case when lat >= 0 then 0::double else 10000000::double end as y0 from v_lla"
T1 = f"select *, sinh(atanh(sin(radians(lat))) - {E1}::double*atanh({E1}::double*sin(radians(lat)))) as t, radians(lon - lon0) as lam from p"
T2 = "select *, atan2(t, cos(lam)) as xi, atanh(sin(lam)/sqrt(1+t*t)) as eta from t1"
FWD = f"select id, lat, lon, lon0, y0, 500000 + 0.9996::double*{RA}::double*(eta + {_series('', X.FORWARD, 'xi', 'eta', 'cos', 'sinh')}) as x, y0 + 0.9996::double*{RA}::double*(xi + {_series('', X.FORWARD, 'xi', 'eta', 'sin', 'cosh')}) as y from t2"
TM = {"p": PLACES, "t1": T1, "t2": T2, "f": FWD}


def _utm(spark: SparkSession, sf: str):
    p = V.places(spark, sf).withColumn("lon0", F.floor((F.col("lon") + 180) / 6) * 6 - 177.0).withColumn("y0", F.when(F.col("lat") >= 0, 0.0).otherwise(1e7))
    x, y = X.forward(X.utm(1, True), F.col("lon"), F.col("lat"), F.col("lon0"), F.col("y0"))
    return p.withColumn("x", x).withColumn("y", y)


@query("lla_utm", V.sql("select id::bigint as id, round(x, 4) + 0.0 as x, round(y, 4) + 0.0 as y from f", "v_lla", **TM))
def lla_utm(spark: SparkSession, sf: str) -> DataFrame:
    return _utm(spark, sf).select(F.col("id").cast("long").alias("id"), shown(F.col("x"), 4).alias("x"), shown(F.col("y"), 4).alias("y"))


@query("utm_lla", V.sql("select id::bigint as id, round(lon, 7) + 0.0 as lon, round(lat, 7) + 0.0 as lat from v_lla", "v_lla"))
def utm_lla(spark: SparkSession, sf: str) -> DataFrame:
    """There and back: the inverse series gives the places again."""
    lon, lat = X.back(X.utm(1, True), F.col("x"), F.col("y"), F.col("lon0"), F.col("y0"))
    return _utm(spark, sf).select(F.col("id").cast("long").alias("id"), shown(lon, 7).alias("lon"), shown(lat, 7).alias("lat"))


@query("utm_epsg", V.sql("select id::bigint as id, (case when lat >= 0 then 32600 else 32700 end + (((floor((lon + 180) / 6)::integer % 60) + 60) % 60) + 1)::integer as epsg from v_lla", "v_lla"))
def utm_epsg(spark: SparkSession, sf: str) -> DataFrame:
    return V.places(spark, sf).select(F.col("id").cast("long").alias("id"), X.utm_code(F.col("lat"), F.col("lon")).alias("epsg"))


@query("lla_mercator", V.sql("select id::bigint as id, round(radians(lon) * 6378137, 4) + 0.0 as x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 4) + 0.0 as y from v_lla", "v_lla"))
def lla_mercator(spark: SparkSession, sf: str) -> DataFrame:
    x, y = X.forward(X.parse_crs("EPSG:3857"), F.col("lon"), F.col("lat"))
    return V.places(spark, sf).select(F.col("id").cast("long").alias("id"), shown(x, 4).alias("x"), shown(y, 4).alias("y"))


@query("bounds_tf", V.sql("select round(min(x), 4) + 0.0 as x0, round(max(x), 4) + 0.0 as x1, round(min(y), 4) + 0.0 as y0, round(max(y), 4) + 0.0 as y1 from f", p="select k as id, case when s < 2 then -33 + s::double else -33 + k / 20.0::double end as lat, case when s < 2 then 24 + k / 20.0::double else 24 + (s - 2)::double end as lon, 25::double as lon0, 0::double as y0 from (select unnest(range(0, 4)) as s), (select unnest(range(0, 21)) as k)", t1=T1, t2=T2, f=FWD))
def bounds_tf(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds in another system, from points along all four sides."""
    edge = spark.range(84).select(F.expr("id div 21").alias("s"), (F.col("id") % 21 / 20.0).alias("k"))
    lat = F.when(F.col("s") < 2, -33.0 + F.col("s")).otherwise(-33.0 + F.col("k"))
    lon = F.when(F.col("s") < 2, 24.0 + F.col("k")).otherwise(24.0 + F.col("s") - 2)
    x, y = X.forward(X.Crs("tm", 25.0, 0.9996, 500_000.0), lon, lat)
    return edge.select(x.alias("x"), y.alias("y")).agg(*(shown(f(c), 4).alias(f"{c}{n}") for c in "xy" for n, f in ((0, F.min), (1, F.max))))


#: Towards north from t2, and the angles of a camera from that and roll, pitch and yaw (a, b, c).
_SQ = "(t*t + cos(lam)*cos(lam))"
NORTH1 = f"select *, cos(lam)/{_SQ} as na, -t*sin(lam)/({_SQ}*sqrt(1+t*t)) as nb, 1+" + "+".join(f"{2 * (m + 1)}*({c!r}::double)*cos({2 * (m + 1)}*xi)*cosh({2 * (m + 1)}*eta)" for m, c in enumerate(X.FORWARD)) + " as np, " + "+".join(f"{2 * (m + 1)}*({c!r}::double)*sin({2 * (m + 1)}*xi)*sinh({2 * (m + 1)}*eta)" for m, c in enumerate(X.FORWARD)) + " as nq from t2"
NORTH2 = "select *, (nb*np - na*nq) / sqrt((nb*np - na*nq)*(nb*np - na*nq) + (na*np + nb*nq)*(na*np + nb*nq)) as nx, (na*np + nb*nq) / sqrt((nb*np - na*nq)*(nb*np - na*nq) + (na*np + nb*nq)*(na*np + nb*nq)) as ny from n1"
R = {f"{i}{j}": f"({RPY[3 * i + j]})" for i in range(3) for j in range(3)}
OPK_OF_RPY = ", ".join(
    f"round({e}, 8) + 0.0 as {n}"
    for n, e in (
        ("omega", f"atan2(ny*{R['02']} - nx*{R['12']}, {R['22']})"),
        ("phi", f"asin(greatest(-1, least(1, -(nx*{R['02']} + ny*{R['12']}))))"),
        ("kappa", f"atan2(-(nx*{R['00']} + ny*{R['10']}), nx*{R['01']} + ny*{R['11']})"),
    )
)
BODY = "select *, radians(-5.0::double + id % 11) as a, radians(-4.0::double + id % 9) as b, radians((id % 350)::double) as c from n2"


@query("rpy_opk", V.sql(f"select id::bigint as id, {OPK_OF_RPY} from bodies", "v_lla", **{k: TM[k] for k in ("p", "t1", "t2")}, n1=NORTH1, n2=NORTH2, bodies=BODY))
def rpy_opk(spark: SparkSession, sf: str) -> DataFrame:
    """Body angles to the camera's, in the world's axes at each place."""
    p = V.places(spark, sf).withColumn("lon0", F.floor((F.col("lon") + 180) / 6) * 6 - 177.0)
    roll, pitch, yaw = (F.radians(F.lit(v) + F.col("id") % m) for v, m in ((-5.0, 11), (-4.0, 9), (0.0, 350)))
    out = A.rpy_to_opk((roll, pitch, yaw), X.north(X.utm(1, True), F.col("lon"), F.col("lat"), F.col("lon0")))
    return p.select(F.col("id").cast("long").alias("id"), *(shown(v, 8).alias(n) for v, n in zip(out, ("omega", "phi", "kappa"), strict=True)))


TRANSFORM = (4.0, 0.25, 19880.0, 0.125, -4.0, 30120.0)


@query("affine", V.sql("select id::bigint as id, 19880 + 4*(j+0.5::double) + 0.25::double*(i+0.5::double) as x, 30120 + 0.125::double*(j+0.5::double) - 4*(i+0.5::double) as y from v_pixel", "v_pixel"))
def affine(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel centres to the world, as transforms address corners."""
    x, y = K.affine(TRANSFORM, F.col("j"), F.col("i"))
    return V.pixels(spark, sf).select(F.col("id").cast("long").alias("id"), x.alias("x"), y.alias("y"))


@query("affine_inv", V.sql("select id::bigint as id, round((-4*(x-19880) - 0.25::double*(y-30120))/(-16.03125::double) - 0.5::double, 9) + 0.0 as j, round((4*(y-30120) - 0.125::double*(x-19880))/(-16.03125::double) - 0.5::double, 9) + 0.0 as i from v_world", "v_world"))
def affine_inv(spark: SparkSession, sf: str) -> DataFrame:
    j, i = K.affine_inverse(TRANSFORM, F.col("x"), F.col("y"))
    return V.world(spark, sf).select(F.col("id").cast("long").alias("id"), shown(j, 9).alias("j"), shown(i, 9).alias("i"))


@query("nan_equals", "select event_id::bigint as id, (case when event_id % 3 = 0 then null else value end is not distinct from case when event_id % 2 = 0 then null else value end) as same from events")
def nan_equals(spark: SparkSession, sf: str) -> DataFrame:
    """Not-a-number equals itself; it reaches the engine as NULL."""
    e, v = F.col("event_id"), F.col("value")
    a, b = (F.when(e % m == 0, F.lit(float("nan"))).otherwise(v) for m in (3, 2))
    return V.table(spark, sf, "events").select(e.cast("long").alias("id"), same(a, b).alias("same"))


@query("z_scale", V.sql("select id::bigint as id, round(alt * 0.3048::double, 6) + 0.0 as z from v_lla", "v_lla"))
def z_scale(spark: SparkSession, sf: str) -> DataFrame:
    c = X.parse_crs("+proj=longlat +vunits=ft")
    return V.places(spark, sf).select(F.col("id").cast("long").alias("id"), shown(F.col("alt") * c.z_scale).alias("z"))


@query("mean_latlon", V.sql("select round(avg(lat), 8) + 0.0 as lat, round(avg(lon), 8) + 0.0 as lon from v_lla", "v_lla"))
def mean_latlon(spark: SparkSession, sf: str) -> DataFrame:
    return V.places(spark, sf).agg(shown(F.avg("lat"), 8).alias("lat"), shown(F.avg("lon"), 8).alias("lon"))

