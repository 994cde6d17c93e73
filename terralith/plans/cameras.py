"""Queries on camera models: projections, inverses and boundaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions import cameras as C
from terralith.functions import inverse
from terralith.functions.num import shown
from terralith.operators import boundary as B
from terralith.operators import undistort as U
from terralith.plans import views as V
from terralith.plans.catalog import query



class Late:
    """Columns that are built when they are used, as modules are imported without a session."""

    def __init__(self, build):
        self._build = build

    def __getattr__(self, name: str):
        return getattr(self._build(), name)


K = Late(lambda: C.intrinsic(*V.SIZE, V.FOCAL, V.FOCAL, V.SENSOR, *V.CENTRE))
POSE = Late(lambda: C.pose(*V.POSITION, *(math.radians(a) for a in V.ANGLES)))
ROT = "select 20000.0::double as tx, 30000.0::double as ty, 1000.0::double as tz, cos(radians(-3.0::double)) as co, sin(radians(-3.0::double)) as so, cos(radians(2.0::double)) as cp, sin(radians(2.0::double)) as sp, cos(radians(10.0::double)) as ck, sin(radians(10.0::double)) as sk"
CAM = "select tx, ty, tz, cp*ck as r00, cp*sk as r01, -sp as r02, co*sk+so*sp*ck as r10, -(co*ck-so*sp*sk) as r11, so*cp as r12, so*sk-co*sp*ck as r20, -(so*ck+co*sp*sk) as r21, -(co*cp) as r22, 5.0::double*200/6 as fx, 5.0::double*150/4.5 as fy, 97.5::double as cx, 78.5::double as cy from rot"
RAYS = "select id, (r00*(x-tx)+r10*(y-ty)+r20*(z-tz)) as a, (r01*(x-tx)+r11*(y-ty)+r21*(z-tz)) as b, (r02*(x-tx)+r12*(y-ty)+r22*(z-tz)) as c, fx, fy, cx, cy from v_world, cam"
UV = "select id, a/c as u, b/c as v, (a/c)*(a/c)+(b/c)*(b/c) as q, fx, fy, cx, cy from rays"
PX = "select id::bigint as id, round(fx*du+cx, 6)+0.0 as j, round(fy*dv+cy, 6)+0.0 as i from "


def w2p_sql(distorted: str) -> str:
    return V.sql(f"{PX} (select *, {distorted} from uv)", "v_world", rot=ROT, cam=CAM, rays=RAYS, uv=UV)


def frame(kind: str = "pinhole", d: dict | None = None, undistorted: C.Intrinsic | None = None) -> C.Frame:
    return C.Frame(K, POSE, kind, d or {}, undistorted)


def projected(kind: str, d: dict | None = None):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        j, i = frame(kind, d).world_to_pixel(F.col("x"), F.col("y"), F.col("z"))
        return V.world(spark, sf).select(F.col("id").cast("long").alias("id"), shown(j).alias("j"), shown(i).alias("i"))

    return run


BROWN_SQL = "u*(1+q*(-0.25::double+q*(0.2::double+q*-0.1::double)))+0.02::double*u*v+0.01::double*(q+2*u*u) as du, v*(1+q*(-0.25::double+q*(0.2::double+q*-0.1::double)))+0.01::double*(q+2*v*v)+0.02::double*u*v as dv"
OPENCV_RADIAL = "(1+q*(-0.25::double+q*(0.2::double+q*-0.1::double)))/(1+q*(0.001::double+q*(0.001::double+q*-0.001::double)))"
OPENCV_SQL = f"u*{OPENCV_RADIAL}+0.02::double*u*v+0.01::double*(q+2*u*u) as du, v*{OPENCV_RADIAL}+0.01::double*(q+2*v*v)+0.02::double*u*v as dv"
ANGLE = "atan(sqrt(q))"
BENT = f"{ANGLE}*(1+{ANGLE}*{ANGLE}*(-0.25::double+{ANGLE}*{ANGLE}*(0.1::double+{ANGLE}*{ANGLE}*(0.01::double+{ANGLE}*{ANGLE}*-0.01::double))))"
FISHEYE_SQL = f"u*(case when q=0 then 1 else {BENT}/sqrt(q) end) as du, v*(case when q=0 then 1 else {BENT}/sqrt(q) end) as dv"
query("w2p_pinhole", w2p_sql("u as du, v as dv"))(projected("pinhole"))
query("w2p_brown", w2p_sql(BROWN_SQL))(projected("brown", V.BROWN))
query("w2p_opencv", w2p_sql(OPENCV_SQL))(projected("opencv", V.OPENCV))
query("w2p_fisheye", w2p_sql(FISHEYE_SQL))(projected("fisheye", V.FISHEYE))


MIXED = f"{PX} (select m.id, m.fx, m.fy, m.cx, m.cy, case when m.id % 2 = 0 then m.du else n.du end as du, case when m.id % 2 = 0 then m.dv else n.dv end as dv from (select *, {BROWN_SQL} from uv) m join (select *, {FISHEYE_SQL} from uv) n on m.id = n.id)"


@query("w2p_mixed", V.sql(MIXED, "v_world", rot=ROT, cam=CAM, rays=RAYS, uv=UV))
def w2p_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Two kinds of camera in one query, told apart by a column."""
    w = V.world(spark, sf)
    a, b = (frame(k, d).world_to_pixel(F.col("x"), F.col("y"), F.col("z")) for k, d in (("brown", V.BROWN), ("fisheye", V.FISHEYE)))
    even = F.col("id") % 2 == 0
    return w.select(F.col("id").cast("long").alias("id"), shown(F.when(even, a[0]).otherwise(b[0])).alias("j"), shown(F.when(even, a[1]).otherwise(b[1])).alias("i"))


P2W = "select id::bigint as id, round(tx+(r00*u+r01*v+r02)*(z-tz)/(r20*u+r21*v+r22), 6)+0.0 as x, round(ty+(r10*u+r11*v+r12)*(z-tz)/(r20*u+r21*v+r22), 6)+0.0 as y from (select id, z, (j-cx)/fx as u, (i-cy)/fy as v, cam.* from v_pixel, cam)"


@query("p2w_pinhole", V.sql(P2W, "v_pixel", rot=ROT, cam=CAM))
def p2w_pinhole(spark: SparkSession, sf: str) -> DataFrame:
    x, y = frame().pixel_to_world(F.col("j"), F.col("i"), F.col("z"))
    return V.pixels(spark, sf).select(F.col("id").cast("long").alias("id"), shown(x).alias("x"), shown(y).alias("y"))


def _unprojected(kind: str, d: dict):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = frame(kind, d)
        px = V.pixels(spark, sf).withColumn("uv", inverse.undistorted(kind, d, (F.col("j") - K.cx) / K.fx, (F.col("i") - K.cy) / K.fy))
        x, y = c.ray_to_world(F.col("uv.u"), F.col("uv.v"), F.col("z"))
        return px.select(F.col("id").cast("long").alias("id"), shown(x, 5).alias("x"), shown(y, 5).alias("y"))

    return run


#: Steps of the inverses in SQL: of a row's distorted u0, v0, as often as the engine's own.
BROWN_STEP = "(u0 - 0.02::double*x*y - 0.01::double*(x*x+y*y+2*x*x)) / (1+(x*x+y*y)*(-0.25::double+(x*x+y*y)*(0.2::double+(x*x+y*y)*-0.1::double))) as x, (v0 - 0.01::double*(x*x+y*y+2*y*y) - 0.02::double*x*y) / (1+(x*x+y*y)*(-0.25::double+(x*x+y*y)*(0.2::double+(x*x+y*y)*-0.1::double))) as y"
OPENCV_STEP = BROWN_STEP.replace(") / (1+", ") * (1+(x*x+y*y)*(0.001::double+(x*x+y*y)*(0.001::double+(x*x+y*y)*-0.001::double))) / (1+")
FISHEYE_STEP = "x - (x*(1+x*x*(-0.25::double+x*x*(0.1::double+x*x*(0.01::double+x*x*-0.01::double)))) - sqrt(u0*u0+v0*v0)) / (1+x*x*(3*-0.25::double+x*x*(5*0.1::double+x*x*(7*0.01::double+x*x*9*-0.01::double)))) as x"


def iterated(rows: str, step: str, first: str = "u0 as x, v0 as y", steps: int = 50) -> dict[str, str]:
    """Parts of a query whose last, fixed, has the rows (with u0 and v0) and x, y after so many steps."""
    return {"steps": f"select *, {first}, 0 as n_ from ({rows}) union all select * replace ({step}, n_ + 1 as n_) from steps where n_ < {steps}", "fixed": f"select * from steps where n_ = {steps}"}


def iterated_sql(body: str, rows: str, step: str, *views: str, first: str = "u0 as x, v0 as y", steps: int = 50, before: dict[str, str] | None = None, after: dict[str, str] | None = None) -> str:
    return V.sql(body, *views, **(before or {}), **iterated(rows, step, first, steps), **(after or {})).replace("with ", "with recursive ", 1)


BENT_PIXELS = "select id, z, (j-cx)/fx as u0, (i-cy)/fy as v0, cam.* from v_pixel, cam"
GROUND = "select id::bigint as id, round(tx+(r00*u+r01*v+r02)*(z-tz)/(r20*u+r21*v+r22), 5)+0.0 as x, round(ty+(r10*u+r11*v+r12)*(z-tz)/(r20*u+r21*v+r22), 5)+0.0 as y from "
PAIRS = {"rot": ROT, "cam": CAM}
FISHEYE_FIRST = "least(sqrt(u0*u0+v0*v0), pi()/2) as x, v0 as y"
FISHEYE_UV = "(select *, case when u0*u0+v0*v0 > 0 then u0*tan(x)/sqrt(u0*u0+v0*v0) else u0 end as u, case when u0*u0+v0*v0 > 0 then v0*tan(x)/sqrt(u0*u0+v0*v0) else v0 end as v from fixed)"
query("p2w_brown", iterated_sql(GROUND + "(select *, x as u, y as v from fixed)", BENT_PIXELS, BROWN_STEP, "v_pixel", before=PAIRS))(_unprojected("brown", V.BROWN))
query("p2w_opencv", iterated_sql(GROUND + "(select *, x as u, y as v from fixed)", BENT_PIXELS, OPENCV_STEP, "v_pixel", before=PAIRS))(_unprojected("opencv", V.OPENCV))
query("p2w_fisheye", iterated_sql(GROUND + FISHEYE_UV, BENT_PIXELS, FISHEYE_STEP, "v_pixel", before=PAIRS, first=FISHEYE_FIRST, steps=20))(_unprojected("fisheye", V.FISHEYE))


@query("broadcast_z", V.sql(P2W.replace("z, (j", "700.0::double as z, (j"), "v_pixel", rot=ROT, cam=CAM))
def broadcast_z(spark: SparkSession, sf: str) -> DataFrame:
    """One height for all pixels."""
    x, y = frame().pixel_to_world(F.col("j"), F.col("i"), 700.0)
    return V.pixels(spark, sf).select(F.col("id").cast("long").alias("id"), shown(x).alias("x"), shown(y).alias("y"))


@query("intrinsic", V.sql("select cam_id::bigint as cam_id, round(focal*200, 9)+0.0 as fx, round(focal*200, 9)+0.0 as fy, round(99.5::double+200*cx, 9)+0.0 as cx, round(74.5::double+200*cy, 9)+0.0 as cy from v_cam", "v_cam"))
def intrinsic(spark: SparkSession, sf: str) -> DataFrame:
    """Without a sensor size, focal lengths are in units of the width."""
    k = C.intrinsic(*V.SIZE, F.col("focal"), None, None, F.col("cx"), F.col("cy"))
    return V.cams(spark, sf).select(F.col("cam_id").cast("long").alias("cam_id"), *(shown(getattr(k, n), 9).alias(n) for n in ("fx", "fy", "cx", "cy")))


EXTRINSIC = "select filename, round(cos(phi)*cos(kappa), 12)+0.0 as r00, round(cos(phi)*sin(kappa), 12)+0.0 as r01, round(-sin(phi), 12)+0.0 as r02, round(cos(omega)*sin(kappa)+sin(omega)*sin(phi)*cos(kappa), 12)+0.0 as r10, round(-(cos(omega)*cos(kappa)-sin(omega)*sin(phi)*sin(kappa)), 12)+0.0 as r11, round(sin(omega)*cos(phi), 12)+0.0 as r12, round(sin(omega)*sin(kappa)-cos(omega)*sin(phi)*cos(kappa), 12)+0.0 as r20, round(-(sin(omega)*cos(kappa)+cos(omega)*sin(phi)*sin(kappa)), 12)+0.0 as r21, round(-(cos(omega)*cos(phi)), 12)+0.0 as r22, x, y, z from v_shot"


@query("extrinsic", V.sql(EXTRINSIC, "v_shot"))
def extrinsic(spark: SparkSession, sf: str) -> DataFrame:
    p = C.pose(*(F.col(c) for c in ("x", "y", "z", "omega", "phi", "kappa")))
    return V.shots(spark, sf).select("filename", *(shown(p.rotation[a][b], 12).alias(f"r{a}{b}") for a in range(3) for b in range(3)), "x", "y", "z")


@query("distort_px", V.sql(f"select id::bigint as id, round(greatest(0, least(199, fx*du+cx)), 6)+0.0 as j, round(greatest(0, least(149, fy*dv+cy)), 6)+0.0 as i from (select *, {BROWN_SQL} from uv)", "v_pixel", rot=ROT, cam=CAM, uv="select id, (j-cx)/fx as u, (i-cy)/fy as v, ((j-cx)/fx)*((j-cx)/fx)+((i-cy)/fy)*((i-cy)/fy) as q, fx, fy, cx, cy from v_pixel, cam"))
def distort_px(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of an undistorted image in the distorted one, kept inside it."""
    j, i = C.pixel(K, *frame("brown", V.BROWN).distorted((F.col("j") - K.cx) / K.fx, (F.col("i") - K.cy) / K.fy))
    inside = lambda c, n: F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), c))
    return V.pixels(spark, sf).select(F.col("id").cast("long").alias("id"), shown(inside(j, 200)).alias("j"), shown(inside(i, 150)).alias("i"))


def lens(kind: str = "brown", d: dict | None = None) -> U.Lens:
    return U.Lens.of(V.SIZE, V.FOCAL, V.SENSOR, *V.CENTRE, kind, V.BROWN if d is None else d)


@query("undistort_px", iterated_sql("select id::bigint as id, round(fx*x+cx, 6)+0.0 as j, round(fy*y+cy, 6)+0.0 as i from fixed", BENT_PIXELS, BROWN_STEP, "v_pixel", before=PAIRS))
def undistort_px(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of a distorted image in an undistorted one of the same intrinsics."""
    own = lens()
    straight = U.Lens(own.size, own.fx, own.fy, own.cx, own.cy)
    out = U.undistorted(V.pixels(spark, sf).select("id", "j", "i"), own, straight)
    return out.select(F.col("id").cast("long").alias("id"), shown(F.col("j")).alias("j"), shown(F.col("i")).alias("i"))


#: The rectangles of a 9 x 9 grid of undistorted pixels, and the intrinsics that show them.
GRID81 = "select a, b, (b*199/8.0::double-cx)/fx as u0, (a*149/8.0::double-cy)/fy as v0 from (select unnest(range(0, 9)) as a), (select unnest(range(0, 9)) as b), cam"
RECT = "select max(case when b = 0 then x end) as iu0, max(case when a = 0 then y end) as iv0, min(case when b = 8 then x end) as iu1, min(case when a = 8 then y end) as iv1, min(x) as ou0, min(y) as ov0, max(x) as ou1, max(y) as ov1 from fixed"
STRAIGHT = "select alpha, " + ", ".join(f"{i}*(1-alpha)+{o}*alpha as {n}" for n, i, o in (("ux", "199/(iu1-iu0)", "199/(ou1-ou0)"), ("uy", "149/(iv1-iv0)", "149/(ov1-ov0)"), ("uj", "-199/(iu1-iu0)*iu0", "-199/(ou1-ou0)*ou0"), ("ui", "-149/(iv1-iv0)*iv0", "-149/(ov1-ov0)*ov0"))) + " from rect, (values (0.0::double), (0.5), (1.0)) as al(alpha)"
RECT_PARTS = {"rect": RECT, "straight": STRAIGHT}


@query("undistort_rects", iterated_sql("select rect as rect, round(u0, 9)+0.0 as u0, round(v0, 9)+0.0 as v0, round(u1, 9)+0.0 as u1, round(v1, 9)+0.0 as v1 from (select 'inner' as rect, iu0 as u0, iv0 as v0, iu1 as u1, iv1 as v1 from rect union all select 'outer', ou0, ov0, ou1, ov1 from rect) as q", GRID81, BROWN_STEP, before=PAIRS, after=RECT_PARTS))
def undistort_rects(spark: SparkSession, sf: str) -> DataFrame:
    """The largest rectangle inside and the least around a 9 x 9 grid of undistorted pixels."""
    return B.undistorted_rectangles(spark, K, V.SIZE, "brown", V.BROWN).select("rect", *(shown(F.col(c), 9).alias(c) for c in ("u0", "v0", "u1", "v1")))


@query("undistort_k", iterated_sql("select alpha, round(ux, 7)+0.0 as fx, round(uy, 7)+0.0 as fy, round(uj, 7)+0.0 as cx, round(ui, 7)+0.0 as cy from straight", GRID81, BROWN_STEP, before=PAIRS, after=RECT_PARTS))
def undistort_k(spark: SparkSession, sf: str) -> DataFrame:
    """Intrinsics between the two rectangles, for three blends: those of the lens itself."""
    rows = [(a, k.fx, k.fy, k.cx, k.cy) for a in (0.0, 0.5, 1.0) for k in [lens().straight(a)]]
    made = spark.createDataFrame(rows, "alpha double, fx double, fy double, cx double, cy double")
    return made.select("alpha", *(shown(F.col(c), 7).alias(c) for c in ("fx", "fy", "cx", "cy")))


@query("w2p_nodistort", iterated_sql("select id::bigint as id, round(ux*u+uj, 5)+0.0 as j, round(uy*v+ui, 5)+0.0 as i from uv, straight where alpha = 1", GRID81, BROWN_STEP, "v_world", before=PAIRS, after=RECT_PARTS | {"rays": RAYS, "uv": UV}))
def w2p_nodistort(spark: SparkSession, sf: str) -> DataFrame:
    """Undistorted images project through their own intrinsics, whatever the model."""
    j, i = frame("brown", V.BROWN, lens().straight(1.0).intrinsic()).world_to_pixel(F.col("x"), F.col("y"), F.col("z"))
    return V.world(spark, sf).select(F.col("id").cast("long").alias("id"), shown(j, 5).alias("j"), shown(i, 5).alias("i"))


@query("pixel_boundary_und", iterated_sql("select ord::integer as ord, round(greatest(0, least(199, ux*x+uj)), 6)+0.0 as j, round(greatest(0, least(149, uy*y+ui)), 6)+0.0 as i from bound, straight where alpha = 0.5", GRID81 + " union all select 100 + ord, -1, (j-cx)/fx, (i-cy)/fy from (select * from (values (0, 0.0::double, 0.0::double), (1, 99.5, 0.0), (2, 199.0, 0.0), (3, 199.0, 74.5), (4, 199.0, 149.0), (5, 99.5, 149.0), (6, 0.0, 149.0), (7, 0.0, 74.5)) as t(ord, j, i)), cam", BROWN_STEP, before=PAIRS, after={"rect": RECT + " where a < 100", "straight": STRAIGHT, "bound": "select a - 100 as ord, x, y from fixed where a >= 100"}))
def pixel_boundary_und(spark: SparkSession, sf: str) -> DataFrame:
    """The boundary of what an undistorted image shows, kept inside it."""
    out = U.undistorted(B.pixel_boundary(spark, *V.SIZE), lens(), lens().straight(0.5), clip=True)
    return out.select("ord", shown(F.col("j")).alias("j"), shown(F.col("i")).alias("i"))


RPC_SQL = """select id::bigint as id,
 case when z is null then null else round((0.01::double + 0.98::double*x + 0.02::double*y + 0.03::double*h + 0.001::double*x*y + 0.002::double*x*x + 0.0005::double*x*y*h + 0.0001::double*x*x*x) / (1 + 0.001::double*x + 0.0005::double*h + 0.0002::double*y*y) * 100 + 99.5, 6) + 0.0 end as j,
 case when z is null then null else round((-0.02::double + 0.01::double*x - 0.97::double*y + 0.02::double*h + 0.0015::double*x*h + 0.0001::double*y*y*h + 0.0002::double*h*h*h) / (1 + 0.002::double*y + 0.0001::double*x*x) * 75 + 74.5, 6) + 0.0 end as i
 from (select id, z, (lon - 24.5)/0.5 as x, (lat + 33.5)/0.5 as y, (z - 250)/250 as h from pts)"""
POINTS = "select id, 24.0::double + (id % 1000) * 0.001::double as lon, -34.0::double + ((id * 3) % 1000) * 0.001::double as lat, {} as z from v_world"


def rpc_struct():
    def at(**terms):
        values = [0.0] * 20
        for name, v in terms.items():
            powers = tuple(name.count(c) for c in "xyh") if name != "one" else (0, 0, 0)
            values[C.RPC_TERMS.index(powers)] = v
        return F.array(*map(F.lit, values))

    scalars = {"line_off": 74.5, "samp_off": 99.5, "lat_off": -33.5, "long_off": 24.5, "height_off": 250.0, "line_scale": 75.0, "samp_scale": 100.0, "lat_scale": 0.5, "long_scale": 0.5, "height_scale": 250.0}
    return F.struct(
        *(F.lit(v).alias(k) for k, v in scalars.items()),
        at(one=0.01, x=0.98, y=0.02, h=0.03, xy=0.001, xx=0.002, xyh=0.0005, xxx=0.0001).alias("samp_num_coeff"),
        at(one=1.0, x=0.001, h=0.0005, yy=0.0002).alias("samp_den_coeff"),
        at(one=-0.02, x=0.01, y=-0.97, h=0.02, xh=0.0015, yyh=0.0001, hhh=0.0002).alias("line_num_coeff"),
        at(one=1.0, y=0.002, xx=0.0001).alias("line_den_coeff"),
    )


def _rpc(nulls: bool):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        w = V.world(spark, sf).select("id", (24.0 + (F.col("id") % 1000) * 0.001).alias("lon"), (-34.0 + ((F.col("id") * 3) % 1000) * 0.001).alias("lat"), (F.when(F.col("id") % 5 != 0, F.col("z")) if nulls else F.col("z")).alias("z")).withColumn("rpc", rpc_struct())
        j, i = C.rpc_to_pixel(F.col("rpc"), F.col("lon"), F.col("lat"), F.col("z"))
        lost = F.col("z").isNull()
        return w.select(F.col("id").cast("long").alias("id"), F.when(~lost, shown(j)).alias("j"), F.when(~lost, shown(i)).alias("i"))

    return run


query("w2p_rpc", V.sql(RPC_SQL, "v_world", pts=POINTS.format("z")))(_rpc(False))
query("rpc_nulls", V.sql(RPC_SQL, "v_world", pts=POINTS.format("case when id % 5 <> 0 then z end")))(_rpc(True))


@query("p2w_rpc", V.sql("select id::bigint as id, round(j, 5)+0.0 as j, round(i, 5)+0.0 as i, lost from (select id, case when id % 9 = 0 then -1 else j end as j, case when id % 9 = 0 then -1 else i end as i, id % 9 = 0 as lost from v_pixel)", "v_pixel"))
def p2w_rpc(spark: SparkSession, sf: str) -> DataFrame:
    """Places that models project to pixels at a height, projected again; without a height there is none."""
    px = V.pixels(spark, sf).withColumn("rpc", rpc_struct()).withColumn("h", F.when(F.col("id") % 9 != 0, F.col("z")))
    px = px.withColumn("w", inverse.rpc_to_world(F.col("rpc"), F.col("j"), F.col("i"), F.col("h")))
    j, i = C.rpc_to_pixel(F.col("rpc"), F.col("w.lon"), F.col("w.lat"), F.col("h"))
    return px.select(F.col("id").cast("long").alias("id"), shown(F.coalesce(F.nanvl(j, F.lit(-1.0)), F.lit(-1.0)), 5).alias("j"), shown(F.coalesce(F.nanvl(i, F.lit(-1.0)), F.lit(-1.0)), 5).alias("i"), (F.col("w.lon").isNull() | F.coalesce(F.isnan("w.lon"), F.lit(True))).alias("lost"))


BOUNDARY = "select * from (values (0, 0.0::double, 0.0::double), (1, 99.5, 0.0), (2, 199.0, 0.0), (3, 199.0, 74.5), (4, 199.0, 149.0), (5, 99.5, 149.0), (6, 0.0, 149.0), (7, 0.0, 74.5)) as t(ord, j, i)"


@query("pixel_boundary", f"select ord::integer as ord, j, i from ({BOUNDARY})")
def pixel_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return B.pixel_boundary(spark, *V.SIZE)


SIDES = "select * from (values (0, 0.0::double, 0.0::double, 199.0::double, 0.0::double, 23), (1, 199.0, 0.0, 199.0, 149.0, 17), (2, 199.0, 149.0, 0.0, 149.0, 23), (3, 0.0, 149.0, 0.0, 0.0, 17)) as t(side, j0, i0, j1, i1, n)"


@query("pixel_boundary_n", f"with s as ({SIDES}) select side::integer as side, k::integer as k, round(j0 + (j1 - j0) * k / n, 9) + 0.0 as j, round(i0 + (i1 - i0) * k / n, 9) + 0.0 as i from s, lateral (select unnest(range(0, n)) as k)")
def pixel_boundary_n(spark: SparkSession, sf: str) -> DataFrame:
    b = B.pixel_boundary_n(spark, *V.SIZE, 80)
    return b.select("side", "k", shown(F.col("j"), 9).alias("j"), shown(F.col("i"), 9).alias("i"))


WB = "select ord::integer as ord, round(tx+(r00*u+r01*v+r02)*({z}-tz)/(r20*u+r21*v+r22), 6)+0.0 as x, round(ty+(r10*u+r11*v+r12)*({z}-tz)/(r20*u+r21*v+r22), 6)+0.0 as y from (select ord, (j-cx)/fx as u, (i-cy)/fy as v, cam.* from b, cam)"


@query("world_boundary", V.sql(WB.format(z="825.0::double"), rot=ROT, cam=CAM, b=BOUNDARY))
def world_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return B.world_boundary(B.pixel_boundary(spark, *V.SIZE), frame(), 825.0)


@query("world_boundary_clip", V.sql(WB.format(z="least(700.0::double + 100 * ord, tz)"), rot=ROT, cam=CAM, b=BOUNDARY))
def world_boundary_clip(spark: SparkSession, sf: str) -> DataFrame:
    """Heights above the camera, as those of the last points are, are taken as its own."""
    return B.world_boundary(B.pixel_boundary(spark, *V.SIZE), frame(), F.least(700.0 + 100 * F.col("ord"), POSE.position[2]))


HORIZON = "select filename, bool_or(rz >= 0) as horizon from (select filename, (sin(omega)*sin(kappa)-cos(omega)*sin(phi)*cos(kappa))*((j-99.5)/160) - (sin(omega)*cos(kappa)+cos(omega)*sin(phi)*sin(kappa))*((i-74.5)/160) - cos(omega)*cos(phi) as rz from (select filename, omega*6 as omega, phi*5 as phi, kappa from v_shot), b) group by filename"


@query("horizon_fov", V.sql(HORIZON, "v_shot", b=BOUNDARY))
def horizon_fov(spark: SparkSession, sf: str) -> DataFrame:
    """Cameras that see the horizon: the ray of a boundary pixel doesn't go down."""
    s = V.shots(spark, sf).select("filename", (F.col("omega") * 6).alias("omega"), (F.col("phi") * 5).alias("phi"), "kappa")
    return B.sees_horizon(s, B.pixel_boundary(spark, *V.SIZE), C.Intrinsic(F.lit(160.0), F.lit(160.0), F.lit(99.5), F.lit(74.5)))
