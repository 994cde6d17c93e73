"""Command line: orthorectify images by files of parameters, tags, a dataset folder or rational polynomials; sharpen images."""

from __future__ import annotations

import argparse
import logging
import sys

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.catalogue import FrameCatalogue, RpcCatalogue
from terralith.errors import CrsMissingError, ParamError, TerralithError
from terralith.functions import crs as X
from terralith.functions.text import file_name
from terralith.operators import catalog as J
from terralith.operators import orthorectify as O
from terralith.operators import pansharp as P
from terralith.sources import files, params, sinks, store, yamls

log = logging.getLogger("terralith")


def resolution(values: list[float] | None) -> tuple[float, float] | None:
    """None or no value: found from the images; one: square cells; two: width and height."""
    if not values:
        return None
    if len(values) > 2 or min(values) <= 0:
        raise ParamError("A resolution has one or two values above 0")
    return values[0], values[-1]


def options(texts: list[str]) -> dict:
    """NAME=VALUE texts as names in small letters and values of their kinds."""
    out = {}
    for t in texts:
        name, sign, value = t.partition("=")
        if not sign:
            raise ParamError(f"{t} isn't of the form NAME=VALUE")
        value = value.strip()
        out[name.strip().lower()] = None if value.lower() in ("none", "null", "nil") else yaml.safe_load(value)
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="terralith", description=__doc__)
    top.add_argument("-v", "--verbose", action="count", default=0, help="say more")
    commands = top.add_subparsers(dest="command", required=True)
    ortho = argparse.ArgumentParser(add_help=False)
    ortho.add_argument("--dem", help="elevation raster")
    ortho.add_argument("--dem-band", type=int, default=1)
    ortho.add_argument("--crs", help="coordinate system of the world, EPSG or proj4")
    ortho.add_argument("--resolution", type=float, action="append", help="size of cells; once, or twice if all the same")
    ortho.add_argument("--interp", default="cubic", choices=["nearest", "bilinear", "cubic", "lanczos"])
    ortho.add_argument("--dem-interp", default="cubic", choices=["nearest", "bilinear", "cubic", "lanczos"])
    ortho.add_argument("--dtype", default="float32", choices=list(sinks.NODATA))
    ortho.add_argument("--export-params", action="store_true", help="write parameters instead of images")
    out = argparse.ArgumentParser(add_help=False)
    out.add_argument("--out-dir", default=".")
    out.add_argument("--overwrite", action="store_true")
    out.add_argument("--creation-option", action="append", default=[], help="NAME=VALUE of the output's profile")
    src = argparse.ArgumentParser(add_help=False)
    src.add_argument("src", nargs="+", help="images: paths or wildcards")
    frame = commands.add_parser("frame", parents=[ortho, out, src], help="by files of interior and exterior parameters")
    frame.add_argument("--int-param", required=True)
    frame.add_argument("--ext-param", required=True)
    frame.add_argument("--lla-crs", default="EPSG:4979")
    frame.add_argument("--radians", action="store_true")
    commands.add_parser("exif", parents=[ortho, out, src], help="by the images' tags")
    odm = commands.add_parser("odm", parents=[ortho, out], help="by a dataset folder of drone images")
    odm.add_argument("--dataset-dir", required=True)
    rpc = commands.add_parser("rpc", parents=[ortho, out, src], help="by rational polynomial models")
    rpc.add_argument("--rpc-param", help="file of models; the images' tags without")
    rpc.add_argument("--gcp-refine", help="file of control points, or tags")
    rpc.add_argument("--refine-method", default="shift", choices=["shift", "shift-drift"])
    sharp = commands.add_parser("sharpen", parents=[out], help="sharpen bands by a pan image")
    sharp.add_argument("--pan", required=True)
    sharp.add_argument("--multispectral", required=True)
    sharp.add_argument("--index", type=int, action="append", help="numbers of bands")
    sharp.add_argument("--weight", type=float, action="append")
    sharp.add_argument("--interp", default="cubic", choices=["nearest", "bilinear", "cubic", "lanczos"])
    sharp.add_argument("--dtype", default="float32", choices=list(sinks.NODATA))
    return top


def read_dem(spark: SparkSession, path: str, band: int) -> tuple[DataFrame, O.Grid]:
    """Elevation (i, j, z) and its grid."""
    head = files.read_heads(spark, path).first()
    if head is None:
        raise FileNotFoundError(path)
    if not 1 <= band <= head["bands"]:
        raise TerralithError(f"{path} has {head['bands']} bands, not {band}")
    if head["transform"] is None:
        raise CrsMissingError(f"{path} isn't georeferenced")
    a, _, c, _, e, f = head["transform"]
    pixels = files.pixels_of(files.read_rasters(spark, path, [band])).select("i", "j", F.col("v").alias("z"))
    return pixels, O.Grid(c, f, a, e, X.parse_crs(f"EPSG:{head['epsg']}") if head["epsg"] else None)


def image_pixels(spark: SparkSession, globs: list[str]) -> DataFrame:
    p = files.pixels_of(files.read_rasters(spark, globs))
    return p.select(file_name(F.col("path")).alias("image"), "band", "i", "j", "v")


def run_ortho(spark: SparkSession, args: argparse.Namespace, globs: list[str], cameras: FrameCatalogue | RpcCatalogue) -> DataFrame | None:
    """Writes parameters, or orthorectified tiles of all images; the table of tiles."""
    if args.export_params:
        cameras.write(args.out_dir, args.overwrite)
        return None
    if not args.dem:
        raise ParamError("An elevation raster is needed: --dem")
    crs = X.projected(args.crs) if args.crs else getattr(cameras, "crs", None)
    if crs is None:
        raise CrsMissingError("A coordinate system is needed: --crs")
    res = resolution(args.resolution)
    if res and res[0] != res[1]:
        raise ParamError("Cells are square")
    paths = files.paths(spark, globs)
    dem, grid = read_dem(spark, args.dem, args.dem_band)
    found = J.check(cameras.cameras(paths)).withColumn("image", file_name(F.col("path")))
    how = {"crs": crs, "resolution": res[0] if res else None, "kernel": args.interp, "dem_kernel": args.dem_interp}
    if isinstance(cameras, RpcCatalogue):
        out = O.orthorectify_rpc(image_pixels(spark, globs), found.select("image", "im_size", "rpc"), dem, grid, **how)
    else:
        out = O.orthorectify(image_pixels(spark, globs), O.frame_cameras(found, "image"), dem, grid, **how)
    for r in out.grids.where("reason is not null").select("reason").toLocalIterator():
        log.warning(r["reason"])
    profile = sinks.profile(args.dtype, 1, "deflate", options=options(args.creation_option) or None)
    return sinks.write_tiles(out.pixels, out.grids, store.joined(args.out_dir, "ortho"), profile["dtype"], crs.epsg(), int(profile.get("blocksize", sinks.TILE)), args.overwrite)


def run_sharpen(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    heads = {}
    for name in ("pan", "multispectral"):
        head = files.read_heads(spark, getattr(args, name)).first()
        heads[name] = head, P.Raster(head["transform"][2], head["transform"][5], head["transform"][0], head["transform"][4], head["height"], head["width"]) if head["transform"] else None
    (pan_head, pan_at), (ms_head, ms_at) = heads["pan"], heads["multispectral"]
    if pan_at is None and ms_at is None:
        pan_at = P.Raster(0.0, 0.0, 1.0, -1.0, pan_head["height"], pan_head["width"])
    ms_at = ms_at or P.fitted_over(pan_at, ms_head["height"], ms_head["width"])
    pan_at = pan_at or P.fitted_over(ms_at, pan_head["height"], pan_head["width"])
    bands = args.index or list(range(1, ms_head["bands"] + 1))
    if not set(bands) <= set(range(1, ms_head["bands"] + 1)):
        raise ParamError(f"The image has {ms_head['bands']} bands")
    pan = files.pixels_of(files.read_rasters(spark, args.pan, [1])).select("i", "j", "v")
    ms = files.pixels_of(files.read_rasters(spark, args.multispectral)).select("band", "i", "j", "v")
    sharp = P.sharpen_images(pan, pan_at, ms, ms_at, sorted(set(bands)), args.interp, args.weight)
    rows = sharp.select("i", "j", F.explode(F.array(*(F.struct(F.lit(k + 1).alias("band"), F.col(f"b{b}").alias("v")) for k, b in enumerate(bands)))).alias("b"))
    pixels = rows.select(F.lit(args.multispectral.rsplit("/", 1)[-1]).alias("image"), "b.band", F.col("i").alias("r"), F.col("j").alias("c"), "b.v")
    grid = spark.createDataFrame([(args.multispectral.rsplit("/", 1)[-1], pan_at.x0, pan_at.y0, pan_at.dx, pan_at.rows, pan_at.cols, None)], "image string, x0 double, y0 double, res double, rows long, cols long, reason string")
    return sinks.write_tiles(pixels, grid, store.joined(args.out_dir, "sharp"), args.dtype, pan_head["epsg"] or ms_head["epsg"], overwrite=args.overwrite)


def run(spark: SparkSession, argv: list[str]) -> DataFrame | None:
    """What a command line does; the table of files that it has written."""
    args = parser().parse_args(argv)
    logging.basicConfig(level=max(10, 30 - 10 * args.verbose))
    match args.command:
        case "frame":
            out = run_ortho(spark, args, args.src, FrameCatalogue.read(spark, args.int_param, args.ext_param, args.crs, args.lla_crs, args.radians))
        case "exif":
            out = run_ortho(spark, args, args.src, FrameCatalogue.from_images(spark, args.src, args.crs))
        case "odm":
            folder = args.dataset_dir.rstrip("/")
            args.dem = args.dem or f"{folder}/odm_dem/dsm.tif"
            names = [r["path"] for r in files.odm_images(spark, folder).select("path").orderBy("path").toLocalIterator()]
            shots = f"{folder}/opensfm/reconstruction.json"
            out = run_ortho(spark, args, names, FrameCatalogue.read(spark, shots, shots, args.crs))
        case "rpc":
            models = RpcCatalogue.read(spark, args.rpc_param) if args.rpc_param else RpcCatalogue.from_images(spark, args.src)
            if args.gcp_refine == "tags":
                models = models.refine(params.gcps_of_heads(files.read_heads(spark, args.src)), args.refine_method)
            elif args.gcp_refine:
                models = models.refine(params.read_gcps(files.texts(spark, args.gcp_refine)), args.refine_method)
            out = run_ortho(spark, args, args.src, models)
        case _:
            out = run_sharpen(spark, args)
    if out is None:
        return None
    # the table is the work: it is done once, and kept as a list of files beside them
    listed = store.joined(args.out_dir, f"{args.command}-files")
    out.write.mode("overwrite" if args.overwrite else "errorifexists").parquet(listed)
    return spark.read.schema(out.schema).parquet(listed)


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.appName("terralith").getOrCreate()
    try:
        out = run(spark, sys.argv[1:] if argv is None else argv)
        if out is not None:
            log.info("%d files", out.count())
    except (TerralithError, FileNotFoundError, FileExistsError) as e:
        print(f"terralith: {e}", file=sys.stderr)
        return 1
    return 0


def write_settings(spark: SparkSession, argv: list[str], path: str, overwrite: bool = False) -> None:
    """The settings of a command line as YAML."""
    yamls.write_options(vars(parser().parse_args(argv)), path, spark, overwrite)
