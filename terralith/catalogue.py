"""Catalogues of cameras: parameters of many images from files or tags, looked up, refined and written."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.errors import CrsMissingError, ParamError, TerralithWarning
from terralith.functions import crs as C
from terralith.operators import catalog as J
from terralith.operators import refine as R
from terralith.sources import exterior as E
from terralith.sources import files, params, store, yamls


def _suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name[name.rfind(".") :].lower() if "." in name else ""


class FrameCatalogue:
    """Frame cameras: interior (camera, kind, ...) and exterior (filename, x, ..., camera) parameters and the world's system."""

    def __init__(self, interior: DataFrame, exterior: DataFrame, crs: C.Crs | None):
        self.interior, self.exterior, self.crs = interior, exterior, crs

    @staticmethod
    def read(spark: SparkSession, interior: str, exterior: str, crs: str | None = None, lla_crs: str = E.LLA, radians: bool = False) -> FrameCatalogue:
        """From files, by their suffixes: YAML or JSON, and tables, reconstructions or GeoJSON."""
        match _suffix(interior):
            case ".yaml" | ".yml":
                cams = yamls.read_interior(spark, interior).drop("path")
            case ".json":
                cams = yamls.interior_of_json(params.read_interior_json(params.check_interior_json(params.cameras_of(files.texts(spark, interior)))))
            case other:
                raise ParamError(f"Interior parameters aren't read from {other or 'such'} files")
        match _suffix(exterior):
            case ".csv" | ".txt":
                ext = E.read_table(spark, exterior, crs, lla_crs, radians=radians)
            case ".json":
                ext = E.read_reconstruction(files.texts(spark, exterior), crs)
            case ".geojson":
                ext = E.read_features(files.texts(spark, exterior))
            case other:
                raise ParamError(f"Exterior parameters aren't read from {other or 'such'} files")
        return FrameCatalogue(cams, ext.rows, ext.crs or (C.projected(crs) if crs else None))

    @staticmethod
    def from_images(spark: SparkSession, globs: str | list[str], crs: str | None = None) -> FrameCatalogue:
        """From the tags of images."""
        decoded = E.decode(files.read_heads(spark, globs))
        cams = E.interior_of(decoded)
        bad = cams.where("error is not null").select("filename", "error").first()
        if bad:
            raise ParamError(f"{bad['filename']}: {bad['error']}")
        ext = E.read_tagged(decoded, crs)
        # cameras of one id are one: the last by name, as later files overwrite
        one = params.last_of(cams.drop("error"), ["camera"], "filename").drop("filename")
        lens = [F.col(k) if k in one.columns else F.lit(None).cast("double").alias(k) for k in yamls.LENS]
        return FrameCatalogue(one.select("camera", "kind", "im_size", "focal_len", "sensor_size", "cx", "cy", *lens), ext.rows, ext.crs)

    def cameras(self, images: DataFrame) -> DataFrame:
        """Images (path) with all parameters, and reason where some are missing."""
        found = J.by_name(images, self.exterior)
        return J.with_interior(found, self.interior, "camera")

    def write(self, folder: str, overwrite: bool = False) -> None:
        """int_param.yaml and ext_param.geojson."""
        yamls.write_interior(self.interior, store.joined(folder, "int_param.yaml"), overwrite)
        if self.crs is None:
            raise CrsMissingError("Exterior parameters need a coordinate system to be written")
        params.write_exterior(self.exterior, self.crs, store.joined(folder, "ext_param.geojson"), overwrite)


class RpcCatalogue:
    """Rational polynomial models (filename, im_size, rpc)."""

    def __init__(self, models: DataFrame, gcps: DataFrame | None = None):
        self.models, self.gcps = models, gcps

    @staticmethod
    def read(spark: SparkSession, path: str) -> RpcCatalogue:
        return RpcCatalogue(yamls.read_rpc(spark, path).drop("path"))

    @staticmethod
    def from_images(spark: SparkSession, globs: str | list[str]) -> RpcCatalogue:
        """From tags, or a text file beside an image."""
        return RpcCatalogue(params.rpc_of_heads(files.read_heads(spark, globs)))

    def refine(self, gcps: DataFrame, method: str = "shift") -> RpcCatalogue:
        """Models refined by control points; a warning says how many have none, and too few are an error."""
        rows = J.check(R.refine(self.models, gcps, method))
        left = rows.where("n = 0").count()
        if left:
            warnings.warn(f"{left} models have no control points", TerralithWarning, stacklevel=2)
        return RpcCatalogue(rows.drop("n"), gcps)

    def cameras(self, images: DataFrame) -> DataFrame:
        return J.by_name(images, self.models, what="RPC")

    def write(self, folder: str, overwrite: bool = False) -> None:
        """rpc_param.yaml and, of refined models, gcps.geojson."""
        yamls.write_rpc(self.models, store.joined(folder, "rpc_param.yaml"), overwrite)
        if self.gcps is not None:
            params.write_gcp_file(self.gcps, store.joined(folder, "gcps.geojson"), overwrite)
