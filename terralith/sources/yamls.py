"""Interior and rational polynomial parameters in YAML: readers that check them, and writers."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.errors import ParamError
from terralith.functions.cameras import COEFFICIENTS
from terralith.sources import store
from terralith.sources.files import LARGE, large, lines, texts

#: Names of the two tilts of a sensor in files, by ours.
TILTS = {"t1": "tx", "t2": "ty"}
NEEDED = ("type", "im_size", "focal_len")
PLACED = ("sensor_size", "cx", "cy")
LENS = COEFFICIENTS["opencv"]
INTERIOR_DDL = "camera string, kind string, im_size array<int>, focal_len array<double>, sensor_size array<double>, cx double, cy double, " + ", ".join(f"{k} double" for k in LENS)
#: Parts of a rational polynomial model: fixed names.
RPC_NUMBERS = tuple(f"{a}_{b}" for a in ("height", "lat", "line", "long", "samp") for b in ("off", "scale"))
RPC_LISTS = tuple(f"{a}_{b}_coeff" for a in ("line", "samp") for b in ("num", "den"))
RPC_DDL = "filename string, im_size array<int>, rpc struct<" + ", ".join([*(f"{n}: double" for n in RPC_NUMBERS), *(f"{n}: array<double>" for n in RPC_LISTS), "err_bias: double", "err_rand: double"]) + ">"
RPC_ARROW = pa.schema([("filename", pa.string()), ("im_size", pa.list_(pa.int32())), ("rpc", pa.struct([*((n, pa.float64()) for n in RPC_NUMBERS), *((n, pa.list_(pa.float64())) for n in RPC_LISTS), ("err_bias", pa.float64()), ("err_rand", pa.float64())])), ("path", pa.string())])


def loaded(text: str) -> dict:
    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ParamError(f"This isn't YAML: {e}") from e
    if not isinstance(doc, dict) or not doc:
        raise ParamError("A mapping of parameters is needed")
    return doc


def file_name_of(kind: str, name: str) -> str:
    return TILTS.get(name, name)


def _numbers(value, of: str) -> list[float]:
    got = value if isinstance(value, list) else [value]
    if not got or not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in got):
        raise ParamError(f"{of} isn't a number or a list of them")
    return [float(v) for v in got]


def interior_rows(text: str) -> list[dict]:
    """Cameras of a text: by id, one camera alone with a name perhaps, or one in a section camera."""
    doc = loaded(text)
    if "camera" in doc:
        doc = doc["camera"]
    if not isinstance(next(iter(doc.values())), dict):
        doc = {doc.get("name", "unknown"): doc}
    out = []
    for name, c in doc.items():
        if not isinstance(c, dict):
            raise ParamError(f"Camera {name} isn't a mapping")
        missing = [k for k in NEEDED if k not in c]
        if missing:
            raise ParamError(f"Camera {name} lacks {', '.join(missing)}")
        kind = str(c["type"]).lower()
        if kind not in COEFFICIENTS:
            raise ParamError(f"Camera {name} is of an unknown type {kind}")
        known = {file_name_of(kind, k): k for k in COEFFICIENTS[kind]}
        unknown = set(c) - set(known) - {*NEEDED, *PLACED, "name"}
        if unknown:
            raise ParamError(f"Camera {name} has unknown parameters: {', '.join(sorted(map(str, unknown)))}")
        row = {"camera": str(name), "kind": kind, "im_size": [int(v) for v in _numbers(c["im_size"], "im_size")], "focal_len": _numbers(c["focal_len"], "focal_len")}
        row["sensor_size"] = _numbers(c["sensor_size"], "sensor_size") if "sensor_size" in c else None
        row |= {k: _numbers(c[k], k)[0] if k in c else None for k in ("cx", "cy")} | dict.fromkeys(LENS)
        row |= {known[k]: _numbers(v, k)[0] for k, v in c.items() if k in known}
        out.append(row)
    return out


def _parsed(docs: DataFrame, parse, ddl: str) -> DataFrame:
    """Rows of texts (path, value); a text that is wrong raises an error that names its path."""

    def run(frames):
        for pdf in frames:
            for path, value in zip(pdf["path"], pdf["value"], strict=True):
                try:
                    rows = parse(value)
                except ParamError as e:
                    raise ParamError(f"{path}: {e}") from e
                yield pd.DataFrame(rows).assign(path=path)

    return docs.mapInPandas(run, f"{ddl}, path string")


def read_interior(spark: SparkSession, glob: str) -> DataFrame:
    """Interior parameters of YAML files; a type, size or name that is wrong raises ParamError when rows are made."""
    return _parsed(texts(spark, glob), interior_rows, INTERIOR_DDL)


def rpc_rows(text: str) -> list[dict]:
    out = []
    for name, p in loaded(text).items():
        if not isinstance(p, dict) or not isinstance(p.get("rpc"), dict) or len(p.get("im_size") or ()) != 2:
            raise ParamError(f"{name} needs im_size and rpc")
        rpc = p["rpc"]
        row: dict = {}
        for k in RPC_NUMBERS:
            if not isinstance(rpc.get(k), (int, float)):
                raise ParamError(f"{name} needs a number {k}")
            row[k] = float(rpc[k])
        for k in RPC_LISTS:
            if not isinstance(rpc.get(k), list) or len(rpc[k]) != 20 or not all(isinstance(v, float) for v in rpc[k]):
                raise ParamError(f"{name} needs 20 numbers {k}")
            row[k] = rpc[k]
        row |= {k: float(rpc[k]) if rpc.get(k) is not None else None for k in ("err_bias", "err_rand")}
        out.append({"filename": str(name), "im_size": [int(v) for v in p["im_size"]], "rpc": row})
    return out


#: A key and numbers that need no YAML reader: its words for other things than texts and floats aren't among them.
PLAIN = re.compile(r"[A-Za-z_](?:[\w./ -]{0,100}[\w./-])?", re.ASCII)
WORDS = frozenset(("y", "n", "yes", "no", "on", "off", "true", "false", "null"))
_FLOAT = r"-?\d+\.\d*(?:[eE][-+]\d+)?"
_NUMBER, _LIST, _SIZE = re.compile(_FLOAT, re.ASCII), re.compile(rf"\[{_FLOAT}(?:, {_FLOAT})*\]", re.ASCII), re.compile(r"    im_size: \[([1-9]\d*), ([1-9]\d*)\]", re.ASCII)


def _plain_rpc(text: str) -> dict | None:
    """A model in the layout of write_rpc(), or None: rpc_rows() says then what it is."""
    lines = re.sub(r",\n +", ", ", text.rstrip("\n")).split("\n")
    size = _SIZE.fullmatch(lines[1]) if len(lines) > 3 else None
    name = lines[0][:-1]
    if not size or not lines[0].endswith(":") or not PLAIN.fullmatch(name) or name.lower() in WORDS or lines[2] != "    rpc:":
        return None
    rpc: dict = dict.fromkeys(("err_bias", "err_rand"))
    for line in lines[3:]:
        key, _, value = line.partition(": ")
        key = key[8:] if key.startswith("        ") else ""
        if key in RPC_LISTS and _LIST.fullmatch(value):
            rpc[key] = [float(v) for v in value[1:-1].split(", ")]
            if len(rpc[key]) != 20:
                return None
        elif (key in RPC_NUMBERS or key in ("err_bias", "err_rand")) and _NUMBER.fullmatch(value):
            rpc[key] = float(value)
        else:
            return None
    if not all(k in rpc for k in (*RPC_NUMBERS, *RPC_LISTS)):
        return None
    return {"filename": name, "im_size": [int(v) for v in size.groups()], "rpc": rpc}


def _models_of(text: str) -> list[dict]:
    plain = _plain_rpc(text)
    return [plain] if plain else rpc_rows(text)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """path and start of each block with its lines, batch by batch, as lists."""
    for b in batches:
        start, value = b.column("start").to_numpy(), b.column("value").to_pylist()
        cuts = [0, *(np.flatnonzero(start[1:] != start[:-1]) + 1).tolist(), len(value)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if y > x:
                yield b.column("path")[x].as_py(), int(start[x]), value[x:y]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, the lines before its first key and those from its last one on."""
    held: dict[int, list] = {}
    for _, start, got in _blocks(batches):
        ends = held.setdefault(start, [[], None])
        keys = [k for k, v in enumerate(got) if v and v[0] != " "]
        if keys:
            if ends[1] is None:
                ends[0] += got[: keys[0]]
            ends[1] = got[keys[-1] :]
        else:
            ends[0 if ends[1] is None else 1].extend(got)
    if held:
        join = lambda v: None if v is None else "\n".join(v)
        yield pa.RecordBatch.from_pydict({"start": list(held), "head": [join(v[0]) for v in held.values()], "tail": [join(v[1]) for v in held.values()]})


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The models that begin and end in a block: neither its first lines nor its last model."""
    at, held, rows = None, None, []
    for path, start, got in _blocks(batches):
        if start != at:
            at, held = start, None
        for line in got:
            if line and line[0] != " ":
                if held:
                    rows += [r | {"path": path} for r in _models_of("\n".join(held))]
                held = [line]
            elif held:
                held.append(line)
        if len(rows) >= 2000:
            yield pa.RecordBatch.from_pylist(rows, RPC_ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, RPC_ARROW)


def _split(spark: SparkSession, path: str) -> DataFrame | None:
    """Models of a file in blocks; None if it isn't plainly a mapping with different keys on lines of their own."""
    found = lines(spark, path).drop("at")
    key = F.col("value").rlike(r"^[A-Za-z_][A-Za-z0-9_./ -]*:$")
    odd = F.col("value").rlike(r"[&*|>\\\\#!%'\"\t{}?]")
    if found.where(odd | ~(key | F.col("value").startswith(" ") | (F.col("value") == ""))).limit(1).count():
        return None
    if found.where(key).groupBy("value").count().where("count > 1").limit(1).count():
        return None
    # a model or two a block come to the driver
    blocks = sorted(found.mapInArrow(_ends, "start long, head string, tail string").collect())
    whole, open_ = [], []
    for r in blocks:
        if r["head"]:
            open_.append(r["head"])
        if r["tail"] is not None:
            whole.append("\n".join(open_))
            open_ = [r["tail"]]
    whole = [t for t in (*whole, "\n".join(open_)) if t.strip()]
    name = found.select("path").first()["path"]
    edges = _parsed(spark.createDataFrame([(name, t) for t in whole], "path string, value string"), _models_of, RPC_DDL)
    return found.mapInArrow(_inner, f"{RPC_DDL}, path string").unionByName(edges)


def read_rpc(spark: SparkSession, glob: str, least: int = LARGE) -> DataFrame:
    """Rational polynomial models of YAML files, by image; a large file of plain layout is read in blocks, others a file a row."""
    big, others = large(spark, glob, least)
    parts = {p: s for p in big for s in [_split(spark, p)] if s is not None}
    if not parts:
        return _parsed(texts(spark, glob), rpc_rows, RPC_DDL)
    others += [p for p in big if p not in parts]
    rest = [_parsed(texts(spark, others), rpc_rows, RPC_DDL)] if others else []
    return reduce(DataFrame.unionByName, [*parts.values(), *rest])


def _dumped(doc: dict) -> str:
    return yaml.safe_dump(doc, sort_keys=False, indent=4, default_flow_style=None)


def _one_or_list(values):
    return values[0] if len(values) == 1 else list(values)


def interior_parts(rows: DataFrame) -> Iterable[str]:
    """YAML of cameras, one after another, in order of their ids."""
    for r in rows.orderBy("camera").toLocalIterator():
        c = {"type": r["kind"], "im_size": list(r["im_size"]), "focal_len": _one_or_list(r["focal_len"])}
        if r["sensor_size"]:
            c["sensor_size"] = list(r["sensor_size"])
        c |= {file_name_of(r["kind"], k): r[k] for k in ("cx", "cy", *COEFFICIENTS[r["kind"]]) if k in r and r[k] is not None}
        yield _dumped({r["camera"]: c})


def write_interior(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    store.write_text(rows.sparkSession, path, interior_parts(rows), overwrite)


def _number(v: float) -> str:
    """As YAML has it: a power needs a point before it."""
    text = repr(v)
    return text.replace("e", ".0e", 1) if "e" in text and "." not in text else text


def rpc_text(name: str, im_size: list, rpc: dict) -> str:
    """YAML of a model; what isn't plain is left to the YAML writer."""
    rpc = {k: v for k, v in rpc.items() if v is not None}
    numbers = [v for values in rpc.values() for v in (values if isinstance(values, list) else [values])]
    if not PLAIN.fullmatch(name) or name.lower() in WORDS or not all(isinstance(v, float) and math.isfinite(v) for v in numbers):
        return _dumped({name: {"im_size": list(im_size), "rpc": rpc}}).rstrip("\n")
    shown = (f"        {k}: [{', '.join(map(_number, v))}]" if isinstance(v, list) else f"        {k}: {_number(v)}" for k, v in rpc.items())
    return "\n".join([f"{name}:", f"    im_size: [{', '.join(map(str, im_size))}]", "    rpc:", *shown])


def write_rpc(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Models (filename, im_size, rpc) in one YAML file, in order of their names; executors write its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"value": [rpc_text(r["filename"], r["im_size"], r["rpc"]) for r in b.to_pylist()]})

    store.write_rows(rows.select("filename", "im_size", "rpc").orderBy("filename").mapInArrow(run, "value string"), path, overwrite=overwrite)


def write_options(options: dict, path: str, spark: SparkSession, overwrite: bool = False) -> None:
    """The settings of a run."""
    store.write_text(spark, path, [_dumped(options)], overwrite)


def interior_frame(spark: SparkSession, text: str) -> DataFrame:
    """Cameras of a text that the driver holds."""
    return _parsed(spark.createDataFrame([("", text)], "path string, value string"), interior_rows, INTERIOR_DDL).drop("path")


def interior_of_json(rows: DataFrame) -> DataFrame:
    """Cameras read from JSON in the columns of those from YAML: equal focal lengths are one."""
    focal = F.when(F.col("focal_x") == F.col("focal_y"), F.array("focal_x")).otherwise(F.array("focal_x", "focal_y"))
    lens = [F.col(k) if k in rows.columns else F.lit(None).cast("double").alias(k) for k in LENS]
    return rows.select("camera", "kind", F.array("width", "height").alias("im_size"), focal.alias("focal_len"), F.lit(None).cast("array<double>").alias("sensor_size"), "cx", "cy", *lens)
