"""TIFF and JPEG at the level of bytes: directories, tags, georeferencing and pixels, without any image library.

Reads classic and big TIFF in strips or tiles, plain, deflated, LZW or PackBits, with predictors. Writes classic
TIFF in deflated tiles, georeferenced.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
import zlib
from dataclasses import dataclass, field

import numpy as np

from terralith.errors import ParamError

#: Kinds of TIFF samples by (format, bits): fixed values.
SAMPLES = {(1, 8): "u1", (1, 16): "u2", (2, 16): "i2", (3, 32): "f4", (3, 64): "f8"}
#: Codes and bytes of TIFF's field types: fixed values.
FIELD = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("s", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8)}
#: Tags of three directories by number: fixed names.
MAIN = {271: "Make", 272: "Model", 274: "Orientation"}
EXIF = {37386: "FocalLength", 40962: "PixelXDimension", 40963: "PixelYDimension", 41486: "FocalPlaneXResolution", 41487: "FocalPlaneYResolution", 41488: "FocalPlaneResolutionUnit", 41989: "FocalLengthIn35mmFilm", 42033: "BodySerialNumber"}
GPS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude"}
EXIF_AT, GPS_AT, XMP, RPC, TIEPOINTS, SCALE, MATRIX, KEYS, NODATA = 34665, 34853, 700, 50844, 33922, 33550, 34264, 34735, 42113
#: Order of the numbers of a rational polynomial tag before its four lists: fixed names.
RPC_ORDER = ("err_bias", "err_rand", "line_off", "samp_off", "lat_off", "long_off", "height_off", "line_scale", "samp_scale", "lat_scale", "long_scale", "height_scale")
RPC_LISTS = ("line_num_coeff", "line_den_coeff", "samp_num_coeff", "samp_den_coeff")
XMP_START = b"http://ns.adobe.com/xap/1.0/\0"


class Directory:
    """The tags of one directory by number, read when asked for."""

    def __init__(self, data: bytes, at: int | None = None):
        if data[:2] not in (b"II", b"MM"):
            raise ParamError("This isn't TIFF")
        self.data, self.order = data, "<" if data[:2] == b"II" else ">"
        (magic,) = struct.unpack_from(self.order + "H", data, 2)
        self.wide = magic == 43
        if at is None:
            (at,) = struct.unpack_from(self.order + ("Q" if self.wide else "I"), data, 8 if self.wide else 4)
        size, head = (20, "Q") if self.wide else (12, "H")
        (n,) = struct.unpack_from(self.order + head, data, at)
        at += 8 if self.wide else 2
        self.entries = {}
        for k in range(n):
            tag, kind = struct.unpack_from(self.order + "HH", data, at + size * k)
            (count,) = struct.unpack_from(self.order + ("Q" if self.wide else "I"), data, at + size * k + 4)
            self.entries[tag] = (kind, count, at + size * k + (12 if self.wide else 8))

    def __contains__(self, tag: int) -> bool:
        return tag in self.entries

    def raw(self, tag: int) -> tuple[int, bytes]:
        kind, count, at = self.entries[tag]
        n = FIELD[kind][1] * count
        if n > (8 if self.wide else 4):
            (at,) = struct.unpack_from(self.order + ("Q" if self.wide else "I"), self.data, at)
        return kind, self.data[at : at + n]

    def get(self, tag: int, default=None) -> list:
        """Numbers of a tag; rationals as floats, NaN where they divide by zero."""
        if tag not in self.entries or self.entries[tag][0] not in FIELD:
            return default
        kind, raw = self.raw(tag)
        code, size = FIELD[kind]
        if code == "s":
            return [raw]
        flat = struct.unpack(f"{self.order}{len(raw) // size * len(code)}{code[0]}", raw)
        return list(flat) if len(code) == 1 else [a / b if b else float("nan") for a, b in zip(flat[::2], flat[1::2], strict=True)]

    def text(self, tag: int) -> str | None:
        got = self.get(tag)
        return got[0].split(b"\0")[0].decode("utf-8", "replace") if got and isinstance(got[0], bytes) else None


def _written(d: Directory, tag: int) -> str:
    """A tag as text: words and whole numbers as they are, bytes in hexadecimal, others in brackets."""
    kind = d.entries[tag][0]
    if kind == 2:
        return d.text(tag) or ""
    values = d.get(tag)
    if kind in (1, 7):
        return " ".join(f"0x{b:02x}" for b in (values if kind == 1 else values[0]))
    return " ".join(str(v) if kind in (3, 4, 8, 9) else f"({v:.15g})" for v in values)


def exif_of(d: Directory) -> dict[str, str]:
    out = {}
    for at, names in ((None, MAIN), (EXIF_AT, EXIF), (GPS_AT, GPS)):
        if at is not None and at not in d:
            continue
        part = d if at is None else Directory(d.data, d.get(at)[0])
        out |= {f"EXIF_{name}": _written(part, tag) for tag, name in names.items() if tag in part and part.entries[tag][0] in FIELD}
    return out


def xmp_of(text: str) -> dict[str, str]:
    """Texts of elements and values of attributes by their qualified names; of equal names the last in order of the document."""
    out: dict[str, str] = {}
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return out
    for e in root.iter():
        out[e.tag] = e.text or ""
        out |= e.attrib
    return out


def _packet(raw: bytes) -> dict[str, str]:
    a, z = raw.find(b"<"), raw.rfind(b">")
    return xmp_of(raw[a : z + 1].decode("utf-8", "replace")) if 0 <= a < z else {}


@dataclass
class Image:
    """What an image's head says: its size, tags, and how it lies in the world."""

    width: int
    height: int
    bands: int = 0
    dtype: str | None = None
    exif: dict = field(default_factory=dict)
    xmp: dict = field(default_factory=dict)
    rpc: dict | None = None
    gcps: list = field(default_factory=list)
    epsg: int | None = None
    transform: list | None = None  # x = a j + b i + c, y = d j + e i + f of pixel corners
    nodata: float | None = None


def rpc_of(values: list[float]) -> dict:
    out = dict(zip(RPC_ORDER, values, strict=False))
    return out | {name: list(values[12 + 20 * k : 32 + 20 * k]) for k, name in enumerate(RPC_LISTS)}


def head_of(data: bytes) -> Image:
    """The head of a TIFF or JPEG file."""
    if data[:2] == b"\xff\xd8":
        return _jpeg_head(data)
    d = Directory(data)
    bits, kind = d.get(258, [1])[0], d.get(339, [1])[0]
    out = Image(d.get(256)[0], d.get(257)[0], d.get(277, [1])[0], SAMPLES.get((kind, bits)), exif_of(d))
    if XMP in d:
        out.xmp = _packet(d.raw(XMP)[1])
    if RPC in d and len(d.get(RPC)) == 92:
        out.rpc = rpc_of(d.get(RPC))
    if KEYS in d:
        keys = d.get(KEYS)
        codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
        out.epsg = next((codes[k] for k in (3072, 2048) if codes.get(k, 32767) not in (0, 32767)), None)
    tie, scale = d.get(TIEPOINTS, []), d.get(SCALE)
    if MATRIX in d:
        m = d.get(MATRIX)
        out.transform = [m[0], m[1], m[3], m[4], m[5], m[7]]
    elif scale and len(tie) >= 6:
        out.transform = [scale[0], 0.0, tie[3] - scale[0] * tie[0], 0.0, -scale[1], tie[4] + scale[1] * tie[1]]
    elif len(tie) > 6:
        out.gcps = [tuple(tie[k : k + 6]) for k in range(0, len(tie) - 5, 6)]
    try:
        out.nodata = float(d.text(NODATA)) if NODATA in d else None
    except ValueError:
        pass
    return out


def _jpeg_head(data: bytes) -> Image:
    out, at = Image(0, 0, 0, "u1"), 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        if mark == 0xE1 and body[:6] == b"Exif\0\0":
            out.exif = exif_of(Directory(body[6:]))
        elif mark == 0xE1 and body.startswith(XMP_START):
            out.xmp = _packet(body[len(XMP_START) :])
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            out.height, out.width = struct.unpack_from(">HH", body, 1)
            out.bands = body[5]
            break
        at += 2 + size
    if not out.width:
        raise ParamError("A JPEG file without a size")
    return out


def unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the highest first, each table a code shorter than it could be."""
    out, table, width, value, have, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        value, have = (value << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = value >> have & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def unpacked_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n == 128:
            at += 1
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


#: Ways of compression by number: fixed values.
DECODERS = {1: bytes, 5: unlzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpacked_bits}


def read_pixels(data: bytes) -> np.ndarray:
    """A band-first array of a TIFF file."""
    d = Directory(data)
    rows, cols, bands = d.get(257)[0], d.get(256)[0], d.get(277, [1])[0]
    key = d.get(339, [1])[0], d.get(258, [1])[0]
    way, predictor, planar = d.get(259, [1])[0], d.get(317, [1])[0], d.get(284, [1])[0] == 2
    if way not in DECODERS or key not in SAMPLES or predictor not in (1, 2, 3):
        raise ParamError(f"TIFF with compression {way}, predictor {predictor} and samples {key} isn't supported")
    kind = np.dtype(SAMPLES[key])
    tiled = 322 in d
    wide, high = (d.get(322)[0], d.get(323)[0]) if tiled else (cols, min(rows, d.get(278, [rows])[0]))
    starts, sizes = (d.get(324), d.get(325)) if tiled else (d.get(273), d.get(279))
    across, down = -(-cols // wide), -(-rows // high)
    depth = 1 if planar else bands
    out = np.zeros((bands, rows, cols), kind)
    for k, (at, size) in enumerate(zip(starts, sizes, strict=True)):
        band, place = divmod(k, across * down)
        r, c = place // across * high, place % across * wide
        tall = high if tiled else min(high, rows - r)
        raw = DECODERS[way](data[at : at + size])
        if predictor == 3:
            lines = np.frombuffer(raw, np.uint8).reshape(tall, -1)
            lines = np.cumsum(lines.reshape(tall, -1, depth), axis=1, dtype=np.uint8).reshape(tall, kind.itemsize, wide * depth)
            block = np.ascontiguousarray(lines.transpose(0, 2, 1)).view(kind.newbyteorder(">"))[..., 0]
        else:
            block = np.frombuffer(raw, kind.newbyteorder(d.order), tall * wide * depth).reshape(tall, wide * depth)
        block = block.reshape(tall, wide, depth).astype(kind)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind)
        part = block[: rows - r, : cols - c].transpose(2, 0, 1)
        out[band : band + 1 if planar else bands, r : r + part.shape[1], c : c + part.shape[2]] = part
    return out


def write(pixels: np.ndarray, transform: list[float] | None = None, epsg: int | None = None, nodata: float | None = None, tile: int | None = None, extra: dict[int, tuple[int, list]] | None = None, photometric: int = 1) -> bytes:
    """A band-first array as TIFF: deflated, a strip a band or square tiles; extra holds further tags (kind, values)."""
    bands, rows, cols = pixels.shape
    code = next(k for k, v in SAMPLES.items() if np.dtype(v) == pixels.dtype)
    little = pixels.astype(pixels.dtype.newbyteorder("<"), copy=False)
    if tile:
        parts = [np.zeros((tile, tile), little.dtype) for _ in range(bands * (-(-rows // tile)) * (-(-cols // tile)))]
        k = 0
        for b in range(bands):
            for r in range(0, rows, tile):
                for c in range(0, cols, tile):
                    piece = little[b, r : r + tile, c : c + tile]
                    parts[k][: piece.shape[0], : piece.shape[1]] = piece
                    k += 1
    else:
        parts = list(little)
    body = [zlib.compress(np.ascontiguousarray(p).tobytes()) for p in parts]
    body = [p + b"\0" * (len(p) % 2) for p in body]
    places = np.cumsum([8, *map(len, body)]).tolist()
    tags: dict[int, tuple[int, list]] = {256: (4, [cols]), 257: (4, [rows]), 258: (3, [code[1]] * bands), 259: (3, [8]), 262: (3, [photometric]), 277: (3, [bands]), 284: (3, [2]), 339: (3, [code[0]] * bands)}
    tags |= {322: (3, [tile]), 323: (3, [tile]), 324: (4, places[:-1]), 325: (4, list(map(len, body)))} if tile else {273: (4, places[:-1]), 278: (4, [rows]), 279: (4, list(map(len, body)))}
    if transform:
        a, b, c, d, e, f = transform
        tags[MATRIX] = (12, [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])
    if epsg:
        geographic = epsg in (4326, 4979)
        tags[KEYS] = (3, [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg])
    if nodata is not None:
        tags[NODATA] = (2, [f"{nodata:.17g}".encode() + b"\0"])
    out = b"".join(body)
    return struct.pack("<2sHI", b"II", 42, places[-1]) + out + _directory(tags | (extra or {}), places[-1])


def _directory(tags: dict[int, tuple[int, list]], at: int) -> bytes:
    """A directory that begins at a place, with the values that it refers to; a value that is a dict is a directory."""
    entries, more = [], b""
    beyond = at + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        kind, values = tags[tag]
        if isinstance(values, dict):
            raw, count = struct.pack("<I", beyond + len(more)), 1
            more += _directory(values, beyond + len(more))
            entries.append(struct.pack("<HHI", tag, kind, count) + raw)
            continue
        raw = values[0] if kind in (2, 7) else struct.pack(f"<{len(np.ravel(values))}{FIELD[kind][0][0]}", *np.ravel(values).tolist())
        count = len(raw) if kind in (2, 7) else len(values)
        if len(raw) <= 4:
            entries.append(struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHII", tag, kind, count, beyond + len(more)))
            more += raw + b"\0" * (len(raw) % 2)
    return struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0" + more


def jpeg_head(width: int, height: int, tags: dict[int, tuple[int, list]], xmp: str | None = None) -> bytes:
    """A JPEG file without pixels that holds tags, for what reads heads alone."""
    out = b"\xff\xd8"
    block = b"Exif\0\0" + struct.pack("<2sHI", b"II", 42, 8) + _directory(tags, 8)
    for body in [block, *([XMP_START + xmp.encode()] if xmp else [])]:
        out += b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    return out + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width, 3) + b"\1\x11\0\2\x11\1\3\x11\1\xff\xd9"
