"""MATLAB level-5 files: a reader and a writer of numeric, text, cell and struct arrays.

Only what the level-5 format says; level 7.3 files are HDF5 and are refused.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd

from .binary import by_matrix

#: Element types of the format and their numpy types.
KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, PACKED = 14, 15
CELL, STRUCT, TEXT = 1, 2, 4
#: numpy types of the numeric array classes.
CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}


class _Reader:
    def __init__(self, raw: bytes, order: str):
        self.raw, self.order = raw, order

    def element(self, at: int) -> tuple[int, int, int, int]:
        """(type, start, bytes, next) of the element at ``at``."""
        kind, size = struct.unpack_from(f"{self.order}II", self.raw, at)
        if kind >> 16:  # both in one word: the data follow at once
            return kind & 0xFFFF, at + 4, kind >> 16, at + 8
        pad = 0 if kind == PACKED else -size % 8
        return kind, at + 8, size, at + 8 + size + pad

    def numbers(self, at: int) -> tuple[np.ndarray, int]:
        kind, start, size, after = self.element(at)
        dtype = np.dtype(self.order + KINDS[kind])
        return np.frombuffer(self.raw, dtype, size // dtype.itemsize, start), after

    def matrix(self, at: int, end: int):
        """(name, value) of the array whose parts start at ``at``."""
        if at >= end:
            return "", np.zeros((0, 0))
        flags, at = self.numbers(at)
        kind, is_complex = int(flags[0]) & 0xFF, bool(int(flags[0]) & 0x800)
        dims, at = self.numbers(at)
        name, at = self.numbers(at)
        name, shape = name.tobytes().decode("latin-1"), tuple(int(d) for d in dims)
        if kind == CELL:
            values = []
            for _ in range(int(np.prod(shape))):
                _, start, size, at = self.element(at)
                values.append(self.matrix(start, start + size)[1])
            return name, values
        if kind == STRUCT:
            width, at = self.numbers(at)
            names, at = self.numbers(at)
            width = int(width[0])
            text = names.tobytes()
            fields = [text[i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(text), width)]
            rows = []
            for _ in range(int(np.prod(shape))):
                row = {}
                for f in fields:
                    _, start, size, at = self.element(at)
                    row[f] = self.matrix(start, start + size)[1]
                rows.append(row)
            return name, rows[0] if len(rows) == 1 else rows
        if kind != TEXT and kind not in CLASSES:
            return name, None
        values, at = self.numbers(at)
        if kind == TEXT:
            lines = np.array([chr(int(v)) for v in values], object).reshape(shape, order="F")
            return name, "\n".join("".join(line) for line in np.atleast_2d(lines))
        out = values.astype(CLASSES[kind]).reshape(shape, order="F")
        if is_complex:
            imag, at = self.numbers(at)
            out = out + 1j * imag.astype(float).reshape(shape, order="F")
        return name, out


def read_mat(raw: bytes) -> dict:
    """The variables of a file by name."""
    if len(raw) < 128 or raw[:4] == b"\x89HDF" or b"MATLAB 7.3" in raw[:128]:
        raise ValueError("not a level-5 file")
    order = "<" if raw[126:128] == b"IM" else ">"
    out, reader, at = {}, _Reader(raw, order), 128
    while at + 8 <= len(raw):
        kind, start, size, after = reader.element(at)
        if kind == PACKED:
            inner = _Reader(zlib.decompress(raw[start : start + size]), order)
            kind, first, length, _ = inner.element(0)
            if kind == MATRIX:
                name, value = inner.matrix(first, first + length)
                out[name] = value
        elif kind == MATRIX:
            name, value = reader.matrix(start, start + size)
            out[name] = value
        at = after
    return out


def _part(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def _matrix(name: str, value) -> bytes:
    if isinstance(value, dict):
        names = b"".join(k.encode("latin-1").ljust(32, b"\0") for k in value)
        body = _part(6, struct.pack("<II", STRUCT, 0)) + _part(5, struct.pack("<ii", 1, 1)) + _part(1, name.encode("latin-1"))
        body += struct.pack("<HHi", 5, 4, 32) + _part(1, names) + b"".join(_matrix("", v) for v in value.values())
        return _part(MATRIX, body)
    if isinstance(value, str):
        head = struct.pack("<II", TEXT, 0), struct.pack("<ii", 1, len(value)), _part(17, value.encode("utf-16-le"))
    else:
        array = np.atleast_2d(np.asarray(value, float))
        head = struct.pack("<II", 6, 0), struct.pack(f"<{array.ndim}i", *array.shape), _part(9, array.tobytes(order="F"))
    return _part(MATRIX, _part(6, head[0]) + _part(5, head[1]) + _part(1, name.encode("latin-1")) + head[2])


def write_mat(values: dict, packed: bool = False) -> bytes:
    """A level-5 file of numbers, texts and structs."""
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    parts = [_matrix(k, v) for k, v in values.items()]
    if packed:
        parts = [struct.pack("<II", PACKED, len(z := zlib.compress(p))) + z for p in parts]
    return head + b"".join(parts)


def _vector(mat: dict, name: str, n: int):
    value = mat.get(name)
    if value is None or isinstance(value, (str, dict, list)):
        return None
    flat = np.real(np.ravel(value)).astype(float)
    return flat if len(flat) == n else np.full(n, flat[0]) if len(flat) == 1 else None


@by_matrix
def parse_native(path: str, raw: bytes) -> tuple[np.ndarray, float, dict]:
    """Processed profiles: the first present of the images, with their vectors by trace."""
    mat = read_mat(raw)
    image = next((mat[k] for k in ("data", "migdata", "interp_data", "nmo_data", "nmo_dat", "filtdata", "hfilt_data") if isinstance(mat.get(k), np.ndarray)), None)
    if image is None:
        raise ValueError("no image")
    data = np.real(image)
    n = data.shape[1]
    names = ("decday", "lat", "long", "elev", "x_coord", "y_coord", "dist", "pressure", "trace_int", "trig")
    dt = _vector(mat, "dt", 1)
    return data, float(dt[0]) if dt is not None else float("nan"), {k: _vector(mat, k, n) for k in names}


@by_matrix
def parse_sounder(path: str, raw: bytes) -> tuple[np.ndarray, float, dict]:
    """Echograms of power by fast time: dB, positions, and days of the GPS time since year 0."""
    mat = read_mat(raw)
    if "Data" not in mat or "Longitude" not in mat:
        raise ValueError("no echogram")
    lat = np.ravel(mat["Latitude"])
    power = np.asarray(mat["Data"], float)
    if power.shape[1] != len(lat) and power.shape[0] == len(lat):
        power = power.T
    with np.errstate(divide="ignore", invalid="ignore"):
        data = 10 * np.log10(power)
    data[~np.isfinite(data)] = np.nan
    time = np.ravel(mat["Time"])
    return data, float(np.mean(np.diff(time))), dict(lat=lat, long=np.ravel(mat["Longitude"]), decday=np.ravel(mat["GPS_time"]) / 86400 + 719529)


def gps_rows(raw: bytes) -> pd.DataFrame:
    """decday, long, lat and elev of a file of GPS fixes; all four must be there."""
    mat = read_mat(raw)
    missing = [k for k in ("decday", "long", "lat", "elev") if k not in mat]
    if missing:
        raise ValueError(f"{', '.join(missing)} must be in the file")
    return pd.DataFrame({k: np.ravel(mat[k]).astype(float) for k in ("decday", "long", "lat", "elev")})
