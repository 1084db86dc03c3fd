"""Images and time-of-flight frames as pixel tables, decoded on the executors; and images as files.

PNG (8 bits, not interlaced), PNM and MAT level 5 files are read without other libraries; where Pillow is installed, all its formats are.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "frame int, path string, w int, h int, x int, y int, c0 double, c1 double, c2 double"
TOF = "frame int, path string, w int, h int, node long, X double, Y double, Z double, I double"
#: File names that count as frames.
FRAMES = "*.{jpg,jpeg,png,ppm,pgm,pnm,mat}"


def decode_png(data: bytes) -> np.ndarray:
    """(h, w, bands) of an 8-bit PNG without interlacing; palettes are looked up."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, palette = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    if depth != 8 or interlace:
        raise ValueError("only 8-bit PNG files without interlacing are read")
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * bands)
    out = np.zeros((h, w * bands), np.uint8)
    above = np.zeros(w * bands, np.int64)
    for y in range(h):
        how, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        if how == 2:
            line = line + above
        elif how:
            for i in range(w * bands):
                left = line[i - bands] if i >= bands else 0
                if how == 1:
                    guess = left
                elif how == 3:
                    guess = (left + above[i]) // 2
                else:
                    corner = above[i - bands] if i >= bands else 0
                    p = left + above[i] - corner
                    guess = min((left, above[i], corner), key=lambda v, p=p: abs(p - v))
                line[i] = (line[i] + guess) & 255
        above = line & 255
        out[y] = above
    out = out.reshape(h, w, bands)
    return palette[out[..., 0]] if colour == 3 else out


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG file of (h, w) or (h, w, 3) bytes."""
    pixels = np.asarray(pixels, np.uint8)
    h, w = pixels.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], 1)

    def chunk(kind: bytes, part: bytes) -> bytes:
        return struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decode_pnm(data: bytes) -> np.ndarray:
    """(h, w, bands) of a PGM or PPM file, plain or raw."""
    kind, words, at = data[:2], [], 2
    while len(words) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        words.append(int(data[at:end]))
        at = end
    (w, h, most), bands = words, 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P2", b"P3"):
        values = np.array(data[at:].split()[: w * h * bands], float)
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", w * h * bands, at + 1).astype(float)
    return (values * 255 / most).reshape(h, w, bands)


def decode_image(data: bytes) -> np.ndarray:
    """(h, w, bands), values 0..255."""
    if data[:4] == b"\x89PNG":
        return decode_png(data)
    if data[:2] in (b"P2", b"P3", b"P5", b"P6"):
        return decode_pnm(data)
    try:
        from PIL import Image
    except ImportError:
        raise ValueError("this image format needs Pillow") from None
    image = np.asarray(Image.open(io.BytesIO(data)))
    return image if image.ndim == 3 else image[..., None]


def decode_mat(data: bytes) -> dict[str, np.ndarray]:
    """Numeric arrays of a MAT level 5 file by name."""
    order = "<" if data[126:128] == b"IM" else ">"
    numbers = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}

    def elements(block: bytes) -> Iterator[tuple[int, bytes]]:
        at = 0
        while at + 8 <= len(block):
            kind, size = struct.unpack(order + "II", block[at : at + 8])
            if kind >> 16:  # small element: size and type in one word
                yield kind & 0xFFFF, block[at + 4 : at + 4 + (kind >> 16)]
                at += 8
                continue
            yield kind, block[at + 8 : at + 8 + size]
            at += 8 + (size if kind == 15 else -(-size // 8) * 8)

    out = {}
    for kind, body in elements(data[128:]):
        for inner, array in elements(zlib.decompress(body)) if kind == 15 else [(kind, body)]:
            if inner != 14:
                continue
            parts = list(elements(array))
            shape = np.frombuffer(parts[1][1], order + "i4")
            values = np.frombuffer(parts[3][1], order + numbers[parts[3][0]]).astype(float)
            out[parts[2][1].decode()] = values.reshape(shape, order="F")
    return out


def _files(spark: SparkSession, path: str, all_frames: bool) -> DataFrame:
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("pathGlobFilter", FRAMES).load(path)
    numbered = files.select((F.row_number().over(Window.orderBy("path")) - 1).alias("frame"), "path")  # names only
    if not all_frames:
        numbered = numbered.where("frame = 0")
    return files.select("path", "content").join(numbered, "path")


def read_pixels(spark: SparkSession, path: str, all_frames: bool = False) -> DataFrame:
    """frame, path, w, h, x, y, c0..c2 of the first image of a path, or of all in order of their names.

    Grey images have their values in c0 and zeros in the others; bands past the third are left out.
    """
    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for frame, name, content in zip(part["frame"], part["path"], part["content"], strict=True):
                image = decode_image(bytes(content)).astype(float)
                h, w, bands = image.shape
                bands = 1 if bands < 3 else 3
                x, y = np.meshgrid(np.arange(w), np.arange(h), indexing="ij")
                values = {f"c{k}": image[..., k].T.ravel() if k < bands else 0.0 for k in range(3)}
                yield pd.DataFrame({"frame": frame, "path": name, "w": w, "h": h, "x": x.ravel(), "y": y.ravel(), **values})

    return _files(spark, path, all_frames).select("frame", "path", "content").mapInPandas(decode, PIXELS)


def read_tof(spark: SparkSession, path: str, all_frames: bool = False) -> DataFrame:
    """frame, path, w, h, node, X, Y, Z, I of MAT files with these four arrays; the size is that of X."""
    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for frame, name, content in zip(part["frame"], part["path"], part["content"], strict=True):
                arrays = decode_mat(bytes(content))
                if missing := [c for c in "XYZI" if c not in arrays]:
                    raise ValueError(f"{name} lacks the arrays {missing}")
                h, w = arrays["X"].shape
                yield pd.DataFrame({"frame": frame, "path": name, "w": w, "h": h, "node": np.arange(w * h), **{c: arrays[c].ravel(order="F") for c in "XYZI"}})

    return _files(spark, path, all_frames).select("frame", "path", "content").mapInPandas(decode, TOF)


def write_images(pixels: DataFrame, folder: str, thumbnail: bool = False) -> DataFrame:
    """frame, file of PNG images part-00000.png .. of a pixel table (frame, x, y, c0..c2), one image a task, written as rows of bytes under ``folder``.

    With ``thumbnail`` a smaller image, at most 144 x 176 or a quarter of the size, goes beside each.
    """
    def encode(part: pd.DataFrame) -> pd.DataFrame:
        w, h = int(part["x"].max()) + 1, int(part["y"].max()) + 1
        image = np.zeros((h, w, 3), np.uint8)
        for k in range(3):
            image[part["y"], part["x"], k] = np.clip(np.rint(part[f"c{k}"]), 0, 255)
        frame = int(part["frame"].iloc[0])
        rows = [(frame, f"part-{frame:05d}.png", encode_png(image))]
        if thumbnail:
            tw, th = max(w // 4, 144), max(h // 4, 176)
            small = image[np.arange(th) * h // th][:, np.arange(tw) * w // tw]
            rows.append((frame, f"part-{frame:05d}-thumb.png", encode_png(small)))
        return pd.DataFrame(rows, columns=["frame", "file", "content"])

    made = pixels.select("frame", "x", "y", "c0", "c1", "c2").groupBy("frame").applyInPandas(encode, "frame int, file string, content binary")
    made.write.mode("overwrite").parquet(folder)
    return pixels.sparkSession.read.parquet(folder)
