"""Writing pixels as PNG and triangles as binary STL.

Tasks turn their rows into finished bytes: rows of pixels, or 50-byte triangles. The driver
only passes these through, one partition at a time and in order, into a file that appears
under its name when it is whole.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelith.operators.mesh import SIDES, normal

PNG_MARK = b"\x89PNG\r\n\x1a\n"
STL_HEAD = b"voxelith".ljust(80, b"\x00")
#: One triangle of a binary STL file.
STL_ROW = np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("attribute", "<u2")])


def _whole(path: str) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    return f"{path}.part"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pixel_rows(pixels: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """py, x0 and row, the bytes of a run of pixels from x0 on, in the order of the image."""

    def strips(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame[list(bands)].to_numpy(dtype=np.uint8)
            for y, at in frame.groupby("py").indices.items():
                order = at[np.argsort(frame["px"].to_numpy()[at])]
                yield pd.DataFrame({"py": [y], "x0": [int(frame["px"].to_numpy()[order[0]])], "row": [values[order].tobytes()]})

    rows = pixels.select("px", "py", *bands).repartitionByRange("py").sortWithinPartitions("py", "px")
    return rows.mapInPandas(strips, "py int, x0 int, row binary")


def write_png(pixels: DataFrame, path: str, width: int, height: int, bands: tuple[str, ...]) -> None:
    """Writes pixels(px, py, bands): one band is gray, three are RGB, four RGBA, two gray with alpha."""
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[len(bands)]
    parts = pixel_rows(pixels, bands)
    temporary = _whole(path)
    packer = zlib.compressobj(6)
    with open(temporary, "wb") as out:
        out.write(PNG_MARK + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)))
        seen, line = -1, b""
        for part in parts.toLocalIterator():
            if part.py != seen:
                line = _flush(out, packer, line, seen, width * len(bands))
                seen = part.py
            line += bytes(part.row)
        _flush(out, packer, line, seen, width * len(bands))
        if seen != height - 1:
            raise ValueError(f"{seen + 1} rows of pixels instead of {height}")
        out.write(_chunk(b"IDAT", packer.flush()) + _chunk(b"IEND", b""))
    os.replace(temporary, path)


def _flush(out, packer, line: bytes, at: int, size: int) -> bytes:
    if at >= 0:
        if len(line) != size:
            raise ValueError(f"row {at} has {len(line)} bytes instead of {size}")
        data = packer.compress(b"\x00" + line)
        if data:
            out.write(_chunk(b"IDAT", data))
    return b""


def read_png(path: str) -> np.ndarray:
    """(height, width, bands) of a PNG as written above."""
    with open(path, "rb") as f:
        data = f.read()
    at, body, head = len(PNG_MARK), b"", b""
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        head, body = (part, body) if kind == b"IHDR" else (head, body + part * (kind == b"IDAT"))
        at += 12 + size
    width, height, _, colour = struct.unpack(">IIBB", head[:10])
    bands = {0: 1, 4: 2, 2: 3, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(height, 1 + width * bands)
    if raw[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return raw[:, 1:].reshape(height, width, bands)


def triangle_bytes(triangles: DataFrame, order: list) -> DataFrame:
    """part (of the order) and data, the bytes of its triangles."""
    flat = [F.col(f"{v}.{i}").alias(f"{v}{i}") for v in ("n", "v0", "v1", "v2") for i in "xyz"]
    placed = triangles.withColumn("n", normal()).select(*order, *flat)
    names = [f"{v}{i}" for v in ("n", "v0", "v1", "v2") for i in "xyz"]

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = np.zeros(len(frame), dtype=STL_ROW)
            values = frame[names].to_numpy(dtype=np.float32)
            out["n"], out["v"] = values[:, :3], values[:, 3:].reshape(-1, 3, 3)
            yield pd.DataFrame({"n": [len(frame)], "data": [out.tobytes()]})

    keys = [c for c in placed.columns if c not in names]
    sorted_ = placed.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else placed
    return sorted_.mapInPandas(pack, "n long, data binary")


def write_stl(path: str, triangles: DataFrame, boxes: DataFrame | None = None) -> int:
    """Writes a solid's triangles in the order of its sides, then those of the boxes; returns their number.

    The count in the head is that of the rows really written.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in SIDES]), F.col("side"))
    streams = [triangle_bytes(triangles, [rank.alias("s"), "r", "c", "k"])]
    if boxes is not None:
        streams.append(triangle_bytes(boxes, ["box", "k"]))
    temporary = _whole(path)
    total = 0
    with open(temporary, "wb") as out:
        out.write(STL_HEAD + struct.pack("<I", 0))
        for stream in streams:
            for part in stream.toLocalIterator():
                out.write(part.data)
                total += part.n
        out.seek(len(STL_HEAD))
        out.write(struct.pack("<I", total))
    os.replace(temporary, path)
    return total


def read_stl(path: str) -> np.ndarray:
    """The triangles of a binary STL file; raises if its size and count disagree."""
    with open(path, "rb") as f:
        data = f.read()
    count = struct.unpack_from("<I", data, 80)[0]
    if len(data) != 84 + 50 * count:
        raise ValueError("the file's size is not that of its triangles")
    return np.frombuffer(data, dtype=STL_ROW, offset=84)


def tile_path(folder: str, tz: int, tx: int) -> str:
    return os.path.join(folder, f"tile_{tz:03d}_{tx:03d}.stl")


def write_tiles(triangles: DataFrame, boxes: DataFrame, folder: str) -> DataFrame:
    """One STL file for each tile (tz, tx), written by the task that holds the tile.

    folder must be visible to all executors. Returns tz, tx and n of the files written.
    """
    solid = triangles.select(
        "tz", "tx", F.array_position(F.array(*[F.lit(s) for s in SIDES]), F.col("side")).cast("int").alias("a"),
        F.col("r").cast("long").alias("b"), F.col("c").cast("long").alias("d"), "k", "v0", "v1", "v2",
    )
    ring = boxes.select("tz", "tx", F.lit(99).alias("a"), F.col("box").cast("long").alias("b"), F.lit(0).cast("long").alias("d"), "k", "v0", "v1", "v2")
    whole = solid.unionByName(ring).withColumn("n", normal())
    names = [f"{v}{i}" for v in ("n", "v0", "v1", "v2") for i in "xyz"]
    flat = [F.col(f"{v}.{i}").alias(f"{v}{i}") for v in ("n", "v0", "v1", "v2") for i in "xyz"]

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["a", "b", "d", "k"], kind="stable")
        out = np.zeros(len(frame), dtype=STL_ROW)
        values = frame[names].to_numpy(dtype=np.float32)
        out["n"], out["v"] = values[:, :3], values[:, 3:].reshape(-1, 3, 3)
        tz, tx = int(frame["tz"].iloc[0]), int(frame["tx"].iloc[0])
        path = tile_path(folder, tz, tx)
        temporary = f"{_whole(path)}-{os.getpid()}"
        with open(temporary, "wb") as f:
            f.write(STL_HEAD + struct.pack("<I", len(out)) + out.tobytes())
        os.replace(temporary, path)
        return pd.DataFrame({"tz": [tz], "tx": [tx], "n": [len(out)]})

    return whole.select("tz", "tx", "a", "b", "d", "k", *flat).groupBy("tz", "tx").applyInPandas(write, "tz int, tx int, n long")


def finished_tiles(spark, folder: str) -> DataFrame:
    """tz and tx of the tile files that are whole: their size fits their count."""
    schema = T.StructType([T.StructField("tz", T.IntegerType()), T.StructField("tx", T.IntegerType())])
    done = []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        parts = name.removesuffix(".stl").split("_")
        if name.startswith("tile_") and name.endswith(".stl") and len(parts) == 3:
            path = os.path.join(folder, name)
            with open(path, "rb") as f:
                head = f.read(84)
            if len(head) == 84 and os.path.getsize(path) == 84 + 50 * struct.unpack_from("<I", head, 80)[0]:
                done.append((int(parts[1]), int(parts[2])))
    return spark.createDataFrame(done, schema)
