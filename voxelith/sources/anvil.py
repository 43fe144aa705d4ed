"""Region files as relations.

A region file starts with 1024 big-endian words, one for each chunk of 32 x 32: the upper
three bytes number its first 4096-byte sector, the lowest counts its sectors. A chunk record
is a big-endian length, a compression byte (1 gzip, 2 zlib, 3 none) and the tags. One row of
Spark's binaryFile is one region; decoding runs in Arrow batches on the executors, and only
what the asked columns need is decoded.
"""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.functions.bits import palette_bits, unpack_array
from voxelith.functions.blocks import WATER, skipped
from voxelith.operators.regions import label_voxels
from voxelith.sources import nbt

SECTOR = 4096
NAME = re.compile(r"r\.(-?\d+)\.(-?\d+)\.mca$")
# The stored height maps in order of preference.
SURFACE_MAPS = ("WORLD_SURFACE", "MOTION_BLOCKING", "WORLD_SURFACE_WG", "MOTION_BLOCKING_NO_LEAVES")
GROUND_MAPS = ("MOTION_BLOCKING_NO_LEAVES", "MOTION_BLOCKING", "WORLD_SURFACE")


@dataclass(frozen=True)
class ScanOptions:
    """How heights are found.

    ground_only prefers maps without leaves and, in section scans, skips blocks that are no
    ground. Stored maps are used unless detect_floating or force_scan asks for the blocks.
    y_offset is added to stored heights, which count from the chunk's lowest level.
    """

    ground_only: bool = False
    detect_floating: bool = False
    force_scan: bool = False
    water: bool = False
    y_offset: int = 0


def region_place(path: str) -> tuple[int, int] | None:
    found = NAME.search(path)
    return (int(found[1]), int(found[2])) if found else None


def chunk_records(data: bytes) -> Iterator[tuple[int, int, dict]]:
    """Local x and z and tags of each readable chunk; damaged ones are left out."""
    if len(data) < SECTOR:
        return
    for slot, word in enumerate(struct.unpack(">1024I", data[:SECTOR])):
        start, sectors = (word >> 8) * SECTOR, word & 255
        if not start or not sectors or start + 5 > len(data):
            continue
        size, how = struct.unpack_from(">IB", data, start)
        body = data[start + 5 : start + 4 + size]
        if size < 1 or len(body) != size - 1:
            continue
        try:
            if how == 1:
                body = gzip.decompress(body)
            elif how == 2:
                body = zlib.decompress(body)
            elif how != 3:
                continue
        except (OSError, EOFError, zlib.error):
            continue
        root = nbt.parse(body)
        if root is not None:
            yield slot % 32, slot // 32, root


def sections(chunk: dict) -> dict[int, dict]:
    """Sections of a chunk by number."""
    found = chunk.get("sections") or chunk.get("Sections") or []
    return {int(s.get("Y", s.get("y", 0))): s for s in found}


def _palette(section: dict) -> tuple[list[str], np.ndarray | None] | None:
    """Names and packed indices of a section; no indices if one block fills it."""
    if "block_states" in section:
        state = section["block_states"]
        entries, data = state.get("palette") or [], state.get("data")
    elif "BlockStates" in section and "Palette" in section:
        entries, data = section["Palette"], section["BlockStates"]
    else:
        return None
    names = [str(e.get("Name", "")) if isinstance(e, dict) else str(e) for e in entries]
    return (names, data) if names else None


def _flags(section: dict, test) -> np.ndarray | None:
    """A boolean cube (y, z, x) of test over the block names; the test runs once for each palette entry."""
    found = _palette(section)
    if found is None:
        return None
    names, data = found
    flags = np.array([test(n) for n in names])
    if data is None:
        return np.full((16, 16, 16), flags[0])
    return flags[unpack_array(data, palette_bits(len(names)), 4096)].reshape(16, 16, 16)


def solid_blocks(section: dict, ground_only: bool) -> np.ndarray | None:
    """Blocks that count, by (y, z, x). Numeric ids of old files count unless 0, whatever ground_only says."""
    cube = _flags(section, lambda n: not skipped(n, ground_only))
    if cube is None and len(section.get("Blocks", b"")) == 4096:
        return np.frombuffer(bytes(section["Blocks"]), dtype=np.uint8).reshape(16, 16, 16) != 0
    return cube


def scan_heights(chunk: dict, options: ScanOptions) -> np.ndarray | None:
    """Heights (z, x) from the blocks: 0 in empty columns, or the lowest level if only grounded blocks count."""
    parts = sections(chunk)
    if not parts:
        return None
    low, high = min(parts), max(parts)
    cube = np.zeros(((high - low + 1) * 16, 16, 16), dtype=bool)
    for number, section in parts.items():
        try:
            solid = solid_blocks(section, options.ground_only)
        except (IndexError, ValueError, TypeError):
            continue
        if solid is not None:
            cube[(number - low) * 16 : (number - low + 1) * 16] = solid
    bare = 0
    if options.detect_floating:
        bare = low * 16
        if cube.any():
            label = label_voxels(cube)
            seeds = np.unique(label[:16][cube[:16]])
            if not len(seeds):
                lowest = int(np.argmax(cube.any(axis=(1, 2))))
                seeds = np.unique(label[lowest][cube[lowest]])
            cube = np.isin(label, seeds) & cube
    top = low * 16 + len(cube) - np.argmax(cube[::-1], axis=0)
    return np.where(cube.any(axis=0), top, bare).astype(np.int64)


def stored_heights(chunk: dict, options: ScanOptions) -> np.ndarray | None:
    maps = chunk.get("Heightmaps") or {}
    for name in GROUND_MAPS if options.ground_only else SURFACE_MAPS:
        if len(maps.get(name, ())):
            return unpack_array(maps[name], 9, 256).reshape(16, 16) + options.y_offset
    flat = chunk.get("HeightMap", ())
    return np.asarray(flat[:256], dtype=np.int64).reshape(16, 16) + options.y_offset if len(flat) >= 256 else None


def heights(root: dict, options: ScanOptions) -> np.ndarray | None:
    chunk = root.get("Level", root)
    if not options.detect_floating and not options.force_scan:
        found = stored_heights(chunk, options)
        if found is not None:
            return found
    return scan_heights(chunk, options)


def water_flags(root: dict, tops: np.ndarray) -> np.ndarray:
    """Whether the block right below each height is water, at any level and in uniform sections too."""
    out = np.zeros((16, 16), dtype=bool)
    z, x = np.mgrid[0:16, 0:16]
    for number, section in sections(root.get("Level", root)).items():
        y = tops - 1 - number * 16
        here = (y >= 0) & (y < 16)
        if here.any():
            wet = _flags(section, lambda n: n in WATER)
            if wet is not None:
                out[here] = wet[y[here], z[here], x[here]]
    return out


CHUNKS = "cx int, cz int, h array<int>"
_ARROW = [("cx", pa.int32()), ("cz", pa.int32()), ("h", pa.list_(pa.int32())), ("path", pa.string())]


def decode_regions(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """chunks(cx, cz, h, path and, if asked for, water) of binaryFile rows (path, content)."""
    arrow = pa.schema(_ARROW + [("water", pa.list_(pa.bool_()))] * options.water)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                place = region_place(path)
                if place is None:
                    continue
                rows = []
                for lx, lz, root in chunk_records(content.as_py()):
                    found = heights(root, options)
                    if found is not None:
                        row = (place[0] * 32 + lx, place[1] * 32 + lz, found.ravel().tolist(), path)
                        rows.append(row + ((water_flags(root, found).ravel().tolist(),) if options.water else ()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return files.select("path", "content").mapInArrow(run, CHUNKS + ", path string" + ", water array<boolean>" * options.water)


def region_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content, rx and rz of a folder's region files; content is read only where it is used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "r.*.*.mca").load(folder)
    pattern = NAME.pattern
    return files.select(
        "path", "content", F.regexp_extract("path", pattern, 1).cast("int").alias("rx"), F.regexp_extract("path", pattern, 2).cast("int").alias("rz")
    )


def write_region(chunks: dict[tuple[int, int], dict], compression: int = 2) -> bytes:
    """A region file of chunk tags by local place."""
    return pack_region({place: (nbt.dump(root), compression) for place, root in chunks.items()})


def pack_region(records: dict[tuple[int, int], tuple[bytes, int]]) -> bytes:
    """A region file of dumped tags and their compression by local place; an unknown compression stores them as they are."""
    table, body = [0] * 1024, b""
    for (lx, lz), (raw, compression) in sorted(records.items()):
        packed = {1: gzip.compress, 2: zlib.compress}.get(compression, bytes)(raw)
        record = struct.pack(">IB", len(packed) + 1, compression) + packed
        record += b"\x00" * (-len(record) % SECTOR)
        table[lz * 32 + lx] = ((2 + len(body) // SECTOR) << 8) | (len(record) // SECTOR)
        body += record
    return struct.pack(">1024I", *table) + b"\x00" * SECTOR + body


def encode_regions(tags: DataFrame) -> DataFrame:
    """Region files (path, content) of chunks (cx, cz, tags, compression); a task holds one region's 1024 chunks at most."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        rx, rz = int(frame["cx"].iloc[0]) >> 5, int(frame["cz"].iloc[0]) >> 5
        records = {
            (int(cx) & 31, int(cz) & 31): (bytes(raw), int(how))
            for cx, cz, raw, how in zip(frame["cx"], frame["cz"], frame["tags"], frame["compression"], strict=True)
        }
        return pd.DataFrame({"path": [f"r.{rx}.{rz}.mca"], "content": [pack_region(records)]})

    return tags.groupBy(F.shiftright("cx", 5), F.shiftright("cz", 5)).applyInPandas(
        lambda frame: pack(frame), "path string, content binary"
    )


def pack_longs(values: np.ndarray, bits: int, aligned: bool = True) -> np.ndarray:
    """Numbers of so many bits in longs: none across two longs if aligned, else one stream of bits."""
    out: list[int] = []
    if aligned:
        each = 64 // bits
        for i in range(0, len(values), each):
            out.append(sum(int(v) << (bits * k) for k, v in enumerate(values[i : i + each])))
    else:
        stream = sum(int(v) << (bits * k) for k, v in enumerate(values))
        out = [(stream >> (64 * i)) & (2**64 - 1) for i in range(-(-len(values) * bits // 64))]
    return np.array(out, dtype=np.uint64).view(np.int64)
