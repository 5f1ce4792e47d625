"""Media columns: Netpbm and BMP to numpy arrays, area resizing by integral images, NPY tiles and difference hashes.

``process`` takes any binary column of images. ``store`` writes texts losslessly as images: their bytes, zero padded
to a multiple of 64, are the samples of an 8-bit grey image 64 wide; ``digests`` stores, reads the stored bytes back
through the decoder and the NPY tiles, and describes what it read.

Cases: null text is empty (64 zero bytes); a null doc_id stays null; null or undecodable media give a row with null
features and an ``error``; repeated rows are treated each; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textnp

WIDTH = 64
BMP_FROM = 1 << 14
TILE = 64
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
PROCESS_SCHEMA = "id long, height int, width int, channels int, dhash string, tiles array<struct<top:int,left:int,npy:binary>>, error string"
_GAP = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])+")


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """8 bits a sample with a grey palette, rows from the bottom up."""
    height, width = image.shape
    rows = np.zeros((height, -(-width // 4) * 4), np.uint8)
    rows[:, :width] = image[::-1]
    grey = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    grey[:, 3] = 0
    start = 14 + 40 + 1024
    return struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + grey.tobytes() + rows.tobytes()


def _netpbm(raw: bytes) -> np.ndarray:
    kind, at, fields = raw[1] - 48, 2, []
    while len(fields) < (2 if kind in (1, 4) else 3):
        gap = _GAP.match(raw, at)
        at = gap.end() if gap else at
        number = re.compile(rb"\d+").match(raw, at)
        if not number:
            raise ValueError("header")
        fields.append(int(number[0]))
        at = number.end()
    (width, height), most = fields[:2], fields[2] if len(fields) > 2 else 1
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if kind <= 3:
        body = re.sub(rb"#[^\n\r]*", b" ", raw[at:])
        values = [int(x) for x in (re.findall(rb"[01]", body) if kind == 1 else body.split())]
        data = np.array(values[:n], np.uint16)
    elif kind == 4:
        row = -(-width // 8)
        bits = np.frombuffer(raw, np.uint8, row * height, at + 1).reshape(height, row)
        data = np.unpackbits(bits, axis=1)[:, :width].ravel()
    else:
        data = np.frombuffer(raw, np.uint8 if most < 256 else np.dtype(">u2"), n, at + 1)
    if len(data) < n:
        raise ValueError("short")
    if kind in (1, 4):
        data, most = 1 - data, 1  # 1 is black
    if most != 255:
        data = (data.astype(np.uint32) * 255 + most // 2) // most
    image = data.astype(np.uint8).reshape(height, width, channels)
    return image if channels == 3 else image[:, :, 0]


def _bmp(raw: bytes) -> np.ndarray:
    start, header, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", raw, 10)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0:
        raise ValueError("kind of BMP")
    rows, stride = abs(height), -(-width * bits // 32) * 4
    body = np.frombuffer(raw, np.uint8, stride * rows, start).reshape(rows, stride)
    body = body[::-1] if height > 0 else body
    if bits >= 24:
        return body[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1].copy()
    colours = struct.unpack_from("<I", raw, 46)[0] or 1 << bits
    palette = np.frombuffer(raw, np.uint8, 4 * colours, 14 + header).reshape(-1, 4)[:, 2::-1]
    index = body if bits == 8 else np.unpackbits(body, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits)[::-1])
    index = index[:, :width]
    grey = bool((palette[:, 0] == palette[:, 1]).all() and (palette[:, 0] == palette[:, 2]).all())
    return palette[:, 0][index] if grey else palette[index]


def decode(raw: bytes) -> np.ndarray:
    """uint8 array, height x width for grey and height x width x 3 for colour."""
    if raw[:1] == b"P" and raw[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(raw)
    if raw[:2] == b"BM":
        return _bmp(raw)
    raise ValueError("neither Netpbm nor BMP")


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area, from one integral image read at fractional places."""
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def at(n: int, parts: int):
        x = np.linspace(0, n, parts + 1)
        low = np.minimum(x.astype(np.int64), n - 1)
        return low, x - low

    (r, fr), (c, fc) = at(image.shape[0], height), at(image.shape[1], width)
    lines = total[r] * (1 - fr)[:, None] + total[r + 1] * fr[:, None]
    corners = lines[:, c] * (1 - fc) + lines[:, c + 1] * fc
    area = (image.shape[0] / height) * (image.shape[1] / width)
    return np.diff(np.diff(corners, axis=0), axis=1) / area


def dhash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 9 cell means is less than its right neighbour."""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    small = np.round(resize(grey, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def tiles(image: np.ndarray, size: int = TILE) -> list[tuple[int, int, bytes]]:
    """(top, left, NPY file) of each tile; those at the edges are smaller."""
    out = []
    for top in range(0, image.shape[0], size):
        for left in range(0, image.shape[1], size):
            np.lib.format.write_array(file := io.BytesIO(), np.ascontiguousarray(image[top : top + size, left : left + size]), version=(1, 0), allow_pickle=False)
            out.append((top, left, file.getvalue()))
    return out


def join_tiles(parts: list[tuple[int, int, bytes]], shape: tuple[int, ...]) -> np.ndarray:
    image = np.zeros(shape, np.uint8)
    for top, left, npy in parts:
        part = np.lib.format.read_array(io.BytesIO(npy), allow_pickle=False)
        image[top : top + part.shape[0], left : left + part.shape[1]] = part
    return image


def process(table: DataFrame, id_column: str, media_column: str, size: int = TILE) -> DataFrame:
    """id, height, width, channels, dhash, tiles and error of each row of a binary column."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = dict.fromkeys(("id", "height", "width", "channels", "dhash", "tiles", "error"))
                row["id"] = i
                try:
                    image = decode(raw or b"")
                    row |= {"height": image.shape[0], "width": image.shape[1], "channels": 1 if image.ndim == 2 else 3, "dhash": dhash(image)}
                    row["tiles"] = [dict(zip(("top", "left", "npy"), t, strict=True)) for t in tiles(image, size)]
                except (ValueError, IndexError, struct.error) as e:
                    row["error"] = str(e) or type(e).__name__
                rows.append(row)
            kinds = pa.schema([("id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("dhash", pa.string()), ("tiles", pa.list_(pa.struct([("top", pa.int32()), ("left", pa.int32()), ("npy", pa.binary())]))), ("error", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return table.selectExpr(f"CAST(`{id_column}` AS BIGINT) AS id", f"`{media_column}` AS media").mapInArrow(run, PROCESS_SCHEMA)


def payload_image(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), np.uint8)
    out[: len(raw)] = raw
    return out.reshape(-1, WIDTH)


def store_bytes(raw: np.ndarray, bmp_from: int = BMP_FROM) -> bytes:
    """PGM for short payloads, for its small header; BMP, with rows at fixed offsets, from ``bmp_from`` bytes on."""
    image = payload_image(raw)
    return encode_pgm(image) if image.size < bmp_from else encode_bmp(image)


def store(docs: DataFrame, bmp_from: int = BMP_FROM) -> DataFrame:
    """doc_id, n_bytes and media of each document; bmp_from: 0 for BMP alone, a very large one for PGM alone."""

    def run(batches):
        for batch in batches:
            raw, at = textnp.utf8(batch.column("text"))
            media = [store_bytes(raw[a:b], bmp_from) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(media, pa.large_binary()).cast(pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def digests(stored: DataFrame) -> DataFrame:
    """The payload read back from ``store``'s media through decoder and tiles, and features of the image."""

    def run(batches):
        for batch in batches:
            rows = []
            for n, media in zip(batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
                media = media.as_buffer()
                image = decode(media.to_pybytes())
                payload = join_tiles(tiles(image, TILE), image.shape).tobytes()
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), media.size, hashlib.sha256(media).hexdigest(), f"dhash:{dhash(image)}"))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *names])

    return stored.mapInArrow(run, SCHEMA)
