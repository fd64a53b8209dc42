"""Media columns: payloads stored as progressive JPEG, decoded to coefficients and full-resolution RGB tensors.

A payload's bytes become coefficients (the format's unit), 64 to a block and six blocks to a unit of four luma and two
chroma blocks, so that nothing is lost.  The scans are accumulated into coefficient arrays when read back.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import jpeg
from factloom.llm.common import slices, table, text_bytes, tidy

BLOCK = 64


def to_units(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of coefficients of payloads (each padded with zeros to whole blocks, one at least), units a row and rows
    of each image, and each payload's blocks."""
    size = np.diff(ends)
    blocks = np.maximum(-(-size // BLOCK), 1)
    wide, high = jpeg.grid(-(-blocks // jpeg.PER_UNIT))
    first = np.concatenate([[0], np.cumsum(wide * high * jpeg.PER_UNIT)])
    out = np.zeros((first[-1], BLOCK), np.int16)
    n = np.repeat(np.arange(len(size)), blocks)
    own = np.arange(len(n)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    out[first[n] + own] = -128  # a payload's padding is bytes of 0
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(len(size)), size)
    flat[np.arange(len(data)) - ends[doc] + first[doc] * BLOCK] = data.astype(np.int16) - 128
    return out.reshape(-1, jpeg.PER_UNIT, BLOCK), wide, high, blocks


def from_image(im: jpeg.Image) -> np.ndarray:
    """All blocks of a stored image in the order of its units, as coefficients."""
    y, cb, cr = im.coefficients
    rows, cols = cb.shape[:2]
    luma = y.reshape(rows, 2, cols, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(-1, 4, BLOCK)
    return np.concatenate([luma, cb.reshape(-1, 1, BLOCK), cr.reshape(-1, 1, BLOCK)], 1).reshape(-1, BLOCK)


@dataclass
class Stored:
    media: bytes
    payload: bytes
    tensor: np.ndarray
    feature: str


def store(data: np.ndarray, ends: np.ndarray) -> list[Stored]:
    """Writes payloads as files, reads the files back and computes each image's tensor and feature."""
    units, wide, high, blocks = to_units(data, ends)
    files = jpeg.encode(units, wide, high, [str(n).encode() for n in blocks.tolist()])
    images = jpeg.decode(files)
    every = [from_image(im) for im in images]
    count = np.array([len(b) // jpeg.PER_UNIT for b in every])
    at = np.concatenate([[0], np.cumsum(count)])
    all_units = np.concatenate(every).reshape(-1, jpeg.PER_UNIT, BLOCK)
    tensors = unit_rgb(all_units)
    out = []
    for k, (f, im, b) in enumerate(zip(files, images, every, strict=True)):
        n = int(im.note)
        payload = (b[:n] + 128).astype(np.uint8).tobytes()
        rows, cols = im.height // 16, im.width // 16
        tensor = tensors[at[k] : at[k + 1]].reshape(rows, cols, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(im.height, im.width, 3)
        out.append(Stored(f, payload, tensor, feature(tensor)))
    return out


def unit_rgb(units: np.ndarray) -> np.ndarray:
    """Units of coefficients, quantised by one, as 16 x 16 RGB tiles; chroma samples are repeated."""
    s = jpeg.samples(units.reshape(-1, BLOCK), np.ones(BLOCK, np.int32)).reshape(-1, jpeg.PER_UNIT, 8, 8)
    y = s[:, :4].reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16)
    cb, cr = (s[:, k].repeat(2, 1).repeat(2, 2) for k in (4, 5))
    return jpeg.to_rgb(y, cb, cr)


def feature(tensor: np.ndarray) -> str:
    """Height and width, the sum of each channel, and a checksum of the tensor's bytes."""
    flat = np.ascontiguousarray(tensor)
    r, g, b = flat.reshape(-1, 3).sum(0, dtype=np.int64).tolist()
    return f"{tensor.shape[0]}x{tensor.shape[1]}:{r},{g},{b}:{zlib.crc32(flat):08x}"


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Stores each text as an image and reads it back: id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature; with_media also media (the file) and tensor (its RGB bytes, row by row).

    A null text counts as empty, and an empty one is a block of zeros; equal texts give equal values.  Whole texts of
    any length are stored, one image each; rows may repeat; other columns are ignored.
    """

    def run(batches):
        for b, col in slices(batches, text_col, 1 << 20):
            data, ends = text_bytes(col)
            got = store(data, ends)
            cols = [
                b.column(b.schema.get_field_index(id_col)),
                pa.array(np.diff(ends)),
                pa.array([len(s.payload) for s in got], pa.int64()),
                pa.array([hashlib.sha256(s.payload).hexdigest() for s in got]),
                pa.array([zlib.crc32(s.payload[-BLOCK:]) for s in got], pa.int64()),
                pa.array([len(s.media) for s in got], pa.int64()),
                pa.array([hashlib.sha256(s.media).hexdigest() for s in got]),
                pa.array([s.feature for s in got]),
            ]
            if with_media:
                cols += [pa.array([s.media for s in got], pa.binary()), pa.array([s.tensor.tobytes() for s in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["media", "tensor"] if with_media else [])]
    rows = df.select(id_col, text_col)
    schema = f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(tidy(run), schema + ", media binary, tensor binary" * with_media)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null texts are empty, equal texts give equal values, repeats a row each; see `media_column`."""
    return media_column(table(spark, sf_dir, "documents"))
