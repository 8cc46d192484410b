"""Media columns: Netpbm and BMP images to numpy arrays, NPY tiles and difference hashes.

Defined results: null or undecodable bytes, samples above the stated maximum and
headers that promise more than the bytes hold give a row with null width, height,
tile and hash and a reason in ``media_error``. Columns of the input that clash
with the ones added here are replaced; repeated rows repeat; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAD = 64
TILE = 16
#: Pixels that are summed at once, at least a row; bounds the memory of a large image.
BAND_CELLS = 1 << 18


class MediaError(ValueError):
    """The bytes are no image that this module reads."""


def _numbers(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    """The next ``n`` numbers of a Netpbm header, after white space and comments, and where they end."""
    token, out = re.compile(rb"(?:[ \t-\r]|#[^\n]*\n)*([0-9]{1,9})(?![0-9])"), []
    for _ in range(n):
        m = token.match(data, at)
        if not m:
            raise MediaError("bad Netpbm header")
        out.append(int(m[1]))
        at = m.end()
    return out, at


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1:2]
    fields, at = _numbers(data, 2, 2 if kind in b"14" else 3)
    w, h, top = (*fields, 1)[:3]
    depth = 3 if kind in b"36" else 1
    if w <= 0 or h <= 0 or not 0 < top < 65536:
        raise MediaError("bad Netpbm size")
    n, short = w * h * depth, MediaError("short Netpbm body")
    if n > 8 * len(data):  # no form stores a sample in less than a bit
        raise short
    if kind in b"123":
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        if not re.fullmatch(rb"[01 \t-\r]*" if kind == b"1" else rb"[0-9 \t-\r]*", body):
            raise MediaError("bad Netpbm sample")
        tokens = re.findall(rb"[01]", body)[:n] if kind == b"1" else [t.lstrip(b"0") for t in body.split(None, n)[:n]]
        if any(len(t) > 5 for t in tokens):  # no maximum has more digits
            raise MediaError("Netpbm sample above its maximum")
        flat = np.array([int(t or b"0") for t in tokens], np.int64)
    else:
        body = data[at + 1 :]
        if kind == b"4":
            stride = (w + 7) // 8
            if len(body) < stride * h:
                raise short
            flat = np.unpackbits(np.frombuffer(body, np.uint8, stride * h).reshape(h, stride), axis=1)[:, :w].ravel()
        else:
            sample = np.dtype(np.uint8 if top < 256 else ">u2")
            if len(body) < n * sample.itemsize:
                raise short
            flat = np.frombuffer(body, sample, n)
    if flat.size < n:
        raise short
    if int(flat.max()) > top:
        raise MediaError("Netpbm sample above its maximum")
    if kind in b"14":
        flat = 255 * (1 - flat.astype(np.int64))  # 1 is black in a bitmap
    elif top != 255:
        flat = flat.astype(np.int64) * 255 // top
    return flat.astype(np.uint8, copy=False).reshape((h, w, 3) if depth == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise MediaError("short BMP header")
    word = lambda at, n=4, signed=False: int.from_bytes(data[at : at + n], "little", signed=signed)
    start, head, w, h, bits, packed = word(10), word(14), word(18, 4, True), word(22, 4, True), word(28, 2), word(30)
    if packed or bits not in (1, 4, 8, 24, 32) or w <= 0 or h == 0 or head < 40:
        raise MediaError("BMP form not read")
    rows, stride = abs(h), (w * bits + 31) // 32 * 4
    if len(data) - start < stride * rows:
        raise MediaError("short BMP body")
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if bits >= 24:
        out = raw[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, 2::-1]
    else:
        if bits == 8:
            index = raw[:, :w]
        elif bits == 4:
            index = np.stack([raw >> 4, raw & 15], axis=2).reshape(rows, -1)[:, :w]
        else:
            index = np.unpackbits(raw, axis=1)[:, :w]
        palette = data[14 + head :][: 4 * min(word(46) or 1 << bits, 1 << bits)]
        table = np.frombuffer(palette, np.uint8, len(palette) // 4 * 4).reshape(-1, 4)[:, 2::-1]
        if int(index.max()) >= len(table):
            raise MediaError("BMP index beyond its palette")
        grey = bool((table[:, 0] == table[:, 1]).all() and (table[:, 1] == table[:, 2]).all())
        out = table[:, 0][index] if grey else table[index]
    return out[::-1] if h > 0 else out


def decode_image(data: bytes) -> np.ndarray:
    """Netpbm P1 to P6 or an uncompressed BMP, as uint8 of (height, width[, 3])."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise MediaError("unknown media type")


def encode_pgm(samples: bytes, width: int = PAD) -> bytes:
    """8-bit samples as a binary Netpbm greymap of ``width`` columns."""
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def encode_bmp(grey: np.ndarray) -> bytes:
    """A grey array as an 8-bit BMP."""
    h, w = grey.shape
    stride = (w + 3) // 4 * 4
    body = np.zeros((h, stride), np.uint8)
    body[:, :w] = grey[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    le = lambda x, n=4: int(x).to_bytes(n, "little")
    start = 54 + 1024
    return b"BM" + le(start + body.size) + le(0) + le(start) + le(40) + le(w) + le(h) + le(1, 2) + le(8, 2) + le(0) + le(body.size) + le(0) * 2 + le(256) + le(0) + palette.tobytes() + body.tobytes()


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each output cell covers, rounded half up, from integral images.

    The integral image is linear between pixel edges, so reading it at fractional
    edges weighs partly covered pixels by their share. Edges are fractions of
    ``height`` and ``width``, so all sums are whole numbers and the result is exact.
    Rows are summed in bands.
    """
    h, w = grey.shape
    x0, xr = np.divmod(np.arange(width + 1) * w, width)
    y0, yr = np.divmod(np.arange(height + 1) * h, height)
    x1 = np.minimum(x0 + 1, w)

    def columns(rows: np.ndarray) -> np.ndarray:
        """Integral over x, read at the cell edges: (rows, width + 1)."""
        run = np.zeros((rows.shape[0], w + 1), np.int64)
        np.cumsum(rows, axis=1, out=run[:, 1:], dtype=np.int64)
        return run[:, x0] * (width - xr) + run[:, x1] * xr

    at_edge, below = np.zeros((height + 1, width + 1), np.int64), np.zeros(width + 1, np.int64)
    band = max(1, BAND_CELLS // w)
    for start in range(0, h, band):
        run = np.vstack([below[None], below + np.cumsum(columns(grey[start : start + band]), axis=0)])
        inside = (y0 >= start) & (y0 < start + len(run) - 1)
        at, part = y0[inside] - start, yr[inside][:, None]
        at_edge[inside] = run[at] * (height - part) + run[at + 1] * part
        below = run[-1]
    at_edge[y0 == h] = below * height
    sums = np.diff(np.diff(at_edge, axis=0), axis=1)
    return ((2 * sums + h * w) // (2 * h * w)).astype(np.uint8)


def grey_of(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    r, g, b = (image[:, :, i].astype(np.uint32) for i in range(3))
    return ((299 * r + 587 * g + 114 * b + 500) // 1000).astype(np.uint8)


def difference_hash(grey: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 9 area means exceeds its left neighbour."""
    small = area_resize(grey, 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(grey: np.ndarray, size: int = TILE) -> bytes:
    """The area-resized image in NPY format."""
    out = io.BytesIO()
    np.save(out, area_resize(grey, size, size), allow_pickle=False)
    return out.getvalue()


DECODED = [
    T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("channels", T.IntegerType()),
    T.StructField("tile", T.BinaryType()), T.StructField("dhash", T.StringType()), T.StructField("media_error", T.StringType()),
]
_ARROW = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.BinaryType: pa.binary(), T.StringType: pa.string()}


def _described(data: bytes | None) -> tuple:
    if data is None:
        return None, None, None, None, None, "null"
    try:
        image = decode_image(data)
    except MediaError as e:
        return None, None, None, None, None, str(e)
    grey = grey_of(image)
    return grey.shape[1], grey.shape[0], 1 if image.ndim == 2 else 3, npy_tile(grey), difference_hash(grey), None


def decode_media(df: DataFrame, column: str = "media") -> DataFrame:
    """Add width, height, channels, NPY tile, difference hash and media_error of image bytes."""
    kept = df.drop(*[f.name for f in DECODED])
    schema = T.StructType([*kept.schema.fields, *DECODED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = list(zip(*(_described(x.as_py()) for x in b.column(column)), strict=True)) or [()] * len(DECODED)
            new = [pa.array(c, _ARROW[type(f.dataType)]) for c, f in zip(cells, DECODED, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=schema.names)

    return kept.mapInArrow(run, schema)


PACKED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long, tile_sha256 string"


def _packed(text: str) -> tuple:
    raw = text.encode()
    media = encode_pgm(raw + bytes(PAD - len(raw) % PAD if len(raw) % PAD or not raw else 0))
    image = decode_image(media)
    payload = image.tobytes()  # what the stored form gives back
    tile = npy_tile(image)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), image.shape[1], image.shape[0], hashlib.sha256(tile).hexdigest()


def text_media(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a greymap of its UTF-8 bytes, and the digests of what is read back.

    A null text counts as empty; an empty one is stored as 64 zero bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.columns
            cells = list(zip(*(_packed(x.as_py() or "") for x in texts), strict=True)) or [()] * (len(names) - 1)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True))], names=names)

    names = [x.split()[0] for x in PACKED.split(", ")]
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PACKED)
