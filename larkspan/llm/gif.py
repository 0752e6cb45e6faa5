"""GIF media columns: decode LZW code streams, palettes, disposal and transparency into timed frames with colour histograms.

The codec follows the GIF89a layout (header, palettes, extensions, image blocks, interlacing). Frames are composed on the
logical screen. `store_payload` writes bytes losslessly as palette indices of timed frames; `read_payload` gets them back
from the composed frames.

Defined results: null media gives one row with status `null` and no frame, a GIF without an image one with status `no frame`;
bytes that are no whole GIF give the frames up to the fault (status `ok`) and one more row without a frame and with status
`error: ...`; a screen of more than `MOST_PIXELS` is such a fault, found before memory is taken; empty payloads are padded by the caller. Rows are independent, so repeated rows give
repeated results; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

TOP = 4096  # codes have 12 bits at most
WIDTH, ROWS = 192, 256  # of a stored frame, at most
MOST_PIXELS = 1 << 26  # of a screen


def _widths(min_bits: int) -> np.ndarray:
    """Bits of the n-th code after a clear code (n from 0), until codes stay at 12 bits."""
    clear = 1 << min_bits
    size = np.maximum(clear + 2 + np.arange(TOP - clear + 1) - 1, clear + 2)
    return np.minimum(12, np.floor(np.log2(size)).astype(np.int64) + 1)


_W = {m: _widths(m) for m in range(2, 9)}
_START = {m: np.concatenate([[0], np.cumsum(w)]) for m, w in _W.items()}

_BIT = (1 << np.arange(12)).astype(np.uint16)
_USED = np.arange(12) < np.arange(13)[:, None]  # by width


def lzw_encode(data: bytes, min_bits: int = 8) -> bytes:
    """Code stream of palette indices; starts with a clear code and clears the table when it is full."""
    clear = 1 << min_bits
    parts: list[list[int]] = [[clear]]
    part: list[int] = []
    put, nxt = part.append, clear + 2
    roots = [{-1: i} for i in range(clear)]  # a node: its code at -1, and the nodes that follow it
    if data:
        node = roots[data[0]]
        for b in data[1:]:
            if b in node:
                node = node[b]
                continue
            put(node[-1])
            if nxt < TOP:
                node[b] = {-1: nxt}
                nxt += 1
            else:
                put(clear)
                parts.append(part)
                part, nxt = [], clear + 2
                put, roots = part.append, [{-1: i} for i in range(clear)]
            node = roots[b]
        put(node[-1])
    put(clear + 1)
    parts.append(part)
    codes = np.concatenate([np.array(p, np.uint16) for p in parts])
    widths = np.concatenate([_W[min_bits][: len(p)] for p in parts])
    if len(widths) != len(codes):
        raise ValueError("code run is longer than its table")
    bits = (codes[:, None] & _BIT).view(np.uint16) != 0
    return np.packbits(bits[_USED[widths]], bitorder="little").tobytes()


def _expand(codes: np.ndarray, clear: int, most: int) -> np.ndarray:
    """Indices of the codes between two clear codes, `most` at most.

    The n-th code's new entry is the output from that code's start to one index past its end, so every code is a copy of
    earlier output; lengths and sources are resolved for all codes at once by pointer doubling.
    """
    n = np.arange(len(codes))
    parent = codes - (clear + 2)
    literal = codes < clear
    if (bad := ~literal & (parent >= n)).any():
        raise ValueError(f"code {codes[bad][0]} is not in the table")
    at, length = np.where(literal, n, parent), np.where(literal, 0, 1)
    while (more := length[at]).any():
        length, at = length + more, at[at]
    length += 1
    starts = np.cumsum(length) - length
    if len(starts) > (keep := int(np.searchsorted(starts, most))):
        codes, parent, literal, length, starts = codes[:keep], parent[:keep], literal[:keep], length[:keep], starts[:keep]
    total = int(starts[-1] + length[-1])
    here = np.arange(total)
    source = np.where(np.repeat(literal, length), here, here + np.repeat(starts[np.maximum(parent, 0)] - starts, length))
    while not np.array_equal(further := source[source], source):
        source = further
    values = np.zeros(total, np.uint8)
    values[starts[literal]] = codes[literal]
    return values[source][:most]


def lzw_decode(stream: bytes, min_bits: int, n_pixels: int) -> bytes:
    """Palette indices of a code stream; raises ValueError on a code that cannot be or a stream that ends early."""
    if not 2 <= min_bits <= 8:
        raise ValueError(f"code size {min_bits}")
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    n_bits, at, out, got = 8 * len(stream), 0, [], 0
    widths, starts = _W[min_bits], _START[min_bits]
    run: list[np.ndarray] = []  # codes since the last clear
    read = 0
    ended = False
    while got < n_pixels and not ended:
        if read < len(widths):
            w, s = widths[read:], starts[read:-1] - starts[read] + at
        else:
            w, s = np.full(TOP, 12), at + 12 * np.arange(TOP)
        fits = int(np.searchsorted(s + w, n_bits, "right"))
        w, s = w[:fits], s[:fits]
        byte = s >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (s & 7) & ((1 << w) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else fits
        run.append(codes[:stop])
        read += stop
        ended = not fits or bool(len(stops) and codes[stop] == end)
        if ended or len(stops):
            if read:
                out.append(_expand(np.concatenate(run), clear, n_pixels - got))
                got += len(out[-1])
            run, read = [], 0
            at = int(s[stop] + w[stop]) if len(stops) else at
        else:
            at = int(s[-1] + w[-1])
    if got < n_pixels:
        raise ValueError(f"{got} of {n_pixels} pixels")
    return b"".join(x.tobytes() for x in out)


class Frame(NamedTuple):
    """A composed frame: RGBA of the whole screen, and where the image was drawn."""

    delay_ms: int
    disposal: int
    transparent: int  # -1: none
    box: tuple[int, int, int, int]  # left, top, width, height
    indices: np.ndarray
    rgba: np.ndarray


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        if at + 1 + n > len(data):
            raise ValueError("block ends early")
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _row_order(h: int) -> np.ndarray:
    return np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> Iterator[Frame]:
    """Frames of a GIF in order; ValueError or IndexError at the first fault."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    w, h, flags = struct.unpack_from("<HHB", data, 6)
    if w * h > MOST_PIXELS:
        raise ValueError(f"screen of {w} x {h}")
    at = 13
    palette = None
    if flags & 128:
        n = 2 << (flags & 7)
        palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((h, w, 4), np.uint8)
    delay, disposal, clear_at = 0, 0, -1
    while True:
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9:
                bits, hundredths, index = struct.unpack_from("<BHB", body)
                delay, disposal, clear_at = 10 * hundredths, bits >> 2 & 7, index if bits & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError(f"block {kind:#x}")
        left, top, fw, fh, bits = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = palette
        if bits & 128:
            n = 2 << (bits & 7)
            colours = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        if colours is None:
            raise ValueError("no palette")
        if left + fw > w or top + fh > h:
            raise ValueError("frame is off the screen")
        min_bits = data[at]
        stream, at = _blocks(data, at + 1)
        indices = np.frombuffer(lzw_decode(stream, min_bits, fw * fh), np.uint8).reshape(fh, fw)
        if bits & 64:
            rows = np.empty_like(indices)
            rows[_row_order(fh)] = indices
            indices = rows
        if indices.size and int(indices.max()) >= len(colours) and not (clear_at >= len(colours) and (indices[indices >= len(colours)] == clear_at).all()):
            raise ValueError("index beyond the palette")
        kept = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + fh, left : left + fw]
        if clear_at < 0:
            area[..., :3] = colours[indices]
            area[..., 3] = 255
        else:
            shown = indices != clear_at
            area[..., :3][shown] = colours[indices[shown]]
            area[..., 3][shown] = 255
        yield Frame(delay, disposal, clear_at, (left, top, fw, fh), indices, canvas.copy())
        if disposal == 2:
            area[:] = 0
        elif kept is not None:
            canvas = kept
        delay, disposal, clear_at = 0, 0, -1


def colour_histogram(rgba: np.ndarray, per_channel: int = 4) -> list[int]:
    """Visible pixels by colour, per_channel bins a channel, and last the transparent pixels."""
    flat = rgba.reshape(-1, 4)
    key = np.zeros(len(flat), np.int32)
    for ch in range(3):
        key = key * per_channel + flat[:, ch].astype(np.int32) * per_channel // 256
    key[flat[:, 3] == 0] = per_channel**3
    return np.bincount(key, minlength=per_channel**3 + 1).tolist()


_GREY = bytes(x for i in range(256) for x in (i, i, i))


def store_payload(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = 10) -> bytes:
    """A GIF of timed frames whose pixels are the payload's bytes; the length must be a multiple of the width."""
    if not payload or len(payload) % width:
        raise ValueError("payload must be a positive multiple of the width")
    height = min(rows, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), _GREY, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for at in range(0, len(payload), width * rows):
        part = payload[at : at + width * rows]
        stream = lzw_encode(part)
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay_cs, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08"]
        out += [bytes([len(s)]) + s for s in (stream[i : i + 255] for i in range(0, len(stream), 255))] + [b"\0"]
    return b"".join([*out, b"\x3b"])


def read_payload(frames: list[Frame]) -> bytes:
    """The bytes that store_payload got: the red samples of each frame's box."""
    return b"".join(f.rgba[f.box[1] : f.box[1] + f.box[3], f.box[0] : f.box[0] + f.box[2], 0].tobytes() for f in frames)


def frames_of(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per frame: id, frame_no, start_ms, delay_ms, disposal, width, height, rgba, histogram, status.

    Null media, media without a frame, and what follows the last good frame of faulty media give one row with a null frame_no.
    """
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, data in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows, status, start, size, n = [], "ok", 0, 0, 0
                if data is None:
                    status = "null"
                else:
                    try:
                        for f in decode(data):
                            h, w = f.rgba.shape[:2]
                            rows.append((n, start, f.delay_ms, f.disposal, w, h, f.rgba.tobytes(), colour_histogram(f.rgba)))
                            start, size, n = start + f.delay_ms, size + f.rgba.size, n + 1
                            if len(rows) >= 16 or size > 32_000_000:
                                yield batch_of(ident, rows, "ok", batch)
                                rows, size = [], 0
                    except (ValueError, IndexError, struct.error) as e:
                        status = f"error: {e}"
                if rows:
                    yield batch_of(ident, rows, "ok", batch)
                if status != "ok" or not n:
                    yield batch_of(ident, [(None,) * 8], "no frame" if status == "ok" else status, batch)

    def batch_of(ident: pa.Scalar, rows: list[tuple], status: str, batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        arrays = [pa.array([ident.as_py()] * len(rows), batch.column(0).type), *map(pa.array, cols, types), pa.array([status] * len(rows))]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "frame_no", "start_ms", "delay_ms", "disposal", "width", "height", "rgba", "histogram", "status"])

    schema = f"id {kind.simpleString()}, frame_no int, start_ms long, delay_ms int, disposal int, width int, height int, rgba binary, histogram array<long>, status string"
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, schema)


def payload_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text as a GIF and read it back: id, n_bytes, media, payload read from the media, and frame features."""
    c.bounded_arrow(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for lo in range(0, len(texts), 32):
                rows = []
                for raw in texts[lo : lo + 32]:
                    raw = raw or b""
                    media = store_payload(raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH)))
                    frames = list(decode(media))
                    h, w = frames[0].rgba.shape[:2]
                    hist = np.sum([colour_histogram(f.rgba) for f in frames], axis=0)
                    starts = np.cumsum([0, *(f.delay_ms for f in frames)]).tolist()
                    feature = f"screen={w}x{h};starts={','.join(map(str, starts))};colours={','.join(f'{i}:{hist[i]}' for i in np.flatnonzero(hist))}"
                    back = read_payload(frames)
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, media))
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(rows)), *map(pa.array, zip(*rows, strict=True), types)], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def op10_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the GIF that each whole text is stored in, taken from the bytes read back."""
    return payload_media(c.documents(spark, sf_dir)).drop("media")
