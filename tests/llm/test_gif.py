import struct

import numpy as np
import pytest

from larkspan.llm import gif


@pytest.mark.parametrize("data", [b" " * 192, bytes(192 * 700), bytes(range(256)) * 3, b"on the and tion, " * 4800])
def test_payload_round_trip(data):
    data = data.ljust(-(-len(data) // 192) * 192)
    media = gif.store_payload(data)
    frames = list(gif.decode(media))
    assert gif.read_payload(frames) == data
    assert sum(f.delay_ms for f in frames) == 100 * len(frames)


def test_random_indices_and_code_sizes():
    rng = np.random.default_rng(1)
    for bits in range(2, 9):
        for n in (1, 7, 5000, 40000):
            data = rng.integers(0, 1 << bits, n).astype(np.uint8).tobytes()
            assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, n) == data


def image(stream, w, h, left=0, top=0, flags=0, palette=b""):
    return b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + palette + b"\x02" + bytes([len(stream)]) + stream + b"\0"


def control(disposal, transparent=None, delay=5):
    return b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0"


PALETTE = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
HEAD = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + PALETTE


def test_disposal_transparency_and_local_palette():
    red = image(gif.lzw_encode(bytes([1] * 4), 2), 2, 2)
    dot = image(gif.lzw_encode(bytes([2]), 2), 1, 1)
    hole = image(gif.lzw_encode(bytes([3, 2, 3, 3]), 2), 2, 2)
    local = image(gif.lzw_encode(bytes([1]), 2), 1, 1, 1, 1, 0x80, bytes([9, 9, 9, 7, 8, 9]))
    data = HEAD + control(1) + red + control(3) + dot + control(2, 3) + hole + control(1) + local + b"\x3b"
    a, b, c, d = list(gif.decode(data))
    assert (a.rgba[..., 0] == 255).all() and a.delay_ms == 50
    assert b.rgba[0, 0].tolist() == [0, 255, 0, 255] and b.rgba[0, 1].tolist() == [255, 0, 0, 255]
    assert c.rgba[0, 0].tolist() == [255, 0, 0, 255] and c.rgba[0, 1].tolist() == [0, 255, 0, 255]  # the dot was put back
    assert d.rgba[0, 0].tolist() == [0, 0, 0, 0] and d.rgba[1, 1].tolist() == [7, 8, 9, 255]  # the screen was cleared
    assert gif.colour_histogram(d.rgba)[-1] == 3


def test_interlaced_rows():
    rows = np.arange(20) % 4
    order = np.concatenate([np.arange(a, 20, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
    data = b"GIF89a" + struct.pack("<HHBBB", 1, 20, 0x81, 0, 0) + PALETTE + image(gif.lzw_encode(rows[order].astype(np.uint8).tobytes(), 2), 1, 20, flags=0x40) + b"\x3b"
    (f,) = gif.decode(data)
    assert f.indices[:, 0].tolist() == rows.tolist()


def test_code_that_names_itself():
    # indices 1 1 1 1 1 1: codes 1, 6, 7 with the entry made by the code itself
    assert gif.lzw_decode(gif.lzw_encode(bytes([1] * 6), 2), 2, 6) == bytes([1] * 6)


def plain_lzw(body, bits):
    """Code stream to indices with a table of tuples, one code at a time."""
    value = int.from_bytes(body, "little")
    clear = 1 << bits
    out, width, last, table = [], bits + 1, None, {}
    while True:
        code = value & ((1 << width) - 1)
        value >>= width
        if code == clear:
            table, width, last = {i: (i,) for i in range(clear)} | {clear: (), clear + 1: ()}, bits + 1, None
            continue
        if code == clear + 1:
            return out
        entry = table[code] if code in table else (*last, last[0])
        out += entry
        if last is not None and len(table) < 4096:
            table[len(table)] = (*last, entry[0])
            if len(table) == 1 << width and width < 12:
                width += 1
        last = entry


def plain_decode(data):
    """A decoder of its own for GIFs without local palettes, transparency or interlacing: (delay, box, colours) of each image."""
    n = 2 << (data[10] & 7)
    palette = [data[13 + 3 * i : 16 + 3 * i] for i in range(n)]
    at, delay, out = 13 + 3 * n, 0, []
    while data[at] != 0x3B:
        box = struct.unpack_from("<HHHH", data, at + 1) if data[at] == 0x2C else None
        if box is None and data[at + 1] == 0xF9:
            delay = data[at + 4] + 256 * data[at + 5]
        at += 10 if box else 2
        bits = data[at]
        at += 1 if box else 0
        body = b""
        while data[at]:
            body += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        if box:
            out.append((delay, box, b"".join(palette[i] for i in plain_lzw(body, bits))))
    return out


@pytest.mark.parametrize("data", [b" " * 192, bytes(range(256)) * 3, b"on the and tion, " * 4800, np.random.default_rng(2).integers(0, 256, 192 * 300).astype(np.uint8).tobytes()])
def test_stored_media_in_another_decoder(data):
    data = data.ljust(-(-len(data) // 192) * 192)
    frames = plain_decode(gif.store_payload(data))
    assert b"".join(colours[::3] for _, _, colours in frames) == data and all(c[::3] == c[1::3] == c[2::3] for _, _, c in frames)
    assert all(delay == 10 for delay, _, _ in frames)
    assert [f.box for f in gif.decode(gif.store_payload(data))] == [box for _, box, _ in frames]


def test_number_of_rows_and_hostile_headers(spark):
    red = control(1, delay=0) + image(gif.lzw_encode(bytes([1] * 4), 2), 2, 2)
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0x81, 0, 0) + PALETTE + red + b"\x3b"
    media = {n: HEAD + red * n + b"\x3b" for n in (0, 1, 16, 17, 32)} | {100: huge, 101: HEAD + red * 16 + b"\x2c\0", 102: b"", 103: HEAD[:9]}
    df = spark.createDataFrame([(i, bytearray(m)) for i, m in media.items()], "doc_id long, media binary")
    got = {}
    for r in gif.frames_of(df, "doc_id", "media").collect():
        got.setdefault(r.id, []).append((r.frame_no, r.status.split(":")[0], r.start_ms))
    for n in (1, 16, 17, 32):
        assert sorted(got[n]) == [(k, "ok", 0) for k in range(n)]
    assert got[0] == [(None, "no frame", None)] and got[102] == got[103] == got[100] == [(None, "error", None)]
    assert sorted(x for x in got[101] if x[0] is not None) == [(k, "ok", 0) for k in range(16)] and (None, "error", None) in got[101] and len(got[101]) == 17


def test_frames_table(spark):
    good = HEAD + control(1) + image(gif.lzw_encode(bytes([1] * 4), 2), 2, 2) + b"\x3b"
    df = spark.createDataFrame([(1, bytearray(good), 0), (2, None, 0), (3, bytearray(b"no gif"), 0), (4, bytearray(good[:-9]), 0)], "doc_id long, media binary, frame_no int")
    got = {(r.id, r.frame_no): r for r in gif.frames_of(df, "doc_id", "media").collect()}
    assert got[1, 0].status == "ok" and got[1, 0].histogram[48] == 4
    assert got[2, None].status == "null" and got[3, None].status.startswith("error") and got[4, None].status.startswith("error")


def test_payload_media(spark):
    import hashlib

    texts = [None, "", "añb\x00", "word " * 30000, "x" * 192, "x" * 192]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in gif.payload_media(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert gif.read_payload(list(gif.decode(got[i].media))) == want
    assert got[4].media_sha256 == got[5].media_sha256
    assert gif.payload_media(df.limit(0)).count() == 0
