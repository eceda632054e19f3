import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from sievetree.llm import gif

from .conftest import AWKWARD


def plain_lzw(stream, bits, most):
    """Textbook decoder, code by code."""
    clear, end = 1 << bits, (1 << bits) + 1
    table, width, out, last, at = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, b"", None, 0
    number = int.from_bytes(stream, "little")
    while at + width <= 8 * len(stream) and len(out) < most:
        code = number >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            table, width, last = table[: clear + 2], bits + 1, None
            continue
        if code == end:
            break
        word = table[code] if code < len(table) else last + last[:1]
        if last is not None and len(table) < 4096:
            table.append(last + word[:1])
        out, last = out + word, word
        width = min(12, max(width, len(table).bit_length()))
    return out[:most]


@pytest.mark.parametrize("alphabet", [1, 2, 17, 256])
def test_lzw(alphabet):
    rng = random.Random(alphabet)
    for n in (1, 2, 3, 100, 5000, 30000):
        data = bytes(rng.randrange(alphabet) for _ in range(n))
        stream = gif.lzw_encode(data)
        assert gif.lzw_decode(stream, 8, n) == data == plain_lzw(stream, 8, n)


def test_full_table_without_clear():
    """Encoders may go on with a full table."""
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(9000))
    codes = [256, *data, 257]
    width = gif._widths(8, len(codes))[0]
    number, at = 256, 9
    for code, w in zip(codes[1:], width, strict=False):
        number |= code << at
        at += int(w)
    stream = number.to_bytes(at // 8 + 1, "little")
    assert gif.lzw_decode(stream, 8, 9000) == data


def test_frames_palette_interlace_disposal_transparency():
    def image(left, top, w, h, samples, interlace=False, local=b""):
        stream = gif.lzw_encode(samples, 2)
        flags = (0x40 if interlace else 0) | (0x81 if local else 0)
        return b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + local + b"\x02" + bytes([len(stream)]) + stream + b"\0"

    control = lambda disposal, delay, index=None: b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (index is not None), delay, index or 0) + b"\0"
    head = b"GIF89a" + struct.pack("<HHBBB", 3, 5, 0x81, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    rows = bytes([0] * 3 + [1] * 3 + [2] * 3 + [3] * 3 + [0] * 3)
    in_passes = b"".join(rows[3 * r : 3 * r + 3] for r in (0, 4, 2, 1, 3))
    comment = b"\x21\xfe\x02hi\0"
    data = head + comment + control(1, 7) + image(0, 0, 3, 5, in_passes, True) + control(2, 8, 0) + image(1, 1, 2, 1, bytes([0, 2])) + control(3, 9) + image(0, 0, 1, 1, bytes([1]), local=bytes(range(12))) + control(0, 1) + image(2, 4, 1, 1, bytes([3])) + b"\x3b"
    frames = list(gif.decode(data))
    assert [f.delay for f in frames] == [7, 8, 9, 1]
    assert frames[0].samples == rows
    assert frames[1].canvas[1].tolist() == [[255, 0, 0, 255], [255, 0, 0, 255], [0, 255, 0, 255]]
    assert frames[2].canvas[1].tolist() == [[255, 0, 0, 255], [0, 0, 0, 0], [0, 0, 0, 0]]
    assert frames[2].canvas[0, 0].tolist() == [3, 4, 5, 255]
    assert frames[3].canvas[0, 0].tolist() == [0, 0, 0, 255]
    assert frames[3].canvas[4, 2].tolist() == [0, 0, 255, 255]
    assert gif.histogram(frames[0]).sum() == 3 * 15
    for n in (0, 5, 20, len(data) - 8):
        with pytest.raises(ValueError):
            list(gif.decode(data[:n]))


def test_round_trip(awkward, nothing):
    rows = gif.store(awkward).collect()
    want = sorted((t or "").encode() for _, t in AWKWARD)
    assert sorted(bytes(r.payload)[: r.n_bytes] for r in rows) == want
    for r in rows:
        assert len(r.payload) % 64 == 0 and len(r.payload) > 0 and not any(bytes(r.payload)[r.n_bytes :]) and len(r.payload) - r.n_bytes in range(65)
        assert sum(r.grey) == len(r.payload)
        assert np.array_equal(np.bincount(np.frombuffer(bytes(r.payload), np.uint8) // 16, minlength=16), r.grey)
    assert gif.store(nothing).count() == 0
    assert gif.payload("") == bytes(64) and len(gif.payload("a" * 64)) == 64 and len(gif.payload("a" * 65)) == 128
    frames = gif.frames(gif.store(awkward)).collect()
    assert {r.frame for r in frames if r.doc_id == 9} == {0, 1, 2}
    assert all(r.delay_ms == 100 and r.at_ms == 100 * r.frame and r.red == r.blue for r in frames)
    assert gif.digests(awkward).count() == len(AWKWARD)


def test_digests_are_of_the_payload_read_back_and_the_stored_file(spark):
    rows = [(1, "text of a file"), (2, None), (3, ""), (4, "x" * 64), (5, "Größe 東京 " * 3000), (6, "text of a file")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    media = {r.doc_id: bytes(r.media) for r in gif.store(docs).collect()}
    got = {r.doc_id: r for r in gif.digests(docs).collect()}
    for i, text in rows:
        raw = (text or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert b"".join(f.samples for f in gif.decode(media[i])) == padded
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
        pixels = [int(x) for x in r.feature.split(";")[1].split(",")]
        assert pixels == [sum(b >> 4 == k for b in padded) for k in range(16)]
    assert got[1][1:] == got[6][1:]
