"""GIF: LZW code streams, palettes, interlace, disposal and transparency; timed frames and colour histograms.

The code width is a function of how many codes were read since the last clear code, so a run of codes is cut out of the bits by
array operations. The string of table entry e is what code e wrote and the first byte of what code e+1 wrote; both lie side by side
in the output, so an entry is a place and a length there and decoding a code copies a slice.

Payloads are stored as frames of 64 columns of 8-bit samples with a grey palette, as many frames as they need, each with a delay.

Defined results: null text is the empty text, its payload 64 zero bytes; each row has its own result, equal for equal texts; a frame
holds at most ROWS rows, so a long text is more frames; damaged streams raise ValueError. Empty in, empty out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

COLUMNS, ROWS, DELAY = 64, 1024, 10
_TABLE = 4096


@lru_cache(32)
def _widths(bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of the k-th code since a clear, k below n, for samples of `bits` bits, and the bits up to its end."""
    entries = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    width = np.minimum(12, np.maximum(bits + 1, np.floor(np.log2(entries)).astype(np.int64) + 1))
    return width, np.cumsum(width)


def lzw_codes(samples: bytes, bits: int = 8) -> list[list[int]]:
    """Codes of the samples, a list for each run that starts with a clear code."""
    clear = 1 << bits
    runs, codes = [], [clear]
    if samples:
        table: dict[int, int] = {}
        get, new, word = table.get, clear + 2, samples[0]
        for byte in samples[1:]:
            key = word << 8 | byte
            code = get(key)
            if code is not None:
                word = code
                continue
            codes.append(word)
            if new < _TABLE:
                table[key] = new
                new += 1
            else:
                runs.append(codes)
                codes = [clear]
                table.clear()
                new = clear + 2
            word = byte
        codes.append(word)
    runs.append([*codes, clear + 1])
    return runs


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """The code stream. A run's first code, the clear code, still has the width of the run before."""
    values, ends, first, at = [], [], bits + 1, 0
    for codes in lzw_codes(samples, bits):
        width, stop = _widths(bits, _TABLE)
        n = len(codes) - 1
        values.append(np.array(codes, np.int64))
        ends.append(np.r_[first, first + stop[:n]] + at)
        at, first = int(ends[-1][-1]), int(width[n])
    value, end = np.concatenate(values), np.concatenate(ends)
    begin = np.r_[0, end[:-1]]
    # A code reaches into three bytes at most; no two set the same bit, so bytes are sums.
    byte, bit = begin >> 3, value << (begin & 7)
    n = int(byte[-1]) + 3
    out = sum(np.bincount(byte + i, bit >> 8 * i & 255, n) for i in range(3))
    return out.astype(np.uint8)[: -(-at // 8)].tobytes()


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """Samples of a code stream, `most` of them at most."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.r_[np.frombuffer(stream, np.uint8).astype(np.int64), np.zeros(3, np.int64)]
    total, at = 8 * len(stream), 0
    out = bytearray()
    while len(out) < most:
        # One run: codes up to the next clear or end code; without one the table is full and widths stay at 12.
        n, codes, done = 4096, None, False
        while True:
            width, stop = _widths(bits, n)
            stop = at + stop
            fits = int(np.searchsorted(stop, total, "right"))
            begin = stop[:fits] - width[:fits]
            byte = begin >> 3
            codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (begin & 7)) & ((1 << width[:fits]) - 1)
            marks = np.flatnonzero((codes == clear) | (codes == end))
            if len(marks):
                done = codes[marks[0]] == end
                at = int(stop[marks[0]])
                codes = codes[: marks[0]]
                break
            if fits < n:
                done = True
                break
            n *= 4
        if len(codes):
            out += _strings(codes, clear)
        if done:
            break
    return bytes(out[:most])


def _strings(codes: np.ndarray, clear: int) -> bytes:
    """What the codes of one run write. Lengths follow the chain of entries by pointer doubling; then every byte that a code copies points to an earlier byte, and pointers are doubled until all are at literal ones."""
    n = len(codes)
    entry = codes - (clear + 2)
    copies = entry >= 0
    if (entry[copies] >= np.minimum(np.flatnonzero(copies), _TABLE - clear - 2)).any():
        raise ValueError("a code stream names an entry that is not yet there")
    up = np.where(copies, entry, n)
    length, up = np.r_[np.ones(n, np.int64), 0], np.r_[up, n]
    while (up < n).any():
        length, up = length + length[up], up[up]
    length = length[:n]
    place = np.cumsum(length) - length
    source = np.arange(int(length.sum()))
    source -= np.repeat(np.where(copies, place - place[np.where(copies, entry, 0)], 0), length)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    literal = np.zeros(len(source), np.uint8)
    literal[place[~copies]] = codes[~copies]
    return literal[source].tobytes()


@dataclass
class Frame:
    """left, top, width, height of the part drawn; samples: its palette indices, row by row; canvas: RGBA rows after drawing; delay in hundredths of a second."""

    left: int
    top: int
    width: int
    height: int
    delay: int
    samples: bytes
    canvas: np.ndarray


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def _row_order(height: int) -> np.ndarray:
    """Interlaced rows come in four passes."""
    return np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> Iterator[Frame]:
    """Frames of a GIF file. Pixels of the transparent index leave the canvas as it is; disposal 2 clears the frame's part, 3 restores it."""
    try:
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("not a GIF file")
        width, height, flags = struct.unpack_from("<HHB", data, 6)
        at, shared = 13, None
        if flags & 0x80:
            shared, at = _palette(data, at, flags)
        canvas = np.zeros((height, width, 4), np.uint8)
        delay, disposal, clear_index = 0, 0, None
        while data[at] != 0x3B:
            if data[at] == 0x21:
                if data[at + 1] == 0xF9:
                    packed, delay, index = struct.unpack_from("<BHB", data, at + 3)
                    disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
                _, at = _blocks(data, at + 2)
                continue
            if data[at] != 0x2C:
                raise ValueError("unknown block")
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            colours = shared
            if flags & 0x80:
                colours, at = _palette(data, at, flags)
            if colours is None:
                raise ValueError("no palette")
            bits = data[at]
            stream, at = _blocks(data, at + 1)
            samples = lzw_decode(stream, bits, w * h)
            if len(samples) < w * h:
                raise ValueError("a frame ends early")
            grid = np.frombuffer(samples, np.uint8).reshape(h, w)
            if flags & 0x40:
                ordered = np.empty_like(grid)
                ordered[_row_order(h)] = grid
                grid = ordered
            before = canvas.copy() if disposal == 3 else None
            table = np.zeros((256, 4), np.uint8)
            table[: len(colours), :3], table[: len(colours), 3] = colours, 255
            part = canvas[top : top + h, left : left + w]
            shown = grid[: part.shape[0], : part.shape[1]]
            drawn = np.ones(shown.shape, bool) if clear_index is None else shown != clear_index
            part[drawn] = table[shown[drawn]]
            yield Frame(left, top, w, h, delay, grid.tobytes(), canvas.copy())
            if disposal == 2:
                part[:] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, clear_index = 0, 0, None
    except (IndexError, struct.error) as e:
        raise ValueError("a GIF file ends early") from e


def encode(samples: bytes, columns: int = COLUMNS, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """Samples, a multiple of `columns` of them, as frames of 8-bit grey, one after the other in time."""
    height = min(rows, len(samples) // columns)
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    out = [b"GIF89a", struct.pack("<HHBBB", columns, height, 0xF7, 0, 0), grey]
    for at in range(0, len(samples), columns * rows):
        part = samples[at : at + columns * rows]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 2 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, columns, len(part) // columns, 0) + b"\x08")
        stream = lzw_encode(part)
        out += [bytes([len(x)]) + x for i in range(0, len(stream), 255) if (x := stream[i : i + 255])]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def payload(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % COLUMNS if raw else COLUMNS)


def histogram(frame: Frame, bins: int = 16, channels: int = 3) -> np.ndarray:
    """Pixels of the frame's visible canvas by red, green and blue (or the first of them), `bins` columns each."""
    visible = frame.canvas[: frame.top + frame.height, : frame.left + frame.width]
    visible = visible[visible[..., 3] > 0]
    return np.concatenate([np.bincount(visible[:, c] // (256 // bins), minlength=bins) for c in range(channels)])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, size, at = batch.column("doc_id"), 0, 0
        rows: list[tuple] = []
        for i, text in enumerate(batch.column("text")):
            data = payload(text.as_py())
            media = encode(data)
            samples, delays, grey = [], [], np.zeros(16, np.int64)
            for f in decode(media):  # one canvas at a time
                samples.append(f.samples)
                delays.append(10 * f.delay)
                grey += histogram(f, 16, 1)
            back = b"".join(samples)
            rows.append((len(text.as_py().encode("utf-8", "surrogatepass")), media, back, delays, grey.tolist()))
            size += len(media) + len(back)
            if size > 16_000_000 or i == len(batch) - 1:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(rows)), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4], pa.list_(pa.int64()))], ["doc_id", "n_bytes", "media", "payload", "delays_ms", "grey"])
                rows, size, at = [], 0, i + 1


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the GIF file), payload (read back from it), delays_ms of its frames, grey (colour histogram over them)."""
    return texts(docs).mapInArrow(_store, "doc_id long, n_bytes long, media binary, payload binary, delays_ms array<int>, grey array<long>")


def _frames(batches: Iterator[pa.RecordBatch], id_col: str, media_col: str, bins: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, media in zip(batch.column(id_col), batch.column(media_col), strict=True):
            rows, at = [], 0
            for k, f in enumerate(decode(media.as_py()) if media.as_py() is not None else ()):
                h = histogram(f, bins).tolist()
                rows.append((doc_id.as_py(), k, at, 10 * f.delay, f.width, f.height, f.canvas.tobytes(), h[:bins], h[bins : 2 * bins], h[2 * bins :]))
                at += 10 * f.delay
                if len(rows) == 16:
                    yield _frame_batch(rows)
                    rows = []
            if rows:
                yield _frame_batch(rows)


def _frame_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3]
    names = ["doc_id", "frame", "at_ms", "delay_ms", "width", "height", "rgba", "red", "green", "blue"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", bins: int = 16) -> DataFrame:
    """A row for each frame of each GIF file: its number, time, delay, size, canvas as RGBA and colour histograms. A null file has none."""
    schema = "doc_id long, frame int, at_ms long, delay_ms int, width int, height int, rgba binary, red array<long>, green array<long>, blue array<long>"
    return media.select(F.col(id_col).cast("long").alias(id_col), media_col).mapInArrow(lambda b: _frames(b, id_col, media_col, bins), schema)


def digests(docs: DataFrame) -> DataFrame:
    stored = store(docs)
    tail = F.substring("payload", -COLUMNS, COLUMNS)
    feature = F.concat_ws(";", F.concat_ws(",", F.transform("delays_ms", lambda x: x.cast("string"))), F.concat_ws(",", F.transform("grey", lambda x: x.cast("string"))))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
