"""Media columns: GIF bytes to timed frames with colour histograms.

``decode`` reads the block structure, undoes the LZW code streams, interlacing,
local and global palettes, transparency and the disposal rules, and returns the
full canvas of each frame as RGBA.  ``frames`` stores one row a frame: timing,
size, a packed canvas and columns of a colour histogram (4 levels a channel, 64
bins, and the transparent pixels).  ``encode`` writes GIFs, for tests and for
media made from other columns.

Defined cases: null bytes, and bytes that are no GIF or whose header or first
frame is cut short, give one row with frame null and the reason in error; a
later frame that is cut short ends the frames with one such row, after the
frames before it; codes after the canvas is full are ignored, missing ones leave
background; a canvas or frame above ``max_pixels`` (a parameter) is refused as an
error row; a delay of 0 stays 0; repeated rows give the same frames; an empty table
gives no rows; columns other than the two named are not read; a key named as one of
the frames' columns gets underscores after its name.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.common import map_rows

MAX_PIXELS = 1 << 26


class Broken(ValueError):
    """Bytes that are not a whole GIF."""


def unpack_codes(data: bytes, least: int, limit: int) -> bytes:
    """The pixels of an LZW stream with ``least`` bits a pixel, ``limit`` at most."""
    clear, stop = 1 << least, (1 << least) + 1
    base = [bytes((i,)) for i in range(clear)] + [b"", b""]
    words, width, last = base[:], least + 1, b""
    out, made = [], 0
    acc = bits = 0
    for byte in data:
        acc |= byte << bits
        bits += 8
        while bits >= width:
            code = acc & ((1 << width) - 1)
            acc >>= width
            bits -= width
            if code == clear:
                words, width, last = base[:], least + 1, b""
                continue
            if code == stop:
                return b"".join(out)[:limit]
            if not last:
                if code >= clear:
                    raise Broken("a code before its word")
                word = words[code]
            else:
                if code < len(words):
                    word = words[code]
                elif code == len(words):
                    word = last + last[:1]
                else:
                    raise Broken("a code beyond the table")
                if len(words) < 4096:
                    words.append(last + word[:1])
                    if len(words) == 1 << width and width < 12:
                        width += 1
            out.append(word)
            made += len(word)
            if made >= limit:
                return b"".join(out)[:limit]
            last = word
    return b"".join(out)


def pack_codes(pixels: bytes, least: int) -> bytes:
    """The LZW stream of pixels."""
    clear, stop = 1 << least, (1 << least) + 1
    out, acc, bits = bytearray(), 0, 0
    words: dict[bytes, int] = {}
    width = least + 1

    def put(code: int) -> None:
        nonlocal acc, bits
        acc |= code << bits
        bits += width
        while bits >= 8:
            out.append(acc & 255)
            acc >>= 8
            bits -= 8

    put(clear)
    words = {bytes((i,)): i for i in range(clear)}
    size, word = clear + 2, b""
    for p in pixels:
        longer = word + bytes((p,))
        if longer in words:
            word = longer
            continue
        put(words[word])
        if size < 4096:
            words[longer] = size
            size += 1
            if size > 1 << width and width < 12:
                width += 1
        else:
            put(clear)
            words, size, width = {bytes((i,)): i for i in range(clear)}, clear + 2, least + 1
        word = bytes((p,))
    if word:
        put(words[word])
        if size < 4096:
            size += 1
            if size > 1 << width and width < 12:
                width += 1
    put(stop)
    if bits:
        out.append(acc & 255)
    return bytes(out)


def _rows(height: int) -> np.ndarray:
    """The order in which interlaced rows come."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes, max_pixels: int = MAX_PIXELS) -> Iterator[tuple[int, np.ndarray]]:
    """(delay in ms, RGBA canvas) of each frame; Broken where the bytes end early."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise Broken("the bytes end early")
        at += n
        return data[at - n : at]

    def blocks() -> bytes:
        parts = []
        while n := take(1)[0]:
            parts.append(take(n))
        return b"".join(parts)

    if take(6) not in (b"GIF87a", b"GIF89a"):
        raise Broken("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", take(7))
    if width * height == 0 or width * height > max_pixels:
        raise Broken(f"a canvas of {width} x {height}")
    common = np.frombuffer(take(3 << (flags & 7) + 1), np.uint8).reshape(-1, 3) if flags & 128 else None
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear = 0, 0, -1
    while True:
        kind = take(1)
        if kind == b";":
            return
        if kind == b"!":
            label = take(1)[0]
            body = blocks()
            if label == 0xF9:
                if len(body) < 4:
                    raise Broken("a short control block")
                f, hundredths, index = struct.unpack("<BHB", body[:4])
                delay, disposal, clear = hundredths * 10, f >> 2 & 7, index if f & 1 else -1
            continue
        if kind != b",":
            raise Broken("an unknown block")
        x, y, w, h, f = struct.unpack("<HHHHB", take(9))
        palette = np.frombuffer(take(3 << (f & 7) + 1), np.uint8).reshape(-1, 3) if f & 128 else common
        if palette is None:
            raise Broken("no palette")
        least = take(1)[0]
        if not 1 <= least <= 11:
            raise Broken("a code size out of range")
        if w * h > max_pixels:
            raise Broken(f"a frame of {w} x {h}")
        got = np.frombuffer(unpack_codes(blocks(), least, w * h), np.uint8)
        index = np.full(w * h, -1, np.int64)
        index[: len(got)] = got
        index = index.reshape(h, w)
        if f & 64:
            straight = np.empty_like(index)
            straight[_rows(h)] = index
            index = straight
        seen = index[: max(0, height - y), : max(0, width - x)]
        before = canvas.copy() if disposal == 3 else None
        put = (seen >= 0) & (seen != clear) & (seen < len(palette))
        part = canvas[y : y + seen.shape[0], x : x + seen.shape[1]]
        part[put, :3] = palette[seen[put]]
        part[put, 3] = 255
        yield delay, canvas.copy()
        if disposal == 2:
            part[...] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear = 0, 0, -1


def encode(
    frames: list[np.ndarray], palette: np.ndarray, delays: list[int], transparent: int = -1, disposal: int | list[int] = 0, interlaced: bool | list[bool] = False,
    places: list[tuple[int, int]] | None = None, size: tuple[int, int] | None = None, local: list[np.ndarray | None] | None = None,
) -> bytes:
    """A GIF of index arrays with a common palette, or of the frame's own where
    ``local`` has one; delays in ms; places: (x, y) of each frame on a canvas of
    ``size`` (width, height), by default that of the first frame."""
    each = lambda v: v if isinstance(v, list) else [v] * len(frames)
    places, local = places or [(0, 0)] * len(frames), local or [None] * len(frames)
    width, height = size or frames[0].shape[::-1]

    def colours(table: np.ndarray) -> tuple[int, bytes]:
        bits = max(1, int(len(table) - 1).bit_length())
        full = np.zeros((1 << bits, 3), np.uint8)
        full[: len(table)] = table
        return bits, full.tobytes()

    common, data = colours(palette)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 128 | (common - 1) << 4 | common - 1, 0, 0), data]
    for pixels, delay, dispose, woven, (x, y), own in zip(frames, delays, each(disposal), each(interlaced), places, local):
        h, w = pixels.shape
        bits, table = colours(own) if own is not None else (common, b"")
        out.append(b"!\xf9\x04" + struct.pack("<BHB", dispose << 2 | (transparent >= 0), delay // 10, max(0, transparent)) + b"\0")
        out.append(b"," + struct.pack("<HHHHB", x, y, w, h, 64 * woven | (128 | bits - 1 if own is not None else 0)) + table)
        least = max(2, bits)
        stream = pack_codes((pixels[_rows(h)] if woven else pixels).astype(np.uint8).tobytes(), least)
        out.append(bytes((least,)) + b"".join(bytes((len(stream[i : i + 255]),)) + stream[i : i + 255] for i in range(0, len(stream), 255)) + b"\0")
    return b"".join(out) + b";"


def histogram(canvas: np.ndarray) -> tuple[list[int], int]:
    """(64 bins of opaque pixels, transparent pixels)."""
    flat = canvas.reshape(-1, 4)
    shown = flat[flat[:, 3] > 0].astype(np.int64) >> 6
    return np.bincount(shown[:, 0] * 16 + shown[:, 1] * 4 + shown[:, 2], minlength=64).tolist(), int(len(flat) - len(shown))


FRAME = "frame int, start_ms long, delay_ms int, width int, height int, pixels binary, histogram array<int>, n_transparent int, error string"


def frames(media: DataFrame, key: str, content: str, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """One row a frame of each GIF in column ``content``, with its ``key``."""
    own, name = T.StructType.fromDDL(FRAME), key
    while name.lower() in own.names:
        name += "_"
    schema = T.StructType([T.StructField(name, media.schema[key].dataType), *own.fields])
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.string()]

    def rows(data: bytes | None) -> Iterator[tuple]:
        start, n = 0, 0
        if data is None:
            yield None, None, None, None, None, None, None, None, "no bytes"
            return
        try:
            for delay, canvas in decode(data, max_pixels):
                bins, clear = histogram(canvas)
                yield n, start, delay, canvas.shape[1], canvas.shape[0], canvas.tobytes(), bins, clear, None
                start, n = start + delay, n + 1
            if n == 0:
                yield None, None, None, None, None, None, None, None, "no frame"
        except Broken as e:
            yield None, None, None, None, None, None, None, None, str(e)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, data in enumerate(batch.column(1)):
            held: list[tuple] = []
            size = 0
            for row in rows(data.as_py()):
                held.append(row)
                size += len(row[5] or b"")
                if size > 8 << 20:
                    yield out(batch, i, held)
                    held, size = [], 0
            if held:
                yield out(batch, i, held)

    def out(batch: pa.RecordBatch, i: int, held: list[tuple]) -> pa.RecordBatch:
        keys = batch.column(0).take(pa.array([i] * len(held)))
        return pa.RecordBatch.from_arrays([keys, *[pa.array([r[k] for r in held], t) for k, t in enumerate(types)]], names=schema.names)

    return map_rows(media.select(key, content), schema, run)


#: Four opaque colours and a transparent one.
COLOURS = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]], np.uint8)


#: The same colours in the order of a frame's own palette, and where each went.
SHUFFLED = [2, 0, 3, 1, 4]
#: Of the four frames: (x, y) on the canvas, disposal, interlaced, own palette.
LAYOUT = (((0, 0), 1, False, False), ((1, 0), 3, True, True), ((0, 1), 2, False, True), ((2, 2), 0, True, False))


def from_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, gif): each vector drawn as an animation of up to four square frames, a
    quarter of its values each, on a canvas two pixels wider; a value's level is its
    pixel's colour, the lowest level transparent.  Frames differ in place, disposal
    (leave, restore, clear), interlacing and palette as ``LAYOUT`` says."""
    schema = T.StructType([T.StructField("vec_id", embeddings.schema["vec_id"].dataType), T.StructField("gif", T.BinaryType())])
    moved = np.argsort(SHUFFLED)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made: list[bytes | None] = []
        for v in batch.column(1).to_pylist():
            if not v:
                made.append(None)
                continue
            x = np.array([np.nan if y is None else y for y in v], np.float64)
            level = np.where(np.isnan(x), 4, np.digitize(x, [-0.1, 0.0, 0.1, 0.2])).astype(np.int64)
            level = np.where(level == 0, 4, level - 1)
            parts = np.array_split(level, min(4, len(level)))
            side = math.isqrt(max(map(len, parts)) - 1) + 1
            pixels = [np.pad(p, (0, side * side - len(p)), constant_values=4).reshape(side, side) for p in parts]
            how = LAYOUT[: len(parts)]
            made.append(
                encode(
                    [moved[p] if own else p for p, (*_, own) in zip(pixels, how)], COLOURS, [40 + 10 * k for k in range(len(parts))], transparent=4, disposal=[d for _, d, *_ in how], interlaced=[i for *_, i, _ in how],
                    places=[at for at, *_ in how], size=(side + 2, side + 2), local=[COLOURS[SHUFFLED] if own else None for *_, own in how],
                )
            )
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=schema.names)

    return map_rows(embeddings.select("vec_id", "embedding"), schema, run)
