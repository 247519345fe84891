"""GIFs written and read back; disposal, transparency, timing and broken bytes."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import gif

PALETTE = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=6000), st.integers(2, 8))
def test_code_streams_round_trip(data, bits):
    pixels = bytes(x & ((1 << bits) - 1) for x in data)
    assert gif.unpack_codes(gif.pack_codes(pixels, bits), bits, len(pixels)) == pixels


def test_long_stream_fills_the_table():
    r = np.random.default_rng(1)
    pixels = r.integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert gif.unpack_codes(gif.pack_codes(pixels, 8), 8, len(pixels)) == pixels


@pytest.mark.parametrize("interlaced", [False, True])
def test_frames_round_trip(interlaced):
    r = np.random.default_rng(2)
    frames = [r.integers(0, 4, (13, 7)).astype(np.uint8) for _ in range(3)]
    got = list(gif.decode(gif.encode(frames, PALETTE, [10, 0, 250], interlaced=interlaced)))
    assert [d for d, _ in got] == [10, 0, 250]
    for want, (_, canvas) in zip(frames, got):
        assert (canvas[..., :3] == PALETTE[want]).all() and (canvas[..., 3] == 255).all()


def test_transparency_keeps_what_is_below_and_disposal_clears():
    a = np.array([[1, 1], [1, 1]], np.uint8)
    b = np.array([[3, 2], [2, 3]], np.uint8)
    for disposal, below in ((0, (255, 0, 0, 255)), (1, (255, 0, 0, 255)), (2, (0, 0, 0, 0)), (3, (0, 0, 0, 0))):
        got = [c for _, c in gif.decode(gif.encode([a, b], PALETTE, [0, 0], transparent=3, disposal=disposal))]
        assert tuple(got[1][0, 0]) == below and tuple(got[1][0, 1]) == (0, 255, 0, 255)


def test_local_palettes_and_frames_off_the_canvas():
    head = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0, 0, 0)
    local = np.array([[9, 9, 9], [200, 100, 50]], np.uint8).tobytes()
    stream = gif.pack_codes(bytes([1] * 9), 2)
    frame = b"," + struct.pack("<HHHHB", 2, 3, 3, 3, 0x80) + local + b"\x02" + bytes((len(stream),)) + stream + b"\0"
    (_, canvas), = gif.decode(head + frame + b";")
    assert (canvas[3, 2:] == [200, 100, 50, 255]).all() and canvas[:3].sum() == 0 and canvas[3, :2].sum() == 0


def test_histogram():
    canvas = np.zeros((2, 2, 4), np.uint8)
    canvas[0, 0] = (255, 0, 0, 255)
    canvas[0, 1] = (0, 0, 255, 255)
    bins, clear = gif.histogram(canvas)
    assert bins[48] == 1 and bins[3] == 1 and sum(bins) == 2 and clear == 2


def test_broken_bytes_and_repeats(spark):
    whole = gif.encode([np.ones((2, 2), np.uint8)] * 2, PALETTE, [20, 30])
    big = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0)
    rows = [(1, whole), (1, whole), (2, None), (3, b""), (4, b"no gif"), (5, whole[:-12]), (6, big), (None, whole), (7, b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b";")]
    table = spark.createDataFrame([(*r, "own", 1) for r in rows], "k long, content binary, frame string, width int")
    got = gif.frames(table, "k", "content").collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.k, []).append(r)
    assert [(r.frame, r.start_ms, r.delay_ms) for r in by[None]] == [(0, 0, 20), (1, 20, 30)] and len(by[1]) == 4
    assert all(len(by[k]) == 1 and by[k][0].frame is None and by[k][0].error for k in (2, 3, 4, 6, 7))
    assert by[5][-1].error and by[5][-1].frame is None
    assert gif.frames(table.limit(0), "k", "content").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=200))
def test_no_bytes_crash(data):
    for start in (b"", b"GIF89a", b"GIF89a" + struct.pack("<HHBBB", 3, 3, 0x80, 0, 0) + bytes(6)):
        try:
            list(gif.decode(start + data))
        except gif.Broken:
            pass


def test_vectors_become_frames(spark):
    table = spark.createDataFrame([(1, [0.5] * 64), (2, None), (3, []), (4, [-1.0, 0.05]), (5, [float("nan"), 0.0, -0.05, 0.15])], "vec_id long, embedding array<float>")
    got = gif.frames(gif.from_vectors(table), "vec_id", "gif").collect()
    n = {k: sum(r.vec_id == k and r.frame is not None for r in got) for k in range(1, 6)}
    assert n == {1: 4, 2: 0, 3: 0, 4: 2, 5: 4}


def test_clashing_key_and_the_pixel_bound(spark):
    whole = gif.encode([np.ones((2, 2), np.uint8)], PALETTE, [20])
    got = gif.frames(spark.createDataFrame([(7, whole)], "Width long, content binary"), "Width", "content", max_pixels=4)
    assert got.columns[0] == "Width_" and [(r.Width_, r.width) for r in got.collect()] == [(7, 2)]
    assert "canvas" in gif.frames(spark.createDataFrame([(7, whole)], "k long, content binary"), "k", "content", max_pixels=3).collect()[0].error


def test_own_palettes_places_and_mixed_disposals():
    a, b = np.array([[1, 2], [3, 4]], np.uint8), np.array([[0]], np.uint8)
    local = np.array([[7, 8, 9], [1, 1, 1]], np.uint8)
    made = gif.encode([a, b, b], np.arange(15, dtype=np.uint8).reshape(5, 3), [0, 0, 0], disposal=[1, 3, 0], places=[(0, 0), (1, 1), (2, 0)], size=(3, 2), local=[None, local, local])
    one, two, three = (c for _, c in gif.decode(made))
    assert tuple(one[1, 1]) == (12, 13, 14, 255) and tuple(two[1, 1]) == (7, 8, 9, 255)
    assert tuple(three[1, 1]) == (12, 13, 14, 255) and tuple(three[0, 2]) == (7, 8, 9, 255) and one[0, 2, 3] == 0
