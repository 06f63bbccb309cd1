"""FLAC streams of other forms than the writer's, made by hand, and streams that mislead a search for headers."""

import hashlib
import resource
import struct
import subprocess
import sys

import numpy as np
import pytest

from stowline.llm import flac_media
from stowline.llm.flac_reader import CRC8, CRC16, FIXED, read_stream


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += f"{value & ((1 << n) - 1):0{n}b}" if n else ""

    def data(self):
        text = self.text + "0" * (-len(self.text) % 8)
        return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8))


def crc(data, table, bits):
    c = 0
    for x in data:
        c = (c << 8 & ((1 << bits) - 1)) ^ table[c >> (bits - 8) ^ x]
    return c


def residuals(b, values, block, order, parts, rice, rice_kind, escape):
    b.put(rice_kind, 2)
    b.put(parts, 4)
    at = 0
    for k in range(1 << parts):
        n = (block >> parts) - (order if k == 0 else 0)
        own = values[at : at + n]
        at += n
        if escape and k % 2:
            b.put((1 << (4 + rice_kind)) - 1, 4 + rice_kind)
            b.put(18, 5)
            for e in own:
                b.put(e, 18)
            continue
        b.put(rice, 4 + rice_kind)
        for e in own:
            z = e << 1 ^ (e >> 63)
            b.put(1, (z >> rice) + 1)
            b.put(z, rice)


def subframe(b, x, bits, kind, wasted=0, **how):
    b.put(0, 1)
    b.put(kind, 6)
    b.put(1 if wasted else 0, 1)
    if wasted:
        b.put(1, wasted)
        x, bits = [v >> wasted for v in x], bits - wasted
    if kind == 0:
        return b.put(x[0], bits)
    order = len(x) if kind == 1 else kind - 8 if kind < 32 else kind - 31
    for v in x[:order]:
        b.put(v, bits)
    if kind == 1:
        return None
    coefs, shift = (FIXED[order], 0) if kind < 32 else ([(7, -3, 2, -1, 1)[j % 5] for j in range(order)], 2)
    if kind >= 32:
        b.put(5 - 1, 4)
        b.put(shift, 5)
        for c in coefs:
            b.put(c, 5)
    residuals(b, [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefs)) >> shift) for i in range(order, len(x))], len(x), order, **how)


def frame(number, channels, bits, layout, code, kinds, **how):
    n = len(channels[0])
    head = bytes([0xFF, 0xF8, 7 << 4, layout << 4 | code << 1]) + chr(number).encode() + struct.pack(">H", n - 1)
    b = Bits()
    if layout == 8:
        channels = [channels[0], [x - y for x, y in zip(*channels)]]
    elif layout == 9:
        channels = [[x - y for x, y in zip(*channels)], channels[1]]
    elif layout == 10:
        channels = [[x + y >> 1 for x, y in zip(*channels)], [x - y for x, y in zip(*channels)]]
    for c, (x, kind) in enumerate(zip(channels, kinds)):
        subframe(b, x, bits + (layout >= 8 and c == (0 if layout == 9 else 1)), kind, **how)
    out = head + bytes([crc(head, CRC8, 8)]) + b.data()
    return out + struct.pack(">H", crc(out, CRC16, 16))


def stream(frames, samples, bits, block):
    width = -(-bits // 8)
    raw = b"".join(int(v).to_bytes(width, "little", signed=True) for row in samples for v in row)
    info = struct.pack(">HH", block, block) + bytes(6) + (44100 << 44 | (samples.shape[1] - 1) << 41 | (bits - 1) << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(raw).digest()
    return b"fLaC\x04\x00\x00\x02ab\x80" + len(info).to_bytes(3, "big") + info + b"".join(frames)


@pytest.mark.parametrize("layout, bits, code", [(0, 16, 4), (1, 16, 4), (8, 16, 4), (9, 16, 0), (10, 16, 4), (10, 24, 6), (2, 12, 2)])
@pytest.mark.parametrize("kind, parts, rice_kind, escape, wasted", [(1, 0, 0, False, 0), (8, 0, 0, False, 0), (10, 3, 1, True, 0), (12, 2, 0, True, 0), (34, 0, 0, False, 0), (39, 3, 1, True, 0), (10, 0, 0, False, 2)])
def test_any_form_is_read(layout, bits, code, kind, parts, rice_kind, escape, wasted):
    rng = np.random.default_rng(layout * 100 + kind)
    channels = 3 if layout == 2 else 1 if layout == 0 else 2
    n = 96
    x = np.clip(np.cumsum(rng.integers(-20, 21, (3 * n, channels)), axis=0), -1500, 1500)
    if wasted:
        x = x << wasted + 1
    how = {} if kind == 1 else {"parts": parts, "rice": 5, "rice_kind": rice_kind, "escape": escape}
    frames = [frame(k, [x[k * n : (k + 1) * n, c].tolist() for c in range(channels)], bits, layout, code, [kind] * channels, wasted=wasted, **how) for k in range(3)]
    data = stream(frames, x, bits, n)
    samples, info = read_stream(data)
    assert (samples == x).all() and (info.channels, info.bits, info.rate) == (channels, bits, 44100)
    assert (flac_media.decode_streams([data])[0] == x).all()
    for at in (len(data) - 20, len(data) // 2):
        with pytest.raises(ValueError):
            flac_media.decode_streams([data[:at] + bytes([data[at] ^ 4]) + data[at + 1 :]])
    with pytest.raises(ValueError):
        read_stream(data[:-5])


def test_both_readers_agree_and_a_false_header_misleads_neither():
    rng = np.random.default_rng(3)
    payload = bytearray(rng.integers(0, 256, 192 * 3, dtype=np.uint8).tobytes())
    false = flac_media._headers(np.array([1]))[0][0][:6].tobytes()
    payload[50:56] = bytes(x ^ 0x80 for x in false)
    plain = rng.integers(60, 70, 192 * 5, dtype=np.uint8).tobytes()
    streams = flac_media.encode_streams([bytes(payload), plain])
    with pytest.raises(ValueError):
        flac_media._decode_fast(streams[:1])
    assert [(x.view(np.uint8) ^ 0x80).tobytes() for x in flac_media.decode_streams(streams)] == [bytes(payload), plain]
    assert ((read_stream(streams[1])[0][:, 0].astype(np.int8).view(np.uint8) ^ 0x80).tobytes()) == plain


def test_frames_of_low_orders_alone_are_read_fast():
    ramp = np.repeat(np.arange(0, 192, dtype=np.uint8), 4).tobytes()
    streams = flac_media.encode_streams([ramp, bytes([5]) * 192])
    assert [(x.view(np.uint8) ^ 0x80).tobytes() for x in flac_media._decode_fast(streams)] == [ramp, bytes([5]) * 192]


def test_a_long_text_takes_bounded_memory():
    code = "import resource, numpy as np\nfrom stowline.llm import flac_media as f\nbase = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\np = np.random.default_rng(0).integers(97, 123, 192 * 52000, dtype=np.uint8).tobytes()\ns = f.encode_streams([p])\nassert (f.decode_streams(s)[0].view(np.uint8) ^ 0x80).tobytes() == p\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) >> 10)"
    assert resource.RUSAGE_SELF == 0
    mb = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120).stdout)
    assert mb < 330


@pytest.mark.parametrize("frames, noise", [(127, True), (128, True), (129, True), (300, True), (2048, False), (2049, False), (70000, False)])
def test_the_general_reader_reads_frame_numbers_of_any_length(frames, noise):
    payload = np.random.default_rng(frames).integers(60, 70, 192 * frames, dtype=np.uint8).tobytes() if noise else bytes([frames % 100]) * (192 * frames)
    (data,) = flac_media.encode_streams([payload])
    assert (read_stream(data)[0][:, 0].astype(np.int8).view(np.uint8) ^ 0x80).tobytes() == payload


def test_a_false_header_in_a_long_stream():
    payload = bytearray(np.random.default_rng(4).integers(0, 256, 192 * 300, dtype=np.uint8).tobytes())
    false = flac_media._headers(np.array([200]))[0][0][:7].tobytes()
    payload[50:57] = bytes(x ^ 0x80 for x in false)
    (data,) = flac_media.encode_streams([bytes(payload)])
    with pytest.raises(ValueError):
        flac_media._decode_fast([data])
    assert [(x.view(np.uint8) ^ 0x80).tobytes() for x in flac_media.decode_streams([data])] == [bytes(payload)]


def test_foreign_numbers_of_two_and_three_bytes():
    x = np.cumsum(np.random.default_rng(9).integers(-20, 21, (96 * 3, 1)), axis=0)
    frames = [frame(k, [x[i * 96 : (i + 1) * 96, 0].tolist()], 16, 0, 4, [8], parts=0, rice=5, rice_kind=0, escape=False) for i, k in enumerate((127, 130, 70000))]
    assert (read_stream(stream(frames, x, 16, 96))[0] == x).all()
