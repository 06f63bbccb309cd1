"""A reader of any FLAC stream, frame by frame in order (for operator 9).

It takes what the format allows: 1 to 8 channels, stereo in difference form, 4 to 32 bits, blocks of any and of changing
size, constant, verbatim, fixed and linear subframes with wasted bits, Rice partitions of either kind with escape
codes. Every header's CRC-8, every frame's CRC-16 and the samples' MD5 are verified.
"""

from __future__ import annotations

import hashlib

import numpy as np

class DamagedStream(ValueError):
    """The stream is not what the format allows, or a checksum does not hold."""


#: Predictors by number: fixed ones of order 0 to 4, as coefficients of the samples before.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def crc_table(bits: int, poly: int) -> list[int]:
    out = []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)
        out.append(c & ((1 << bits) - 1))
    return out


CRC8, CRC16 = crc_table(8, 0x07), crc_table(16, 0x8005)


def _crc8(data: bytes) -> int:
    c = 0
    for x in data:
        c = CRC8[c ^ x]
    return c


def _crc16(data: bytes) -> int:
    c = 0
    for x in data:
        c = (c << 8 & 0xFFFF) ^ CRC16[c >> 8 ^ x]
    return c


class _Bits:
    """Bits of a piece of a stream, as a string of 0 and 1; IndexError behind its end."""

    def __init__(self, data: bytes):
        self.text = "".join(f"{x:08b}" for x in data)
        self.at = 0

    def take(self, n: int) -> int:
        self.at += n
        if self.at > len(self.text):
            raise IndexError
        return int(self.text[self.at - n : self.at] or "0", 2)

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def zeros(self) -> int:
        """Zeros up to the next one, which is read too."""
        stop = self.text.find("1", self.at)
        if stop < 0:
            raise IndexError
        n, self.at = stop - self.at, stop + 1
        return n


class Info:
    """STREAMINFO, and where the frames begin."""

    def __init__(self, stream: bytes):
        if stream[:4] != b"fLaC":
            raise DamagedStream("not a FLAC stream")
        at, last, found = 4, False, None
        while not last:
            if at + 4 > len(stream):
                raise DamagedStream("the stream ends in its metadata")
            last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
            found = stream[at + 4 : at + 4 + size] if kind == 0 else found
            at += 4 + size
        if found is None or len(found) < 34:
            raise DamagedStream("the stream has no STREAMINFO")
        word = int.from_bytes(found[10:18], "big")
        self.begin, self.blocks, self.md5 = at, (int.from_bytes(found[:2], "big"), int.from_bytes(found[2:4], "big")), bytes(found[18:34])
        self.rate, self.channels, self.bits, self.samples = word >> 44, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & ((1 << 36) - 1)


def _residuals(b: _Bits, block: int, order: int) -> list[int]:
    kind = b.take(2)
    if kind > 1:
        raise DamagedStream("residuals of an unknown kind")
    width, parts = 4 + kind, b.take(4)
    out: list[int] = []
    for k in range(1 << parts):
        n = (block >> parts) - (order if k == 0 else 0)
        rice = b.take(width)
        if rice == (1 << width) - 1:
            raw = b.take(5)
            out += [b.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            z = b.zeros() << rice | b.take(rice)
            out.append(z >> 1 ^ -(z & 1))
    return out


def _subframe(b: _Bits, block: int, bits: int) -> list[int]:
    if b.take(1):
        raise DamagedStream("a subframe does not begin with a zero")
    kind, wasted = b.take(6), 0
    if b.take(1):
        wasted = b.zeros() + 1
        bits -= wasted
    if kind == 0:
        out = [b.signed(bits)] * block
    elif kind == 1:
        out = [b.signed(bits) for _ in range(block)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [b.signed(bits) for _ in range(order)]
        coefs, shift = (FIXED[order], 0) if kind < 32 else (None, 0)
        if coefs is None:
            precision = b.take(4) + 1
            shift = b.signed(5)
            coefs = [b.signed(precision) for _ in range(order)]
        for e in _residuals(b, block, order):
            out.append(e + (sum(c * out[-1 - j] for j, c in enumerate(coefs)) >> shift))
    else:
        raise DamagedStream(f"a subframe of reserved kind {kind}")
    return [x << wasted for x in out]


def _frame(data: bytes, info: Info) -> tuple[list[list[int]], int]:
    """Samples of each channel of the frame that data begins with, and its length in bytes."""
    b = _Bits(data)
    if b.take(15) != 0x7FFC:
        raise DamagedStream("no frame begins here")
    b.take(1)
    size, rate, layout, depth = b.take(4), b.take(4), b.take(4), b.take(3)
    b.take(1)
    lead = b.take(8)
    for _ in range(max(0, 7 - (lead ^ 0xFF).bit_length())):
        b.take(8)
    if size == 0 or layout > 10 or depth == 3:
        raise DamagedStream("a frame header has reserved values")
    block = 192 if size == 1 else 576 << (size - 2) if size < 6 else b.take(8) + 1 if size == 6 else b.take(16) + 1 if size == 7 else 256 << (size - 8)
    b.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    head = b.at // 8
    if _crc8(data[:head]) != b.take(8):
        raise DamagedStream("a frame header's checksum does not hold")
    bits = {0: info.bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth]
    channels = layout + 1 if layout < 8 else 2
    # 8 left and side, 9 side and right, 10 middle and side.
    own = [_subframe(b, block, bits + (c == (layout != 9) and layout >= 8)) for c in range(channels)]
    if layout == 8:
        own[1] = [x - y for x, y in zip(*own, strict=True)]
    elif layout == 9:
        own[0] = [x + y for x, y in zip(*own, strict=True)]
    elif layout == 10:
        both = [((x << 1 | y & 1) + y >> 1, (x << 1 | y & 1) - y >> 1) for x, y in zip(*own, strict=True)]
        own = [[x for x, _ in both], [y for _, y in both]]
    b.at += -b.at % 8
    end = b.at // 8
    if _crc16(data[:end]) != b.take(16):
        raise DamagedStream("a frame's checksum does not hold")
    return own, end + 2


def read_stream(stream: bytes) -> tuple[np.ndarray, Info]:
    """Samples (n x channels) of a stream; DamagedStream, with the place, where it is damaged."""
    info = Info(stream)
    at, done, out = info.begin, 0, []
    while done < info.samples or not info.samples and at < len(stream):
        size = 64 + info.channels * max(info.blocks) * (info.bits + 2) // 8
        while True:
            try:
                own, used = _frame(stream[at : at + size], info)
                break
            except IndexError:
                if at + size >= len(stream):
                    raise DamagedStream(f"the stream ends in the frame at byte {at}") from None
                size *= 4
            except DamagedStream as e:
                raise DamagedStream(f"at byte {at}: {e}") from None
        out.append(np.array(own, np.int64).T)
        at += used
        done += len(out[-1])
    samples = np.concatenate(out) if out else np.empty((0, info.channels), np.int64)
    if info.samples and len(samples) != info.samples:
        raise DamagedStream("the stream has another number of samples than it says")
    width = -(-info.bits // 8)
    raw = (samples & ((1 << 8 * width) - 1)).astype("<u8").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()
    if any(info.md5) and hashlib.md5(raw).digest() != info.md5:
        raise DamagedStream("the samples' MD5 does not hold")
    return samples, info
