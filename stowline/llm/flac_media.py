"""Media columns in FLAC (operator 9): streams in and out of 8-bit mono samples, many frames at once.

The writer makes streams of fixed blocks with STREAMINFO (with the samples' MD5) and a seek table; each frame is
constant, verbatim, or Rice-coded residuals of the best of the fixed predictors 0 to 2 and a linear predictor of
order 4. The fast reader, for streams of that form, finds the frames by their headers, whose checksums and numbers must
hold, verifies every frame's CRC-16 and the MD5, decodes residuals and predictors, and gives PCM blocks with their sample
offsets. Both work on arrays of frames: a step of the bit reader or of a predictor is done for all frames of a batch
together. Streams of any other form, and those in which bytes look like another frame's header, are read frame by frame
in order (``flac_reader``).

A sample is a byte less 128. Defined results: a null or empty text is one block of blanks; equal texts give equal
streams; a damaged stream raises DamagedStream, a ValueError, naming the place; repeated rows are done each; an empty table gives no
rows; other columns are ignored. Frames of a very long text are coded ``BATCH`` samples at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import id_and_text, write_table
from .flac_reader import CRC8, CRC16, FIXED, DamagedStream, Info, read_stream

BLOCK = 192
RATE = 8000
#: Frames between two points of the seek table.
SEEK_FRAMES = 64
#: Order and bits of a coefficient of the linear predictor.
LPC_ORDER, LPC_BITS = 4, 8
#: Share of a verbatim frame's bits that coding must save; a smaller gain is not worth the decoding.
LEAST_GAIN = 0.04
#: Samples that a task works on at once.
BATCH = 1 << 20

MEDIA = "doc_id long, n_bytes long, flac binary"
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
PCM = "doc_id long, block long, first_sample long, n_samples long, pcm binary"


_CRC8, _CRC16 = np.array(CRC8, np.uint8), np.array(CRC16, np.uint16)


def _rows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, right: bool, extra: int = 0) -> np.ndarray:
    """A row of bytes for each piece of data, with zeros in front (right) or behind."""
    width = int(lengths.max(initial=0)) + extra
    column = np.arange(width)
    at = column - (width - lengths[:, None]) if right else column[None, :]
    inside = (at >= 0) & (at < lengths[:, None])
    return np.where(inside, data[np.where(inside, starts[:, None] + at, 0)], 0).astype(np.uint8)


def _crc16(rows: np.ndarray) -> np.ndarray:
    """Of rows with zeros in front, which change nothing."""
    crc = np.zeros(len(rows), np.uint16)
    for column in np.ascontiguousarray(rows.T):
        crc = (crc << np.uint16(8)) ^ _CRC16[(crc >> np.uint16(8)).astype(np.uint8) ^ column]
    return crc


def _crc8(rows: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(rows), np.uint8)
    for column in rows.T:
        crc = _CRC8[crc ^ column]
    return crc


def _number(n: int) -> bytes:
    """A frame's number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    size = next(s for s in range(2, 8) if n < 1 << (5 * s + 1))
    tail = [0x80 | (n >> (6 * k) & 0x3F) for k in range(size - 1)]
    return bytes([(0xFF00 >> size & 0xFF) | n >> (6 * (size - 1)), *reversed(tail)])


def _headers(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of frame headers with CRC-8, and their lengths."""
    names, inverse = np.unique(numbers, return_inverse=True)
    raw = [b"\xff\xf8\x10\x02" + _number(int(n)) for n in names]
    lengths = np.array([len(r) for r in raw])
    rows = np.array([list(r.rjust(11, b"\0")) for r in raw], np.uint8).reshape(-1, 11)
    crc = _crc8(rows)
    left = np.zeros((len(raw), 12), np.uint8)
    for i, r in enumerate(raw):
        left[i, : len(r)] = list(r)
        left[i, len(r)] = crc[i]
    return left[inverse], lengths[inverse] + 1


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantized coefficients (frames x order) and shifts, by the autocorrelation of each frame."""
    f = x.astype(np.float64)
    r = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, : f.shape[1] - k]) for k in range(LPC_ORDER + 1)], axis=1)
    a, error = np.zeros((len(x), LPC_ORDER)), np.maximum(r[:, 0], 1e-9)
    for m in range(LPC_ORDER):
        k = (r[:, m + 1] - np.einsum("ij,ij->i", a[:, :m], r[:, m:0:-1])) / error
        before = a[:, :m].copy()
        a[:, m] = k
        a[:, :m] = before - k[:, None] * before[:, ::-1]
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = (1 << (LPC_BITS - 1)) - 1
    shift = np.clip(np.floor(np.log2(top / np.maximum(np.abs(a).max(axis=1), 1e-9))), 0, 15).astype(np.int64)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -top - 1, top).astype(np.int32), shift.astype(np.int32)


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Frames of int8 samples (frames x BLOCK), end to end, and their lengths in bytes."""
    x = samples.astype(np.int32)
    n = len(x)
    constant = (x == x[:, :1]).all(axis=1)
    coefs, shift = _linear(x)
    best_bits = np.full(n, int(8 * BLOCK * (1 - LEAST_GAIN)))
    kind, param = np.where(constant, 0, 1), np.zeros(n, np.int32)
    residual = np.zeros((n, BLOCK), np.uint32)
    for k, order in ((8, 0), (9, 1), (10, 2), (31 + LPC_ORDER, LPC_ORDER)):
        guess = np.zeros_like(x)
        if k < 32:
            for j, c in enumerate(FIXED[order]):
                guess[:, order:] += c * x[:, order - 1 - j : BLOCK - 1 - j]
            extra = 0
        else:
            for j in range(order):
                guess[:, order:] += coefs[:, j : j + 1] * x[:, order - 1 - j : BLOCK - 1 - j]
            guess >>= shift[:, None]
            extra = 9 + order * LPC_BITS
        e = x - guess
        z = ((e << 1) ^ (e >> 31)).astype(np.uint32)
        z[:, :order] = 0
        mean = z.sum(axis=1, dtype=np.int64) / (BLOCK - order)
        rice = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.uint32)
        bits = (z >> rice[:, None])[:, order:].sum(axis=1, dtype=np.int64) + (BLOCK - order) * (1 + rice.astype(np.int64)) + 8 * order + 10 + extra
        better = (bits < best_bits) & ~constant
        best_bits[better], kind[better], param[better] = bits[better], k, rice[better]
        residual[better] = z[better]
    head, head_size = _headers(numbers)
    coded = kind >= 8
    body = np.where(constant, 1, np.where(coded, -(-best_bits // 8), BLOCK))
    size = head_size + 1 + body + 2
    begin = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()) * 8, np.uint8)
    first = (begin + head_size + 1) * 8

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[at + j] = value >> (width - 1 - j) & 1

    rows = np.flatnonzero(coded)
    if len(rows):
        order = np.where(kind[rows] >= 32, LPC_ORDER, kind[rows] - 8)
        at = first[rows] + 8 * order
        linear = np.flatnonzero(kind[rows] >= 32)
        put(at[linear], np.full(len(linear), LPC_BITS - 1), 4)
        put(at[linear] + 4, shift[rows][linear], 5)
        for j in range(LPC_ORDER):
            put(at[linear] + 9 + j * LPC_BITS, coefs[rows][linear, j] & ((1 << LPC_BITS) - 1), LPC_BITS)
        at[linear] += 9 + LPC_ORDER * LPC_BITS
        rice = param[rows].astype(np.int64)
        put(at + 6, rice, 4)
        z = residual[rows].astype(np.int64)
        q = z >> rice[:, None]
        length = q + 1 + rice[:, None]
        skip = np.arange(BLOCK)[None, :] < order[:, None]
        length[skip] = 0
        stop = at[:, None] + 10 + np.cumsum(length, axis=1) - length + q
        keep = ~skip
        stop, low, width = stop[keep], z[keep], np.broadcast_to(rice[:, None], z.shape)[keep]
        bits[stop] = 1
        for j in range(int(width.max(initial=0))):
            some = np.flatnonzero(width > j)
            bits[stop[some] + 1 + j] = low[some] >> (width[some] - 1 - j) & 1
    out = np.packbits(bits)
    raw = samples.view(np.uint8)
    for j in range(12):
        some = np.flatnonzero(head_size > j)
        out[begin[some] + j] = head[some, j]
    at = begin + head_size
    out[at] = kind << 1
    rows = np.flatnonzero(~coded & ~constant)
    out[(at[rows, None] + 1 + np.arange(BLOCK)).ravel()] = raw[rows].ravel()
    out[at[constant] + 1] = raw[constant, 0]
    for j in range(LPC_ORDER):
        some = np.flatnonzero((kind == 9) & (j < 1) | (kind == 10) & (j < 2) | (kind >= 32))
        out[at[some] + 1 + j] = raw[some, j]
    crc = _crc16(_rows(out, begin, size - 2, right=True))
    out[begin + size - 2], out[begin + size - 1] = crc >> np.uint16(8), crc & np.uint16(255)
    return out.tobytes(), size


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads, whose lengths are positive multiples of BLOCK."""
    count = np.array([len(p) // BLOCK for p in payloads])
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ np.uint8(0x80)).view(np.int8).reshape(-1, BLOCK)
    numbers = np.arange(len(samples)) - np.repeat(np.cumsum(count) - count, count)
    coded = [encode_frames(samples[k : k + BATCH // BLOCK], numbers[k : k + BATCH // BLOCK]) for k in range(0, len(samples), BATCH // BLOCK)]
    data, sizes = b"".join(d for d, _ in coded), np.concatenate([x for _, x in coded])
    ends = np.cumsum(sizes)
    out, frame = [], 0
    for n in count.tolist():
        a, z = int(ends[frame] - sizes[frame]), int(ends[frame + n - 1])
        own = sizes[frame : frame + n]
        offset = np.cumsum(own) - own
        seek = b"".join(struct.pack(">QQH", k * BLOCK, int(offset[k]), BLOCK) for k in range(0, n, SEEK_FRAMES))
        md5 = hashlib.md5(samples[frame : frame + n].tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | n * BLOCK).to_bytes(8, "big") + md5
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + data[a:z])
        frame += n
    return out


def _stream_info(stream: bytes) -> tuple[int, int, bytes]:
    """Where the frames begin, the number of samples, and their MD5."""
    info = Info(stream)
    if info.blocks != (BLOCK, BLOCK) or info.channels != 1 or info.bits != 8:
        raise DamagedStream(f"not a mono stream of 8 bits in blocks of {BLOCK}")
    return info.begin, info.samples, info.md5


def _find_frames(data: np.ndarray, begin: np.ndarray, end: np.ndarray, frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and subframe places of all frames: headers that hold, in the order of their numbers."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero((data[:-5] == 0xFF) & (data[1:-4] == 0xF8) & (data[2:-3] == 0x10) & (data[3:-2] == 0x02))
    owner = np.searchsorted(begin, at, side="right") - 1
    inside = (owner >= 0) & (at < end[np.maximum(owner, 0)])
    at, owner = at[inside], owner[inside]
    lead = data[at + 4]
    tail = np.where(lead < 0x80, 0, np.where(lead >= 0xFC, 5, np.where(lead >= 0xF8, 4, np.where(lead >= 0xF0, 3, np.where(lead >= 0xE0, 2, 1)))))
    number = np.where(tail == 0, lead, lead & (0x3F >> tail)).astype(np.int64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    for j in range(5):
        number = np.where(tail > j, number << 6 | padded[at + 5 + j] & 0x3F, number)
    head = 5 + tail
    good = _crc8(_rows(padded, at, head, right=True)) == padded[at + head]
    at, owner, number, head = at[good], owner[good], number[good], head[good]
    first = np.cumsum(frames) - frames
    wanted = np.full(int(frames.sum()), -1, np.int64)
    real = number < frames[owner]
    slot = first[owner[real]] + number[real]
    wanted[slot[::-1]] = np.flatnonzero(real)[::-1]  # of equal numbers the first
    if (wanted < 0).any():
        raise DamagedStream(f"frame {int(np.flatnonzero(wanted < 0)[0])} of the batch has no valid header")
    return at[wanted], (at + head + 1)[wanted]


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream, after all checksums hold: int8, or int64 (n x channels) of streams of another form."""
    try:
        return _decode_fast(streams)
    except DamagedStream:
        if len(streams) > 1:
            return [x for s in streams for x in decode_streams([s])]
        samples, info = read_stream(streams[0])
        return [samples[:, 0].astype(np.int8) if info.channels == 1 and info.bits == 8 else samples]


def _decode_fast(streams: list[bytes]) -> list[np.ndarray]:
    if not streams:
        return []
    infos = [_stream_info(s) for s in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    frames = np.array([n // BLOCK for _, n, _ in infos])
    begin, end = base[:-1] + [i[0] for i in infos], base[1:]
    starts, places = _find_frames(data, begin, end, frames)
    last = np.cumsum(frames) - 1
    ends = np.append(starts[1:], 0)
    ends[last] = end
    if (ends <= starts).any():
        raise DamagedStream("frames are not in the order of their numbers")
    step = BATCH // BLOCK
    samples = np.concatenate([_decode_frames(data, starts[k : k + step], places[k : k + step], ends[k : k + step]) for k in range(0, len(starts), step)])
    out, at = [], 0
    for (_, n, md5), count in zip(infos, frames.tolist(), strict=True):
        own = samples[at : at + count].reshape(-1)
        if len(own) != n or hashlib.md5(own.tobytes()).digest() != md5:
            raise DamagedStream("the samples' MD5 does not hold")
        out.append(own)
        at += count
    return out


def _decode_frames(data: np.ndarray, starts: np.ndarray, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if int((ends - starts).max()) > 2 * BLOCK or (_crc16(_rows(data, starts, ends - starts, right=True)) != 0).any():
        raise DamagedStream("a frame's checksum does not hold")
    kind = data[places] >> 1
    x = np.zeros((len(starts), BLOCK), np.int32)
    rows = np.flatnonzero(kind == 0)
    x[rows] = data[places[rows] + 1].view(np.int8)[:, None]
    rows = np.flatnonzero(kind == 1)
    x[rows] = data[places[rows, None] + 1 + np.arange(BLOCK)].view(np.int8)
    rows = np.flatnonzero(kind >= 8)
    if len(rows):
        x[rows] = _decode_coded(data, places[rows] + 1, ends[rows] - 2, kind[rows])
    return x.astype(np.int8)


def _decode_coded(data: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Samples of frames with Rice-coded residuals of fixed or linear predictors (partition order 0)."""
    n = len(begin)
    rows = _rows(data, begin, end - begin, right=False, extra=4)
    width = rows.shape[1] * 8
    flat = rows.reshape(-1)
    wide = np.zeros(len(flat), np.uint32)
    for j in range(3):
        wide[: len(flat) - j] |= flat[j:].astype(np.uint32) << np.uint32(16 - 8 * j)
    base = np.arange(n, dtype=np.int64) * width

    def take(at: np.ndarray, count) -> np.ndarray:
        """count bits (up to 16) at bit places of the rows laid end to end."""
        return (wide[at >> 3] >> (24 - (at & 7) - count).astype(np.uint32)).astype(np.int64) & ((1 << np.asarray(count)) - 1)

    linear = kind >= 32
    order = np.where(linear, kind.astype(np.int64) - 31, kind.astype(np.int64) - 8)
    most = int(order.max())
    coefs, shift = np.zeros((most, n), np.int32), np.zeros(n, np.int32)
    for k in range(1, min(most, 4) + 1):
        own = ~linear & (order == k)
        coefs[:k, own] = np.array(FIXED[k], np.int32)[:, None]
    at = base + 8 * order
    some = np.flatnonzero(linear)
    if len(some):
        precision = take(at[some], np.full(len(some), 4)) + 1
        shift[some] = take(at[some] + 4, np.full(len(some), 5))
        for j in range(most):
            own = order[some] > j
            value = take(at[some][own] + 9 + j * precision[own], precision[own])
            coefs[j, some[own]] = value - (value >> (precision[own] - 1) << precision[own])
        at[some] += 9 + order[some] * precision
    if take(at, np.full(n, 6)).any():
        raise DamagedStream("only Rice codes in one partition are read")
    rice = take(at + 6, np.full(n, 4))
    bits = np.unpackbits(rows, axis=1)
    places = np.where(bits.view(bool), np.arange(width, dtype=np.int16 if width < 32000 else np.int32), width - 1)
    following = np.minimum.accumulate(places[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    stops, begins = np.zeros((BLOCK, n), np.int64), np.zeros((BLOCK, n), np.int64)
    at = at + 10
    for i in range(BLOCK):
        stop = base + following[np.minimum(at, base + width - 1)]
        coded = i >= order
        stops[i], begins[i] = stop, at
        at = np.where(coded, stop + 1 + rice, at)
    deep = np.broadcast_to(rice, stops.shape)
    z = (stops - begins) << deep | take(np.minimum(stops + 1, len(flat) * 8 - 24), deep)
    e = ((z >> 1) ^ -(z & 1)).astype(np.int32)
    x = np.zeros((BLOCK, n), np.int32)
    warm = rows[:, :most].astype(np.int8).T if most else None
    for i in range(BLOCK):
        guess = np.zeros(n, np.int32)
        for j in range(min(i, most)):
            guess += coefs[j] * x[i - 1 - j]
        x[i] = e[i] + (guess >> shift)
        if i < most:
            x[i] = np.where(i < order, warm[i], x[i])
    return x.T


def payload(text: str) -> bytes:
    """UTF-8 with blanks up to a positive multiple of BLOCK."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b" ")


def _batches(sizes: list[int]) -> Iterator[slice]:
    at = 0
    while at < len(sizes):
        size, end = 0, at
        while end < len(sizes) and (end == at or size + sizes[end] <= BATCH):
            size += sizes[end]
            end += 1
        yield slice(at, end)
        at = end


def to_flac(docs: DataFrame) -> DataFrame:
    """A table of the documents' texts as FLAC streams, in the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for part in _batches([len(t) for t in texts]):
                payloads = [payload(t) for t in texts[part]]
                raw = [len(t.encode("utf-8", "surrogatepass")) for t in texts[part]]
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[part], "n_bytes": raw, "flac": encode_streams(payloads)})

    return write_table(id_and_text(docs).mapInPandas(run, MEDIA), "flac")


def features(media: DataFrame) -> DataFrame:
    """What the stored streams say: payload digests and a feature string (peak, sum, sum of squares, sign changes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            streams = batch["flac"].tolist()
            for part in _batches([len(s) for s in streams]):
                out = []
                for doc, n, stream, x in zip(batch["doc_id"].iloc[part], batch["n_bytes"].iloc[part], streams[part], decode_streams(streams[part]), strict=True):
                    raw = (x.view(np.uint8) ^ np.uint8(0x80)).tobytes()
                    wide = x.astype(np.int64)
                    feature = f"{int(np.abs(wide).max())}:{int(wide.sum())}:{int((wide * wide).sum())}:{int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"
                    out.append((doc, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return media.mapInPandas(run, RESULT)


def _pcm(samples: np.ndarray, stream: bytes) -> bytes:
    if samples.ndim == 1:
        return samples.tobytes()
    width = -(-Info(stream).bits // 8)
    return (samples & ((1 << 8 * width) - 1)).astype("<u8").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()


def pcm_blocks(media: DataFrame, samples: int = BLOCK * SEEK_FRAMES) -> DataFrame:
    """PCM blocks of decoded streams with the offset of their first sample: what a reader seeks by.

    Samples are little endian, channels in turn, in the fewest bytes that hold their bits.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            streams = batch["flac"].tolist()
            for part in _batches([len(s) for s in streams]):
                for doc, stream, x in zip(batch["doc_id"].iloc[part], streams[part], decode_streams(streams[part]), strict=True):
                    starts = range(0, len(x), samples)
                    pieces = [x[a : a + samples] for a in starts]
                    yield pd.DataFrame({"doc_id": doc, "block": range(len(pieces)), "first_sample": list(starts), "n_samples": [len(p) for p in pieces], "pcm": [_pcm(p, stream) for p in pieces]})

    return media.select("doc_id", F.col("flac")).mapInPandas(run, PCM)
