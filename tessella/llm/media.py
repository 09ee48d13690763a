"""Media columns: progressive JPEG files to RGB tensors.

A progressive file sends each coefficient in parts: bands of the spectrum (spectral selection) at falling precision
(successive approximation). decode() accumulates all scans into arrays of coefficients, one per component; then numpy
dequantises and inverse-transforms all blocks at once, repeats chroma samples up to full resolution and converts to
RGB. encode() is the other way, for making media from numbers and for tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Row-major place of the k-th coefficient of the zigzag order.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_ANGLES = (2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16
DCT = np.cos(_ANGLES) * np.where(np.arange(8)[:, None] == 0, np.sqrt(1 / 8), 0.5)


class MediaError(ValueError):
    pass


_TABLES: dict[bytes, tuple[list[int], list[int]]] = {}


def _lookup(spec: bytes) -> tuple[list[int], list[int]]:
    """From a table's 16 counts and its symbols: code length and symbol for each 16 bits that may come; length 0: no code."""
    if spec not in _TABLES:
        if len(_TABLES) > 64:
            _TABLES.clear()
        length, symbol, at = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        k = 16
        for bits in range(1, 17):
            for _ in range(spec[bits - 1]):
                if k >= len(spec) or at >= 1 << 16:
                    raise MediaError("bad Huffman table")
                width = 1 << (16 - bits)
                length[at : at + width], symbol[at : at + width] = bits, spec[k]
                at += width
                k += 1
        _TABLES[spec] = length.tolist(), symbol.tolist()
    return _TABLES[spec]


class _Component:
    def __init__(self, h: int, v: int, quant: int):
        self.h, self.v, self.quant = h, v, quant
        self.table: np.ndarray | None = None

    def lay(self, width: int, height: int, hmax: int, vmax: int) -> None:
        mx, my = -(-width // (8 * hmax)), -(-height // (8 * vmax))
        self.wide, self.high = mx * self.h, my * self.v
        self.used_wide = -(-(-(-width * self.h // hmax)) // 8)
        self.used_high = -(-(-(-height * self.v // vmax)) // 8)
        self.blocks = [[0] * 64 for _ in range(self.wide * self.high)]


class _Scan:
    """Decodes one segment of entropy-coded data (between restarts)."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data.replace(b"\xff\x00", b"\xff") + b"\0" * 8, 0, 0
        self.end = (len(self.data) - 8) * 8
        self.eob_run = 0

    def bits(self, n: int) -> int:
        if not n:
            return 0
        at = self.at
        self.at = at + n
        k = at >> 3
        return (int.from_bytes(self.data[k : k + 4], "big") >> (32 - (at & 7) - n)) & ((1 << n) - 1)

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        at = self.at
        if at >= self.end:
            raise MediaError("scan ends early")
        k = at >> 3
        peek = (int.from_bytes(self.data[k : k + 3], "big") >> (8 - (at & 7))) & 0xFFFF
        n = table[0][peek]
        if not n:
            raise MediaError("bad code")
        self.at = at + n
        return table[1][peek]

    def value(self, n: int) -> int:
        v = self.bits(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def sequential(self, b: list[int], dc, ac, last: int) -> int:
        last += self.value(self.symbol(dc))
        b[0] = last
        k = 1
        while k < 64:
            s = self.symbol(ac)
            run, size = s >> 4, s & 15
            if not size:
                if run < 15:
                    break
                k += 16
                continue
            k += run
            if k > 63:
                raise MediaError("run beyond a block")
            b[k] = self.value(size)
            k += 1
        return last

    def ac_first(self, b: list[int], ac, first: int, last: int, low: int) -> None:
        if self.eob_run:
            self.eob_run -= 1
            return
        k = first
        while k <= last:
            s = self.symbol(ac)
            run, size = s >> 4, s & 15
            if size:
                k += run
                if k > 63:
                    raise MediaError("run beyond a block")
                b[k] = self.value(size) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                self.eob_run = (1 << run) - 1 + self.bits(run)
                return

    def ac_refine(self, b: list[int], ac, first: int, last: int, low: int) -> None:
        one = 1 << low
        k = first
        if not self.eob_run:
            while k <= last:
                s = self.symbol(ac)
                run, size = s >> 4, s & 15
                new = 0
                if size:
                    new = one if self.bits(1) else -one
                elif run < 15:
                    self.eob_run = (1 << run) + self.bits(run)
                    break
                while k <= last:
                    if b[k]:
                        if self.bits(1) and not abs(b[k]) & one:
                            b[k] += one if b[k] > 0 else -one
                    elif run:
                        run -= 1
                    else:
                        if new:
                            b[k] = new
                        k += 1
                        break
                    k += 1
        if self.eob_run:
            while k <= last:
                if b[k] and self.bits(1) and not abs(b[k]) & one:
                    b[k] += one if b[k] > 0 else -one
                k += 1
            self.eob_run -= 1


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded data from at, cut at restart markers, and where the next other marker is."""
    out, begin = [], at
    while True:
        k = data.find(b"\xff", at)
        if k < 0 or k + 1 >= len(data):
            return [*out, data[begin:]], len(data)
        kind = data[k + 1]
        if kind == 0:
            at = k + 2
        elif 0xD0 <= kind <= 0xD7:
            out.append(data[begin:k])
            at = begin = k + 2
        elif kind == 0xFF:
            at = k + 1
        else:
            return [*out, data[begin:k]], k


def coefficients(data: bytes) -> tuple[int, int, dict[int, _Component]]:
    """Height, width and the components with their coefficients (zigzag order) and quantisation tables."""
    if data[:2] != b"\xff\xd8":
        raise MediaError("not a JPEG")
    at, quants, dc, ac, restart = 2, {}, {}, {}, 0
    parts: dict[int, _Component] = {}
    height = width = 0
    progressive = ended = False
    seen: set[int] = set()
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            raise MediaError("no marker where one must be")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            ended = True
            break
        if kind == 0x01 or 0xD0 <= kind <= 0xD8:  # markers without a body
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                if len(body) < 1 + n:
                    raise MediaError("bad quantisation table")
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _lookup(body[1:n])
                body = body[n:]
        elif kind in (0xC0, 0xC1, 0xC2):
            progressive = kind == 0xC2
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if body[0] != 8 or not height or not width or body[5] not in (1, 3):
                raise MediaError("only 8 bits, sizes over 0 and 1 or 3 components")
            for k in range(body[5]):
                i, hv, q = body[6 + 3 * k : 9 + 3 * k]
                parts[i] = _Component(hv >> 4, hv & 15, q)
            hmax, vmax = max(c.h for c in parts.values()), max(c.v for c in parts.values())
            if any(not 1 <= x <= 4 or m % x for c in parts.values() for x, m in ((c.h, hmax), (c.v, vmax))):
                raise MediaError("sampling factors that aren't decoded")
            if sum(-(-width // (8 * hmax)) * c.h * -(-height // (8 * vmax)) * c.v for c in parts.values()) > 8 * len(data):
                raise MediaError("more blocks than the file has bits for")
            for c in parts.values():
                c.lay(width, height, hmax, vmax)
        elif kind in (0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise MediaError("a kind of JPEG that isn't decoded")
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind == 0xDA:
            n = body[0]
            picked = [(parts[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)]
            first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            segments, at = _segments(data, at)
            if not n or last > 63 or first > last:
                raise MediaError("bad scan")
            if not first and not high:
                seen |= {body[1 + 2 * k] for k in range(n)}
            _scan(picked, segments, restart, first, last, high, low, dc, ac, progressive, width, height, parts)
    if not parts:
        raise MediaError("no frame")
    if not ended or seen != set(parts):
        raise MediaError("the file is cut short")
    for c in parts.values():
        if c.quant not in quants:
            raise MediaError("no quantisation table")
        c.table = quants[c.quant]
    return height, width, parts


def _scan(picked, segments, restart, first, last, high, low, dc, ac, progressive, width, height, parts) -> None:
    if len(picked) == 1:
        c = picked[0][0]
        units = [[(0, y * c.wide + x)] for y in range(c.used_high) for x in range(c.used_wide)]
    else:
        hmax, vmax = max(c.h for c in parts.values()), max(c.v for c in parts.values())
        mx, my = -(-width // (8 * hmax)), -(-height // (8 * vmax))
        units = [[(k, (y * c.v + v) * c.wide + x * c.h + h) for k, (c, _, _) in enumerate(picked) for v in range(c.v) for h in range(c.h)] for y in range(my) for x in range(mx)]
    step = restart or len(units)
    for k, begin in enumerate(range(0, len(units), step)):
        if k >= len(segments):
            raise MediaError("restart missing")
        s, previous = _Scan(segments[k]), [0] * len(picked)
        for unit in units[begin : begin + step]:
            for n, block in unit:
                c, d, a = picked[n]
                b = c.blocks[block]
                if not progressive:
                    previous[n] = s.sequential(b, dc[d], ac[a], previous[n])
                elif first == 0:
                    if high:
                        b[0] |= s.bits(1) << low
                    else:
                        previous[n] += s.value(s.symbol(dc[d]))
                        b[0] = previous[n] * (1 << low)
                elif high:
                    s.ac_refine(b, ac[a], first, last, low)
                else:
                    s.ac_first(b, ac[a], first, last, low)


def _plane(c: _Component) -> np.ndarray:
    """Samples of a component from its coefficients, -128 to 127."""
    flat = np.zeros((len(c.blocks), 64))
    flat[:, ZIGZAG] = np.array(c.blocks, float) * c.table
    blocks = DCT.T @ flat.reshape(-1, 8, 8) @ DCT
    return blocks.reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.high * 8, c.wide * 8)


def decode(data: bytes) -> np.ndarray:
    """height x width x 3, uint8. Chroma samples are repeated to full resolution; grey files give equal channels."""
    try:
        height, width, parts = coefficients(data)
        return _pixels(height, width, parts)
    except (IndexError, KeyError, TypeError, ValueError, OverflowError, UnboundLocalError) as e:
        raise e if isinstance(e, MediaError) else MediaError(f"damaged file: {e!r}") from e


def _pixels(height: int, width: int, parts: dict[int, _Component]) -> np.ndarray:
    hmax, vmax = max(c.h for c in parts.values()), max(c.v for c in parts.values())
    planes = []
    for c in parts.values():
        p = np.repeat(np.repeat(_plane(c), vmax // c.v, axis=0), hmax // c.h, axis=1)
        planes.append(p[:height, :width])
    if len(planes) == 1:
        rgb = np.repeat((planes[0] + 128)[:, :, None], 3, axis=2)
    else:
        y, cb, cr = planes
        rgb = np.stack([y + 128 + 1.402 * cr, y + 128 - 0.344136 * cb - 0.714136 * cr, y + 128 + 1.772 * cb], axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


# --- the other way ---------------------------------------------------------------------------------------------------

_DC_SPEC = bytes([0, 0, 0, 12, *[0] * 12, *range(12)])
_AC_SYMBOLS = bytes(sorted({*(r << 4 | s for r in range(16) for s in range(1, 11)), *(r << 4 for r in range(16))}))
_AC_SPEC = bytes([*[0] * 7, len(_AC_SYMBOLS), *[0] * 8]) + _AC_SYMBOLS
_AC_CODE = {s: k for k, s in enumerate(_AC_SYMBOLS)}
#: (components, first and last coefficient, precision before and after): DC, then bands of AC, then refinements.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 6, 63, 0, 2), ((0,), 1, 63, 2, 1), ((0, 1, 2), 0, 0, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0)]


class _Bits:
    def __init__(self):
        self.value, self.count = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value, self.count = self.value << n | value & ((1 << n) - 1), self.count + n

    def bytes(self) -> bytes:
        pad = -self.count % 8
        return (self.value << pad | (1 << pad) - 1).to_bytes((self.count + pad) // 8, "big").replace(b"\xff", b"\xff\x00")


def _amplitude(out: _Bits, v: int) -> None:
    n = abs(v).bit_length()
    out.put(v if v > 0 else v + (1 << n) - 1, n)


def _write_ac(out: _Bits, blocks: list[list[int]], first: int, last: int, high: int, low: int) -> None:
    run_of_ends, kept = 0, []

    def flush():
        nonlocal run_of_ends, kept
        if run_of_ends:
            n = run_of_ends.bit_length() - 1
            out.put(_AC_CODE[n << 4], 8)
            out.put(run_of_ends, n)
        for bit in kept:
            out.put(bit, 1)
        run_of_ends, kept = 0, []

    for b in blocks:
        size = [abs(x) >> low for x in b]
        stop = max((k for k in range(first, last + 1) if (size[k] == 1 if high else size[k])), default=0)
        run, bits = 0, []
        for k in range(first, last + 1):
            s = size[k]
            if not s:
                run += 1
                continue
            while run > 15 and k <= stop:
                flush()
                out.put(_AC_CODE[0xF0], 8)
                run -= 16
                for bit in bits:
                    out.put(bit, 1)
                bits = []
            if high and s > 1:
                bits.append(s & 1)
                continue
            flush()
            if high:
                out.put(_AC_CODE[run << 4 | 1], 8)
                out.put(b[k] > 0, 1)
                for bit in bits:
                    out.put(bit, 1)
                bits = []
            else:
                v = s if b[k] > 0 else -s
                out.put(_AC_CODE[run << 4 | s.bit_length()], 8)
                _amplitude(out, v)
            run = 0
        if run or bits:
            run_of_ends += 1
            kept += bits
            if run_of_ends == 0x7FFF or len(kept) > 900:
                flush()
    flush()


def quantise(rgb: np.ndarray, quant: int, sampling: int = 2) -> tuple[list[list[list[int]]], list[tuple[int, int]]]:
    """Blocks of quantised coefficients (zigzag order) of Y, Cb and Cr, and how many there are across and down."""
    height, width, _ = rgb.shape
    unit = 8 * sampling
    padded = np.pad(rgb.astype(float), ((0, -height % unit), (0, -width % unit), (0, 0)), mode="edge")
    r, g, b = padded[..., 0], padded[..., 1], padded[..., 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b - 128
    planes = [y, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b]
    out, sizes = [], []
    for k, p in enumerate(planes):
        if k:
            p = p.reshape(p.shape[0] // sampling, sampling, p.shape[1] // sampling, sampling).mean(axis=(1, 3))
        h, w = p.shape[0] // 8, p.shape[1] // 8
        blocks = DCT @ p.reshape(h, 8, w, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8) @ DCT.T
        out.append(np.rint(blocks.reshape(-1, 64)[:, ZIGZAG] / quant).astype(int).tolist())
        sizes.append((w, h))
    return out, sizes


def encode(rgb: np.ndarray, quant: int = 8, sampling: int = 2, script: list | None = None) -> bytes:
    """A progressive file with one quantiser for all coefficients and chroma at 1 / sampling (1 or 2) of the resolution."""
    height, width, _ = rgb.shape
    blocks, sizes = quantise(rgb, quant, sampling)

    def segment(kind: int, body: bytes) -> bytes:
        return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body

    out = [b"\xff\xd8", segment(0xDB, bytes([0, *[quant] * 64]))]
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, sampling << 4 | sampling, 0, 2, 0x11, 0, 3, 0x11, 0])
    out += [segment(0xC2, frame), segment(0xC4, bytes([0]) + _DC_SPEC), segment(0xC4, bytes([0x10]) + _AC_SPEC)]
    for picked, first, last, high, low in script or SCRIPT:
        bits = _Bits()
        if first == 0:
            mx, my = sizes[0][0] // sampling, sizes[0][1] // sampling
            previous = [0, 0, 0]
            for y in range(my):
                for x in range(mx):
                    for c in picked:
                        n = sampling if c == 0 else 1
                        for v in range(n):
                            for h in range(n):
                                now = blocks[c][(y * n + v) * sizes[c][0] + x * n + h][0] >> low
                                if high:
                                    bits.put(now & 1, 1)
                                else:
                                    d = now - previous[c]
                                    previous[c] = now
                                    bits.put(abs(d).bit_length(), 4)
                                    _amplitude(bits, d)
        else:
            c = picked[0]
            n = sampling if c == 0 else 1
            wide, high_ = -(-(-(-width * n // sampling)) // 8), -(-(-(-height * n // sampling)) // 8)
            used = [blocks[c][y * sizes[c][0] + x] for y in range(high_) for x in range(wide)]
            _write_ac(bits, used, first, last, high, low)
        head = bytes([len(picked), *(x for c in picked for x in (c + 1, 0)), first, last, high << 4 | low])
        out += [segment(0xDA, head), bits.bytes()]
    return b"".join([*out, b"\xff\xd9"])


def picture(vector: np.ndarray, size: int = 16) -> np.ndarray:
    """size x size x 3 picture of a vector: waves whose weights are its values, all of them, as many a channel as it takes; NaN counts as 0."""
    v = np.nan_to_num(np.asarray(vector, float))
    n = max(4, int(np.ceil(np.sqrt(len(v) / 3))))
    v = np.concatenate([v, np.zeros(3 * n * n - len(v))])
    v = v / max(1e-9, np.abs(v).max())
    basis = np.cos((2 * np.arange(size)[None, :] + 1) * np.arange(n)[:, None] * np.pi / (2 * size))
    weight = v.reshape(3, n, n) / (1 + np.arange(n)[:, None] + np.arange(n)[None, :])
    p = np.einsum("cij,iy,jx->yxc", weight, basis, basis)
    return np.clip(np.rint(128 + 90 * p), 0, 255).astype(np.uint8)


def render(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", quant: int = 4) -> DataFrame:
    """(id, media): each vector's picture as a progressive JPEG; a null vector gives null, an empty one and zeros a grey picture, null values and NaN count
    as 0. Repeated rows are rendered each, no rows give none, extra columns don't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [None if v is None else encode(picture(np.array([np.nan if x is None else x for x in v], float)), quant) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], ["id", "media"])

    kind = dict(vectors.dtypes)[id]
    return vectors.select(F.col(id).alias("id"), F.col(vector).alias("v")).mapInArrow(run, f"id {kind}, media binary")


def decode_media(table: DataFrame, id: str = "id", media: str = "media") -> DataFrame:
    """(id, height, width, channels, rgb, error): each file's pixels, row by row, at full resolution.

    A null or damaged or empty file has null pixels, and for the latter two error says why: also one that ends before its end mark, or that
    claims more blocks than it has bits. Repeated rows are decoded each, no rows give none, extra columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b.column(1).to_pylist():
                try:
                    rgb = None if raw is None else decode(raw)
                    rows.append((None,) * 5 if rgb is None else (*rgb.shape, rgb.tobytes(), None))
                except MediaError as e:
                    rows.append((None, None, None, None, str(e)))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["id", "height", "width", "channels", "rgb", "error"])

    kind = dict(table.dtypes)[id]
    return table.select(F.col(id).alias("id"), F.col(media).alias("media")).mapInArrow(run, f"id {kind}, height int, width int, channels int, rgb binary, error string")
