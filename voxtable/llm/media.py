"""Media columns: payloads as progressive JPEG images.

A payload is a row of 64-byte blocks. Each byte is one quantised coefficient of
an 8 x 8 block: byte b is b - 128 in the DC place and, in an AC place, b from
128 up and b - 255 below, so that every AC coefficient has category 8 and its
magnitude bits are the byte. Blocks fill a YCbCr image of 16 x 16 pixel units
(four luma blocks, one of each chroma), and a comment segment gives the number of
payload blocks. Coefficients are the format's unit, so the store is lossless.
A payload of more than ``SPAN`` bytes is stored as several images of equal width,
file after file, so memory beyond the text and its tensor does not grow with it and
no image reaches the format's largest height; its tensor is theirs, one below the other.

The file is a standard progressive JPEG (ITU T.81): DC and AC scans by spectral
selection, each first without its lowest bit and then refined by successive
approximation. The decoder reads any such stream of Huffman-coded progressive
scans into coefficient arrays; scans in which every coefficient is coded with
the same number of bits, as the encoder's are, are read as arrays. Tensors are
inverse-transformed in numpy, chroma upsampled to full resolution, and converted
to RGB.

Defined cases: a null text is empty; an empty payload is one zero block; a very long
text is several images, up to the 2 GB that a cell of Spark's tables holds; equal
texts give equal images; repeated rows give repeated rows; an empty table gives
an empty result; an image that is not a progressive JPEG raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtable.scratch import cut

BLOCK = 64
#: Units of 384 payload bytes across an image, but for those of fewer in all.
WIDE = 64
#: Payload bytes of one image at most: 680 whole rows of units, about 17 MB.
SPAN = 680 * WIDE * 6 * BLOCK


# The zigzag order of T.81, from its rule: diagonals in alternating direction.
def _zigzag() -> np.ndarray:
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
#: (first, last) coefficient of the AC scans of each component.
BANDS = (((1, 5), (6, 63)), ((1, 63),), ((1, 63),))
SAMPLING = ((2, 2), (1, 1), (1, 1))


def pad(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, at: int, lengths: dict[int, list[int]]) -> bytes:
    counts = bytes(len(lengths.get(n, ())) for n in range(1, 17))
    return bytes((kind << 4 | at,)) + counts + bytes(s for n in sorted(lengths) for s in lengths[n])


#: Huffman tables of the encoder. AC first scans use one symbol, run 0 and category 7, of one bit; AC
#: refinements only end-of-band runs. The DC table has all twelve categories in four bits.
DC_TABLE = {4: list(range(12))}
AC_FIRST = {1: [0x07], 2: [0x00]}
AC_REFINE = {4: [n << 4 for n in range(15)]}


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits, filled up with ones, as bytes in which a zero follows each 0xFF."""
    n = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(n, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")


def _number_bits(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Each value's lowest ``width`` bits, one after another."""
    ends = np.cumsum(widths)
    total = int(ends[-1]) if len(ends) else 0
    which = np.repeat(np.arange(len(widths)), widths)
    down = (ends[which] - 1 - np.arange(total)).astype(np.int64)
    return (values[which] >> down & 1).astype(np.uint8)


def _dc_first(dc: np.ndarray, comps: np.ndarray) -> bytes:
    """DC values in scan order (already without their lowest bit), of the components ``comps``."""
    diff = np.empty(len(dc), np.int64)
    for c in range(3):
        own = dc[comps == c]
        diff[comps == c] = np.diff(own, prepend=0)
    size = np.zeros(len(diff), np.int64)
    for k in range(11):
        size += np.abs(diff) >= 1 << k
    low = np.where(diff < 0, diff + (1 << size) - 1, diff)
    return _stuffed(_number_bits((size << size) | low, size + 4))


def encode(payload: bytes, span: int | None = None) -> bytes:
    """A payload of a positive multiple of 64 bytes as progressive JPEG files, one after another; mostly one."""
    span = span or SPAN
    if len(payload) <= span:
        return _image(payload, 1)
    return b"".join(_image(payload[k : k + span], WIDE) for k in range(0, len(payload), span))


def _image(payload: bytes, least: int) -> bytes:
    """One file; its width is ``least`` units at least."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    units = -(-len(blocks) // 6)
    full = np.full((units * 6, BLOCK), 128, np.uint8)
    full[: len(blocks)] = blocks
    mcu = full.reshape(units, 6, BLOCK)
    # Units in rows of at most WIDE; the last row is filled with neutral blocks.
    wide = max(least, min(units, WIDE))
    high = -(-units // wide)
    if high * wide > units:
        mcu = np.concatenate([mcu, np.full((high * wide - units, 6, BLOCK), 128, np.uint8)])
    luma = mcu[:, :4].reshape(high, wide, 2, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(-1, BLOCK)
    planes = (luma, mcu[:, 4], mcu[:, 5])
    out = [b"\xff\xd8", _segment(0xFE, b"blocks=%d" % len(blocks)), _segment(0xDB, bytes(1) + bytes([1]) * 64)]
    out.append(_segment(0xC2, b"\x08" + (16 * high).to_bytes(2, "big") + (16 * wide).to_bytes(2, "big") + b"\x03" + bytes(x for c in range(3) for x in (c + 1, SAMPLING[c][0] << 4 | SAMPLING[c][1], 0))))
    out.append(_segment(0xC4, _table(0, 0, DC_TABLE) + _table(1, 0, AC_FIRST) + _table(1, 1, AC_REFINE)))
    dc = mcu[:, :, 0].astype(np.int64).reshape(-1) - 128
    comps = np.tile([0, 0, 0, 0, 1, 2], len(mcu))
    all_three = b"\x03\x01\x00\x02\x00\x03\x00"
    out += [_segment(0xDA, all_three + b"\x00\x00\x01"), _dc_first(dc >> 1, comps)]
    for c in range(3):
        for a, b in BANDS[c]:
            # One code bit 0 and seven magnitude bits for each coefficient: the byte without its lowest bit.
            out += [_segment(0xDA, bytes((1, c + 1, 0, a, b, 0x01))), (np.ascontiguousarray(planes[c][:, a : b + 1]) >> 1).tobytes()]
    out += [_segment(0xDA, all_three + b"\x00\x00\x10"), _stuffed((dc & 1).astype(np.uint8))]
    for c in range(3):
        ac = planes[c][:, 1:]
        low = (ac & 1) ^ (ac < 128)  # of the magnitude
        bits, n = [], len(low)
        for at in range(0, n, 0x7FFF):
            run = min(0x7FFF, n - at)
            kind = run.bit_length() - 1
            bits += [_number_bits(np.array([kind, run - (1 << kind)]), np.array([4, kind])), low[at : at + run].reshape(-1)]
        out += [_segment(0xDA, bytes((1, c + 1, 1, 1, 63, 0x10))), _stuffed(np.concatenate(bits))]
    return b"".join(out) + b"\xff\xd9"


class _Bits:
    """Sequential reader of one scan's bits."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        got = self.bits[self.at : self.at + n]
        if len(got) < n:
            raise ValueError("a scan ends early")
        self.at += n
        v = 0
        for b in got.tolist():
            v = v << 1 | b
        return v

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("not a code of the Huffman table")

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


class _Table:
    """A Huffman table: its codes, and the code at the head of any 16 bits."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[tuple[int, int], int] = {}
        code, k = 0, 0
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                self.codes[n, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self._look: list[tuple[int, int]] | None = None

    @property
    def look(self) -> list[tuple[int, int]]:
        if self._look is None:
            self._look = [(0, 0)] * 65536
            for (n, code), s in self.codes.items():
                self._look[code << (16 - n) : (code + 1) << (16 - n)] = [(n, s)] * (1 << (16 - n))
        return self._look


#: Tables that this worker has read; files of one encoder share theirs.
_TABLES: dict[bytes, _Table] = {}


def _huffman(counts: bytes, symbols: bytes) -> _Table:
    key = counts + symbols
    if key not in _TABLES:
        if len(_TABLES) > 64:
            _TABLES.clear()
        _TABLES[key] = _Table(counts, symbols)
    return _TABLES[key]


def _dc_diffs(data: bytes, table: _Table, n: int) -> list[int]:
    """``n`` DC differences of a scan, by the table of the next 16 bits."""
    look, out, at, raw = table.look, [], 0, data + bytes(8)
    for _ in range(n):
        word = int.from_bytes(raw[at >> 3 : (at >> 3) + 6], "big")
        left = 48 - (at & 7)
        length, s = look[word >> (left - 16) & 0xFFFF]
        if not length:
            raise ValueError("not a code of the Huffman table")
        left -= length
        v = word >> (left - s) & ((1 << s) - 1)
        out.append(v if not s or v >> (s - 1) else v - (1 << s) + 1)
        at += length + s
    if at > 8 * len(data):
        raise ValueError("a scan ends early")
    return out


class Image:
    """Coefficients of a decoded file: for each component (rows, columns, 64) in zigzag order."""

    def __init__(self, width: int, height: int, sampling: list[tuple[int, int]], tables: list[int]):
        self.width, self.height, self.sampling, self.tables = width, height, sampling, tables
        self.most = max(h for h, _ in sampling), max(v for _, v in sampling)
        self.units = -(-width // (8 * self.most[0])), -(-height // (8 * self.most[1]))
        self.planes = [np.zeros((self.units[1] * v, self.units[0] * h, 64), np.int32) for h, v in sampling]
        self.quant: dict[int, np.ndarray] = {}
        self.comment = b""

    def own_blocks(self, c: int) -> tuple[int, int]:
        """Rows and columns of blocks in a scan of this component alone."""
        h, v = self.sampling[c]
        return -(-(-(-self.height * v // self.most[1])) // 8), -(-(-(-self.width * h // self.most[0])) // 8)

    def order(self, comps: list[int]) -> list[tuple[int, np.ndarray]]:
        """(component, index of the block in its plane) of a scan's blocks, by component: positions in scan order."""
        if len(comps) == 1:
            rows, cols = self.own_blocks(comps[0])
            stride = self.planes[comps[0]].shape[1]
            if cols == stride:
                return [(comps[0], np.arange(rows * cols))]
            return [(comps[0], (np.arange(rows)[:, None] * stride + np.arange(cols)).reshape(-1))]
        out = []
        for c in comps:
            h, v = self.sampling[c]
            grid = np.arange(self.units[1] * v * self.units[0] * h).reshape(self.units[1], v, self.units[0], h)
            out.append((c, grid.transpose(0, 2, 1, 3).reshape(-1)))
        return out


def _scan(image: Image, comps: list[int], codes_dc: list, codes_ac: list, first: int, last: int, high: int, low: int, data: bytes) -> None:
    """Adds one scan to the coefficients."""
    order = image.order(comps)
    flat = [image.planes[c].reshape(-1, 64) for c in range(len(image.planes))]
    if first == 0:
        per_unit = [image.sampling[c][0] * image.sampling[c][1] if len(comps) > 1 else 1 for c in comps]
        units = len(order[0][1]) // per_unit[0]
        if high:  # one bit for each block
            bits = np.unpackbits(np.frombuffer(data, np.uint8))[: units * sum(per_unit)].reshape(units, -1)
            at = 0
            for (c, idx), k in zip(order, per_unit):
                flat[c][idx, 0] |= bits[:, at : at + k].reshape(-1).astype(np.int32) << low
                at += k
            return
        if len({id(x) for x in codes_dc}) == 1:
            diffs = np.array(_dc_diffs(data, codes_dc[0], units * sum(per_unit)), np.int64)
        else:
            reader, got = _Bits(data), []
            for _ in range(units):
                for codes, k in zip(codes_dc, per_unit):
                    got += [reader.signed(reader.symbol(codes.codes)) for _ in range(k)]
            diffs = np.array(got, np.int64)
        diffs, at = diffs.reshape(units, -1), 0
        for (c, idx), k in zip(order, per_unit):
            flat[c][idx, 0] = np.cumsum(diffs[:, at : at + k].reshape(-1)) << low
            at += k
        return
    (c, idx), codes, plane = order[0], codes_ac[0].codes, flat[order[0][0]]
    width = last - first + 1
    if high:
        _refine(plane, idx, codes, first, last, low, data)
        return
    for (n, code), s in codes.items():
        run, size = s >> 4, s & 15
        if run == 0 and n + size == 8 and len(data) == width * len(idx):
            rows = np.frombuffer(data, np.uint8)
            if (rows >> size == code).all():  # a byte for every coefficient
                v = (rows & ((1 << size) - 1)).astype(np.int32)
                v[v < 1 << (size - 1)] -= (1 << size) - 1
                plane[idx, first : last + 1] = v.reshape(len(idx), width) * (1 << low)
                return
    reader, pending = _Bits(data), 0
    for b in idx.tolist():
        if pending:
            pending -= 1
            continue
        k = first
        while k <= last:
            s = reader.symbol(codes)
            run, size = s >> 4, s & 15
            if size == 0:
                if run < 15:
                    pending = (1 << run) + reader.take(run) - 1
                    break
                k += 16
                continue
            k += run
            plane[b, k] = reader.signed(size) * (1 << low)
            k += 1


def _refine(plane: np.ndarray, idx: np.ndarray, codes: dict, first: int, last: int, low: int, data: bytes) -> None:
    """One bit more of an AC band (T.81, G.1.2.3)."""
    reader, one, at, n = _Bits(data), 1 << low, 0, len(idx)

    def correct(where: tuple) -> None:
        """A bit for each nonzero coefficient of ``where``, in order."""
        band = plane[where]
        nonzero = band != 0
        k = int(nonzero.sum())
        bits = reader.bits[reader.at : reader.at + k].astype(np.int32)
        if len(bits) < k:
            raise ValueError("a scan ends early")
        reader.at += k
        band[nonzero] += np.sign(band[nonzero]) * bits * one
        plane[where] = band

    while at < n:
        b, k = idx[at], first
        while k <= last:
            s = reader.symbol(codes)
            run, size = s >> 4, s & 15
            if size == 0 and run < 15:
                blocks = (1 << run) + reader.take(run)
                correct((slice(b, b + 1), slice(k, last + 1)))
                rest = idx[at + 1 : at + blocks]
                if len(rest):
                    correct((slice(rest[0], rest[-1] + 1), slice(first, last + 1)) if rest[-1] - rest[0] == len(rest) - 1 else np.ix_(rest, np.arange(first, last + 1)))
                at += blocks - 1
                break
            value = (one if reader.take(1) else -one) if size else 0
            while k <= last:  # over ``run`` zeros, correcting what lies between
                if plane[b, k]:
                    if reader.take(1):
                        plane[b, k] += one if plane[b, k] > 0 else -one
                elif run == 0:
                    break
                else:
                    run -= 1
                k += 1
            if value and k <= last:
                plane[b, k] = value
            k += 1
        at += 1


def decode(data: bytes) -> Image:
    """The coefficients of a progressive JPEG without restart intervals."""
    return _decode(data, 0)[0]


def decode_all(data: bytes) -> Iterator[Image]:
    """The images of a row of files."""
    at = 0
    while at < len(data) or not at:
        image, at = _decode(data, at)
        yield image


def _decode(data: bytes, start: int) -> tuple[Image, int]:
    """The image that begins at ``start``, and the place behind it."""
    if data[start : start + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, image, comment, quant = start + 2, None, b"", {}
    dc: dict[int, _Table] = {}
    ac: dict[int, _Table] = {}
    ids: list[int] = []
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (wide + 1)], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + 64 * (wide + 1) :]
        elif marker == 0xC4:
            while body:
                k = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _huffman(body[1:17], body[17 : 17 + k])
                body = body[17 + k :]
        elif marker == 0xC2:
            parts = [body[6 + 3 * c : 9 + 3 * c] for c in range(body[5])]
            ids = [p[0] for p in parts]
            image = Image(int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), [(p[1] >> 4, p[1] & 15) for p in parts], [p[2] for p in parts])
        elif marker == 0xDA:
            if image is None:
                raise ValueError("not a progressive JPEG")
            comps = [ids.index(body[1 + 2 * k]) for k in range(body[0])]
            use = [body[2 + 2 * k] for k in range(body[0])]
            first, last, approx = body[-3:]
            end = at
            while True:  # to the next marker
                end = data.index(b"\xff", end)
                if data[end + 1]:
                    break
                end += 2
            _scan(image, comps, [dc.get(u >> 4) for u in use], [ac.get(u & 15) for u in use], first, last, approx >> 4, approx & 15, data[at:end].replace(b"\xff\x00", b"\xff"))
            at = end
        elif marker in (0xC0, 0xC1, 0xDD) or 0xC3 <= marker <= 0xCF:
            raise ValueError(f"marker {marker:02X}: only Huffman-coded progressive images without restarts are read")
    if image is None:
        raise ValueError("not a progressive JPEG")
    image.comment, image.quant = comment, quant
    return image, at + 2


def payload_of(image: Image) -> bytes:
    """The bytes that :func:`encode` stored."""
    n = int(image.comment.removeprefix(b"blocks="))
    y, cb, cr = image.planes
    wide = cb.shape[1]
    luma = y.reshape(-1, 2, wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    mcu = np.concatenate([luma, cb.reshape(-1, 1, 64), cr.reshape(-1, 1, 64)], axis=1).reshape(-1, 64)[:n]
    out = np.where(mcu < 0, mcu + 255, mcu)
    out[:, 0] = mcu[:, 0] + 128
    return out.astype(np.uint8).tobytes()


def _basis() -> np.ndarray:
    k = np.arange(8)
    m = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) / 2
    m[:, 0] /= np.sqrt(2)
    return m


#: 64 coefficients in zigzag order -> 64 samples in rows.
TRANSFORM = np.kron(_basis(), _basis())[:, ZIGZAG].T.astype(np.float32).copy()


def rgb(image: Image) -> np.ndarray:
    """The full-resolution tensor (height, width, 3) of 8-bit samples."""
    full = []
    for c, plane in enumerate(image.planes):
        rows, cols, _ = plane.shape
        q = image.quant[image.tables[c]]
        coef = plane.reshape(-1, 64) if (q == 1).all() else plane.reshape(-1, 64) * q
        s = (coef.astype(np.float32) @ TRANSFORM).reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8) + 128
        h, v = image.most[0] // image.sampling[c][0], image.most[1] // image.sampling[c][1]
        if h > 1 or v > 1:  # chroma upsampling by repetition
            s = np.repeat(np.repeat(s, v, axis=0), h, axis=1)
        full.append(s[: image.height, : image.width])
    if len(full) == 1:
        full *= 3
    else:
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        full = [y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb]
    return np.stack([np.clip(np.rint(x), 0, 255).astype(np.uint8) for x in full], axis=-1)


def feature(tensor: np.ndarray) -> str:
    """Size, mean of each channel and a digest of the tensor."""
    means = ",".join(f"{m:.4f}" for m in tensor.reshape(-1, 3).mean(axis=0, dtype=np.float64))
    return f"{tensor.shape[1]}x{tensor.shape[0]}:{means}:{zlib.crc32(np.ascontiguousarray(tensor)):08x}"


MEDIA = T.StructType().add("n_bytes", T.LongType()).add("media", T.BinaryType())
DIGESTS = T.StructType().add("payload_bytes", T.LongType()).add("payload_sha256", T.StringType()).add("tail_crc32", T.LongType()).add("media_bytes", T.LongType()).add("media_sha256", T.StringType()).add("feature", T.StringType())
TENSOR = T.StructType().add("height", T.IntegerType()).add("width", T.IntegerType()).add("rgb", T.BinaryType())
#: Bytes of tensors, and of texts, that go to one batch, but for the last of them.
BATCH = 1 << 23


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as JPEG files; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(b: pa.RecordBatch, start: int, sizes: list[int], files: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0).slice(start, len(files)), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

        for b in batches:
            sizes, files, start, held = [], [], 0, 0
            for t in b.column(1):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                sizes.append(len(raw))
                files.append(encode(pad(raw)))
                held += len(files[-1])
                if held >= BATCH:
                    yield batch(b, start, sizes, files)
                    sizes, files, start, held = [], [], start + len(files), 0
            yield batch(b, start, sizes, files)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *MEDIA.fields]))


def tensors(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digests of the files and of the payload read back from them, feature, height, width, rgb); no shuffle.

    ``rgb`` is the full-resolution tensor of each row's files, as bytes in rows,
    and ``feature`` describes it.
    """
    names = ["n_bytes", *DIGESTS.names, *TENSOR.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())

        def batch(b: pa.RecordBatch, start: int, rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([b.column(0).slice(start, len(rows)), *[pa.array(c, t) for c, t in zip(cols, types)]], ["doc_id", *names])

        for b in batches:
            rows, start, size = [], 0, 0
            for n, m in zip(b.column(1), b.column(2)):
                data = m.as_py()
                digest, tail, got, parts = hashlib.sha256(), b"", 0, []
                for image in decode_all(data):
                    payload = payload_of(image)
                    digest.update(payload)
                    got, tail = got + len(payload), payload[-64:]
                    parts.append(rgb(image))
                tensor = parts[0] if len(parts) == 1 else np.concatenate(parts)
                rows.append((n.as_py(), got, digest.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature(tensor), *tensor.shape[:2], tensor.tobytes()))
                size += tensor.nbytes
                if size >= BATCH:
                    yield batch(b, start, rows)
                    rows, start, size = [], start + len(rows), 0
            yield batch(b, start, rows)

    rows = media.select("doc_id", "n_bytes", "media")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], rows.schema["n_bytes"], *DIGESTS.fields, *TENSOR.fields]))


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the media table to the shared folder, rereads it, and returns each row's digests, feature and RGB tensor, which are for the caller to store."""
    return tensors(cut(store(docs, doc_id, text), "media", "zstd"))
