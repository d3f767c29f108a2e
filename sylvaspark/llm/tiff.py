"""Media columns [operator 6]: TIFF pages.

The reader walks the chain of image directories (either byte order), decodes
strips or tiles that are plain, PackBits, LZW or deflate, undoes the horizontal
predictor, and emits one row per page.  The writer stores bytes losslessly as
8-bit grey pages.  A CRC of the payload deals the first page one of the ``FORMS`` (codec, predictor,
strips or tiles) and each further page takes the next, so every codec does its share of any table's work.

Nulls and the like: a null text counts as empty; equal texts have equal media; texts of any length are stored whole, in pages of
``PAGE_ROWS`` rows; media that are null, or not a readable TIFF, give one row
with ``error`` set and no samples, after the pages that could be read, and never stop the job; an empty table gives an empty result; no column but those
named is read, so names cannot clash.  A page of more samples than a cell can hold (2 GiB) is an error row: no row could hold it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

#: Payload bytes of a sample row; and rows of a page and of a strip or tile.
WIDTH, PAGE_ROWS, PART_ROWS, TILE_WIDTH = 576, 64, 16, 144
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
_TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: Samples of a page at most: what one binary cell of a row can hold.
MOST_SAMPLES = (1 << 31) - 64
#: The forms of a page that :func:`store` deals: codec, predictor, tiles instead of strips.
FORMS = ((DEFLATE, 1, False), (PACKBITS, 1, False), (DEFLATE, 2, True), (LZW, 2, False), (PACKBITS, 1, True), (LZW, 1, True), (DEFLATE, 2, False), (PLAIN, 1, True))


def packbits_encode(data: bytes) -> bytes:
    a = np.frombuffer(data, dtype=np.uint8)
    if not len(a):
        return b""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1, [len(a)]])
    long = np.flatnonzero(np.diff(cut) >= 3)
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(end, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, end in zip(cut[long].tolist(), cut[long + 1].tolist()):
        literal(start)
        while end - start >= 2:
            n = min(128, end - start)
            out += bytes((257 - n, data[start]))
            start += n
        at = start  # a single byte that is left over begins the next literal
    literal(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


@lru_cache(maxsize=1)
def _lzw_bits() -> tuple[np.ndarray, np.ndarray]:
    """Width, and bit offset, of each code after a clear code: 9 to 12 bits, wider as soon as the decoder's table is one short of full."""
    i = np.arange(4100)
    entries = 258 + np.maximum(0, i - 1)
    width = np.minimum(12, 9 + (entries >= 511) + (entries >= 1023) + (entries >= 2047))
    return width, np.concatenate([[0], np.cumsum(width)])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, from one clear code to the next."""
    runs, codes, table, following = [], [], {}, 258
    word = -1
    for b in data:
        if word < 0:
            word = b
            continue
        known = table.get((word << 8) | b)
        if known is not None:
            word = known
            continue
        codes.append(word)
        table[(word << 8) | b] = following
        following += 1
        if following == 4095:
            codes.append(256)
            runs.append(codes)
            codes, table, following = [], {}, 258
        word = b
    if word >= 0:
        codes.append(word)
    runs.append([*codes, 257])
    width, _ = _lzw_bits()
    values = np.array([256, *(c for r in runs for c in r)], dtype=np.int64)
    widths = np.concatenate([[9], *(width[: len(r)] for r in runs)])
    ends = np.cumsum(widths)
    first = (ends - widths) >> 3
    spread = values << (24 - widths - ((ends - widths) & 7))
    out = np.zeros(int(ends[-1] + 7) // 8 + 3, np.int64)
    for i, shift in enumerate((16, 8, 0)):
        out += np.bincount(first + i, (spread >> shift) & 255, len(out)).astype(np.int64)
    return out[: int(ends[-1] + 7) // 8].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    width, offset = _lzw_bits()
    padded = np.frombuffer(data + b"\0" * 4, np.uint8).astype(np.int64)
    window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    out, at, total, ended = [], 0, 0, False
    while not ended and total < size and at + 9 <= 8 * len(data):
        n = int(np.searchsorted(offset, 8 * len(data) - at, "right")) - 1  # codes that still fit
        n = min(n, len(width))
        place, w = at + offset[:n], width[:n]
        codes = (window[place >> 3] >> (32 - (place & 7) - w)) & ((1 << w) - 1)
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        used = int(stop[0]) if len(stop) else n
        ended = not len(stop) or codes[used] == 257
        table, last = list(base), None
        for code in codes[:used].tolist():
            if last is None:
                entry = table[code]
            else:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = last + last[:1]
                else:
                    raise ValueError("LZW code out of range")
                table.append(last + entry[:1])
            out.append(entry)
            total += len(entry)
            last = entry
            if total >= size:
                break
        at += int(offset[used + 1]) if used < n else int(offset[used])
    return b"".join(out)[:size]


_ENCODE = {PLAIN: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 4), PACKBITS: packbits_encode}


def _decode(codec: int, data: bytes, size: int) -> bytes:
    if codec == PLAIN:
        return data[:size]
    if codec in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if codec == LZW:
        return lzw_decode(data, size)
    if codec == PACKBITS:
        return packbits_decode(data, size)
    raise ValueError(f"compression {codec}")


def write(pages: list[tuple[np.ndarray, int, int, bool]], order: str = "<") -> bytes:
    """A TIFF of (samples rows x width x channels uint8, codec, predictor, tiled) pages."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for samples, codec, predictor, tiled in pages:
        if samples.ndim == 2:
            samples = samples[:, :, None]
        rows, width, channels = samples.shape
        wide = TILE_WIDTH if tiled else width
        offsets, counts = [], []
        for y in range(0, max(rows, 1), PART_ROWS):
            for x in range(0, width, wide):
                part = samples[y : y + PART_ROWS, x : x + wide]
                if tiled and part.shape[:2] != (PART_ROWS, wide):
                    part = np.pad(part, ((0, PART_ROWS - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                raw = part.tobytes()
                if codec == PACKBITS:  # rows are packed one by one
                    step = part.shape[1] * channels
                    data = b"".join(packbits_encode(raw[i : i + step]) for i in range(0, len(raw), step))
                else:
                    data = _ENCODE[codec](raw)
                offsets.append(len(out))
                counts.append(len(data))
                out += data
        tags = {256: (4, [width]), 257: (4, [rows]), 258: (3, [8] * channels), 259: (3, [codec]), 262: (3, [1 if channels < 3 else 2]), 277: (3, [channels]), 284: (3, [1]), 317: (3, [predictor])}
        if tiled:
            tags |= {322: (4, [wide]), 323: (4, [PART_ROWS]), 324: (4, offsets), 325: (4, counts)}
        else:
            tags |= {273: (4, offsets), 278: (4, [PART_ROWS]), 279: (4, counts)}
        entries = []
        for tag in sorted(tags):
            kind, values = tags[tag]
            data = struct.pack(f"{order}{len(values)}{_TYPES[kind]}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                at, data = len(out), data
                out += data
                data = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in _TYPES or count * _SIZES[kind] > len(data):
            continue
        place = at + 10 + 12 * i
        if count * _SIZES[kind] > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        tags[tag] = struct.unpack_from(f"{order}{count}{_TYPES[kind]}", data, place)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def read_pages(data: bytes) -> Iterator[np.ndarray]:
    """The samples of each page, rows x width x channels uint8."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories in a loop")
        seen.add(at)
        tags, at = _directory(data, at, order)
        one = lambda tag, default: tags.get(tag, (default,))[0]
        width, rows, channels = one(256, 0), one(257, 0), one(277, 1)
        codec, predictor, fill, planar = one(259, PLAIN), one(317, 1), one(266, 1), one(284, 1)
        if any(b != 8 for b in tags.get(258, (1,))) or fill != 1 or planar != 1 or predictor not in (1, 2):
            raise ValueError("samples are not plain 8-bit")
        if width * rows * channels > MOST_SAMPLES:
            raise ValueError("a page of more than 2 GiB does not fit into a row")
        tiled = 324 in tags
        wide, high = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, rows), rows) or 1)
        offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
        page = np.zeros((rows, width, channels), np.uint8)
        across = -(-width // wide) if wide else 0
        for i, (o, n) in enumerate(zip(offsets, counts)):
            y, x = (i // across) * high, (i % across) * wide
            tall = high if tiled else min(high, rows - y)
            if tall <= 0:
                continue
            raw = _decode(codec, data[o : o + n], tall * wide * channels)
            part = np.frombuffer(raw.ljust(tall * wide * channels, b"\0"), np.uint8).reshape(tall, wide, channels)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=np.uint8)
            page[y : y + tall, x : x + wide] = part[: rows - y, : width - x]
        yield page


def store(payload: bytes) -> bytes:
    """A payload (a positive multiple of WIDTH) as a TIFF."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    first = zlib.crc32(payload)
    return write([(samples[y : y + PAGE_ROWS], *FORMS[(first + i) % len(FORMS)]) for i, y in enumerate(range(0, len(samples), PAGE_ROWS))])


def padded(body: bytes) -> bytes:
    """``body`` with bytes 255 up to a positive multiple of WIDTH."""
    return body.ljust(max(WIDTH, -(-len(body) // WIDTH) * WIDTH), b"\xff")


def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text, padded with bytes 255, as a TIFF."""

    def run(batches):
        for batch in slices(batches):
            for i, body in enumerate(text_bytes(batch.column(1))):
                yield pa.record_batch([batch.column(0).slice(i, 1), pa.array([len(body)], pa.int64()), pa.array([store(padded(body))], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def page_rows(media: bytes | None) -> Iterator[tuple[int, np.ndarray | None, str | None]]:
    """(page, samples, error) of one medium: a row per page; damage ends the pages with a row of its own."""
    number = 0
    try:
        for page in read_pages(media or b""):
            yield number, page, None
            number += 1
    except Exception as e:  # noqa: BLE001 - any damage is a row of its own
        yield number, None, str(e)[:200] or type(e).__name__


_PAGE = "doc_id long, page int, width int, height int, channels int, samples binary, error string"


def to_pages(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per page: (doc_id, page, width, height, channels, samples, error)."""
    names = [c.split()[0] for c in _PAGE.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def run(batches):
        for batch in batches:
            for who, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for number, page, error in page_rows(data.as_py()):
                    shape = (None,) * 3 if page is None else (page.shape[1], page.shape[0], page.shape[2])
                    row = (who, number, *shape, None if page is None else page.tobytes(), error)
                    yield pa.record_batch([pa.array([v], t) for v, t in zip(row, types)], names=names)

    return media.select(F.col(key).cast("long").alias("doc_id"), F.col(column).alias("media")).mapInArrow(run, _PAGE)


class Summary:
    """Digests and features of a medium's pages, one page at a time."""

    def __init__(self):
        self.sha, self.tail, self.size, self.pages, self.width, self.rows = hashlib.sha256(), b"", 0, 0, 0, 0
        self.histogram = np.zeros(256, np.int64)
        self.across = self.down = self.down_n = self.across_n = 0
        self.last: np.ndarray | None = None

    def add(self, page: np.ndarray) -> None:
        raw = page.tobytes()
        self.sha.update(raw)
        self.tail = (self.tail + raw[-32:])[-32:]
        self.size += len(raw)
        self.pages += 1
        self.histogram += np.bincount(page.ravel(), minlength=256)
        flat = page.reshape(page.shape[0], -1).astype(np.int16)
        self.width = self.width or page.shape[1]
        self.rows += len(flat)
        if flat.shape[1] > 1:
            self.across += int(np.abs(np.diff(flat, axis=1)).sum())
            self.across_n += len(flat) * (flat.shape[1] - 1)
        if self.last is not None and self.last.shape[1] == flat.shape[1]:
            flat = np.concatenate([self.last, flat])
        if len(flat) > 1:
            self.down += int(np.abs(np.diff(flat, axis=0)).sum())
            self.down_n += (len(flat) - 1) * flat.shape[1]
        self.last = flat[-1:] if len(flat) else self.last

    def feature(self) -> str:
        """Pages, size, mean, deviation, entropy and horizontal and vertical contrast of the samples, as text."""
        n = int(self.histogram.sum())
        if not n:
            return f"pages={self.pages}"
        values = np.arange(256)
        mean = float((self.histogram * values).sum()) / n
        std = float(np.sqrt((self.histogram * (values - mean) ** 2).sum() / n))
        share = self.histogram[self.histogram > 0] / n
        entropy = -float(np.sum(share * np.log2(share)))
        contrast = [s / c if c else 0.0 for s, c in ((self.across, self.across_n), (self.down, self.down_n))]
        return f"pages={self.pages};width={self.width};rows={self.rows};mean={mean:.4f};std={std:.4f};entropy={entropy:.4f};dx={contrast[0]:.4f};dy={contrast[1]:.4f}"


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def summarize(pages: Iterable[tuple[int, np.ndarray | None, str | None]]) -> tuple:
    """(payload_bytes, payload_sha256, tail_crc32, feature) of the page rows of one medium; null, but for the error as feature, if one is damaged."""
    s = Summary()
    for _, page, error in pages:
        if error is not None:
            return None, None, None, f"error={error}"
        s.add(page)
    return s.size, s.sha.hexdigest(), zlib.crc32(s.tail), s.feature()


def media_digests(media: DataFrame) -> DataFrame:
    """Digests and features of the page rows that :func:`page_rows` reads back from each row (doc_id, n_bytes, media)."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for who, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                stored = data.as_py()
                size, sha, tail, feature = summarize(page_rows(stored))
                of_media = (None, None) if stored is None else (len(stored), hashlib.sha256(stored).hexdigest())
                rows.append((who, n, size, sha, tail, *of_media, feature))
            if rows:
                types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in _DIGEST.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _DIGEST)
