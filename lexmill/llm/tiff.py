"""TIFF media columns: one row a page of the TIFF files in a binary column, and payloads stored as such files.

Reading walks the chain of image directories of classic and big TIFF in either byte order, decodes strips or tiles
(uncompressed, PackBits, LZW, deflate), undoes the horizontal (8 to 64 bits) and the floating-point predictor (16 to 64 bits),
joins planes, and gives the page's samples row by row, pixel by pixel, in little-endian order where they have several
bytes; rows of fewer than 8 bits a sample stay packed. A page that cannot be decoded is a row with its problem and without
samples, and so is a file that is none (page 0 of 0); pages behind it are read as long as the chain is. A directory that was
visited before ends the chain with a problem, too. Pages of over MAX_PAGE_BYTES decoded are not decoded. Subdirectories
(thumbnails) are not walked. Pages are decoded one after another, so a task holds a file and one page of it.

Writing (`store`) cuts a payload into rows of ROW_BYTES = 192 RGB pixels and these into pages of at most PAGE_ROWS rows;
byte 255 fills the last row, an empty payload is one row of it. Pages take turns among STYLES (deflate tiles with predictor,
LZW strips, PackBits strips), from a start that the payload's CRC gives, so equal payloads make equal files. LZW, whose codes
are made one by one, goes without the predictor, which would make noise of text, and without tiles, which pad short pages.

Rows of `read_pages` also carry what can be summed over a file's pages so far: bytes, SHA-256, the last 32 bytes and a
feature string of exact integers. The row of the last page has them for the whole file, without a shuffle. Null media has
no page. Repeated rows have their pages each. An empty table gives an empty one. Key columns pass through, whatever their
names; a page's column whose name a key has gets a `_` behind it. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import free_name, written

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
HORIZONTAL, FLOATING = 2, 3
MAX_PAGE_BYTES = 1 << 29
WIDTH, SAMPLES, PAGE_ROWS, STRIP_ROWS, TILE = 192, 3, 2048, 64, 64
ROW_BYTES = WIDTH * SAMPLES
#: (compression, predictor, in tiles) of the pages that store() writes.
STYLES = ((DEFLATE, HORIZONTAL, True), (LZW, 1, False), (PACKBITS, 1, False))
TAIL = 32
#: Bytes of rows after which a task hands on what it has.
_FLUSH = 1 << 24
# Tags, and the bytes and struct codes of the field types that hold integers.
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "fill_order": 266, "strips": 273, "samples": 277, "strip_rows": 278, "strip_bytes": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tiles": 324, "tile_bytes": 325, "format": 339}
TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}


class Damaged(Exception):
    """A file or page that cannot be read; says why."""


# LZW codes are read most significant bit first, and are one bit longer from one code before the table needs it. So the
# place of the n-th code behind a clear code is known, and all codes up to the next clear code are cut out at once.
CLEAR, END, FIRST, FULL = 256, 257, 258, 4095


def _width_at(entries: np.ndarray | int):  # noqa: ANN202
    """Bits of a code that is written when the table's next entry has this number."""
    return 9 + (np.asarray(entries) >= 511) + (np.asarray(entries) >= 1023) + (np.asarray(entries) >= 2047)


_RUN = FULL - FIRST + 2
_WIDTHS = _width_at(FIRST + np.arange(_RUN)).astype(np.int64)
_PLACES = np.concatenate([[0], np.cumsum(_WIDTHS)])[:-1]
_SINGLE = [bytes([i]) for i in range(256)] + [b"", b""]


def lzw_decode(data: bytes, size: int) -> bytes:
    """At most size bytes; data without a leading clear code start with a fresh table."""
    raw, bits = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64), 8 * len(data)
    out, have, at = [], 0, 0
    while have < size:
        places = at + _PLACES
        n = int(np.searchsorted(places + _WIDTHS, bits, "right"))
        if not n:
            raise Damaged("LZW codes end too early")
        where, widths = places[:n], _WIDTHS[:n]
        b = where >> 3
        codes = ((raw[b] << 16 | raw[b + 1] << 8 | raw[b + 2]) >> (24 - (where & 7) - widths)) & ((1 << widths) - 1)
        marks = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(marks[0]) if len(marks) else n
        table, last = list(_SINGLE), b""
        for code in codes[:stop].tolist():
            if code < len(table):
                said = table[code]
            elif code == len(table) and last:
                said = last + last[:1]
            else:
                raise Damaged("an LZW code before its entry")
            if last:
                table.append(last + said[:1])
            out.append(said)
            have += len(said)
            last = said
            if have >= size:
                break
        if have >= size:
            break
        if stop == n:
            raise Damaged("LZW codes end too early" if n < _RUN else "an LZW table without a clear code")
        if codes[stop] == END:
            raise Damaged("LZW data are too short")
        at = int(where[stop] + widths[stop])
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    codes, widths, table, entries = [CLEAR], [9], {}, FIRST
    numbers = []
    if data:
        prefix = data[0]
        for byte in memoryview(data)[1:]:
            key = prefix << 8 | byte
            code = table.get(key)
            if code is not None:
                prefix = code
                continue
            codes.append(prefix)
            numbers.append(entries)
            table[key] = entries
            entries += 1
            prefix = byte
            if entries == FULL:
                codes.append(CLEAR)
                numbers.append(entries)
                table, entries = {}, FIRST
        codes.append(prefix)
        numbers.append(entries)
    codes.append(END)
    numbers.append(entries + 1)
    widths = np.concatenate([widths, _width_at(np.array(numbers))])
    value = np.array(codes, np.int64) << (12 - widths)
    bits = (value[:, None] >> np.arange(11, -1, -1)) & 1
    return np.packbits(bits[np.arange(12)[None, :] < widths[:, None]].astype(np.uint8)).tobytes()


_SAME = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(row: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(lo: int, hi: int) -> None:
        for i in range(lo, hi, 128):
            part = row[i : min(i + 128, hi)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _SAME.finditer(row):
        literal(at, m.start())
        out.extend((257 - (m.end() - m.start()), row[m.start()]))
        at = m.end()
    literal(at, len(row))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, end = bytearray(), 0, len(data)
    while len(out) < size:
        if at + 1 >= end:
            raise Damaged("PackBits data are too short")
        n = data[at]
        if n < 128:
            if at + n + 2 > end:
                raise Damaged("PackBits data are too short")
            out += data[at + 1 : at + n + 2]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


def _inflate(data: bytes, size: int) -> bytes:
    unzip = zlib.decompressobj()
    try:
        out = unzip.decompress(data, size)
    except zlib.error as e:
        raise Damaged(f"deflate: {e}") from None
    if len(out) < size:
        raise Damaged("deflate data are too short")
    return out


def _plain(data: bytes, size: int) -> bytes:
    if len(data) < size:
        raise Damaged("samples are too short")
    return data[:size]


DECODERS = {NONE: _plain, LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: packbits_decode}


def undo_predictor(rows: np.ndarray, kind: int, samples: int, bits: int, order: str) -> np.ndarray:
    """rows of bytes (rows by bytes of a row, as stored) to the same in which samples are whole values, little-endian."""
    if kind == FLOATING:
        if bits not in (16, 32, 64):
            raise Damaged(f"floating-point predictor at {bits} bits")
        size, n = bits // 8, rows.shape[1]
        if n % (size * samples):
            raise Damaged("a row is no whole number of pixels")
        summed = np.cumsum(rows.reshape(len(rows), n // samples, samples), axis=1, dtype=np.uint8).reshape(len(rows), size, n // size)
        # The bytes of a row lie by significance, the highest first.
        return np.ascontiguousarray(summed[:, ::-1].transpose(0, 2, 1)).reshape(len(rows), n)
    if bits in (16, 32, 64):
        value = np.ascontiguousarray(rows).view(f"{order}u{bits // 8}").astype(f"<u{bits // 8}")
    elif bits == 8 or kind != HORIZONTAL:
        value = np.ascontiguousarray(rows)
    else:
        raise Damaged(f"horizontal predictor at {bits} bits")
    if kind == HORIZONTAL:
        if value.shape[1] % samples:
            raise Damaged("a row is no whole number of pixels")
        value = np.cumsum(value.reshape(len(rows), -1, samples), axis=1, dtype=value.dtype).reshape(len(rows), -1)
    elif kind != 1:
        raise Damaged(f"predictor {kind} is not read")
    return value.view(np.uint8).reshape(len(rows), -1)


@dataclass
class Directory:
    order: str
    tags: dict[int, tuple[int, ...]] = field(default_factory=dict)
    problem: str | None = None

    def get(self, name: str, default: int | None = None) -> int:
        values = self.tags.get(TAGS[name])
        if not values:
            if default is None:
                raise Damaged(f"no {name} in the directory")
            return default
        return int(values[0])

    def all(self, name: str) -> tuple[int, ...]:
        return self.tags.get(TAGS[name], ())


def directories(data: bytes) -> Iterator[Directory]:
    """The image directories in the order of their chain. What ends the chain early is the problem of a last one."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    version = struct.unpack(f"{order}H", data[2:4])[0] if order and len(data) >= 8 else 0
    if version not in (42, 43) or (version == 43 and (len(data) < 16 or struct.unpack(f"{order}HH", data[4:8]) != (8, 0))):
        yield Directory("<", problem="no TIFF header")
        return
    big = version == 43
    count, entry, at_code, place = ("Q", 20, "Q", 8) if big else ("H", 12, "I", 4)
    link = struct.calcsize(at_code)
    at, seen = struct.unpack_from(f"{order}{at_code}", data, place)[0], set()
    if not at:
        yield Directory(order, problem="no image directory")
    while at:
        if at in seen:
            yield Directory(order, problem="the chain of directories comes back on itself")
            return
        seen.add(at)
        one = Directory(order)
        try:
            n = struct.unpack_from(f"{order}{count}", data, at)[0]
            begin = at + struct.calcsize(count)
            end = begin + n * entry
            at = struct.unpack_from(f"{order}{at_code}", data, end)[0]
        except struct.error:
            yield Directory(order, problem="a directory is outside the file")
            return
        for i in range(n):
            tag, kind, number = struct.unpack_from(f"{order}HH{at_code}", data, begin + i * entry)
            code = TYPES.get(kind)
            if code is None or tag not in TAGS.values():
                continue
            size, value = struct.calcsize(code) * number, begin + i * entry + 4 + link
            if size > link:
                value = struct.unpack_from(f"{order}{at_code}", data, value)[0]
            if value + size > len(data):
                one.problem = f"values of tag {tag} are outside the file"
                break
            one.tags[tag] = struct.unpack_from(f"{order}{number}{code}", data, value)
        yield one


@dataclass
class Page:
    index: int
    n_pages: int
    width: int = 0
    height: int = 0
    samples: int = 0
    bits: int = 0
    compression: int = 0
    predictor: int = 0
    tiled: bool = False
    problem: str | None = None
    pixels: bytes | None = None


def _segments(data: bytes, one: Directory, offsets: tuple, sizes: tuple, shape: list[tuple[int, int]], page: Page, samples: int) -> Iterator[np.ndarray]:
    """The decoded rows of bytes of each strip or tile; shape has their rows and bytes a row."""
    if len(offsets) < len(shape) or len(sizes) < len(shape):
        raise Damaged("strips or tiles are missing")
    decode = DECODERS.get(page.compression)
    if decode is None:
        raise Damaged(f"compression {page.compression} is not read")
    backwards = one.get("fill_order", 1) == 2
    for offset, size, (rows, row_bytes) in zip(offsets, sizes, shape, strict=False):
        if offset + size > len(data):
            raise Damaged("a strip or tile is outside the file")
        part = data[offset : offset + size]
        if backwards:
            part = np.packbits(np.unpackbits(np.frombuffer(part, np.uint8), bitorder="little")).tobytes()
        raw = np.frombuffer(decode(part, rows * row_bytes), np.uint8).reshape(rows, row_bytes)
        yield undo_predictor(raw, page.predictor, samples, page.bits, one.order)


def _plane(data: bytes, one: Directory, page: Page, samples: int, number: int) -> np.ndarray:
    """Plane `number` of the page, or all its samples in one: height rows of bytes."""
    row_bytes = -(-page.width * samples * page.bits // 8)
    if page.tiled:
        w, h = one.get("tile_width"), one.get("tile_height")
        if w % 16 or h % 16 or not w or not h or w * h * samples * page.bits // 8 > MAX_PAGE_BYTES:
            raise Damaged("a tile's sides are no multiples of 16, or too long")
        across, down, tile_row = -(-page.width // w), -(-page.height // h), w * samples * page.bits // 8
        if across * down * tile_row * h > 2 * MAX_PAGE_BYTES:
            raise Damaged(f"over {MAX_PAGE_BYTES} bytes")
        n = across * down
        own = slice(number * n, (number + 1) * n)
        parts = list(_segments(data, one, one.all("tiles")[own], one.all("tile_bytes")[own], [(h, tile_row)] * n, page, samples))
        whole = np.concatenate([np.concatenate(parts[i : i + across], axis=1) for i in range(0, n, across)])
        return whole[: page.height, :row_bytes]
    rows = min(one.get("strip_rows", page.height), page.height)
    if not rows:
        raise Damaged("strips without rows")
    n = -(-page.height // rows)
    shape = [(min(rows, page.height - i * rows), row_bytes) for i in range(n)]
    own, sizes = slice(number * n, (number + 1) * n), one.all("strip_bytes")
    if not sizes and page.compression == NONE:
        sizes = tuple(r * b for r, b in shape) * (number + 1)
    return np.concatenate(list(_segments(data, one, one.all("strips")[own], sizes[own], shape, page, samples)))


def _read(data: bytes, one: Directory, page: Page) -> None:
    if one.problem:
        raise Damaged(one.problem)
    page.width, page.height, page.samples = one.get("width"), one.get("height"), one.get("samples", 1)
    page.compression, page.predictor, page.tiled = one.get("compression", 1), one.get("predictor", 1), bool(one.all("tiles"))
    bits = one.all("bits") or (1,)
    page.bits = int(bits[0])
    if len(set(bits)) > 1 or page.bits not in (1, 2, 4, 8, 16, 32, 64):
        raise Damaged(f"samples of {','.join(map(str, bits))} bits")
    if min(page.width, page.height, page.samples) < 1:
        raise Damaged("a page without pixels")
    if page.width * page.height * page.samples * page.bits // 8 > MAX_PAGE_BYTES:
        raise Damaged(f"over {MAX_PAGE_BYTES} bytes")
    if one.get("planar", 1) == 1 or page.samples == 1:
        page.pixels = _plane(data, one, page, page.samples, 0).tobytes()
        return
    if page.bits < 8:
        raise Damaged(f"planes of {page.bits} bits")
    size = page.bits // 8
    planes = [_plane(data, one, page, 1, i).reshape(page.height, page.width, 1, size) for i in range(page.samples)]
    page.pixels = np.concatenate(planes, axis=2).tobytes()


def pages(data: bytes) -> Iterator[Page]:
    found = list(directories(data))
    none = len(found) == 1 and found[0].problem and not found[0].tags
    for i, one in enumerate(found):
        page = Page(i, 0 if none else len(found))
        try:
            _read(data, one, page)
        except Damaged as e:
            page.problem = str(e)
        yield page


# Writing.


def _predicted(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[:, :1], x[:, 1:] - x[:, :-1]], axis=1)


def _packed(x: np.ndarray, compression: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(x.tobytes(), 6)
    if compression == LZW:
        return lzw_encode(x.tobytes())
    if compression == PACKBITS:
        return b"".join(packbits_encode(row.tobytes()) for row in x)
    return x.tobytes()


def write_pages(images: Iterator[tuple[np.ndarray, int, int, bool]]) -> bytes:
    """A little-endian classic TIFF of images (height by width by samples, bytes) with compression, predictor and whether
    in tiles."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for x, compression, predictor, tiled in images:
        height, width, samples = x.shape
        if tiled:
            h = min(TILE, -(-height // 16) * 16)
            full = np.zeros((-(-height // h) * h, -(-width // TILE) * TILE, samples), np.uint8)
            full[:height, :width] = x
            parts = [full[i : i + h, j : j + TILE] for i in range(0, full.shape[0], h) for j in range(0, full.shape[1], TILE)]
        else:
            parts = [x[i : i + STRIP_ROWS] for i in range(0, height, STRIP_ROWS)]
        packed = [_packed(_predicted(p) if predictor == HORIZONTAL else p, compression) for p in parts]
        places = []
        for part in packed:
            places.append(len(out))
            out += part
        sizes, bits = [len(p) for p in packed], [8] * samples
        tags = [("width", "I", [width]), ("height", "I", [height]), ("bits", "H", bits), ("compression", "H", [compression]), ("photometric", "H", [2 if samples == 3 else 1]), ("samples", "H", [samples]), ("planar", "H", [1]), ("predictor", "H", [predictor])]
        tags += [("tile_width", "I", [TILE]), ("tile_height", "I", [h]), ("tiles", "I", places), ("tile_bytes", "I", sizes)] if tiled else [("strips", "I", places), ("strip_rows", "I", [STRIP_ROWS]), ("strip_bytes", "I", sizes)]
        out += b"\0" * (len(out) % 2)
        entries = []
        for name, code, values in sorted(tags, key=lambda t: TAGS[t[0]]):
            value = struct.pack(f"<{len(values)}{code}", *values)
            if len(value) > 4:
                at = len(out)
                out += value + b"\0" * (len(value) % 2)
                value = struct.pack("<I", at)
            entries.append(struct.pack("<HHI", TAGS[name], {"H": 3, "I": 4}[code], len(values)) + value.ljust(4, b"\0"))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def store(payload: bytes) -> bytes:
    """The TIFF file that holds the payload and its filling."""
    size = max(1, -(-len(payload) // ROW_BYTES)) * ROW_BYTES
    whole = np.frombuffer(payload.ljust(size, b"\xff"), np.uint8).reshape(-1, WIDTH, SAMPLES)
    first = zlib.crc32(payload)
    return write_pages((whole[i : i + PAGE_ROWS], *STYLES[(first + i // PAGE_ROWS) % len(STYLES)]) for i in range(0, len(whole), PAGE_ROWS))


class Running:
    """What is summed over the pages of a file."""

    def __init__(self) -> None:
        self.sha, self.bytes, self.tail, self.problems = hashlib.sha256(), 0, b"", 0
        self.seen, self.rows, self.sums, self.edges, self.pages = np.zeros(256, bool), 0, [], 0, 0

    def add(self, page: Page) -> None:
        if page.pixels is None:
            self.problems += 1
            return
        self.pages += 1
        self.rows += page.height
        self.sha.update(page.pixels)
        self.bytes += len(page.pixels)
        self.tail = (self.tail + page.pixels[-TAIL:])[-TAIL:]
        raw = np.frombuffer(page.pixels, np.uint8)
        self.seen |= np.bincount(raw, minlength=256) > 0
        if page.bits == 8:
            x = raw.reshape(page.height, page.width, page.samples)
            sums = x.sum(axis=(0, 1), dtype=np.int64).tolist()
            self.sums = [a + b for a, b in zip(self.sums + [0] * (len(sums) - len(self.sums)), sums + [0] * (len(self.sums) - len(sums)), strict=True)]
            self.edges += int(np.abs(np.diff(x.astype(np.int16), axis=1)).sum(dtype=np.int64))

    @property
    def feature(self) -> str:
        """Pages, rows, different bytes, sums by sample and the sum of differences of neighbours in a row."""
        return f"pages={self.pages};rows={self.rows};values={int(self.seen.sum())};sums={','.join(map(str, self.sums))};edges={self.edges}"


_PAGE = {
    "page": T.IntegerType(), "n_pages": T.IntegerType(), "width": T.LongType(), "height": T.LongType(), "samples": T.IntegerType(), "bits": T.IntegerType(), "compression": T.IntegerType(), "predictor": T.IntegerType(), "tiled": T.BooleanType(),
    "problem": T.StringType(), "pixels": T.BinaryType(), "problems": T.IntegerType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail": T.BinaryType(), "feature": T.StringType(),
}
_ARROW = {T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.StringType: pa.string(), T.BinaryType: pa.binary()}


def _page_rows(media: bytes, pixels: bool) -> Iterator[tuple]:
    running = Running()
    for p in pages(media):
        running.add(p)
        yield p.index, p.n_pages, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.problem, p.pixels if pixels else None, running.problems, running.bytes, running.sha.hexdigest(), running.tail, running.feature


def read_pages(files: DataFrame, keys: list[str], media: str = "media", pixels: bool = True) -> DataFrame:
    """files with a binary column to one row a page: the keys, then the columns of _PAGE. With pixels=False the samples are
    left out (and decoded all the same)."""
    names = [free_name(n, keys) for n in _PAGE]
    types = [_ARROW[type(t)] for t in _PAGE.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, size = [], [], 0

            def flushed() -> pa.RecordBatch:
                mine = batch.select(range(len(keys))).take(pa.array(at, pa.int64()))
                return pa.RecordBatch.from_arrays([*mine.columns, *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=[*keys, *names])

            for i, value in enumerate(batch.column(len(keys))):
                if not value.is_valid:
                    continue
                for row in _page_rows(value.as_py(), pixels):
                    at.append(i)
                    rows.append(row)
                    size += 400 + len(row[10] or b"")
                    if size > _FLUSH:
                        yield flushed()
                        at, rows, size = [], [], 0
            if rows:
                yield flushed()

    schema = T.StructType([*[files.schema[k] for k in keys], *[T.StructField(n, t) for n, t in zip(names, _PAGE.values(), strict=True)]])
    return files.select(*keys, media).mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str, pixels: bool = True) -> DataFrame:
    """One row a page (path, then the page's columns) of the files below a folder whose names end in .tif or .tiff."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.lower("path").rlike(r"\.tiff?$"))
    return read_pages(files.select("path", "content"), ["path"], "content", pixels)


def store_texts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_bytes (of the text in UTF-8; null: 0) and media, the TIFF file that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, files, sizes, held = 0, [], [], 0

            def flushed(end: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

            for i, text in enumerate(batch.column(1)):
                payload = (text.as_py() or "").encode()
                files.append(store(payload))
                sizes.append(len(payload))
                held += len(files[-1])
                if held > _FLUSH:
                    yield flushed(i + 1)
                    begin, files, sizes, held = i + 1, [], [], 0
            if files:
                yield flushed(batch.num_rows)

    out = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(run, out)


def round_trip(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature:
    texts are stored as TIFF in a table of the shared folder, which is then read page by page. A page that cannot be read
    back ends the query."""
    stored = written(store_texts(docs), "tiff-media").withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    read = read_pages(stored, ["doc_id", "n_bytes", "media_bytes", "media_sha256"], pixels=False)
    last = read.filter((F.col("page") == F.col("n_pages") - 1) | (F.col("n_pages") == 0))
    lost = F.raise_error(F.concat(F.lit("a page cannot be read back: "), F.coalesce("problem", F.lit("before the last"))))
    sha = F.when(F.col("problems") == 0, F.col("payload_sha256")).otherwise(lost)
    return last.select("doc_id", "n_bytes", "payload_bytes", sha.alias("payload_sha256"), F.crc32("tail").alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
