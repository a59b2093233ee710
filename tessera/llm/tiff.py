"""TIFF as a media column: write pages, and read them back by walking the image directories.

`encode` writes a classic little-endian TIFF of 8-bit grey pages in strips or
tiles; `pages` reads classic files of any byte order, strips or tiles, no
compression, PackBits, LZW or deflate, with the horizontal predictor undone, and
yields one record per page. Samples are 8-bit and chunky: other widths, planar
layout, the floating-point predictor and BigTIFF are errors. `read_pages` maps a
binary column to one row per page; `text_media` stores texts as images, each by
one of LAYOUTS as its bytes decide, and reads them back.

Nulls: a null or empty text is one row of 64 zero samples; a null file has no
pages. A file that is no TIFF, or whose directories ask for more samples than
its data can hold, raises ValueError before they are allocated, and with
errors="row" gives one row whose `error` is set, after the pages before the
fault. Rows are independent, so ties and repeated rows need no care; a long text
is many pages. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.cluster import bounded_batches

WIDTH = 64
#: Rows of a page, so that a long text is several pages, and rows of a strip.
PAGE_ROWS, STRIP_ROWS = 4096, 256
# Fixed values of TIFF 6.0: compression codes, predictor codes, field type sizes.
NONE, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946
NO_PREDICTOR, HORIZONTAL = 1, 2
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
# Fixed values of TIFF 6.0: tags.
IMAGE_WIDTH, IMAGE_LENGTH, BITS_PER_SAMPLE, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES_PER_PIXEL, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325


RUN = re.compile(rb"(.)\1{1,127}", re.S)


def packbits(data: bytes) -> bytes:
    out, at = [], 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(bytes((len(part) - 1,)) + part)

    for m in RUN.finditer(data):
        literal(m.start())
        out.append(bytes((257 - (m.end() - m.start()), data[m.start()])))
        at = m.end()
    literal(len(data))
    return b"".join(out)


def unpackbits(data: bytes, size: int = sys.maxsize) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


#: LZW codes: clear the table, end of data, the first that is made, and the one before which a writer clears.
CLEAR, STOP, MADE, FULL = 256, 257, 258, 4094


def lzw(data: bytes) -> bytes:
    """MSB-first codes of 9 to 12 bits, which widen one code early."""
    codes, table, fresh = [CLEAR], {}, MADE
    known = table.get
    prefix = data[0] if data else None
    for b in data[1:]:
        key = prefix << 8 | b
        longer = known(key)
        if longer is not None:
            prefix = longer
            continue
        codes.append(prefix)
        table[key] = fresh
        fresh += 1
        prefix = b
        if fresh == FULL:
            codes.append(CLEAR)
            table.clear()
            fresh = MADE
    if prefix is not None:
        codes += [prefix] if fresh + 1 < FULL else [prefix, CLEAR]
    codes.append(STOP)
    value = np.array(codes, ">u2")
    # the next code to be made when each is written: as many after the last clearing as have been written since
    place = np.arange(len(value))
    since = place - np.concatenate(([0], np.maximum.accumulate(np.where(value == CLEAR, place, 0))[:-1])) - 1
    width = np.where(place == 0, 9, 9 + np.searchsorted((512, 1024, 2048), MADE + since, "right"))
    bits = np.unpackbits(value.view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - width[:, None]]).tobytes()


#: The width of the k-th code after a clearing, as a reader sees it, one entry behind the writer.
WIDTHS = 9 + np.searchsorted((511, 1023, 2047), np.maximum(MADE - 1 + np.arange(1 << 13), MADE), "right")


def unlzw(data: bytes, size: int = sys.maxsize) -> bytes:
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8))).astype(np.uint32)
    out: list[bytes] = []
    bit = done = k = 0
    table, last = [bytes((i,)) for i in range(256)] + [b"", b""], b""
    while done < size:
        width = WIDTHS[k:] if k < len(WIDTHS) else WIDTHS[-1:].repeat(4096)
        ends = bit + np.cumsum(width)
        width = width[: np.searchsorted(ends, 8 * len(data), "right")]
        if not len(width):
            break
        starts = ends[: len(width)] - width
        at = starts >> 3
        codes = (raw[at] << 16 | raw[at + 1] << 8 | raw[at + 2]) >> (24 - (starts & 7) - width) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == CLEAR) | (codes == STOP))
        n = int(stop[0]) if len(stop) else len(codes)
        for code in codes[:n].tolist():
            if code < len(table):
                entry = table[code]
            elif last and code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("a broken LZW stream")
            out.append(entry)
            done += len(entry)
            if last:
                table.append(last + entry[:1])
            last = entry
            if done >= size:
                break
        if len(stop) and codes[n] == STOP:
            break
        if len(stop):
            bit, k = int(ends[n]), 0
            del table[MADE:]
            last = b""
        else:
            bit, k = int(ends[n - 1]), k + n
    return b"".join(out)


def compress(data: bytes, scheme: int) -> bytes:
    return {NONE: bytes, LZW: lzw, PACKBITS: packbits, ADOBE_DEFLATE: lambda d: zlib.compress(d, 1), DEFLATE: lambda d: zlib.compress(d, 1)}[scheme](data)


def inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, size)


#: Readers, and the most bytes that a byte of each compression can stand for.
READERS = {NONE: (lambda d, n: d[:n], 1), PACKBITS: (unpackbits, 64), LZW: (unlzw, 4096), ADOBE_DEFLATE: (inflate, 1040), DEFLATE: (inflate, 1040)}


def decompress(data: bytes, scheme: int, size: int) -> bytes:
    """The first `size` bytes; ValueError if there are fewer."""
    made = READERS[scheme][0](data, size)[:size]
    if len(made) < size:
        raise ValueError("a strip or tile is too short")
    return made


def encode(pixels: np.ndarray, scheme: int = ADOBE_DEFLATE, predictor: int = NO_PREDICTOR, page_rows: int = PAGE_ROWS, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None) -> bytes:
    """pixels (rows, width) of uint8 as a TIFF; a page for each page_rows rows, in strips, or in tiles of (rows, width)."""
    rows, width = pixels.shape
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for top in range(0, rows, page_rows):
        page = pixels[top : top + page_rows]
        if tile:
            parts = []
            for y in range(0, len(page), tile[0]):
                for x in range(0, width, tile[1]):
                    part = np.zeros(tile, np.uint8)
                    got = page[y : y + tile[0], x : x + tile[1]]
                    part[: got.shape[0], : got.shape[1]] = got
                    parts.append(part)
        else:
            parts = [page[y : y + strip_rows] for y in range(0, len(page), strip_rows)]
        offsets, counts = [], []
        for part in parts:
            if predictor == HORIZONTAL:
                part = np.diff(part, axis=1, prepend=np.uint8(0))
            made = compress(np.ascontiguousarray(part).tobytes(), scheme)
            offsets.append(len(out))
            counts.append(len(made))
            out += made + b"\0" * (len(made) & 1)
        fields = {IMAGE_WIDTH: [width], IMAGE_LENGTH: [len(page)], BITS_PER_SAMPLE: [8], COMPRESSION: [scheme], PHOTOMETRIC: [1], SAMPLES_PER_PIXEL: [1], PREDICTOR: [predictor]}
        fields |= {TILE_WIDTH: [tile[1]], TILE_LENGTH: [tile[0]], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [strip_rows], STRIP_COUNTS: counts}
        where = {}
        for tag, values in fields.items():
            if len(values) > 1:
                where[tag] = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields))
        for tag, values in sorted(fields.items()):
            out += struct.pack("<HHII", tag, 4, len(values), where.get(tag, values[0]))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(file: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    n = struct.unpack_from(f"{order}H", file, at)[0]
    fields: dict[int, list[int]] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", file, at + 2 + 12 * i)
        if kind not in (1, 3, 4):
            continue
        place = at + 10 + 12 * i
        if TYPE_SIZE[kind] * count > len(file):
            raise ValueError("a field is longer than the file")
        if TYPE_SIZE[kind] * count > 4:
            place = struct.unpack_from(f"{order}I", file, place)[0]
        fields[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", file, place))
    return fields, struct.unpack_from(f"{order}I", file, at + 2 + 12 * n)[0]


def pages(file: bytes) -> Iterator[dict]:
    """A record for each image directory, in order: width, height, samples, compression, predictor, pixels."""
    if len(file) < 8 or file[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    order = "<" if file[:2] == b"II" else ">"
    at, seen = struct.unpack_from(f"{order}I", file, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the image directories form a loop")
        seen.add(at)
        try:
            f, at = _directory(file, at, order)
            one = lambda tag, default=None, f=f: f.get(tag, [default])[0]
            width, height, samples = one(IMAGE_WIDTH), one(IMAGE_LENGTH), one(SAMPLES_PER_PIXEL, 1)
            scheme, predictor = one(COMPRESSION, NONE), one(PREDICTOR, NO_PREDICTOR)
            if set(f.get(BITS_PER_SAMPLE, [1])) != {8} or one(PLANAR, 1) != 1 or predictor not in (NO_PREDICTOR, HORIZONTAL):
                raise ValueError("only chunky 8-bit samples are supported")
            if scheme not in READERS:
                raise ValueError(f"compression {scheme} is not supported")
            if TILE_OFFSETS in f:
                high, wide, starts, counts = one(TILE_LENGTH), one(TILE_WIDTH), f[TILE_OFFSETS], f[TILE_COUNTS]
            else:
                high, wide, starts, counts = min(one(ROWS_PER_STRIP, height), height), width, f[STRIP_OFFSETS], f[STRIP_COUNTS]
            if min(width, height, samples, high, wide) < 1:
                raise ValueError("an image has no samples")
            across = -(-width // wide)
            most = READERS[scheme][1] * sum(min(n, len(file)) for n in counts)
            if len(starts) != len(counts) or len(starts) != across * -(-height // high) or height * width * samples > most:
                raise ValueError("an image has more samples than its data can hold")
            pixels = np.zeros((height, width, samples), np.uint8)
            for i, (start, count) in enumerate(zip(starts, counts, strict=True)):
                y, x = i // across * high, i % across * wide
                tall = high if TILE_OFFSETS in f else min(high, height - y)
                part = np.frombuffer(decompress(file[start : start + count], scheme, tall * wide * samples), np.uint8).reshape(tall, wide, samples)
                if predictor == HORIZONTAL:
                    part = np.cumsum(part, axis=1, dtype=np.uint8)
                pixels[y : y + tall, x : x + wide] = part[: height - y, : width - x]
        except (struct.error, KeyError, TypeError, zlib.error) as e:
            raise ValueError(f"a broken TIFF file: {e}") from e
        yield {"width": width, "height": height, "samples": samples, "compression": scheme, "predictor": predictor, "pixels": pixels}


PAGE_SCHEMA = "page int, width int, height int, samples int, compression int, predictor int, pixels binary, error string"


def read_pages(df: DataFrame, key: str, content: str, errors: str = "raise") -> DataFrame:
    """One row per page of the TIFF in column `content`: key, page (from 0) and PAGE_SCHEMA's columns."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {PAGE_SCHEMA}"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, *(x.split()[0] for x in PAGE_SCHEMA.split(", "))]
        for batch in batches:
            rows = []
            for k, file in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not file.is_valid:
                    continue
                try:
                    for i, p in enumerate(pages(file.as_py())):
                        rows.append([k, i, *(p[n] for n in names[2:7]), p["pixels"].tobytes(), None])
                except ValueError as e:
                    if errors == "raise":
                        raise
                    rows.append([k, None, None, None, None, None, None, None, str(e)])
            kinds = [batch.schema.field(0).type, *[pa.int32()] * 6, pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names)

    return df.select(key, content).mapInArrow(each, schema)


#: Compression, predictor and tile of a stored text, by its CRC modulo their number.
LAYOUTS = [
    (ADOBE_DEFLATE, NO_PREDICTOR, None), (ADOBE_DEFLATE, HORIZONTAL, (64, 32)), (DEFLATE, HORIZONTAL, None), (DEFLATE, NO_PREDICTOR, (16, 16)),
    (LZW, NO_PREDICTOR, None), (LZW, HORIZONTAL, (32, 64)), (PACKBITS, NO_PREDICTOR, (48, 48)), (NONE, HORIZONTAL, None),
]


def stored_text(data: bytes) -> tuple[bytes, bytes, str]:
    """(TIFF, payload read back from it, feature) for the bytes of a text."""
    padded = data + b"\0" * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))
    scheme, predictor, tile = LAYOUTS[zlib.crc32(padded) % len(LAYOUTS)]
    file = encode(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH), scheme, predictor, tile=tile)
    got = list(pages(file))
    samples = np.concatenate([p["pixels"].reshape(-1) for p in got])
    bars = np.bincount(samples >> 4, minlength=16)
    share = bars[bars > 0] / len(samples)
    feature = f"pages={len(got)};compression={got[0]['compression']};predictor={got[0]['predictor']};height={sum(p['height'] for p in got)};mean={samples.mean(dtype=np.float64):.3f};entropy={-(share * np.log2(share)).sum() + 0.0:.3f}"
    return file, samples.tobytes(), feature


MEDIA_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Each text stored as a TIFF and read back: doc_id and MEDIA_SCHEMA's columns, the file itself if asked for."""
    bounded_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MEDIA_SCHEMA}{', media binary' * with_media}"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(x.split()[0] for x in MEDIA_SCHEMA.split(", ")), *["media"] * with_media]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                file, payload, feature = stored_text(data)
                rows.append([len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature, *[file] * with_media])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * with_media]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(each, schema)
