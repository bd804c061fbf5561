"""TIFF media columns: walk image directories, decode strips and tiles, undo predictors, one row per page.

Reads both byte orders, classic and 64-bit files; PackBits, LZW, deflate and
uncompressed strips or tiles; chunky and planar samples of 1, 2, 4, 8, 16, 32 or 64 bits, those
of less than a byte as a byte each; horizontal differencing (predictor 2) and the floating-point predictor (3).

Defined cases: a null file gives no page; an empty, cut or unknown file gives, after the pages before the
damage, one row with page null and its error (in tiff_digests(): one row with null figures and the error); a directory that repeats ends the walk; equal files give equal rows;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebase.llm.common import bounded_batches
from cuebase.llm.textbatch import slices, text_buffer

#: Fixed values of the TIFF 6.0 format: field sizes by type, tags, compression codes.
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: Width in pixels of a stored text (192 bytes a row), rows a strip and rows a page.
TEXT_WIDTH, STRIP_ROWS, PAGE_ROWS = 64, 256, 4096

#: What reading a damaged file can raise.
DAMAGE = (ValueError, KeyError, IndexError, ArithmeticError, struct.error, zlib.error, MemoryError)


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: bytes


def unpack_bits(data: bytes, most: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 1 + (n > 128)
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three equal bytes and more become repeats, the rest literals."""
    a = np.frombuffer(data, dtype=np.uint8)
    if not len(a):
        return b""
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    out, held = bytearray(), bytearray()

    def flush():
        for i in range(0, len(held), 128):
            part = held[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        held.clear()

    for s, n in zip(first.tolist(), np.diff(np.r_[first, len(a)]).tolist(), strict=True):
        if n < 3:
            held += data[s : s + n]
            continue
        flush()
        while n:
            k = min(n, 128)
            out += bytes([257 - k if k > 1 else 0, data[s]])
            n -= k
    flush()
    return bytes(out)


def unpack_lzw(data: bytes, most: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one code early."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, held, bits, last = bytearray(), 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of range")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
        if len(out) >= most:
            break
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    table, size, width, held, bits, out, current = {bytes([i]): i for i in range(256)}, 258, 9, 256, 9, bytearray(), b""

    def put(code: int):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    held, bits = 0, 0
    put(256)
    for i in range(len(data)):
        longer = current + data[i : i + 1]
        if longer in table:
            current = longer
            continue
        put(table[current])
        table[longer] = size
        size += 1
        if size >= 4094:
            put(256)
            table, size, width = {bytes([j]): j for j in range(256)}, 258, 9
        elif size >= 1 << width:
            width += 1
        current = data[i : i + 1]
    if current:
        put(table[current])
        if size + 1 >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _raw(data: bytes, compression: int, most: int) -> bytes:
    if compression == NONE:
        return data[:most]
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    if compression == LZW:
        return unpack_lzw(data, most)
    if compression == PACKBITS:
        return unpack_bits(data, most)
    raise ValueError(f"compression {compression} is not known")


def _block(raw: bytes, rows: int, width: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """Samples of one strip or tile, little-endian, with the predictor undone."""
    if bits < 8:
        line = -(-width * samples * bits // 8)
        if len(raw) < rows * line:
            raise ValueError("strip or tile is cut")
        if predictor != 1:
            raise ValueError(f"predictor {predictor} needs whole bytes")
        one = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=rows * line).reshape(rows, line), axis=1)[:, : width * samples * bits]
        return (one.reshape(rows, width, samples, bits) << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
    size = bits // 8
    if len(raw) < rows * width * samples * size:
        raise ValueError("strip or tile is cut")
    if predictor == 3:
        planes = np.frombuffer(raw, dtype=np.uint8, count=rows * width * samples * size).reshape(rows, width * samples * size)
        step = planes.reshape(rows, width * size, samples) if samples > 1 else planes[:, :, None]
        planes = np.cumsum(step, axis=1, dtype=np.uint8).reshape(rows, size, width * samples)
        return np.ascontiguousarray(planes[:, ::-1].transpose(0, 2, 1)).reshape(rows, -1).view(f"<u{size}").reshape(rows, width, samples)
    a = np.frombuffer(raw, dtype=f"{order}u{size}", count=rows * width * samples).reshape(rows, width, samples).astype(f"<u{size}")
    return np.cumsum(a, axis=1, dtype=a.dtype) if predictor == 2 else a


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError("no TIFF header")
    (magic,) = struct.unpack_from(f"{order}H", data, 2)
    if magic == 42:
        head, entry, word, at = "H", 12, "I", struct.unpack_from(f"{order}I", data, 4)[0]
    elif magic == 43:
        head, entry, word, at = "Q", 20, "Q", struct.unpack_from(f"{order}Q", data, 8)[0]
    else:
        raise ValueError("no TIFF magic number")
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + head, data, at)
        at += struct.calcsize(head)
        tags = {}
        for k in range(n):
            tag, kind = struct.unpack_from(f"{order}HH", data, at + k * entry)
            (count,) = struct.unpack_from(order + word, data, at + k * entry + 4)
            if kind in TYPE_CODES:
                place = at + k * entry + 4 + struct.calcsize(word)
                if TYPE_SIZES[kind] * count > struct.calcsize(word):
                    (place,) = struct.unpack_from(order + word, data, place)
                tags[tag] = struct.unpack_from(f"{order}{count}{TYPE_CODES[kind]}", data, place)
        yield _page(data, tags, order)
        (at,) = struct.unpack_from(order + word, data, at + n * entry)


def _page(data: bytes, tags: dict[int, tuple[int, ...]], order: str) -> Page:
    one = lambda tag, other: tags.get(tag, (other,))[0]
    width, height, samples, compression, predictor = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    bits = set(tags.get(BITS, (1,)))
    if len(bits) > 1 or not bits <= {1, 2, 4, 8, 16, 32, 64}:
        raise ValueError(f"samples of {sorted(bits)} bits are not known")
    bits = bits.pop()
    apart = one(PLANAR, 1) == 2
    deep, planes = (1, samples) if apart else (samples, 1)
    if TILES in tags:
        wide, high, places, lengths = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0], tags[TILES], tags[TILE_BYTES]
    else:
        wide, high, places = width, min(one(ROWS, height), height), tags[STRIPS]
        lengths = tags.get(STRIP_BYTES, (len(data),))
    if min(wide, high, samples) < 1:
        raise ValueError("strips, tiles and pixels have a size of 1 at least")
    out = np.empty((height, width, samples), dtype=f"<u{max(1, bits // 8)}")
    across, down = -(-width // wide), -(-height // high)
    for plane in range(planes):
        for k in range(across * down):
            y, x = k // across * high, k % across * wide
            rows = high if TILES in tags else min(high, height - y)
            i = plane * across * down + k
            raw = _raw(data[places[i] : places[i] + lengths[i]], compression, rows * -(-wide * deep * bits // 8))
            block = _block(raw, rows, wide, deep, bits, predictor, order)
            out[y : y + rows, x : x + wide, plane : plane + deep] = block[: height - y, : width - x]
    return Page(width, height, samples, bits, compression, predictor, out.tobytes())


def write_file(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = STRIP_ROWS, tile: int = 0) -> bytes:
    """A little-endian file of 8-bit pages (height, width, samples), in strips, or in square tiles."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    pack = {NONE: bytes, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits, LZW: pack_lzw}[compression]
    for page in pages:
        height, width, samples = page.shape
        if tile:
            padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile, samples), dtype=np.uint8)
            padded[:height, :width] = page
            blocks = [padded[y : y + tile, x : x + tile] for y in range(0, len(padded), tile) for x in range(0, padded.shape[1], tile)]
        else:
            blocks = [page[y : y + rows] for y in range(0, height, rows)]
        places, lengths = [], []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1)
            raw = pack(b.tobytes())
            places.append(len(out))
            lengths.append(len(raw))
            out += raw
        fields = {WIDTH: (3, [width]), HEIGHT: (4, [height]), BITS: (3, [8] * samples), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if samples == 3 else 1]), SAMPLES: (3, [samples]), PREDICTOR: (3, [predictor])}
        fields |= {TILE_WIDTH: (3, [tile]), TILE_HEIGHT: (3, [tile]), TILES: (4, places), TILE_BYTES: (4, lengths)} if tile else {STRIPS: (4, places), ROWS: (4, [rows]), STRIP_BYTES: (4, lengths)}
        entries = bytearray()
        for tag in sorted(fields):
            kind, values = fields[tag]
            raw = struct.pack(f"<{len(values)}{TYPE_CODES[kind]}", *values)
            if len(raw) > 4:
                raw, place = struct.pack("<I", len(out) + len(out) % 2), raw
                out += b"\0" * (len(out) % 2) + place
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


def text_file(raw: bytes) -> bytes:
    """A text's bytes as pages of 64 RGB pixels a row, padded by spaces to whole rows, one row at least."""
    size = 3 * TEXT_WIDTH
    a = np.frombuffer(raw + b" " * (max(1, -(-len(raw) // size)) * size - len(raw)), dtype=np.uint8).reshape(-1, TEXT_WIDTH, 3)
    return write_file([a[i : i + PAGE_ROWS] for i in range(0, len(a), PAGE_ROWS)])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a TIFF file."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(part.column(1))
                files = [text_file(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(files, pa.binary())], names=["id", "n_bytes", "media"])

    return bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def tiff_pages(files: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """One row per page: id, page, width, height, samples, bits, compression, predictor, pixels, error."""
    schema = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"
    kinds = [pa.int32()] * 7 + [pa.binary(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "media"):
                rows, owner = [], []
                for i in range(len(part)):
                    if not part.column(1)[i].is_valid:
                        continue
                    try:
                        for k, p in enumerate(read_pages(part.column(1)[i].as_py())):
                            rows.append((k, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.pixels, None))
                            owner.append(i)
                    except DAMAGE as e:
                        rows.append((None,) * 8 + (f"{type(e).__name__}: {e}"[:200],))
                        owner.append(i)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64()))] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", *names])

    return files.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {dict(files.dtypes)[id_col]}, {schema}").withColumnRenamed("id", id_col)


def tiff_digests(files: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """One row per file: id, pages, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error."""
    schema = "pages int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def digest(media: bytes):
        whole, tail, size, pages, hist, shape = hashlib.sha256(), b"", 0, 0, np.zeros(256, dtype=np.int64), []
        for p in read_pages(media):
            whole.update(p.pixels)
            tail, size, pages = (tail + p.pixels)[-16:], size + len(p.pixels), pages + 1
            hist += np.bincount(np.frombuffer(p.pixels, dtype=np.uint8), minlength=256)
            shape.append(f"{p.width}x{p.height}")
        mean = int(hist @ np.arange(256)) * 1000 // max(size, 1)
        feature = f"{shape[0]}+{pages - 1} mean={mean} used={int((hist > 0).sum())} mode={int(hist.argmax())} hist={'-'.join(map(str, hist.reshape(8, 32).sum(axis=1).tolist()))}"
        return pages, size, whole.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, None

    def tried(media: bytes):
        try:
            return digest(media)
        except DAMAGE as e:
            return (None,) * 7 + (f"{type(e).__name__}: {e}"[:200],)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "media"):
                rows = [tried(m.as_py()) for m in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2)] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "n_bytes", *names])

    own = files.where(F.col(media_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(media_col).alias("media"), "n_bytes")
    return own.mapInArrow(run, f"id {dict(files.dtypes)[id_col]}, n_bytes long, {schema}").withColumnRenamed("id", id_col)
