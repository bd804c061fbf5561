"""TIFF round trips and malformed files; URL rules against a plain model and SQL."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

from cuebase.llm import queries, tiff
from cuebase.llm.url_filter import filter_urls


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
def test_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(5)
    pages = [rng.integers(0, top, shape, dtype=np.uint8) for shape in ((37, 51, 1), (300, 64, 3), (1, 64, 3)) for top in (2, 256)]
    got = list(tiff.read_pages(tiff.write_file(pages, compression, predictor, rows=7, tile=tile)))
    assert [(p.height, p.width, p.samples, p.pixels) for p in got] == [(*a.shape, a.tobytes()) for a in pages]


def big_endian_16(values: np.ndarray, predictor: int) -> bytes:
    h, w = values.shape
    stored = values.copy()
    if predictor == 2:
        stored[:, 1:] = values[:, 1:] - values[:, :-1]
    raw = zlib.compress(stored.astype(">u2").tobytes())
    tags = [(256, 3, w), (257, 3, h), (258, 3, 16), (259, 3, 8), (273, 4, 8), (277, 3, 1), (278, 3, h), (279, 4, len(raw)), (317, 3, predictor)]
    pad = raw + b"\0" * (len(raw) % 2)
    entries = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", x, 0) if k == 3 else struct.pack(">I", x)) for t, k, x in tags)
    return b"MM\0*" + struct.pack(">I", 8 + len(pad)) + pad + struct.pack(">H", len(tags)) + entries + b"\0\0\0\0"


def test_big_endian_16_bits():
    a = np.arange(60, dtype=np.uint16).reshape(6, 10) * 997
    for predictor in (1, 2):
        (page,) = tiff.read_pages(big_endian_16(a, predictor))
        assert page.bits == 16 and page.pixels == a.astype("<u2").tobytes()


def foreign(tags: dict, blocks: list[bytes], order: str = "<", big: bool = False) -> bytes:
    """A file laid out by the format's own rules, apart from the library's writer: directory first, then fields, then data."""
    word, entry, head = ("Q", 20, 16) if big else ("I", 12, 8)
    size = struct.calcsize(word)
    tags = dict(tags) | {273: (16 if big else 4, [0] * len(blocks)), 279: (16 if big else 4, [len(b) for b in blocks])}
    fields_at = head + (8 if big else 2) + entry * len(tags) + size
    code = {3: "H", 4: "I", 16: "Q"}
    spare = sum(len(v) * struct.calcsize(code[k]) for k, v in tags.values())
    at = fields_at + spare
    for b in blocks:
        tags[273][1][[len(x) for x in blocks].index(len(b)) if len(blocks) == 1 else blocks.index(b)] = at
        at += len(b)
    entries, extra = b"", b""
    for t in sorted(tags):
        k, v = tags[t]
        raw = struct.pack(f"{order}{len(v)}{code[k]}", *v)
        if len(raw) > size:
            entries += struct.pack(f"{order}HH{word}{word}", t, k, len(v), fields_at + len(extra))
            extra += raw
        else:
            entries += struct.pack(f"{order}HH{word}", t, k, len(v)) + raw.ljust(size, b"\0")
    start = {"<": b"II", ">": b"MM"}[order] + (struct.pack(f"{order}HHHQ", 43, 8, 0, 16) if big else struct.pack(f"{order}HI", 42, 8))
    count = struct.pack(order + ("Q" if big else "H"), len(tags))
    return start + count + entries + bytes(size) + extra.ljust(spare, b"\0") + b"".join(blocks)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_foreign_files(order, big):
    rng = np.random.default_rng(11)
    # bilevel in PackBits: rows end on whole bytes
    bits = rng.integers(0, 2, (5, 19), dtype=np.uint8)
    lines = [np.packbits(r).tobytes() for r in bits]
    packed = b"".join(bytes([len(x) - 1]) + x for x in lines)
    (page,) = tiff.read_pages(foreign({256: (3, [19]), 257: (3, [5]), 259: (3, [32773]), 278: (3, [5])}, [packed], order, big))
    assert page.bits == 1 and page.pixels == bits.tobytes()
    # four bits a sample
    nibbles = rng.integers(0, 16, (3, 7), dtype=np.uint8)
    padded = np.concatenate([nibbles, np.zeros((3, 1), np.uint8)], axis=1)
    raw = (padded[:, ::2] << 4 | padded[:, 1::2]).tobytes()
    (page,) = tiff.read_pages(foreign({256: (3, [7]), 257: (3, [3]), 258: (3, [4]), 278: (3, [3])}, [raw], order, big))
    assert page.pixels == nibbles.tobytes()
    # planes apart, old deflate, predictor 2 within each plane
    rgb = rng.integers(0, 256, (4, 6, 3), dtype=np.uint8)
    planes = [zlib.compress(np.concatenate([rgb[:, :1, k], np.diff(rgb[:, :, k], axis=1)], axis=1).tobytes()) for k in range(3)]
    tags = {256: (3, [6]), 257: (3, [4]), 258: (3, [8, 8, 8]), 259: (3, [32946]), 277: (3, [3]), 278: (3, [4]), 284: (3, [2]), 317: (3, [2])}
    (page,) = tiff.read_pages(foreign(tags, planes, order, big))
    assert page.pixels == rgb.tobytes()
    # floats with predictor 3: bytes of a row by significance, the highest first, then differences
    values = rng.normal(size=(3, 5)).astype("<f4")
    shuffled = values.view(np.uint8).reshape(3, 5, 4)[:, :, ::-1].transpose(0, 2, 1).reshape(3, 20)
    stored = zlib.compress(np.concatenate([shuffled[:, :1], np.diff(shuffled, axis=1)], axis=1).tobytes())
    tags = {256: (3, [5]), 257: (3, [3]), 258: (3, [32]), 259: (3, [8]), 278: (3, [3]), 317: (3, [3]), 339: (3, [3])}
    (page,) = tiff.read_pages(foreign(tags, [stored], order, big))
    assert np.array_equal(np.frombuffer(page.pixels, dtype="<f4").reshape(3, 5), values)


def test_digests_of_broken_files(spark):
    good = tiff.text_file(b"some text")
    df = spark.createDataFrame([(1, 9, bytearray(good)), (2, 9, bytearray(good[:40])), (3, 0, bytearray()), (4, 0, None)], "doc_id int, n_bytes long, media binary")
    got = {r.doc_id: r for r in tiff.tiff_digests(df, "doc_id").collect()}
    assert set(got) == {1, 2, 3} and got[1].error is None and got[1].payload_bytes == 192
    assert got[2].error and got[2].payload_bytes is None and got[3].error


@pytest.mark.parametrize("zero", [{278: (3, [0])}, {322: (3, [0]), 323: (3, [16]), 324: (4, [8]), 325: (4, [1])}, {322: (3, [16]), 323: (3, [0]), 324: (4, [8]), 325: (4, [1])}, {277: (3, [0])}, {256: (3, [0])}])
def test_zero_sizes_are_damage(spark, zero):
    """Strips, tiles and pixels without a size are rows with an error; a page without pixels is a page."""
    tags = {256: (3, [4]), 257: (3, [4]), 258: (3, [8]), 278: (3, [4])} | zero
    df = spark.createDataFrame([(1, 0, bytearray(foreign(tags, [bytes(16)]))), (2, 0, bytearray(tiff.text_file(b"x")))], "doc_id int, n_bytes long, media binary")
    for got in (tiff.tiff_digests(df, "doc_id"), tiff.tiff_pages(df, "doc_id")):
        errors = {r.doc_id: r.error for r in got.collect()}
        assert errors[1] and not errors[2]


def test_pages_and_broken_files(spark):
    good = tiff.write_file([np.zeros((2, 3, 1), np.uint8)] * 2, tiff.LZW)
    loop = bytearray(good)
    files = [(1, good), (2, b""), (3, good[: len(good) // 2]), (4, None), (5, b"II*\0\xff\xff\xff\0"), (1, good), (None, good)]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b), "x") for i, b in files], "doc_id int, media binary, page string")
    got = tiff.tiff_pages(df, "doc_id").collect()
    assert sorted((r.doc_id or 0, r.page) for r in got if r.error is None) == [(0, 0), (0, 1), (1, 0), (1, 0), (1, 1), (1, 1), (3, 0)]
    assert {r.doc_id for r in got if r.error} == {2, 3, 5}
    assert tiff.tiff_pages(df.limit(0), "doc_id").count() == 0 and len(loop) == len(good)


def test_texts_come_back(docs, rows):
    got = sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes > 0) for r in tiff.tiff_digests(tiff.store_texts(docs), "doc_id").collect())
    want = []
    for r in rows:
        t = (r[1] or "").encode()
        p = t + b" " * (max(1, -(-len(t) // 192)) * 192 - len(t))
        want.append((str(r[0]), len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), True))
    assert got == sorted(want)


def test_long_text_takes_several_pages():
    raw = b"abc " * 300_000
    pages = list(tiff.read_pages(tiff.text_file(raw)))
    assert len(pages) == 2 and b"".join(p.pixels for p in pages)[: len(raw)] == raw


RULES = [("Org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/e", "allow"), ("com", "/de/", "block"), ("com", "/de/", "allow"), (None, "/", "block"), ("net", "", "block")]
URLS = ["http://a.EXAMPLE.org/es/1?x", "https://example.org/en", "http://org/", "http://xorg/", "http://a.com/de/", "http://b.net", "http://a..org/x", "no scheme", "", None, "http:///x", "http://a.com#/de/", "http://é.org/es/\nmore"]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    hits = [(len(h) + len(p), len(h), a, h.lower() + p) for h, p, a in RULES if h and host and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(hits) if hits else None
    return host, path, best[3] if best else None, best[2] if best else "allow"


def test_urls_equal_model(spark):
    df = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(URLS * 2)], "page_id int, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, spark.createDataFrame(RULES, "host string, path string, action string")).collect()}
    assert got == {k: judged(u) for k, u in enumerate(URLS * 2)}
    none = spark.createDataFrame([], "host string, path string, action string")
    assert {r.verdict for r in filter_urls(df, none, default="block").collect()} == {"block"}
    assert filter_urls(df.limit(0), none).count() == 0


def test_urls_equal_sql(same):
    same(queries.QUERIES["op7_url_filters"], queries.ORACLES["op7_url_filters"])
