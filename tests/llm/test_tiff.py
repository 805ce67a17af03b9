import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from lexmill.llm import tiff

SHORT, LONG, LONG8 = 3, 4, 16


def build(images, order="<", big=False, loop=None):
    """A file of images, each a list of (tag, type, values) and of segments; segment offsets go into tag 273 or 324."""
    mark = b"II" if order == "<" else b"MM"
    at, slot, count, code = ("Q", 8, "Q", "Q") if big else ("I", 4, "H", "I")
    out = bytearray(mark + (struct.pack(f"{order}HHHQ", 43, 8, 0, 0) if big else struct.pack(f"{order}HI", 42, 0)))
    link, starts = (8 if big else 4), []
    for tags, segments, tiled in images:
        places = []
        for part in segments:
            places.append(len(out))
            out += part
        tags = [*tags, (324 if tiled else 273, LONG, places), (325 if tiled else 279, LONG, [len(p) for p in segments])]
        entries = b""
        for tag, kind, values in sorted(tags):
            value = struct.pack(f"{order}{len(values)}{'H' if kind == SHORT else 'I'}", *values)
            if len(value) > slot:
                where = len(out)
                out += value
                value = struct.pack(f"{order}{at}", where)
            entries += struct.pack(f"{order}HH{code}", tag, kind, len(values)) + value.ljust(slot, b"\0")
        starts.append(len(out))
        struct.pack_into(f"{order}{at}", out, link, len(out))
        out += struct.pack(f"{order}{count}", len(tags)) + entries
        link = len(out)
        out += b"\0" * slot
    if loop is not None:
        struct.pack_into(f"{order}{at}", out, link, starts[loop])
    return bytes(out)


def tags(width, height, samples=1, bits=8, compression=1, predictor=1, **more):
    out = [(256, LONG, [width]), (257, LONG, [height]), (258, SHORT, [bits] * samples), (259, SHORT, [compression]), (277, SHORT, [samples]), (317, SHORT, [predictor])]
    return out + [(tiff.TAGS[k], LONG, [v]) for k, v in more.items()]


def only(data):
    found = list(tiff.pages(data))
    assert len(found) == 1, found
    return found[0]


def test_published_vectors():
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])).hex() == "8001e0408044080c068080"
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")
    plain = bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA")
    assert tiff.packbits_decode(packed, 24) == plain and tiff.packbits_decode(tiff.packbits_encode(plain), 24) == plain


PAYLOADS = [b"", b"a", b"\0" * 100_000, bytes(range(256)) * 300, random.Random(1).randbytes(50_000), b"ab" * 40_000, ("věta o slovech. " * 3000).encode(), random.Random(2).randbytes(40) * 2000, b"aaab" + b"b" * 127 + b"c" * 129]


@pytest.mark.parametrize("i", range(len(PAYLOADS)))
def test_codecs_give_the_bytes_back(i):
    data = PAYLOADS[i]
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data


def test_lzw_at_every_length_around_a_wider_code_and_a_full_table():
    noise = random.Random(4).randbytes(4000)
    for n in [*range(245, 262), *range(755, 775), *range(1780, 1800), *range(3830, 3845), 4000]:
        assert tiff.lzw_decode(tiff.lzw_encode(noise[:n]), n) == noise[:n]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("bits", [8, 16, 32])
def test_horizontal_predictor_in_tiles_and_strips(order, big, bits):
    gen = np.random.default_rng(bits)
    x = gen.integers(0, 1 << bits, size=(21, 37, 3)).astype(f"u{bits // 8}")
    less = np.concatenate([x[:, :1], x[:, 1:] - x[:, :-1]], axis=1).astype(f"{order}u{bits // 8}")
    strips = [zlib.compress(less[i : i + 8].tobytes()) for i in range(0, 21, 8)]
    full = np.zeros((32, 48, 3), x.dtype)
    full[:21, :37] = x
    cut = [full[i : i + 16, j : j + 16] for i in (0, 16) for j in (0, 16, 32)]
    tiles = [tiff.lzw_encode(np.concatenate([t[:, :1], t[:, 1:] - t[:, :-1]], axis=1).astype(f"{order}u{bits // 8}").tobytes()) for t in cut]
    data = build([(tags(37, 21, 3, bits, 8, 2, strip_rows=8), strips, False), (tags(37, 21, 3, bits, 5, 2, tile_width=16, tile_height=16), tiles, True)], order, big)
    want = x.astype(f"<u{bits // 8}").tobytes()
    got = list(tiff.pages(data))
    assert [(p.index, p.n_pages, p.tiled, p.problem) for p in got] == [(0, 2, False, None), (1, 2, True, None)]
    assert [p.pixels == want for p in got] == [True, True]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("bits", [16, 32, 64])
def test_floating_predictor_and_planes(order, bits):
    size = bits // 8
    x = np.random.default_rng(3).normal(size=(5, 9, 2)).astype(f"f{size}")

    def stored(rows, samples):
        planes = np.frombuffer(rows.astype(f">f{size}").tobytes(), np.uint8).reshape(5, -1, size).transpose(0, 2, 1).reshape(5, -1, samples)
        return np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1).tobytes()

    whole = build([(tags(9, 5, 2, bits, 8, 3, format=3), [zlib.compress(stored(x, 2))], False)], order)
    apart = build([(tags(9, 5, 2, bits, 8, 3, format=3, planar=2), [zlib.compress(stored(x[:, :, i], 1)) for i in range(2)], False)], order)
    want = x.astype(f"<f{size}").tobytes()
    assert only(whole).pixels == want and only(apart).pixels == want


def test_planes_of_bytes_packed_bits_and_reversed_bits():
    x = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    planes = build([(tags(6, 4, 3, planar=2, strip_rows=2), [x[i : i + 2, :, s].tobytes() for s in range(3) for i in (0, 2)], False)])
    assert only(planes).pixels == x.tobytes()
    bits = bytes([0b10110010, 0b01000000] * 3)
    assert only(build([(tags(10, 3, 1, 1), [bits], False)])).pixels == bits
    assert only(build([(tags(10, 3, 1, 1, fill_order=2), [bytes(int(f"{b:08b}"[::-1], 2) for b in bits)], False)])).pixels == bits


DAMAGE = {
    "no TIFF header": b"II*",
    "no image directory": b"II*\0\0\0\0\0",
    "a directory is outside the file": b"II*\0\xff\0\0\0",
    "strips or tiles are missing": build([(tags(4, 4, strip_rows=1), [b"abcd"] * 3, False)]),
    "samples are too short": build([(tags(4, 4), [b"abcd" * 3], False)]),
    "compression 7 is not read": build([(tags(4, 4, compression=7), [b"abcd" * 4], False)]),
    "deflate data are too short": build([(tags(4, 4, compression=8), [zlib.compress(b"abcd")], False)]),
    "LZW data are too short": build([(tags(4, 4, compression=5), [tiff.lzw_encode(b"abcd")], False)]),
    "PackBits data are too short": build([(tags(4, 4, compression=32773), [b"\x03abcd"], False)]),
    "samples of 7 bits": build([(tags(4, 4, bits=7), [b"abcd" * 4], False)]),
    "predictor 9 is not read": build([(tags(4, 4, predictor=9), [b"abcd" * 4], False)]),
    "a page without pixels": build([(tags(0, 4), [b"abcd" * 4], False)]),
    f"over {tiff.MAX_PAGE_BYTES} bytes": build([(tags(1 << 30, 1 << 30), [b"abcd"], False)]),
    "a tile's sides are no multiples of 16, or too long": build([(tags(4, 4, tile_width=7, tile_height=16), [b"abcd"], True)]),
}


@pytest.mark.parametrize("problem", DAMAGE)
def test_damage_is_a_row_with_its_reason(problem):
    page = only(DAMAGE[problem])
    assert page.problem == problem and page.pixels is None


def test_damaged_pages_and_loops_leave_the_others_whole():
    good = (tags(4, 4), [b"abcd" * 4], False)
    bad = (tags(4, 4, compression=7), [b"abcd" * 4], False)
    found = list(tiff.pages(build([good, bad, good], loop=0)))
    assert [p.problem for p in found] == [None, "compression 7 is not read", None, "the chain of directories comes back on itself"]
    assert found[0].pixels == found[2].pixels == b"abcd" * 4


def test_any_cut_or_flipped_byte_gives_rows_and_no_error():
    whole, rng = tiff.store(b"some text and more " * 90), random.Random(8)
    for _ in range(400):
        raw = bytearray(whole[: rng.randrange(len(whole))] if rng.random() < 0.3 else whole)
        for _ in range(rng.randrange(4)):
            if raw:
                raw[rng.randrange(len(raw))] = rng.randrange(256)
        assert all((p.pixels is None) == (p.problem is not None) for p in tiff.pages(bytes(raw)))


def brute(text):
    """What does not depend on the file: filled bytes, their digest and CRC, rows and features, by plain means."""
    raw = (text or "").encode()
    full = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
    x = np.frombuffer(full, np.uint8).reshape(-1, 192, 3).astype(int)
    feature = f"pages={-(-len(x) // 2048)};rows={len(x)};values={len(set(full))};sums={','.join(str(x[:, :, i].sum()) for i in range(3))};edges={abs(x[:, 1:] - x[:, :-1]).sum()}"
    return len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]), feature


def test_round_trip_of_texts(spark):
    texts = [None, "", "a", "é" * 288, "x" * 577, "slovo a věta\n" * 400, "long " * 600_000, "slovo a věta\n" * 400]
    docs = spark.createDataFrame([(i, t, "p", 1) for i, t in enumerate(texts)] + [(None, "z", "p", 1)], "doc_id long, text string, page string, media int").repartition(3)
    got = {r.doc_id: r for r in tiff.round_trip(docs).collect()}
    assert len(got) == len(texts) + 1
    for i, t in [*enumerate(texts), (None, "z")]:
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == brute(t)
        file = tiff.store((t or "").encode())
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    assert got[0][1:] == got[1][1:] and got[5][1:] == got[7][1:] and "pages=3" in got[6].feature
    assert tiff.round_trip(docs.limit(0)).collect() == []


def test_every_style_is_written():
    assert {p.compression for n in range(9) for p in tiff.pages(tiff.store(b"%d" % n))} == {s[0] for s in tiff.STYLES}


def test_one_row_a_page_with_clashing_keys(spark, tmp_path):
    good = build([(tags(4, 4), [b"abcd" * 4], False), (tags(2, 2), [b"wxyz"], False)])
    files = spark.createDataFrame([("k", good), ("broken", b"II*"), ("none", None), ("k", good)], "page string, media binary")
    got = sorted((r.page, r.page_, r.n_pages, bytes(r.pixels or b""), r.problem or "") for r in tiff.read_pages(files, ["page"]).collect())
    assert got == sorted([("k", 0, 2, b"abcd" * 4, ""), ("k", 1, 2, b"wxyz", "")] * 2 + [("broken", 0, 0, b"", "no TIFF header")])
    assert tiff.read_pages(files.limit(0), ["page"]).collect() == []
    (tmp_path / "a.TIF").write_bytes(good)
    (tmp_path / "b.txt").write_bytes(good)
    assert [r.width for r in tiff.read_files(spark, str(tmp_path), pixels=False).orderBy("page").collect()] == [4, 2]
