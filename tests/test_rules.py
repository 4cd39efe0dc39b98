"""Decision rules on literal rows."""

import pytest
from pyspark.sql import functions as F

from stowage.functions import codecs, containers, kernels
from stowage.functions import columns as C
from stowage.functions import constants as K
from stowage.operators import catalog, integrity, inventory, rollup, selection

POLICY = [
    (1_000_000, 900_000, 500_000, 0.15, False, "SHA256_MISMATCH"),
    (1_000_000, 900_000, 950_000, 0.02, True, "NOT_SMALLER_THAN_BASELINE"),
    (1_000_000, 900_000, 900_000, 0.02, True, "NOT_SMALLER_THAN_BASELINE"),
    (8000, 8000, 7960, 0.002, True, "BENEFIT_TOO_SMALL"),
    (2147483648, 2147483648, 2126512128, 7.5, True, "ACCEPTED"),
    (20_000_000, 20_000_000, 7_800_000, 16.0, True, "ACCEPTED"),
    (50_000_000, 50_000_000, 47_500_000, 60.0, True, "COST_NOT_JUSTIFIED_BY_BENEFIT"),
    (50_000_000, 50_000_000, 10_000_000, 90.0, True, "ACCEPTED"),
    (50_000_000, 50_000_000, 10_000_000, 90.001, True, "EXCEEDS_ABSOLUTE_TIMEOUT"),
]


def test_policy(spark):
    t = spark.createDataFrame(POLICY, "o long, b long, c long, s double, ok boolean, want string")
    bad = t.filter(C.policy_reason(*[F.col(x) for x in "obcs"], F.col("ok")) != F.col("want"))
    assert bad.collect() == []


@pytest.mark.parametrize(
    ("kind", "ext", "size", "n"),
    [("JPEG", "jpg", 500_000, 5), ("JPEG", "jpg", 15 * K.MIB, 3), ("BINARY_UNKNOWN", "jpeg", 100, 5), ("WEBP", "webp", 10_000_000, 1), ("PNG", "png", 1000, 1), ("PNG", "png", 10_000_000, 4), ("BMP", "bmp", 32_768, 5), ("BMP", "bmp", 15 * K.MIB, 3), ("OOXML_ZIP", "xlsx", 100, 2), ("OOXML_ZIP", "docx", 100, 1), ("BINARY_UNKNOWN", "dat", 5_000_000, 1), ("TEXT", "mp4", 5, 1)],
)
def test_routes(spark, kind, ext, size, n):
    t = spark.createDataFrame([(kind, ext, size)], "kind string, ext string, size long")
    assert selection.routed(t).count() == n


def test_overlay_drops_lzma_at_the_cap(spark):
    t = spark.createDataFrame([(1, "TEXT", "txt", 11_999_999), (2, "TEXT", "txt", 12_000_000), (3, "PNG", "png", 100), (4, "ELF_OR_PE", "exe", 12_000_000)], "id int, kind string, ext string, size long")
    got = {}
    for r in selection.routed(t, overlay=True).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.strategy)
    assert got == {1: ["zstd_long_range_v2", "brotli_q9", K.ZSTD, K.LZMA], 2: ["zstd_long_range_v2", "brotli_q9", K.ZSTD]}


def test_levels_and_timeouts(spark):
    t = spark.createDataFrame([(1 << 20,), ((4 << 20) - 1,), (5 << 20,), (40_000_000,)], "n long")
    assert [r[0] for r in t.select(C.zstd_level(F.col("n"))).collect()] == [19, 19, 12, 12]
    s = spark.createDataFrame([(K.LZMA, 0), (K.ZSTD, 1), (K.JXL, 147_000_054), (K.JXL, 0)], "s string, n long")
    assert [round(r[0], 6) for r in s.select(C.restore_timeout(F.col("s"), F.col("n"))).collect()] == [30, 30, 90, 30]
    assert [r[0] for r in s.select(C.probe_timeout(F.col("s"))).collect()] == [30, 90, 90, 90]


@pytest.mark.parametrize(
    ("weight", "cores", "ram", "mb", "disk", "want"),
    [("LIGHT", 0, 2.0, 9999.0, 99.0, "LIGHT_ALWAYS_ADMITTED"), ("HEAVY", 1, 0.1, 1.0, 1.0, "INSUFFICIENT_FREE_CORES"), ("HEAVY", 2, 0.75, 1.0, 1.0, "ADMITTED_FREE_CORES_AVAILABLE"), ("HEAVY", 2, 0.85, 1.0, 1.0, "PROJECTED_RAM_OVER_WATERMARK"), ("HEAVY", 2, 0.875, 1.0, 1.0, "PROJECTED_RAM_OVER_WATERMARK"), ("HEAVY", 2, 0.5, 3000.5, 1.0, "PROCESS_MEMORY_OVER_THRESHOLD"), ("HEAVY", 2, 0.5, 3000.0, 90.5, "DISK_PRESSURE_OVER_THRESHOLD")],
)
def test_gate(spark, weight, cores, ram, mb, disk, want):
    assert spark.range(1).select(C.admission(F.lit(weight), F.lit(cores), F.lit(ram), F.lit(mb), F.lit(disk))).first()[0] == want


def test_signatures_and_text(spark):
    rows = [(b"\x89PNG\r\n\x1a\n" + b"\0" * 32, "dat", "PNG", True), (b"\xff\xd8\xff\xe0", "jpg", "JPEG", False), (b"plain text here", "txt", "TEXT", False), (b"plain", "zzz", "TEXT_UNKNOWN", False), (b"a" * 63 + "é".encode(), "txt", "BINARY_UNKNOWN", False), (b"text", "ipch", "BUILD_ARTIFACT", False), (b"PK\x03\x04", "docx", "OOXML_ZIP", False), (b"\0\0\0\x20ftypavif", "avif", "AVIF", False), (None, "txt", "UNREADABLE", False), (b"\xc3\xa9" * 20, "txt", "BINARY_UNKNOWN", False)]
    t = spark.createDataFrame(rows, "c binary, e string, want string, mismatch boolean")
    kind = C.detect_format(F.col("c"), F.col("e"))
    assert t.filter((kind != F.col("want")) | (C.extension_mismatch(kind, F.col("e")) != F.col("mismatch"))).collect() == []


def test_inventory(spark):
    t = spark.createDataFrame([("a/x.txt", b"hello there"), ("b.TXT", b""), (".bashrc", None)], "relpath string, content binary")
    got = {r.relpath: r for r in inventory.analyze(t).collect()}
    assert (got["a/x.txt"].detected_type, got["a/x.txt"].valid, got["a/x.txt"].is_binary) == ("TEXT", True, False)
    assert (got["b.TXT"].invalid_reason, got["b.TXT"].extension) == ("EMPTY", "txt")
    assert (got[".bashrc"].invalid_reason, got[".bashrc"].extension) == ("UNREADABLE", "")


def test_folder_hash_walks_files_first(spark):
    import hashlib

    t = spark.createDataFrame([("f", p, p * 2) for p in ("b/z", "zz", "a/b/c", "a/c", "aa")], "folder string, relpath string, sha256 string")
    want = hashlib.sha256("".join(p * 3 for p in ("aa", "zz", "a/c", "a/b/c", "b/z")).encode()).hexdigest()
    assert integrity.folder_hash(t).first().folder_hash == want


def test_first_fit(spark):
    items = spark.createDataFrame([(1, i, s) for i, s in enumerate([250, 100, 60, 900, 40])], "category_id long, seq long, size long")
    old = spark.createDataFrame([(1, "a_001.zip", 200)], "category_id long, name string, size long")
    assert [r.bin for r in catalog.first_fit(items, old, 300).orderBy("seq").collect()] == [1, 0, 2, 3, 1]
    assert [r.bin for r in catalog.first_fit(items, old, None).orderBy("seq").collect()] == [1, 2, 3, 4, 5]


def test_next_sequence(spark):
    t = spark.createDataFrame([(1, "c_001.zip"), (1, "c_012.zip"), (2, "odd.zip"), (3, "c_999.zip"), (3, "c_1000.zip")], "category_id long, file_name string")
    assert {r.category_id: r.next_number for r in catalog.next_sequence(t).collect()} == {1: 13, 2: 1, 3: 1000}


def test_enum_counts_of_an_empty_table(spark):
    t = spark.createDataFrame([], "integrity_status string")
    assert {(r[0], r[1]) for r in catalog.enum_counts(t, "integrity_status", K.ARCHIVE_STATUSES).collect()} == {(s, 0) for s in K.ARCHIVE_STATUSES}


def test_search_folds_ascii_only(spark):
    t = spark.createDataFrame([("ÉTÉ.txt",), ("Report_1.TXT",)], "file_name string")
    assert catalog.search(t, "été").count() == 0
    assert catalog.search(t, "REPORT%", suffix=".txt").count() == 1


def test_tags(spark):
    t = spark.createDataFrame([("smart:z:ab:12",), ("smart:z:ab",), ("smart:z:ab:x",), (None,), ("other:a:b:1",)], "c string")
    assert [tuple(r[0]) for r in t.select(C.parse_tag(F.col("c"))).collect()] == [("z", "ab", 12), (None,) * 3, (None,) * 3, (None,) * 3, (None,) * 3]


def test_rollup_clamps(spark):
    t = spark.createDataFrame([("T", None, 10, 30, 5)], "file_type string, strategy string, original long, stored long, ms long")
    r = rollup.metrics_rollup(t).first()
    assert (r.saved_bytes, r.strategy, r.min_saving_percent) == (0, "baseline_zip", -200.0)


def test_formats(spark):
    t = spark.createDataFrame([(0,), (1023,), (1024,), (1536 * 1024,), (5 << 40,)], "n long")
    assert [r[0] for r in t.select(C.format_bytes(F.col("n"))).collect()] == ["0.00 B", "1023.00 B", "1.00 KB", "1.50 MB", "5.00 TB"]


def test_blocks(spark):
    rows = [([0] * 384, 0), ([1] + [0] * 383, 1), ([7] * 384, 2), ([-31] * 384, 3), ([100] * 384, 4)]
    t = spark.createDataFrame(rows, "a array<int>, want int")
    assert t.filter(kernels.block_category(F.col("a")) != F.col("want")).collect() == []


@pytest.mark.parametrize("name", [n for n, c in codecs.REGISTRY.items() if c.encode])
@pytest.mark.parametrize("raw", [b"", b"x", b"header\nb,2\na,1\nb,0\n\nlast", bytes(range(256)) * 300, b"\n\n\n"])
def test_codecs_restore(name, raw):
    c = codecs.REGISTRY[name]
    assert c.decode(c.encode(raw)) == raw


def test_measure_reports_errors(spark):
    t = spark.createDataFrame([(1, b"abc", "generic_zlib"), (2, b"abc", "generic_brotli"), (3, b"abc", "nobody"), (4, None, "generic_zlib")], "id int, content binary, strategy string")
    assert [r.status for r in codecs.measure(t).orderBy("id").collect()] == ["PASS", "SKIPPED_UNAVAILABLE", "SKIPPED_UNAVAILABLE", "ERROR"]


def _png(level, cuts, broken=False):
    import struct
    import zlib

    lines = b"".join(b"\0" + bytes((x * y) % 251 for x in range(60)) for y in range(40))
    stream = zlib.compress(lines, level)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b) ^ (broken and k == b"IDAT"))
    size = -(-len(stream) // cuts)
    idat = [chunk(b"IDAT", stream[i : i + size]) for i in range(0, len(stream), size)]
    return containers.PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", 60, 40, 8, 0, 0, 0, 0)) + b"".join(idat) + chunk(b"tEXt", b"a\0b") + chunk(b"IEND", b"")


@pytest.mark.parametrize("level", [1, 6, 9])
@pytest.mark.parametrize("cuts", [1, 3])
def test_png_is_rebuilt(level, cuts):
    raw = _png(level, cuts)
    packed = containers.png_pack(raw)
    assert packed[0] == 1 and len(packed) < len(raw) and containers.png_unpack(packed) == raw


@pytest.mark.parametrize("raw", [_png(6, 2, broken=True), _png(6, 1)[:-3], _png(6, 1) + b"tail", b"", containers.PNG_MAGIC])
def test_odd_pngs_are_stored(raw):
    packed = containers.png_pack(raw)
    assert packed[0] == 0 and containers.png_unpack(packed) == raw


def test_boxes():
    import struct

    wide = struct.pack(">I4sQ", 1, b"wide", 24) + b"x" * 8
    assert [k for k, _, _ in containers.boxes(wide + struct.pack(">I4s", 8, b"moov"))] == [b"wide", b"moov"]
    assert containers.starts_fast(wide + struct.pack(">I4s", 8, b"moov"))
    assert not containers.starts_fast(struct.pack(">I4s", 1, b"wide")) and not containers.starts_fast(None)


def test_restore_fails_on_a_wrong_hash(spark):
    from pyspark.errors import PythonException

    rows = [(1, None, b"as it is"), (2, "generic_zlib", b"x" * 500), (3, "lzma_x86", b""), (4, "baseline_zip", b"zip"), (5, "generic_zstd", None)]
    stored = codecs.store(spark.createDataFrame(rows, "id long, strategy string, content binary"))
    back = {r.id: r.content for r in codecs.restore(stored).collect()}
    assert back[1] == b"as it is" and back[2] == b"x" * 500 and back[3] == b"" and back[5] is None and back[4][:2] == b"PK"
    with pytest.raises(PythonException, match="RestoreError"):
        codecs.restore(stored.withColumn("sha256", F.lit("0" * 64))).collect()
    with pytest.raises(PythonException, match="isn't available"):
        codecs.store(spark.createDataFrame([("generic_brotli", b"x")], "strategy string, content binary")).collect()


def test_rooms_find_the_first_bin_with_room():
    import random

    r, rooms, plain = random.Random(1), catalog.Rooms(), []
    for _ in range(600):
        size = r.randint(0, 12)
        want = next((i for i, x in enumerate(plain) if x >= size), None)
        assert rooms.first(size) == want
        if want is None:
            assert rooms.add(20 - size) == len(plain)
            plain.append(20 - size)
        else:
            rooms.put(want, rooms.room(want) - size)
            plain[want] -= size


def test_canonical_xml():
    assert codecs.canonical_xml("<a z='1' b=\"2\">\n <c/><!-- no --> </a>") == '<a b="2" z="1"><c></c></a>'
    assert codecs.canonical_xml("<a>") is None and codecs.canonical_xml(None) is None


def test_folder_hash_of_many_folders_and_gaps(spark):
    import hashlib

    rows = [(f"f{i % 7}", f"d{i % 3}/{i}", None if i == 20 else f"{i:064x}") for i in range(70)] + [(None, "x", "0")]
    got = {r.folder: (r.files, r.folder_hash) for r in integrity.folder_hash(spark.createDataFrame(rows, "folder string, relpath string, sha256 string")).collect()}
    for f in {r[0] for r in rows}:
        own = sorted(((f"1{p.split('/')[0]}\x010{p.split('/')[1]}" if "/" in p else f"0{p}", p, s) for g, p, s in rows if g == f), key=lambda x: x[0])
        want = None if any(s is None for *_, s in own) else hashlib.sha256("".join(p + s for _, p, s in own).encode()).hexdigest()
        assert got[f] == (len(own), want)
