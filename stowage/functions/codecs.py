"""Lossless codecs by name, measured and verified in Arrow batches. A codec is a
pair of functions on bytes; the registry is open. Codecs whose library or tool
isn't there are registered as unavailable, with the reason."""

from __future__ import annotations

import importlib.util
import io
import json
import lzma
import struct
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import containers

MIB = 1 << 20


@dataclass(frozen=True)
class Codec:
    name: str
    encode: Callable[[bytes], bytes] | None
    decode: Callable[[bytes], bytes] | None
    unavailable: str | None = None


REGISTRY: dict[str, Codec] = {}


def register(codec: Codec) -> None:
    REGISTRY[codec.name] = codec


def unregister(name: str) -> None:
    REGISTRY.pop(name, None)


def _zip(raw: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("member"), raw, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _unzip(raw: bytes) -> bytes:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return z.read("member")


def _lzma_filter(raw: bytes, preset: int) -> dict:
    """The preset with a dictionary no larger than the data: the same matches
    without setting up tens of megabytes for a small file."""
    return {"id": lzma.FILTER_LZMA2, "preset": preset, "dict_size": min(1 << 26 if preset == 9 else 1 << 23, max(4096, 1 << (len(raw) - 1).bit_length() if raw else 4096))}


def _lzma(raw: bytes) -> bytes:
    return lzma.compress(raw, filters=[_lzma_filter(raw, 6 if len(raw) >= 15 * MIB else 9)])


_MAGIC = b"SX86"


def _lzma_x86(raw: bytes) -> bytes:
    return _MAGIC + lzma.compress(raw, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_X86}, _lzma_filter(raw, 9)])


def _unlzma_x86(raw: bytes) -> bytes:
    if raw[:4] != _MAGIC:
        raise ValueError("not an lzma_x86 member")
    return lzma.decompress(raw[4:], lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_X86}, {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 26}])


def _sorted_lines(raw: bytes) -> bytes:
    """Header kept, data lines sorted (stable) with the permutation behind them."""
    lines = raw.split(b"\n")
    head, data = lines[:1], lines[1:]
    order = sorted(range(len(data)), key=data.__getitem__)
    body = b"\n".join([*head, *(data[i] for i in order)])
    return struct.pack("<II", len(body), len(order)) + body + struct.pack(f"<{len(order)}I", *order)


def _unsorted_lines(raw: bytes) -> bytes:
    size, n = struct.unpack_from("<II", raw)
    lines = raw[8 : 8 + size].split(b"\n")
    out = [b""] * n
    for place, line in zip(struct.unpack_from(f"<{n}I", raw, 8 + size), lines[1:]):
        out[place] = line
    return b"\n".join([lines[0], *out])


def canonical_json(text: str | None) -> str | None:
    """Sorted keys, no white space; null if it isn't JSON."""
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (TypeError, ValueError):
        return None


register(Codec("baseline_zip", _zip, _unzip))
register(Codec("generic_zlib", lambda b: zlib.compress(b, 9), zlib.decompress))
register(Codec("generic_lzma", _lzma, lzma.decompress))
register(Codec("lzma_x86", _lzma_x86, _unlzma_x86))
register(Codec("png_idat_recompress", containers.png_pack, containers.png_unpack))
if importlib.util.find_spec("zstandard"):
    import zstandard

    def _zstd(raw: bytes) -> bytes:
        return zstandard.ZstdCompressor(level=19 if len(raw) < 4 * MIB else 12, threads=2 if len(raw) >= 20 * MIB else 0).compress(raw)

    def _zstd_long(raw: bytes) -> bytes:
        p = zstandard.ZstdCompressionParameters.from_level(12, window_log=27, enable_ldm=True)
        return zstandard.ZstdCompressor(compression_params=p).compress(raw)

    def _unzstd(raw: bytes) -> bytes:
        return zstandard.ZstdDecompressor(max_window_size=1 << 27).decompress(raw)

    register(Codec("generic_zstd", _zstd, _unzstd))
    register(Codec("zstd_long_range_v2", _zstd_long, _unzstd))
    register(Codec("csv_prefilter", lambda b: _zstd(_sorted_lines(b)), lambda b: _unsorted_lines(_unzstd(b))))
for _name, _why in [("generic_brotli", "brotli is not installed"), ("jpeg_xl_lossless_jpeg", "cjxl is not installed"), ("bmp_jxl_lossless", "cjxl is not installed"), ("preflate_ooxml", "preflate is not installed"), ("video_optimizer", "ffmpeg is not installed"), ("xml_prefilter", "xdelta3 is not installed"), ("json_prefilter", "xdelta3 is not installed")]:
    register(Codec(_name, None, None, _why))

_RESULT = "stored_bytes long, compression_time_s double, restore_time_s double, restored_sha256 string, exact_match boolean, status string"


def _measure(codecs: dict[str, Codec]):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, name in zip(batch.column("content"), batch.column("strategy").to_pylist()):
                codec, raw = codecs.get(name), raw.as_py()
                if codec is None or codec.encode is None:
                    rows.append((None, None, None, None, False, "SKIPPED_UNAVAILABLE"))
                    continue
                try:
                    t0 = time.perf_counter()
                    packed = codec.encode(raw)
                    t1 = time.perf_counter()
                    back = codec.decode(packed)
                    t2 = time.perf_counter()
                    ok = back == raw
                    rows.append((len(packed), t1 - t0, t2 - t1, hashlib.sha256(back).hexdigest(), ok, "PASS" if ok else "FAIL_HASH_MISMATCH"))
                except Exception:
                    rows.append((None, None, None, None, False, "ERROR"))
            c = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.bool_(), pa.string()]
            keep = [n for n in batch.schema.names if n != "content"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *(pa.array(x, t) for x, t in zip(c, kinds))], names=[*keep, "stored_bytes", "compression_time_s", "restore_time_s", "restored_sha256", "exact_match", "status"])

    return run


def measure(files: DataFrame) -> DataFrame:
    """files: content (binary), strategy, and other columns, which are kept.
    Compresses, restores and compares; an error or a missing tool is a status,
    never an exception. There is no killing of a single row: times are measured
    and classified afterwards."""
    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != "content"]
    return files.mapInArrow(_measure(dict(REGISTRY)), ", ".join([*rest, _RESULT]))


def measure_unique(files: DataFrame, strategies: list[str], key: str = "sha256") -> DataFrame:
    """files: key, content, and other columns. Measures each content once with
    each strategy and joins the results back: a row per file and strategy. A
    content is shuffled once, however many strategies there are."""
    once = files.select(key, "content").dropDuplicates([key])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _measure(registry)
        for batch in batches:
            for i in range(batch.num_rows):  # a content at a time, so a batch of large ones isn't multiplied
                one = batch.slice(i, 1).take(pa.array([0] * len(strategies), pa.int64()))
                yield from run(iter([one.append_column("strategy", pa.array(strategies, pa.string()))]))

    registry = dict(REGISTRY)
    kind = f"`{key}` {once.schema[key].dataType.simpleString()}, strategy string, {_RESULT}"
    return files.drop("content").join(once.mapInArrow(each, kind), key)


class RestoreError(ValueError):
    """A member's restored bytes aren't those that were stored."""


def _coded(codecs: dict[str, Codec], restore: bool):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sums = [], []
            names = batch.column("strategy").to_pylist()
            wanted = batch.column("sha256").to_pylist() if restore else names
            for raw, name, want in zip(batch.column("stored" if restore else "content"), names, wanted):
                raw = raw.as_py()
                codec = codecs.get(name) if name not in (None, "baseline_zip") or not restore else None
                if name is not None and name != "baseline_zip" and (codec is None or codec.encode is None):
                    raise RestoreError(f"strategy {name} isn't available")
                if raw is None or name is None or (restore and codec is None):
                    back = raw  # stored as it is
                else:
                    back = codec.decode(raw) if restore else codec.encode(raw)
                digest = None if raw is None else hashlib.sha256(back if restore else raw).hexdigest()
                if restore and codec is not None and digest != want:
                    raise RestoreError(f"restored with {name}: sha256 {digest}, wanted {want}")
                out.append(back)
                sums.append(digest)
            keep = [n for n in batch.schema.names if n not in ("content", "stored", "sha256")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(out, pa.binary()), pa.array(sums, pa.string())], names=[*keep, "content" if restore else "stored", "sha256"])

    return run


def _kinds(files: DataFrame, without: tuple[str, ...], more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name not in without), more])


def store(files: DataFrame) -> DataFrame:
    """files: content, strategy and other columns. Members as they are stored:
    the content becomes stored (encoded; as it is without a strategy), with the
    content's sha256. Null contents stay null; a strategy that isn't available is
    an error."""
    return files.mapInArrow(_coded(dict(REGISTRY), False), _kinds(files, ("content", "sha256"), "stored binary, sha256 string"))


def restore(members: DataFrame) -> DataFrame:
    """members: stored, strategy, sha256 and other columns. The contents, of
    which every encoded one must have the sha256 that was stored: a difference
    fails the job, no wrong bytes are returned. Without a strategy, and for the
    baseline, whose container is opened by its reader, bytes go through as they
    are."""
    return members.mapInArrow(_coded(dict(REGISTRY), True), _kinds(members, ("stored", "sha256"), "content binary, sha256 string"))


def canonical_xml(text: str | None) -> str | None:
    """Canonical XML (C14N 2.0): attributes in order, no comments, empty elements
    as pairs of tags, white space between tags gone; null if it isn't well formed."""
    import xml.etree.ElementTree as E

    try:
        return E.canonicalize(text, strip_text=True)
    except (E.ParseError, TypeError, ValueError):
        return None


def compressible(files: DataFrame, sample: int = MIB, least_percent: float = 5.0) -> DataFrame:
    """Adds sample_percent and worth: what a fast zstd (or zlib) saves on the first
    `sample` bytes, and whether it is enough. (A sample is the feature.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if importlib.util.find_spec("zstandard"):
            fast = __import__("zstandard").ZstdCompressor(level=1).compress
        else:
            fast = lambda b: zlib.compress(b, 1)
        for batch in batches:
            p = []
            for x in batch.column("head"):
                b = x.as_py()
                p.append(100.0 * (len(b) - len(fast(b))) / len(b) if b else 0.0)
            keep = [n for n in batch.schema.names if n != "head"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(p, pa.float64())], names=[*keep, "sample_percent"])

    rest = [f for f in files.schema.fields if f.name != "content"]
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "sample_percent double"])
    head = files.select(*[f"`{f.name}`" for f in rest], F.coalesce(F.substring("content", 1, sample), F.lit("").cast("binary")).alias("head"))
    return head.mapInArrow(run, kind).withColumn("worth", F.col("sample_percent") >= least_percent)
