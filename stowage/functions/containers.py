"""Structure of container files: MP4 boxes, PNG chunks, BMP headers."""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def boxes(raw: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, size) of top-level MP4 boxes, up to the first broken one.
    A size of 1 means that 64 bits of it follow the type."""
    view, at = memoryview(raw), 0
    while len(raw) - at >= 8:
        size, kind = struct.unpack_from(">I4s", view, at)
        least = 8
        if size == 1:
            if len(raw) - at < 16:
                return
            (size,) = struct.unpack_from(">Q", view, at + 8)
            least = 16
        yield kind, at, size
        if size < least:
            return
        at += size


def starts_fast(raw: bytes | None) -> bool:
    """The index (moov) comes before the samples (mdat)."""
    return next((k == b"moov" for k, _, _ in boxes(raw or b"") if k in (b"moov", b"mdat")), False)


def _starts_fast(content: pd.Series) -> pd.Series:
    return content.map(starts_fast)


def moov_first(content: Column) -> Column:
    return F.pandas_udf(_starts_fast, "boolean")(content)


def _little(content: Column, at: int, n: int) -> Column:
    """Unsigned little-endian number of n bytes, from byte `at`."""
    h = F.hex(F.substring(content, at + 1, n))
    turned = F.concat(*[F.substring(h, 2 * (n - 1 - i) + 1, 2) for i in range(n)])
    return F.conv(turned, 16, 10).cast("bigint")


def _signed(x: Column) -> Column:
    return F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)


def bmp_problem(content: Column) -> Column:
    """Why a BMP isn't of the supported kind: 24 bits a pixel, no palette, no
    compression, rows without padding, as many bytes as its header says; or OK."""
    n = F.octet_length(content)
    width, height = _signed(_little(content, 18, 4)), F.abs(_signed(_little(content, 22, 4)))
    plain = (_little(content, 14, 4) == 40) & (_little(content, 28, 2) == 24) & (_little(content, 30, 4) == 0) & (_little(content, 10, 4) == 54)
    row = F.floor((width * 24 + 31) / 32) * 4
    return (
        F.when(content.isNull() | (n < 54) | (F.hex(F.substring(content, 1, 2)) != "424D"), "NOT_A_BMP")
        .when(~plain, "VARIANT")
        .when(row != width * 3, "ROW_PADDING")
        .when(n - 54 != row * height, "SIZE")
        .otherwise("OK")
    )


PNG_MAGIC = bytes.fromhex("89504E470D0A1A0A")


def png_chunks(raw: bytes) -> list[tuple[bytes, int, int]] | None:
    """(type, start of the data, length) of each chunk; None if it isn't a whole
    PNG."""
    if raw[:8] != PNG_MAGIC:
        return None
    out, at = [], 8
    while at + 12 <= len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        if at + 12 + n > len(raw):
            return None
        out.append((kind, at + 8, n))
        at += 12 + n
    return out if at == len(raw) else None


def png_pack(raw: bytes) -> bytes:
    """One run of IDAT data is stored as its scanlines, compressed anew, if some
    zlib setting gives the very bytes again; else the file is stored whole.
    Everything outside the run is kept as it is."""
    stored = b"\0" + zlib.compress(raw, 9)
    chunks = png_chunks(raw) or []
    at = [i for i, c in enumerate(chunks) if c[0] == b"IDAT"]
    if not at or at != list(range(at[0], at[-1] + 1)):
        return stored
    parts = [chunks[i] for i in at]
    if any(raw[s + n : s + n + 4] != struct.pack(">I", zlib.crc32(b"IDAT" + raw[s : s + n])) for _, s, n in parts):
        return stored
    stream = b"".join(raw[s : s + n] for _, s, n in parts)
    try:
        lines = zlib.decompress(stream)
    except zlib.error:
        return stored
    for level in range(1, 10):
        for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FILTERED):
            if _deflate(lines, level, strategy) == stream:
                head, tail = raw[: parts[0][1] - 8], raw[parts[-1][1] + parts[-1][2] + 4 :]
                sizes = [n for _, _, n in parts]
                body = lzma.compress(lines, preset=9)
                fields = struct.pack(f">BBIII{len(sizes)}I", level, strategy, len(head), len(tail), len(sizes), *sizes)
                return min(b"\1" + fields + head + tail + body, stored, key=len)
    return stored


def _deflate(lines: bytes, level: int, strategy: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 15, 8, strategy)
    return z.compress(lines) + z.flush()


def png_unpack(packed: bytes) -> bytes:
    if packed[:1] == b"\0":
        return zlib.decompress(packed[1:])
    level, strategy, head, tail, count = struct.unpack_from(">BBIII", packed, 1)
    at = 1 + struct.calcsize(">BBIII")
    sizes = struct.unpack_from(f">{count}I", packed, at)
    at += 4 * count
    stream, out, place = _deflate(lzma.decompress(packed[at + head + tail :]), level, strategy), [packed[at : at + head]], 0
    for n in sizes:
        data = b"IDAT" + stream[place : place + n]
        out.append(struct.pack(">I", n) + data + struct.pack(">I", zlib.crc32(data)))
        place += n
    return b"".join([*out, packed[at + head : at + head + tail]])
