"""Column builders of the archive domain. Every one is a built-in expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(c: Column) -> Column:
    """Lower case of A-Z only, as SQLite's LIKE compares."""
    return F.translate(c, UPPER, LOWER)


def like_contains(c: Column, text: str) -> Column:
    """% and _ in text keep their meaning."""
    return ascii_fold(c).like("%" + text.translate(str.maketrans(UPPER, LOWER)) + "%")


def like_suffix(c: Column, text: str) -> Column:
    return ascii_fold(c).like("%" + text.translate(str.maketrans(UPPER, LOWER)))


def extension(name: Column) -> Column:
    """After the last dot, lower-cased; dot-files have none."""
    return F.lower(F.regexp_extract(name, r"[^./\\][^/\\]*\.([^./\\]*)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def signature(head: Column) -> Column:
    """Type by header bytes, null if none matches; first rule wins."""
    h = F.hex(F.substring(head, 1, K.HEAD_BYTES))
    out = None
    for kind, alternatives in K.SIGNATURES:
        hit = F.lit(False)
        for parts in alternatives:
            one = F.lit(True)
            for offset, digits in parts:
                one = one & (F.substring(h, 2 * offset + 1, len(digits)) == digits)
            hit = hit | one
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def printable_bytes(head: Column) -> Column:
    """Bytes 9-13 and 32-126 of a binary column."""
    h = F.hex(head)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(h) - 1, F.lit(1)), F.lit(2)), lambda i: F.substring(h, i, 2))
    ok = lambda p: ((p >= "09") & (p <= "0D")) | ((p >= "20") & (p <= "7E"))
    return F.size(F.filter(pairs, ok))


def looks_like_text(content: Column) -> Column:
    """Of the first 64 bytes: not empty, valid UTF-8 (a character cut at byte 64
    is not), over 85 % printable."""
    head = F.substring(content, 1, K.HEAD_BYTES)
    n = F.octet_length(head)
    return (n > 0) & F.is_valid_utf8(head.cast("string")) & (printable_bytes(head) / n > K.TEXT_RATIO)


def detect_format(content: Column, ext: Column) -> Column:
    """BUILD_ARTIFACT by extension, then signature, then text by extension."""
    sig = signature(content)
    hints = F.create_map(*[F.lit(x) for kv in K.TEXT_HINTS.items() for x in kv])
    text = F.coalesce(F.element_at(hints, ext), F.lit("TEXT_UNKNOWN"))
    return (
        F.when(ext.isin(K.BUILD_ARTIFACTS), "BUILD_ARTIFACT")
        .when(content.isNull(), "UNREADABLE")
        .when((sig == "ZIP") & ext.isin(K.OOXML), "OOXML_ZIP")
        .when(sig.isNotNull(), sig)
        .when(looks_like_text(content), text)
        .otherwise("BINARY_UNKNOWN")
    )


def extension_mismatch(kind: Column, ext: Column) -> Column:
    """A signature type whose name is neither the extension nor its alias."""
    alias = F.when(ext == "jpg", "jpeg").when(ext == "tif", "tiff").otherwise(ext)
    named = kind.isin([k for k, _ in K.SIGNATURES if k not in ("ZIP", "ELF_OR_PE")])
    return named & (F.lower(kind) != ext) & (F.lower(kind) != alias)


def sanitize_name(name: Column) -> Column:
    clean = F.trim(F.translate(F.coalesce(name, F.lit("")), '<>:"/\\|?*', "_" * 9))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("category"))


def path_validity(path: Column, exists: Column) -> Column:
    """First rule that a source path breaks, or OK."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & ~p.rlike("^[A-Za-z]:$"))
    stem = lambda p: F.upper(F.element_at(F.split(p, r"\."), 1))
    return (
        F.when(path.isNull() | (F.trim(path) == ""), "EMPTY")
        .when(~path.rlike(r"^([A-Za-z]:[\\/]|[\\/])"), "RELATIVE")
        .when(F.length(path) > K.MAX_PATH, "TOO_LONG")
        .when(~exists, "MISSING")
        .when(F.exists(parts, lambda p: stem(p).isin(K.RESERVED_NAMES)), "RESERVED_NAME")
        .when(F.exists(parts, lambda p: p.rlike(r"[ .]$")), "TRAILING_SPACE_OR_DOT")
        .when(F.exists(parts, lambda p: p.rlike('[<>:"|?*\\x00-\\x1F]')), "BAD_CHARACTER")
        .otherwise("OK")
    )


def is_protected(path: Column) -> Column:
    """Equal to or below a protected root, whatever the case."""
    p = F.rtrim(F.lower(F.translate(path, "/", "\\")), F.lit("\\"))
    hit = F.lit(False)
    for root in K.PROTECTED_ROOTS:
        r = root.lower()
        hit = hit | (p == r) | p.startswith(r + "\\")
    return hit


def route(kind: Column, ext: Column, size: Column) -> Column:
    """The name of the candidate list for a file."""
    jpeg = (kind == "JPEG") | ((kind == "BINARY_UNKNOWN") & ext.isin("jpg", "jpeg"))
    big, tier = size >= K.LARGE, size >= K.TIER
    return (
        F.when(ext.isin(K.VIDEO), "video")
        .when(jpeg, F.when(big, "jpeg_large").otherwise("jpeg"))
        .when(kind.isin("WEBP", "AVIF", "HEIC"), "cheap")
        .when(kind == "BMP", F.when(big, "bmp_large").when(tier, "bmp").otherwise("cheap"))
        .when(kind.isin("PNG", "TIFF", "GIF"), F.when(tier, "full").otherwise("cheap"))
        .when((kind == "OOXML_ZIP") & (ext == "xlsx"), "xlsx")
        .otherwise("cheap")
    )


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def candidates(route_name: Column) -> Column:
    out = None
    for name, names in K.ROUTES.items():
        out = F.when(route_name == name, strings(names)) if out is None else out.when(route_name == name, strings(names))
    return out


def overlay_candidates(ext: Column, size: Column, base: Column) -> Column:
    """The overlay's list where it has the extension, else base; lzma forms are
    dropped at the cap."""
    out = None
    for e, names in K.OVERLAY.items():
        out = F.when(ext == e, strings(names)) if out is None else out.when(ext == e, strings(names))
    chosen = out.otherwise(base)
    return F.when((size >= K.OVERLAY_LZMA_CAP) & ext.isin(list(K.OVERLAY)), F.array_except(chosen, strings([K.LZMA, "lzma_x86"]))).otherwise(chosen)


def policy_reason(original: Column, baseline: Column, candidate: Column, seconds: Column, sha_ok: Column, p: K.Policy = K.POLICY) -> Column:
    """The benefit and cost cascade; the first rule that holds decides."""
    saved = baseline - candidate
    percent = F.when(baseline == 0, 0.0).otherwise(100.0 * saved / baseline)
    mib = F.greatest(original, F.lit(1)) / float(K.MIB)
    fast = (seconds <= 0) | (mib >= p.min_throughput_mib * seconds)
    return (
        F.when(~sha_ok, "SHA256_MISMATCH")
        .when(candidate >= baseline, "NOT_SMALLER_THAN_BASELINE")
        .when(seconds > p.timeout_seconds, "EXCEEDS_ABSOLUTE_TIMEOUT")
        .when((saved < p.min_saved_bytes) & (percent < p.min_saved_percent), "BENEFIT_TOO_SMALL")
        .when(~((saved >= p.override_saved_bytes) | (percent >= p.override_saved_percent) | fast | (seconds <= p.small_seconds)), "COST_NOT_JUSTIFIED_BY_BENEFIT")
        .otherwise("ACCEPTED")
    )


def probe_timeout(strategy: Column, ceiling: float = K.POLICY.timeout_seconds) -> Column:
    return F.when(strategy.isin(K.SLOW_PROBES), F.lit(K.POLICY.slow_probe_seconds)).otherwise(F.lit(ceiling))


def restore_timeout(strategy: Column, size: Column) -> Column:
    slope = 90.0 / (147_000_054 / float(K.MIB))
    return F.when(strategy.isin(K.JXL, K.BMP_JXL) & (F.coalesce(size, F.lit(0)) > 0), F.greatest(F.lit(30.0), size / float(K.MIB) * slope)).otherwise(F.lit(30.0))


def zstd_level(size: Column) -> Column:
    return F.when(size < 4 * K.MIB, 19).otherwise(12)


def zstd_threads(size: Column) -> Column:
    return F.when(size >= 20 * K.MIB, 2).otherwise(1)


def weight_class(strategy: Column, size: Column) -> Column:
    return F.when(strategy.isin(K.HEAVY), "HEAVY").when(strategy.isin(K.LIGHT), "LIGHT").when(size < 4 * K.MIB, "LIGHT").otherwise("MEDIUM")


def ram_estimate(strategy: Column, size: Column) -> Column:
    """Bytes that a strategy is expected to need."""
    whole = lambda c: F.floor(c).cast("bigint")
    return (
        F.when(strategy == K.JXL, F.greatest(F.lit(150_000_000).cast("bigint"), whole(size * (1_137_000_000 / 39_274_002)) + 60_000_000))
        .when(strategy == K.BMP_JXL, F.greatest(F.lit(150_000_000).cast("bigint"), whole(size * (598_600_000 / 147_000_054) * 1.3)))
        .when(strategy.isin(K.BROTLI, K.LZMA), F.greatest(F.lit(100_000_000).cast("bigint"), 3 * size))
        .when(strategy == K.PREFLATE, F.greatest(F.lit(40_000_000).cast("bigint"), 4 * size))
        .when(strategy.endswith("_prefilter"), F.greatest(F.lit(20_000_000).cast("bigint"), 3 * size))
        .when(strategy == K.VIDEO_OPT, F.lit(80_000_000).cast("bigint"))
        .when(strategy == "baseline_zip", F.lit(20_000_000).cast("bigint"))
        .otherwise(F.least(size, F.lit(32_000_000).cast("bigint")) + 20_000_000)
    )


def admission(weight: Column, free_cores: Column, ram_share: Column, process_mb: Column, disk: Column, g: K.Gate = K.GATE) -> Column:
    """Reason of the gate; ram_share is the share in use with the candidate."""
    return (
        F.when(weight == "LIGHT", "LIGHT_ALWAYS_ADMITTED")
        .when(free_cores < g.min_free_cores, "INSUFFICIENT_FREE_CORES")
        .when(ram_share >= g.ram_watermark, "PROJECTED_RAM_OVER_WATERMARK")
        .when(process_mb > g.process_mb, "PROCESS_MEMORY_OVER_THRESHOLD")
        .when(disk > g.disk_percent, "DISK_PRESSURE_OVER_THRESHOLD")
        .otherwise("ADMITTED_FREE_CORES_AVAILABLE")
    )


def format_bytes(n: Column) -> Column:
    """1024-based, two decimals, B to TB."""
    out, x = None, n.cast("double")
    for i, unit in enumerate(["B", "KB", "MB", "GB"]):
        shown = F.concat(F.round(x / float(1024**i), 2).cast("decimal(20,2)").cast("string"), F.lit(" " + unit))
        cond = x < float(1024 ** (i + 1))
        out = F.when(cond, shown) if out is None else out.when(cond, shown)
    return out.otherwise(F.concat(F.round(x / float(1024**4), 2).cast("decimal(20,2)").cast("string"), F.lit(" TB")))


def percent_saved(reference: Column, value: Column, digits: int = 2) -> Column:
    """Null where the reference is null or 0."""
    return F.round(100.0 * (reference - value) / F.nullif(reference, F.lit(0)), digits)


def parse_tag(comment: Column) -> Column:
    """struct(strategy, sha256, size) of a member's comment tag
    `smart:<strategy>:<sha256>:<size>`; malformed tags are baseline storage."""
    part = F.split(comment, ":", 4)
    good = comment.startswith("smart:") & (F.size(part) == 4) & F.coalesce(F.get(part, 3), F.lit("")).rlike(r"^-?[0-9]{1,18}$")
    return F.struct(F.when(good, F.get(part, 1)).alias("strategy"), F.when(good, F.get(part, 2)).alias("sha256"), F.when(good, F.get(part, 3).try_cast("bigint")).alias("size"))


def walk_key(path: Column) -> Column:
    """Sort key of an ordered walk in which the files of a folder come before
    its subfolders."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == n - 1, F.concat(F.lit("0"), p)).otherwise(F.concat(F.lit("1"), p))), "\x01")
