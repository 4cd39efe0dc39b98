"""The archive domain's enums, signatures, routes and limits."""

from dataclasses import dataclass

MIB = 1 << 20
KIB = 1 << 10

ITEM_STATUSES = ["ARCHIVED", "CHECKED_OUT", "ARCHIVING", "CHECKING_IN", "ERROR", "MISSING"]
ARCHIVE_STATUSES = ["VERIFIED", "CHANGED", "CORRUPTED", "MISSING"]
DEFAULT_MAX_ARCHIVE_SIZE = 2_147_483_648

# header signatures: (type, [[(offset, hex bytes), ...], ...]); all parts of one alternative must match, first type wins
SIGNATURES = [
    ("JPEG", [[(0, "FFD8FF")]]),
    ("PNG", [[(0, "89504E470D0A1A0A")]]),
    ("GIF", [[(0, "474946383761")], [(0, "474946383961")]]),
    ("BMP", [[(0, "424D")]]),
    ("TIFF", [[(0, "49492A00")], [(0, "4D4D002A")]]),
    ("WEBP", [[(0, "52494646"), (8, "57454250")]]),
    ("AVIF", [[(4, "66747970"), (8, "61766966")], [(4, "66747970"), (8, "61766973")]]),
    ("HEIC", [[(4, "66747970"), (8, x)] for x in ("68656963", "68656978", "68657663", "6865696D", "68656973", "6865766D", "68657673", "6D696631")]),
    ("PDF", [[(0, "255044462D")]]),
    ("SQLITE", [[(0, "53514C69746520666F726D6174203300")]]),
    ("GZIP", [[(0, "1F8B")]]),
    ("ZIP", [[(0, "504B0304")], [(0, "504B0506")], [(0, "504B0708")]]),
    ("ELF_OR_PE", [[(0, "4D5A")], [(0, "7F454C46")]]),
]
BUILD_ARTIFACTS = "ipch pch obj pdb idb ilk sdf suo opendb tlog lastbuildstate res exp pgc pgd iobj ipdb".split()
OOXML = ["docx", "xlsx", "pptx"]
TEXT_HINTS = {
    "json": "JSON", "xml": "XML", "csv": "CSV", "sql": "SQL", "py": "PYTHON", "txt": "TEXT", "md": "MARKDOWN", "log": "LOG",
    "cpp": "CPP", "c": "C", "h": "C_HEADER", "sln": "SLN", "vcxproj": "VCXPROJ", "filters": "FILTERS", "user": "USER_CONFIG", "recipe": "TEXT",
}
TEXT_RATIO = 0.85
HEAD_BYTES = 64

# candidate routes
VIDEO = "mp4 mkv mov avi webm m4v mpg mpeg".split()
ZSTD, BROTLI, LZMA, ZLIB = "generic_zstd", "generic_brotli", "generic_lzma", "generic_zlib"
JXL, BMP_JXL, PREFLATE, VIDEO_OPT = "jpeg_xl_lossless_jpeg", "bmp_jxl_lossless", "preflate_ooxml", "video_optimizer"
CHEAP = [ZSTD]
FULL = [ZSTD, BROTLI, LZMA, ZLIB]
ROUTES = {
    "video": [VIDEO_OPT], "cheap": CHEAP, "full": FULL, "jpeg": [*FULL, JXL], "jpeg_large": [ZSTD, ZLIB, JXL],
    "bmp": [*FULL, BMP_JXL], "bmp_large": [ZSTD, ZLIB, BMP_JXL], "xlsx": [ZSTD, PREFLATE],
}
LARGE, TIER = 15 * MIB, 32 * KIB
# overlay routes by extension; only those whose final value is known
OVERLAY = {
    "txt": ["zstd_long_range_v2", "brotli_q9", ZSTD, LZMA], "jpg": [JXL, ZSTD], "sql": [LZMA],
    "exe": ["lzma_x86"], "dll": ["lzma_x86"], "bin": ["lzma_x86"], "json": [ZSTD, LZMA], "py": [ZSTD, LZMA], "js": [ZSTD, LZMA],
    "png": [], "gif": [], "tiff": [], "tif": [], "xlsx": [], "docx": [], "gz": [], "xz": [], "bz2": [], "zip": [],
}
OVERLAY_LZMA_CAP = 12_000_000
SLOW_PROBES = [BROTLI, LZMA]

# weight classes of strategies
HEAVY = [JXL, BMP_JXL, BROTLI, LZMA]
LIGHT = [ZSTD, "zstd_light", ZLIB, PREFLATE, VIDEO_OPT, "json_prefilter", "csv_prefilter", "xml_prefilter", "baseline_zip"]

# paths
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]
PROTECTED_ROOTS = ["C:\\Windows", "C:\\Program Files", "C:\\Program Files (x86)", "C:\\ProgramData"]
MAX_PATH = 260
SIZE_PRESETS = [1 << 30, 2 << 30, 5 << 30, 10 << 30]
REJECTIONS = {"FAIL_HASH_MISMATCH": "SHA256_MISMATCH", "ERROR": "EXCEPTION", "TIMEOUT": "TIMEOUT", "SKIPPED_UNAVAILABLE": "UNAVAILABLE"}


@dataclass(frozen=True)
class Policy:
    """Benefit and cost limits of a candidate."""

    min_saved_bytes: int = 1_048_576
    min_saved_percent: float = 3.0
    override_saved_bytes: int = 52_428_800
    override_saved_percent: float = 20.0
    min_throughput_mib: float = 2.0
    small_seconds: float = 1.0
    timeout_seconds: float = 90.0
    slow_probe_seconds: float = 30.0
    overlay_timeout_seconds: float = 120.0
    tiny_bytes: int = 4096


@dataclass(frozen=True)
class Gate:
    """Limits of the admission gate and of the latch."""

    min_free_cores: int = 2
    ram_watermark: float = 0.85
    process_mb: float = 3000.0
    disk_percent: float = 90.0
    latch_high: float = 0.80
    latch_low: float = 0.65
    in_flight: int = 16


POLICY, GATE = Policy(), Gate()
