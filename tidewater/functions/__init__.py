"""Scalar functions over columns: paths, device addresses, sizes, alignment, decisions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(s: Column) -> Column:
    """Components between slashes or backslashes, empty ones dropped; always relative."""
    return F.concat_ws("/", F.filter(F.split(s, r"[/\\]"), lambda x: x != ""))


def sanitize_segment(s: Column) -> Column:
    """Separators, reserved and control characters (C0, DEL, C1) become ``_``; Unicode spaces and dots at both ends go."""
    return F.regexp_replace(F.regexp_replace(s, r'[/\\<>:"|?*\x00-\x1F\x7F-\x9F]', "_"), r"^[\p{Z}.]+|[\p{Z}.]+$", "")


def escapes_root(s: Column) -> Column:
    """Whether folding ``.`` and ``..`` lexically leaves the root at any point, or the path is absolute."""
    depth = F.aggregate(
        F.filter(F.split(s, "/"), lambda x: (x != "") & (x != ".")),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda a, x: F.struct((a["at"] + F.when(x == "..", -1).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(x == "..", -1).otherwise(1)).alias("low")),
    )
    return s.startswith("/") | (depth["low"] < 0)


def pci_format(domain: Column, bus: Column, device: Column, function: Column) -> Column:
    two = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    return F.concat(two(domain, 4), F.lit(":"), two(bus, 2), F.lit(":"), two(device, 2), F.lit("."), F.lower(F.hex(function)))


def pci_parse(s: Column) -> Column:
    """struct(domain, bus, device, function), null if malformed; the domain may be left out."""
    part = lambda k: F.regexp_extract(s, r"^(?:([0-9a-fA-F]{1,4}):)?([0-9a-fA-F]{1,2}):([0-9a-fA-F]{1,2})\.([0-9a-fA-F]{1,2})$", k)
    number = lambda k: F.coalesce(F.conv(F.nullif(part(k), F.lit("")), 16, 10).cast("int"), F.lit(0))
    return F.when(part(2) != "", F.struct(number(1).alias("domain"), number(2).alias("bus"), number(3).alias("device"), number(4).alias("function")))


def align_up(n: Column, align: int) -> Column:
    return n if align == 0 else F.when(n % align == 0, n).otherwise(n + align - n % align)


def auto_method(drive: Column, ring: Column, system: str = "linux") -> Column:
    """The write method for a drive: on Linux direct for NVMe with a submission ring and data for other flash; elsewhere by what the system flushes directly; else sync."""
    direct = {"linux": (drive == "nvme") & ring, "macos": drive == "nvme", "windows": drive.isin("nvme", "ssd")}.get(system, F.lit(False))
    data = drive.isin("nvme", "ssd") if system == "linux" else F.lit(False)
    return F.when(direct, "direct").when(data, "data").otherwise("sync")


def has_flags(bits: Column, flags: int) -> Column:
    return bits.bitwiseAND(flags) == flags


def durability_primitive(method: Column, system: Column, nvme_flush: Column, ring: Column) -> Column:
    """What makes a write durable, by method and system; ``nvme_flush``: the drive takes flush commands, ``ring``: a submission ring is open."""
    linux, macos, windows = (system == x for x in ("linux", "macos", "windows"))
    on_linux = F.when(nvme_flush, "io_uring + NVMe FLUSH").when(ring, "io_uring + fdatasync").otherwise("O_DIRECT + pwrite + fdatasync")
    on_windows = F.when(nvme_flush, "FILE_FLAG_WRITE_THROUGH + NVMe IOCTL").otherwise("FILE_FLAG_WRITE_THROUGH")
    direct = F.when(linux, on_linux).when(macos, "F_NOCACHE + F_FULLFSYNC").when(windows, on_windows).otherwise("fsync")
    data = F.when(linux, "fdatasync").when(macos, "F_FULLFSYNC").otherwise("fsync")
    whole = F.when(macos, "F_FULLFSYNC").otherwise("fsync")
    return F.when(method == "mmap", "mmap + msync").when(method == "sync", whole).when(method == "data", data).when(method == "direct", direct).otherwise("fsync")


def is_reserved(method: Column) -> Column:
    return method == "journal"


def method_error(method: Column, feature: Column) -> Column:
    """The error of choosing a method, null if it can be chosen; ``feature``: the user-space driver is compiled in (it has no backend yet)."""
    return F.when(is_reserved(method), "UnsupportedMethod").when((method == "spdk") & ~feature, "FeatureNotEnabled").when(method == "spdk", "SpdkUnavailable")


# Fixed values: (vendor, model) substrings of drives that keep their cache through a power loss.
PROTECTED_DRIVES = [
    ("INTEL", "SSDSC2KB"), ("INTEL", "SSDSC2KG"), ("SOLIDIGM", "SBFPF2BU"), ("SAMSUNG", "PM983"), ("SAMSUNG", "PM9A3"), ("SAMSUNG", "PM1735"), ("SAMSUNG", "PM1733"), ("SAMSUNG", "PM1725"),
    ("MICRON", "7300"), ("MICRON", "7400"), ("MICRON", "7450"), ("MICRON", "9300"), ("MICRON", "9400"), ("WDC", "ULTRASTAR DC SN"), ("HGST", "ULTRASTAR SN"), ("WESTERN DIGITAL", "ULTRASTAR DC SN"),
    ("KIOXIA", "CD"), ("KIOXIA", "CM"), ("TOSHIBA", "PX"), ("SEAGATE", "NYTRO"),
]


def power_loss_protection(vendor: Column, model: Column) -> Column:
    """"yes" for drives known to be protected, else "unknown"; never "no"."""
    known = F.lit(False)
    for v, m in PROTECTED_DRIVES:
        known = known | (F.upper(vendor).contains(v) & F.upper(model).contains(m))
    return F.when(known, "yes").otherwise("unknown")


# What a user-space driver needs.
HUGE_PAGES_MB, CORES = 256, 4


def skip_reasons(system: Column, huge_pages_mb: Column, privileged: Column, devices: Column, usable: Column, iommu: Column, cores: Column) -> Column:
    """Why the user-space driver can't be used, in the order of the checks; an empty array if it can."""
    checks = F.array(
        F.when(huge_pages_mb < HUGE_PAGES_MB, "HugepagesNotConfigured"),
        F.when(~privileged, "InsufficientPrivileges"),
        F.when(devices == 0, "NoNvmeDevices"),
        F.when((devices > 0) & (usable == 0), "AllDevicesInUse"),
        F.when(~iommu, "IommuNotConfigured"),
        F.when(cores < CORES, "InsufficientCores"),
    )
    return F.when(system != "linux", F.array(F.lit("NotLinux"))).otherwise(F.array_compact(checks))


def first_reason(reasons: Column) -> Column:
    return F.get(reasons, 0)


MOST_AGE_S = 30 * 86400


def is_stale(found: dict[str, Column], current: dict[str, Column], probed_at: Column, now: Column) -> Column:
    """Whether a cached probe must be taken again: schema, version, kernel or system differ, or it is 30 days old (seconds; a probe in the future is new)."""
    differs = F.lit(False)
    for k in ("schema", "version", "kernel", "system"):
        differs = differs | ~found[k].eqNullSafe(current[k])
    return differs | (F.greatest(now - probed_at, F.lit(0)) >= MOST_AGE_S)


def fits_mapping(size: Column, page: int, is_file: Column | None = None) -> Column:
    """Whether a payload, or a regular file, holds a page at least."""
    return size >= page if is_file is None else is_file & (size >= page)


def current_mode(first: Column, second: Column) -> Column:
    """The mode that the first of two settings names, else the second, else prod."""
    return F.coalesce(mode_of(first), mode_of(second), F.lit("prod"))


# Features of submission rings and their names.
RING_FEATURES = {
    "FastPoll": "fast_poll", "RegisterBuffers": "register_buffers", "RegisterFiles": "register_files", "UringCmd": "uring_cmd", "SubmitAll": "submit_all",
    "CoopTaskrun": "coop_taskrun", "SingleIssuer": "single_issuer", "DeferTaskrun": "defer_taskrun", "SqPoll": "sqpoll",
}


def ring_feature_name(feature: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in RING_FEATURES.items() for x in pair))[feature]


def ring_feature(name: Column) -> Column:
    """The feature of a name; null if there is none."""
    return F.create_map(*(F.lit(x) for k, v in RING_FEATURES.items() for x in (v, k)))[name]


def commit_window_us(us: Column) -> Column:
    """A group-commit window in microseconds: null for none, 100 ms at most."""
    return F.when(us > 0, F.least(us, F.lit(100_000)))


def clamp(n: Column, low: int, high: int) -> Column:
    """Commit batches are clamped to 1 ... 4096, shards to 1 ... 64."""
    return F.greatest(F.lit(low), F.least(n, F.lit(high)))


MOST_NAME = 255


def temp_name(name: Column, owner: Column, nonce: Column, prefix: str = ".tmp") -> Column:
    """A hidden name beside ``name`` for its replacement, <prefix>-<owner>-<nonce>.<name>; a name that would make it too long for a file system is hashed."""
    head = F.concat(F.lit(prefix + "-"), F.lower(F.hex(owner)), F.lit("-"), F.lpad(F.lower(F.hex(nonce)), 16, "0"), F.lit("."))
    return F.concat(head, F.when(F.octet_length(head) + F.octet_length(name) <= MOST_NAME, name).otherwise(F.lpad(F.lower(F.hex(F.xxhash64(name))), 16, "0")))


def is_temp_name(name: Column, prefix: str = ".tmp") -> Column:
    return name.rlike(f"^{re.escape(prefix)}-[0-9a-f]+-[0-9a-f]{{16}}\\.")


def cache_size(s: Column) -> Column:
    """"32K", "1M" or a number of bytes; null if neither."""
    digits = F.regexp_extract(s, r"^\s*(\d+)\s*([KMkm]?)\s*$", 1)
    unit = F.upper(F.regexp_extract(s, r"^\s*(\d+)\s*([KMkm]?)\s*$", 2))
    return F.when(digits != "", digits.cast("long") * F.when(unit == "K", 1024).when(unit == "M", 1024 * 1024).otherwise(1))


def confine(path: Column) -> Column:
    """A relative path with ``.`` and ``..`` folded; null if it leaves the root at any point or is absolute."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    return F.when(~escapes_root(path), F.array_join(folded, "/"))


def drive_kind(device: Column, rotational: Column) -> Column:
    """A block device's kind, from its name and its rotational flag."""
    return F.when(device.startswith("nvme"), "nvme").when(rotational == 0, "ssd").when(rotational == 1, "hdd").otherwise("unknown")


def mode_of(raw: Column) -> Column:
    """dev or prod from the words for them, in any case and with spaces around; else null."""
    word = F.lower(F.trim(raw))
    return F.when(word.isin("dev", "development", "debug"), "dev").when(word.isin("prod", "production", "release"), "prod")


def kib(s: Column) -> Column:
    """"N kB" as bytes; 0 if it can't be read."""
    return F.coalesce(F.nullif(F.regexp_extract(s, r"^\s*(\d+)\s*(?:kB)?\s*$", 1), F.lit("")).cast("long"), F.lit(0)) * 1024


def field_of(line: Column, name: str) -> Column:
    """The number after ``name`` on a line of "Name:  N unit"; null on other lines."""
    return F.nullif(F.regexp_extract(line, rf"^{name}:?\s*(\d+)", 1), F.lit("")).cast("long")


def atomic_write_unit(blocks: Column, sector: Column) -> Column:
    """Bytes that a drive writes all or nothing, from its zero-based block count; null if unknown or over 32 bits."""
    n = (blocks.cast("long") + 1) * sector
    return F.when(n < 2**32, n)


def escape_quoted(s: Column) -> Column:
    """The inside of a quoted string: backslashes, quotes and line ends escaped, other control characters dropped."""
    for raw, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(raw), F.lit(mark))
    return F.regexp_replace(s, r"[\x00-\x1F]", "")


# The codes of errors.
ERROR_CODES = {
    f"FS-{k:05d}": name
    for k, name in enumerate(
        """Io InvalidPath HardwareProbeFailed UnsupportedPlatform UnsupportedMethod AlignmentRequired AtomicReplaceFailed PartialDirectoryOp ShutdownInProgress QueueFull IoUringSetupFailed
        MmapFailed BufferPoolExhausted PlpDetectionUnavailable NvmePassthroughUnsupported NvmePassthroughDenied AsyncRuntimeRequired GlobPatternInvalid HandlePoisoned IoUringSubmitFailed
        CompletionDriverDead FeatureNotEnabled SpdkUnavailable""".split(),
        1,
    )
}


def error_name(code: Column) -> Column:
    """The name of an error's code; null if there is none."""
    return F.create_map(*(F.lit(x) for pair in ERROR_CODES.items() for x in pair))[code]
