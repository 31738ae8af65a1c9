"""Scalar functions on columns: paths, sizes, validation, classification, delays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# File patterns that are ignored, path parts that are sensitive, limits of messages.
INDEXER_IGNORED = (".git", ".DS_Store", "Thumbs.db", "*.tmp")
WATCHER_IGNORED = (".git", ".DS_Store", "Thumbs.db", "*.tmp", "*.swp", "*~", ".#*", "#*#")
SENSITIVE_PARTS = ("/etc", "/sys", "/proc", "/dev", "/.ssh", "/.gnupg", "/.aws", "/.kube", "/private/etc", "/system", "/library/keychains", "c:\\windows\\system32", "c:\\program files")
MESSAGE_LIMITS = {"message": (0, 10 << 20), "chunk": (256, 16 << 20), "files": (0, 1_000_000), "chunks_per_file": (0, 100_000), "pairing_code": (0, 512), "object": (0, 100 << 20), "daemon_chunk": (1, 16 << 20)}
#: base milliseconds, factor, most milliseconds
RETRY_PRESETS = {"default": (500.0, 2.0, 30000.0), "aggressive": (100.0, 1.5, 10000.0), "conservative": (1000.0, 3.0, 60000.0)}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def first_component(path: Column) -> Column:
    """Text before the first slash; of an absolute path, the empty string."""
    return F.element_at(F.split(path, "/"), 1)


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda p: p != ""))


def matches_pattern(name: Column, pattern: str) -> Column:
    """Equal, or ``*suffix``, or ``prefix*``. With a star at both ends the first one counts, the last is literal."""
    if pattern.startswith("*"):
        return name.endswith(F.lit(pattern[1:]))
    if pattern.endswith("*"):
        return name.startswith(F.lit(pattern[:-1]))
    return name == pattern


def ignored(path: Column, patterns: Sequence[str] = INDEXER_IGNORED) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches_pattern(basename(path), p)
    return out


def ignored_by_daemon(path: Column) -> Column:
    """Hidden files, backups, temporary and swap files, and names between number signs."""
    name = basename(path)
    return name.startswith(".") | name.endswith("~") | name.endswith(".tmp") | name.endswith(".swp") | (name.startswith("#") & name.endswith("#"))


def sensitive(path: Column) -> Column:
    """A sensitive part anywhere in the lower-case path, or a hidden name."""
    out = basename(path).startswith(".")
    for p in SENSITIVE_PARTS:
        out = out | F.lower(path).contains(p)
    return out


def first_failure(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule whose condition holds, else ``ok``."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, name in rules[1:]:
        out = out.when(condition, name)
    return out.otherwise("ok")


def absolute(path: Column) -> Column:
    return path.startswith("/") | path.startswith("\\")


def message_path_problem(path: Column) -> Column:
    return first_failure((F.octet_length(path) > 4096, "too_long"), (path.contains("\x00"), "nul"), (path.contains(".."), "parent"), (absolute(path), "absolute"))


def store_path_problem(path: Column, most: int = 10) -> Column:
    hidden = F.exists(F.split(path, "/"), lambda p: p.startswith("."))
    return first_failure((absolute(path), "absolute"), (path.contains("\x00"), "nul"), (path.contains(".."), "parent"), (depth(path) > most, "too_deep"), (hidden, "hidden"))


def lexical_path_problem(path: Column, most_deep: int = 32, most_long: int = 255) -> Column:
    """What can be said of a path inside a root without looking at a file system."""
    long = F.exists(F.split(path, "/"), lambda p: F.octet_length(p) > most_long)
    return first_failure((path == "", "empty"), (path.contains("\x00"), "nul"), (F.array_contains(F.split(path, "/"), ".."), "parent"), (depth(path) > most_deep, "too_deep"), (long, "name_too_long"))


def hash_problem(text: Column) -> Column:
    return first_failure((text == "", "empty"), (F.octet_length(text) != 64, "length"), (~text.rlike("^[0-9a-fA-F]*$"), "not_hex"))


def folder_id_problem(text: Column) -> Column:
    return first_failure((text == "", "empty"), (F.octet_length(text) > 64, "too_long"), (~text.rlike(r"^[\p{L}\p{N}_-]+$"), "characters"))


def device_name_problem(name: Column) -> Column:
    return first_failure((name == "", "empty"), (F.octet_length(name) > 256, "too_long"), (name.rlike(r"\p{Cc}"), "control"))


def daemon_device_name_problem(name: Column) -> Column:
    return first_failure((name == "", "empty"), (F.octet_length(name) > 64, "too_long"), (name.rlike(r"[/\\\x00]"), "separator"), (name.rlike(r"\p{Cc}"), "control"))


def within_limit(value: Column, kind: str) -> Column:
    low, high = MESSAGE_LIMITS[kind]
    return value.between(low, high)


def compatible_version(version: Column, ours: str = "0.1.0") -> Column:
    """Three numbers with the same first one."""
    return version.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$") & (F.element_at(F.split(version, r"\."), 1).try_cast("long") == int(ours.split(".")[0]))


def compatible_major(version: Column, ours: str = "1.0.0") -> Column:
    """The same text before the first dot."""
    return F.element_at(F.split(version, r"\."), 1) == ours.split(".")[0]


def sanitised(text: Column, most: int = 1000) -> Column:
    """Without control characters other than white space, and cut to the first ``most`` characters."""
    return F.left(F.regexp_replace(text, r"[\x00-\x08\x0E-\x1F\x7F-\x84\x86-\x9F]", ""), F.lit(most))


def human_bytes(n: Column, rate: bool = False) -> Column:
    """Steps of 1024 and one decimal, up to GB for sizes and MB/s for rates; plain bytes have no decimal, byte rates one.

    Ties go to the even digit.
    """
    value, unit = n.cast("double"), "/s" if rate else ""
    out = F.when(value < 1024, F.format_string("%.1f B/s", F.bround(value, 1)) if rate else F.format_string("%d B", n.cast("long")))
    names = ["KB", "MB"] if rate else ["KB", "MB", "GB"]
    for power, name in enumerate(names, 1):
        text = F.format_string(f"%.1f {name}{unit}", F.bround(value / float(1024**power), 1))
        out = out.otherwise(text) if name == names[-1] else out.when(value < float(1024 ** (power + 1)), text)
    return out


def size_class(size: Column) -> Column:
    return F.when(size <= 1 << 20, "Small").when(size <= 100 << 20, "Medium").when(size <= 1 << 30, "Large").otherwise("Huge")


def network_condition(rtt_ms: Column, throughput: Column, loss: Column) -> Column:
    return F.when((rtt_ms < 50) & (throughput > 100) & (loss < 0.001), "Excellent").when((rtt_ms > 200) | (loss > 0.05), "Poor").when((rtt_ms < 100) & (throughput < 10), "Congested").otherwise("Good")


def stream_config(condition: Column, priority: Column, cpu: Column, memory_mb: Column, streams: int = 64, buffer_kb: int = 8192) -> Column:
    """Streams, buffer and compression for a network condition, a priority and the load of the machine."""
    half = lambda c: F.call_function("div", c, F.lit(2))
    n = F.when(condition == "Excellent", 128).when(condition == "Poor", 16).when(condition == "Congested", 4).otherwise(streams)
    buffer = F.when(condition == "Excellent", 16384).when(condition == "Poor", 2048).when(condition == "Congested", 512).otherwise(buffer_kb)
    n = F.when(priority == "Critical", n * 2).when(priority == "Low", half(n)).otherwise(n.cast("long"))
    return F.struct(F.when(cpu > 80, half(n)).otherwise(n).alias("streams"), F.when(memory_mb > 1024, half(buffer)).otherwise(buffer.cast("long")).alias("buffer_kb"), (cpu <= 80).alias("compress"))


def connection_health(idle_s: Column, rtt_ms: Column, loss: Column, errors: Column) -> Column:
    return F.when(idle_s > 30, "Unhealthy").when(rtt_ms > 500, "Degraded").when(loss > 0.05, "Failing").when(errors > 10, "Degraded").otherwise("Healthy")


def retry_delay(attempt: Column, base: float = 500.0, factor: float = 2.0, most: float = 30000.0, jitter: Column | None = None) -> Column:
    """Milliseconds before an attempt; none before the first. jitter is a share of the delay, given by the caller."""
    delay = F.least(base * F.pow(F.lit(factor), attempt - 1), F.lit(most))
    return F.when(attempt == 0, 0.0).otherwise(delay if jitter is None else delay * (1 + jitter))


def reconnect_delay(failures: Column, first: float = 100.0, most: float = 30000.0) -> Column:
    return F.least(first * F.pow(F.lit(2.0), failures), F.lit(most))


def daemon_delay(failures: Column, base_s: float = 1.0, most_s: float = 60.0) -> Column:
    return F.when(failures < 1, 0.0).otherwise(F.least(base_s * F.pow(F.lit(2.0), failures - 1), F.lit(most_s)))


def fingerprint(device_id: Column) -> Column:
    """The first 16 bytes of the hash, in eight groups of four hex digits."""
    return F.regexp_replace(F.substring(F.sha2(device_id.cast("binary"), 256), 1, 32), r"(.{4})(?=.)", "$1:")


def percent(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole == 0, empty).otherwise(part / whole * 100.0)


def decoded_hash(text: Column) -> Column:
    """The bytes of a hex hash; 32 zero bytes if it cannot be decoded."""
    even = F.when(F.length(text) % 2 == 0, F.try_to_binary(text, F.lit("hex")))
    return F.coalesce(even, F.unhex(F.repeat(F.lit("00"), 32)))


def age_hours(since: Column, as_of: Column) -> Column:
    """Whole hours."""
    return F.call_function("div", F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(since.cast("timestamp")), F.lit(3_600_000_000))
