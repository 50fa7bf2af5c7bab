"""Column functions on paths, names and numbers of files."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Media kinds by extension, attribute bits, and limits of the read policy.
KINDS = {
    "photo_raw": ["cr2", "cr3", "nef", "arw", "raf", "orf", "rw2", "dng"],
    "photo_jpeg": ["jpg", "jpeg", "jfif"],
    "image_gif": ["gif"],
    "photo_working": ["tif", "tiff", "psd", "psb", "png"],
    "video_mp4": ["mp4", "mov", "lrf"],
    "video_crm": ["crm"],
    "audio": ["wav", "mp3", "aac"],
    "archive": ["zip", "7z", "rar", "tar", "gz", "bz2", "xz"],
    "document": ["pdf", "doc", "docx", "xlsx", "pptx"],
}
ATTR_REPARSE = 0x400
ATTR_PLACEHOLDER = 0x1000 | 0x40000 | 0x400000
TIMEOUT_SECONDS, TIMEOUT_BYTES = 90, 9 * 1024**3
FORMAT_MEDIA_KINDS = ["photo_raw", "photo_jpeg", "image_gif", "photo_working", "video_mp4", "video_crm", "audio"]
STREAM_KINDS = ["image_gif", "video_mp4", "video_crm", "audio"]
# What a tool says of a damaged file, and of a format that it doesn't know.
DAMAGED = ["bad atom", "corrupt", "error reading", "file is empty", "format error", "invalid atom", "not a valid", "truncated", "unknown file type"]
DAMAGED_HEADER = ["processing ", " after unknown ", "header"]  # in this order, with other words between
UNRECOGNISED = ["unknown file type", "unrecognized file type", "unsupported file type"]


@F.pandas_udf(StringType())
def _fold(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s).casefold().replace("\\", "/"))


def path_key(path: Column, ascii_only: bool = False) -> Column:
    """Comparison key: NFC, case folded, with forward slashes.

    Spark has neither NFC nor case folding, so an Arrow function does it;
    ``ascii_only`` promises ASCII paths, which stay on the JVM.
    """
    return F.translate(F.lower(path), "\\", "/") if ascii_only else _fold(path)


def logical_path(label: Column, rel_path: Column) -> Column:
    """The label alone for the root itself, else label and path joined by a backslash."""
    return F.when(rel_path == "", label).otherwise(F.concat(label, F.lit("\\"), rel_path))


def extension_of(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without one."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.when(name.isNotNull(), F.lit("")))


def media_kind(extension: Column) -> Column:
    pairs = [F.lit(x) for kind, words in KINDS.items() for word in words for x in (word, kind)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(extension)), F.lit("other"))


def id_hex(number: Column) -> Column:
    """Lower-case hex; null for 0."""
    return F.lower(F.hex(F.nullif(number, F.lit(0).cast("long"))))


def ns_to_utc(ns: Column) -> Column:
    """Nanoseconds since 1970 as UTC text with seven digits, cut off; the session's time zone must be UTC."""
    rest = F.pmod(ns, F.lit(1_000_000_000))
    second = F.call_function("div", ns - rest, F.lit(1_000_000_000))
    digits = F.lpad(F.call_function("div", rest, F.lit(100)).cast("string"), 7, "0")
    return F.concat(F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), digits, F.lit("Z"))


def is_placeholder(attributes: Column) -> Column:
    return attributes.bitwiseAND(F.lit(ATTR_PLACEHOLDER)) != 0


def is_reparse(attributes: Column) -> Column:
    return attributes.bitwiseAND(F.lit(ATTR_REPARSE)) != 0


def parent_path(rel_path: Column) -> Column:
    """Null for the root (an empty path), empty for what lies directly in it."""
    return F.when(rel_path != "", F.regexp_extract(rel_path, r"^(.*)/[^/]*$", 1))


def ancestors(path: Column) -> Column:
    """The path itself and all folders above it, the root (an empty path) included."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), above))


# Fixed value: what counts as a number in a text.
NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)"


def first_float(value: Column) -> Column:
    """The first number of a text, or the ratio that starts there; null for a ratio over 0."""
    lead = F.regexp_extract(value, rf"^(?s:.*?)({NUMBER})", 1)
    ratio = lambda k: F.regexp_extract(value, rf"^(?:(?!{NUMBER})(?s:.))*({NUMBER})\s*/\s*({NUMBER})", k)
    over = F.try_divide(F.nullif(ratio(1), F.lit("")).try_cast("double"), ratio(2).try_cast("double"))
    return F.when(ratio(1) != "", over).otherwise(F.nullif(lead, F.lit("")).try_cast("double"))


def first_int(value: Column) -> Column:
    return first_float(value).cast("long")


def first_positive_int_pair(value: Column) -> Column:
    """The first two numbers as an array, if both are above 0 when cut to integers."""
    found = F.transform(F.slice(F.regexp_extract_all(value, F.lit(f"({NUMBER})"), 1), 1, 2), lambda x: x.try_cast("double").cast("long"))
    return F.when((F.size(found) == 2) & F.forall(found, lambda x: x > 0), found)


def gps_decimal(value: Column) -> Column:
    """Degrees from text such as 27 deg 16' 43.09" N; minutes, seconds and direction may be missing, south and west are negative. A bare number is no such text."""
    plain = lambda c: c.rlike("^[0-9]+([.][0-9]+)?$")
    behind = lambda c, mark: F.ltrim(F.substr(c, F.instr(c, mark) + len(mark)))
    whole, rest = F.trim(F.substring_index(value, "deg", 1)), behind(value, "deg")
    total = whole.try_cast("double")
    for mark, share in (("'", 60), ('"', 3600)):
        before = F.substring_index(rest, mark, 1)
        there = rest.contains(mark) & plain(before)
        total = total + F.when(there, before.try_cast("double") / share).otherwise(0.0)
        rest = F.when(there, behind(rest, mark)).otherwise(rest)
    return F.when(value.contains("deg") & plain(whole), F.when(F.substring(rest, 1, 1).isin("S", "W"), -total).otherwise(total))


def iso6709(value: Column) -> Column:
    """latitude, longitude and altitude of a location in ISO 6709 notation (degrees with their signs, a slash at the end); null if out of range."""
    text = F.trim(value)
    parts = F.split(F.substring_index(text, "/", 1), "(?=[+-])")
    good = lambda k, digits: F.get(parts, F.lit(k)).rlike(f"^[+-][0-9]{{1,{digits}}}([.][0-9]+)?$")
    number = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    shape = (F.instr(text, "/") == F.char_length(text)) & good(0, 2) & good(1, 3) & ((F.size(parts) == 2) | ((F.size(parts) == 3) & good(2, 9)))
    return F.when(shape & (F.abs(number(0)) <= 90) & (F.abs(number(1)) <= 180), F.struct(number(0).alias("latitude"), number(1).alias("longitude"), number(2).alias("altitude")))


def offset_minutes(value: Column) -> Column:
    pattern = r"^\s*([+-])(\d{2}):(\d{2})\s*$"
    part = lambda k: F.regexp_extract(value, pattern, k)
    minutes = part(2).try_cast("int") * 60 + part(3).try_cast("int")
    return F.when(value.rlike(pattern), F.when(part(1) == "-", -minutes).otherwise(minutes))


def offset_from_value(value: Column) -> Column:
    """The UTC offset that a text ends with."""
    return offset_minutes(F.nullif(F.regexp_extract(value, r"([+-]\d{2}:\d{2})\s*$", 1), F.lit("")))


CAPTURE = r"(\d{4}:\d{2}:\d{2})[ T](\d{2}:\d{2}:\d{2})(\.\d+)?"


def wall_clock(value: Column) -> Column:
    found = F.regexp_extract(value, CAPTURE, 1)
    return F.when(found != "", F.concat_ws(" ", found, F.regexp_extract(value, CAPTURE, 2)))


def matching_offset(raw: Column, candidates: Column) -> Column:
    """The offset of the first candidate that shows the same wall clock and has one."""
    same = F.filter(candidates, lambda c: (wall_clock(c) == wall_clock(raw)) & offset_from_value(c).isNotNull())
    return offset_from_value(F.try_element_at(same, F.lit(1)))


def capture_utc(raw: Column, offset: Column) -> Column:
    """Wall clock minus offset (minutes) as UTC text; digits of the second stay as written; null without an offset."""
    begins = raw.rlike("^" + CAPTURE)
    local = F.try_to_timestamp(wall_clock(raw), F.lit("yyyy:MM:dd HH:mm:ss"))
    utc = F.date_format(F.timestamp_seconds(F.unix_seconds(local) - offset * 60), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(begins & offset.isNotNull() & local.isNotNull(), F.concat(utc, F.regexp_extract(raw, CAPTURE, 3), F.lit("Z")))


def normalize_explicit_utc(raw: Column) -> Column:
    """ISO time with Z or an offset as UTC text."""
    pattern = r"^\s*(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\s*$"
    part = lambda k: F.regexp_extract(raw, pattern, k)
    as_is = F.concat(part(1), F.lit("T"), part(2), part(3), F.lit("Z"))
    moved = capture_utc(F.concat(F.translate(part(1), "-", ":"), F.lit(" "), part(2), part(3)), offset_minutes(part(4)))
    return F.when(raw.rlike(pattern), F.when(F.upper(part(4)) == "Z", as_is).otherwise(moved))


def is_all_zero_id(value: Column) -> Column:
    return F.trim(value.cast("string")).rlike("^0+$")


def issue_visible(code: Column, message: Column) -> Column:
    """False for the one kind of report that only says that a format isn't known."""
    said = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(message, F.lit(""))), r"\s+", " ")), "[.。]+$", "")
    return (F.lower(F.trim(F.coalesce(code, F.lit("")))) != "exiftool_reported_error") | ~said.isin(UNRECOGNISED)


def corrupt_warning(text: Column) -> Column:
    """A warning that isn't minor and speaks of damage."""
    said = F.lower(text)
    first, second, third = DAMAGED_HEADER
    header = (F.instr(said, first) > 0) & F.substring_index(said, first, -1).contains(second) & F.substring_index(said, second, -1).contains(third)
    for phrase in DAMAGED:
        header = header | said.contains(phrase)
    return ~text.startswith("[minor]") & header


def diagnostic_class(severity: Column, code: Column, message: Column) -> Column:
    severity, text = F.lower(F.coalesce(severity, F.lit(""))), F.coalesce(message, F.lit(""))
    warning = F.when(F.lower(F.ltrim(text)).startswith("[minor]"), "minor").when(corrupt_warning(text), "candidate").otherwise("warning")
    return F.when(~issue_visible(code, message), "unsupported").when(severity == "validation", "validation").when(severity == "warning", warning).when(severity == "error", "need_action").otherwise("information")


def normalize_family(code: Column) -> Column:
    return F.regexp_replace(code, r"(?i)(copy)\d+", "$1#")


def parse_tool_text(text: Column) -> Column:
    """"Tag : value" lines as an array of structs; other lines are left out."""
    pattern = r"^\s*([^:]+?)\s*:\s*(.*?)\s*$"
    lines = F.filter(F.split(text, "\r?\n"), lambda x: x.rlike(pattern))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("tag"), F.regexp_extract(x, pattern, 2).alias("value")))


def pick_validator(extension: Column, kind: Column) -> Column:
    return (
        F.when(extension.isin("zip", "docx", "xlsx", "pptx"), "zip").when(extension == "pdf", "pdf").when(extension == "doc", "ole").when(extension == "gif", "gif")
        .when((extension == "jfif") | kind.isin(FORMAT_MEDIA_KINDS), "media").when(kind == "archive", "7z").otherwise("none")
    )


def format_spec(validator: Column, kind: Column, enabled: Column) -> Column:
    """Struct of the validator and the tool that runs it, as far as ``enabled`` (array of builtin, sevenzip, exiftool, ffprobe) allows; none otherwise."""
    has = lambda tool: F.array_contains(enabled, tool)
    tags, streams = has("exiftool"), has("ffprobe") & F.when(validator == "gif", "image_gif").otherwise(kind).isin(STREAM_KINDS)
    spec = lambda name, tool: F.struct(name.alias("validator"), F.lit(tool).alias("tool"))
    return (
        F.when(validator.isin("zip", "pdf") & has("builtin"), spec(validator, "builtin")).when(validator.isin("7z", "ole") & has("sevenzip"), spec(validator, "7-Zip"))
        .when(validator.isin("media", "gif") & tags & streams, spec(validator, "exiftool+ffprobe")).when(validator.isin("media", "gif") & tags, spec(F.lit("exiftool"), "exiftool"))
        .when(validator.isin("media", "gif") & streams, spec(F.lit("ffprobe"), "ffprobe")).otherwise(spec(F.lit("none"), "none"))
    )


def is_raw_candidate(name: Column) -> Column:
    """Whether an extension, or a path's, is of a RAW format."""
    text = F.lower(F.trim(name))
    return F.when(text.rlike(r"[/\\]"), F.regexp_extract(text, r"\.([^./\\]*)$", 1)).otherwise(F.regexp_replace(text, r"^\.+", "")).isin(KINDS["photo_raw"])


def timeout_for_size(size: Column) -> Column:
    """Seconds without progress after which a read is given up: 90 for each 9 GiB begun."""
    return F.greatest(F.lit(TIMEOUT_SECONDS), F.ceil(size / TIMEOUT_BYTES) * TIMEOUT_SECONDS).cast("double")


#: What a finished attempt makes of the current status, by stage; any other status is an error.
CURRENT = {
    "hash": {"succeeded": "done", "unstable": "unstable", "unsupported": "skipped", "skipped_policy": "skipped", "cancelled": "pending", "abandoned": "pending"},
    "metadata": {"succeeded": "done", "unstable": "unstable", "timeout": "timeout", "unsupported": "not_applicable", "skipped_policy": "skipped", "cancelled": "pending", "abandoned": "pending"},
    "format": {"succeeded": "valid", "invalid": "invalid", "timeout": "timeout", "unstable": "unstable", "unsupported": "unsupported", "skipped_policy": "skipped_policy", "cancelled": "pending", "abandoned": "pending"},
}


def attempt_to_current(stage: Column, status: Column) -> Column:
    pairs = [F.lit(x) for s, found in CURRENT.items() for k, v in found.items() for x in (f"{s} {k}", v)]
    mapped = F.try_element_at(F.create_map(*pairs), F.concat_ws(" ", stage, status))
    return F.when(stage.isin(*CURRENT), F.coalesce(mapped, F.lit("error")))


def reuse_decision(now: Column, before: Column) -> Column:
    """Struct of reuse and basis (or the reason against it) for two structs with size, mtime, placeholder, volume_serial and file_index_hex."""
    ids = F.lit(True)
    for x in (now, before):
        for name in ("volume_serial", "file_index_hex"):
            ids = ids & (F.coalesce(x[name], F.lit("")) != "")
    differ = (now["volume_serial"] != before["volume_serial"]) | (now["file_index_hex"] != before["file_index_hex"])
    basis = (
        F.when(before.isNull(), "no_previous_entry").when(~now["size"].eqNullSafe(before["size"]) | ~now["mtime"].eqNullSafe(before["mtime"]), "stat_changed")
        .when(now["placeholder"] | before["placeholder"], "placeholder").when(ids & differ, "file_id_mismatch").when(ids, "size+mtime+fileid").otherwise("size+mtime")
    )
    return F.struct(basis.startswith("size+").alias("reuse"), basis.alias("basis"))


def fingerprint_of_name(name: Column) -> Column:
    """The eight hex digits that a snapshot file's name ends with, unless they are a run's id."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    run_id = base.rlike(r"_\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}\.\d{6}_[0-9a-f]{8}\.sqlite$")
    return F.when(~run_id, F.nullif(F.regexp_extract(base, r"_([0-9A-F]{8})\.sqlite$", 1), F.lit("")))


def format_bytes(n: Column) -> Column:
    """Decimal units with two digits; whole bytes below 1000."""
    out = F.when(F.abs(n) < 1000, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = out.when(F.abs(n) < 1000.0 ** (power + 1), F.concat(F.format_string("%.2f", n / 1000.0**power), F.lit(f" {unit}")))
    return F.when(n.isNull(), "—").otherwise(out.otherwise(F.concat(F.format_string("%.2f", n / 1000.0**5), F.lit(" PB"))))


def disk_number(text: Column) -> Column:
    """Disk number from PhysicalDriveN, /dev/pdN or /dev/sdX (letters count in base 26)."""
    of = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    letters = F.lower(of(r"(?i)/dev/sd([a-z]+)(?:\s|$)"))
    spelled = F.aggregate(F.split(letters, ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 96)) - 1
    return F.coalesce(of(r"(?i)PhysicalDrive(\d+)").try_cast("int"), of(r"(?i)/dev/pd(\d+)").try_cast("int"), F.when(letters.isNotNull(), spelled))


#: What the eight bits of the exit status say.
EXIT_FLAGS = ["command line or internal error", "device can't be opened or identified", "SMART command failed", "SMART overall health failed", "prefail attribute at or below threshold", "attribute was at or below threshold before", "error log has entries", "self-test log has errors"]


def smart_exit_flags(status: Column) -> Column:
    every = F.array(*[F.struct(F.lit(1 << k).alias("bit"), F.lit(text).alias("text")) for k, text in enumerate(EXIT_FLAGS)])
    return F.transform(F.filter(every, lambda x: status.bitwiseAND(x["bit"]) != 0), lambda x: x["text"])


def collection_status(status: Column, has_warnings: Column) -> Column:
    return F.when(status.bitwiseAND(F.lit(7)) != 0, "incomplete").when((status != 0) | has_warnings, "complete_with_warnings").otherwise("complete")


def clean(text: Column) -> Column:
    """Trimmed text, empty for null."""
    return F.trim(F.coalesce(text.cast("string"), F.lit("")))


def int_or_none(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("long")


def unique_nonempty(values: Column) -> Column:
    """Distinct trimmed texts in order, without empty ones."""
    return F.array_distinct(F.filter(F.transform(values, clean), lambda x: x != ""))


RESERVED = "^(?i)(con|prn|aux|nul|com[1-9]|lpt[1-9])$"


def safe_component(value: Column) -> Column:
    """A text as part of a file name, 80 characters at most."""
    out = F.regexp_replace(F.trim(value), r'[<>:"/\\|?*\x00-\x1f]+', "_")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^[ ._]+|[ ._]+$", "")
    out = F.when(out.rlike(RESERVED), F.concat(F.lit("_"), out)).otherwise(out)
    out = F.regexp_replace(F.substring(out, 1, 80), r"[ ._]+$", "")
    return F.when(out == "", "Disk").otherwise(out)


def disk_identity(labels: Column, letters: Column, number: Column) -> Column:
    """Volume labels, else drive letters, else the drive's number."""
    named = F.substring(F.array_join(F.array_distinct(F.transform(labels, safe_component)), "+"), 1, 120)
    lettered = F.array_join(F.transform(letters, lambda x: F.regexp_replace(x, ":+$", "")), "+")
    return F.when(F.size(labels) > 0, named).when(F.size(letters) > 0, lettered).otherwise(F.concat(F.lit("PhysicalDrive"), number.cast("string")))


def drone_model(category: Column) -> Column:
    """The model_name of a list of "key: value" parts."""
    return F.nullif(F.trim(F.regexp_extract(category, r"(?i)(?:^|;)\s*model_name\s*:\s*([^;]+)", 1)), F.lit(""))


def throughput(size: Column, seconds: Column) -> Column:
    """Bytes a second; 0 without time or bytes."""
    return F.when((seconds > 0) & (size > 0), size / seconds).otherwise(F.lit(0.0))


def size_band(size: Column) -> Column:
    """Nearest power of two, halves to even."""
    return F.rint(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")


def compat_mode(old: Column, new: Column) -> Column:
    return F.when(old == new, F.concat_ws("/", old.cast("string"), new.cast("string"))).otherwise("cross")


def valid_digest(value: Column) -> Column:
    return F.when(value.rlike("^[0-9a-f]{64}$"), value)
