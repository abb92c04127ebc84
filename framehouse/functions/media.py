"""Names, dates and paths of media files as column expressions: all run in the JVM, none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as media, what is passed over, and the names that plans write.
PHOTO_EXTENSIONS = (".jpg", ".jpeg", ".heic", ".png", ".gif", ".bmp", ".tiff", ".tif", ".dng", ".nef", ".cr2", ".cr3", ".arw", ".raf", ".orf", ".rw2")
VIDEO_EXTENSIONS = (".mov", ".mp4", ".m4v", ".avi", ".mkv", ".wmv", ".3gp")
RAW_EXTENSIONS = (".dng", ".nef", ".cr2", ".cr3", ".arw", ".raf", ".orf", ".rw2")
SKIPPED_NAMES = ("run_organize.sh", "run_new_folder.sh", "reorganize_structure.sh", "profiles.yaml", "README.md")
FILENAME_DATES = (r"(?:IMG|VID|PANO|BURST|MVIMG|PXL)_(\d{8})[_-]\d{6}", r"^(?:IMG|VID)-(\d{8})-WA\d+", r"^(\d{8})[_-]\d{6}", r"(\d{4}-\d{2}-\d{2})", r"_(\d{8})_")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
UNKNOWN_DIRECTORY, UNKNOWN_PREFIX, DUPLICATE_DIRECTORY = "Unknown_Date", "Unknown_", "Duplicate"
ARTIFACT_NAMES = (".organize_cache.db", ".organize_log.txt")
ARTIFACT_PREFIXES = ("dry_run_report_", "audit_receipt_", "reorganize_audit_receipt_")
REMEDIES = (("access", ("permission", "access", "bookmark")), ("space", ("space", "disk", "volume")), ("verification", ("hash", "verify")), ("dates", ("date", "unknown")), ("collisions", ("exist", "collision", "duplicate")))
PHASES = ("discovery", "src_hash", "dest_hash", "classification", "copy", "revert", "reorganize")
LAYOUTS = ("yyyy/mm/dd", "yyyy/mm", "yyyy", "yyyy/mon/event", "flat")


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def parent_name(path: Column) -> Column:
    return filename(parent(path))


def natural_key(name: Column) -> Column:
    """A text that sorts names without case and digits by their number, as file managers list them; then by their spelling.

    A number is its count of digits and the digits; other stretches keep their letters. Accents aren't folded.
    """
    number = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    part = lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(number(x)).cast("string"), 4, "0"), number(x))).otherwise(F.concat(F.lit("1"), x))
    parts = F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)")), part)
    return F.concat(F.array_join(parts, "\u0001"), F.lit("\u0000"), name)


def suffix(path: Column) -> Column:
    """The extension with its dot and as it is written, or an empty string."""
    return F.regexp_extract(filename(path), r"^.+(\.[^.]+)$", 1)


def extension(path: Column) -> Column:
    return F.lower(suffix(path))


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def is_photo(path: Column) -> Column:
    return extension(path).isin(*PHOTO_EXTENSIONS)


def is_raw(path: Column) -> Column:
    return extension(path).isin(*RAW_EXTENSIONS)


def is_media(path: Column) -> Column:
    return extension(path).isin(*PHOTO_EXTENSIONS, *VIDEO_EXTENSIONS)


def is_skipped(name: Column) -> Column:
    return name.startswith(".") | name.isin(*SKIPPED_NAMES)


def filename_date(path: Column) -> Column:
    """Midnight (UTC) of the first of the known name patterns that holds a real day of 1900 to 2100."""
    def day(pattern: str) -> Column:
        digits = F.replace(F.regexp_extract(filename(path), pattern, 1), F.lit("-"), F.lit(""))
        known = F.when(digits.rlike(r"^(19\d\d|20\d\d|2100)\d{4}$"), F.try_to_timestamp(digits, F.lit("yyyyMMdd")))
        return F.to_date(known)

    return F.coalesce(*[day(p) for p in FILENAME_DATES])


def resolved_date(path: Column, exif: Column, created: Column, modified: Column) -> Column:
    """struct<date, source, confidence>: what a photo's camera says, its name, then the file's own times."""
    of = lambda date, source, confidence: F.when(date.isNotNull(), F.struct(date.cast("timestamp").alias("date"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence")))
    none = F.struct(F.lit(None).cast("timestamp").alias("date"), F.lit("unknown").alias("source"), F.lit("unknown").alias("confidence"))
    return F.coalesce(of(F.when(is_photo(path), exif), "photoMetadata", "high"), of(filename_date(path), "filename", "medium"), of(created, "fileSystemCreated", "low"), of(modified, "fileSystemModified", "low"), none)


def day_bucket(date: Column) -> Column:
    return F.when(F.year(date) >= 1900, F.date_format(date, "yyyy-MM-dd")).otherwise(UNKNOWN_DIRECTORY)


def identity_parts(identity: Column) -> Column:
    """struct<size, digest>, or null: the size stands before the first underscore, and the digest isn't empty."""
    size = F.regexp_extract(identity, r"^([+-]?\d+)_.", 1).try_cast("long")
    return F.when(size.isNotNull(), F.struct(size.alias("size"), F.regexp_extract(identity, r"^[^_]*_(.+)$", 1).alias("digest")))


def is_trusted_identity(identity: Column) -> Column:
    return identity_parts(identity).isNotNull() & identity.rlike(r"^[^_]*_[0-9A-Fa-f]{64,}$")


def sequence_text(number: Column, width: Column) -> Column:
    """Zeros before the number up to the width; a wider number stays whole."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(width, F.length(text)), F.lit("0"))


def sequence_width(existing: Column, planned: Column, least: int = 3) -> Column:
    return F.greatest(F.lit(least), F.length((existing + planned).cast("string")))


def clean_event_name(name: Column) -> Column:
    parts = F.transform(F.split(F.trim(name), r"[/:\p{Cntrl}\n\r]"), lambda x: F.trim(x))
    return F.nullif(F.array_join(F.filter(parts, lambda x: x != ""), "-"), F.lit(""))


def event_folder(path: Column, root: str, override: Column) -> Column:
    return F.coalesce(clean_event_name(override), F.when(parent(path) == root, F.lit("")).otherwise(parent_name(path)))


def directories(bucket: Column, layout: str, event: Column) -> Column:
    """The directories of a bucket under a layout, with a slash after each."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout}")
    dated = bucket.rlike(r"^[^-]+-[^-]+-[^-]+$")
    y, m, d = (F.split_part(bucket, F.lit("-"), F.lit(k)) for k in (1, 2, 3))
    named = F.when(F.coalesce(event, F.lit("")) != "", F.concat(event, F.lit("/"))).otherwise("")
    month = F.try_element_at(F.array(*map(F.lit, MONTHS)), m.try_cast("int"))
    inner = {
        "yyyy/mm/dd": F.concat(y, F.lit("/"), m, F.lit("/"), d, F.lit("/")),
        "yyyy/mm": F.concat(y, F.lit("/"), m, F.lit("/")),
        "yyyy": F.concat(y, F.lit("/")),
        "yyyy/mon/event": F.coalesce(F.concat(y, F.lit("/"), F.when(m.try_cast("int").between(1, 12), month), F.lit("/"), named), F.lit("")),
        "flat": F.lit(""),
    }[layout]
    unknown = F.concat(F.lit(f"{UNKNOWN_DIRECTORY}/"), named if layout == "yyyy/mon/event" else F.lit(""))
    return F.when(bucket == UNKNOWN_DIRECTORY, unknown).when(dated, inner).otherwise("")


def planned_path(source: Column, root: str, bucket: Column, sequence: Column, width: Column, duplicate: Column, layout: str = "yyyy/mm/dd", event: Column | None = None) -> Column:
    name = F.concat(F.when(bucket == UNKNOWN_DIRECTORY, F.lit(UNKNOWN_PREFIX)).otherwise(F.concat(bucket, F.lit("_"))), sequence_text(sequence, width), suffix(source))
    first = F.when(duplicate, F.lit(f"{root}/{DUPLICATE_DIRECTORY}/")).otherwise(f"{root}/")
    return F.concat(first, directories(bucket, layout, F.lit(None).cast("string") if event is None else event), name)


def indexed_bucket(path: Column) -> Column:
    """The bucket that a file of the destination counts towards: any name that begins as planned ones do; else null."""
    head = F.regexp_extract(filename(path), r"^(\d{4}-\d{2}-\d{2}|Unknown)_(\d+)", 1)
    return F.when(head == "Unknown", F.lit(UNKNOWN_DIRECTORY)).when(head != "", head)


def indexed_sequence(path: Column) -> Column:
    return F.regexp_extract(filename(path), r"^(?:\d{4}-\d{2}-\d{2}|Unknown)_(\d+)", 1).try_cast("long")


def in_duplicates(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), DUPLICATE_DIRECTORY)


def managed_bucket(path: Column) -> Column:
    """Stricter than indexed_bucket: the name must be wholly as planned."""
    name = stem(filename(path))
    return F.when(name.rlike(rf"^{UNKNOWN_PREFIX}\d+$"), F.lit(UNKNOWN_DIRECTORY)).when(name.rlike(r"^\d{4}-\d{2}-\d{2}_\d+$"), F.substring(name, 1, 10))


def month_key(bucket: Column) -> Column:
    return F.when(bucket.rlike(r"^\d{4}-\d{2}"), F.substring(bucket, 1, 7)).otherwise("Unknown")


def is_planned_name(name: Column) -> Column:
    """Whether a plan could have written the name, by its shape alone: a loose test that library health uses."""
    return name.startswith(UNKNOWN_PREFIX) | ((F.length(name) >= 15) & name.rlike(r"^\d{4}-\d{2}-\d{2}_"))


def month_of_path(path: Column) -> Column:
    """The month key of a planned destination path by its name's digits; null for other names."""
    name = filename(path)
    return F.when(name.startswith(UNKNOWN_PREFIX), "Unknown").when(name.rlike(r"^\d{4}-\d{2}-\d{2}_"), F.substring(name, 1, 7))


def is_artifact(name: Column) -> Column:
    """Whether a file at the destination is a run's own and not a medium."""
    return name.isin(*ARTIFACT_NAMES) | F.coalesce(F.array_max(F.array(*[name.startswith(x) for x in ARTIFACT_PREFIXES])), F.lit(False))


def exif_date(raw: Column, offset: Column) -> Column:
    """The instant of an image's date text: with its offset if there is one that reads, else as UTC; day parts by : or -."""
    read = lambda text, form: F.try_to_timestamp(text, F.lit(form))
    shifted = F.when(F.trim(offset) != "", F.concat(raw, F.lit(" "), F.trim(offset)))
    zoned = [read(shifted, "yyyy:MM:dd HH:mm:ss XXX"), read(shifted, "yyyy-MM-dd HH:mm:ss XXX")]
    return F.coalesce(*zoned, read(raw, "yyyy:MM:dd HH:mm:ss"), read(raw, "yyyy-MM-dd HH:mm:ss"))


def remaining_text(seconds: Column) -> Column:
    """What a progress line says of the seconds left."""
    n = F.greatest(F.lit(1).cast("long"), F.floor(seconds + 0.5))
    whole = lambda k: F.floor(n / k).cast("string")
    return F.when(n < 60, "less than 1m remaining").when(n < 3600, F.concat(whole(60), F.lit("m remaining"))).otherwise(F.concat(whole(3600), F.lit("h "), F.floor(n % 3600 / 60).cast("string"), F.lit("m remaining")))


def pair_kind(is_live_still: Column, partner: Column) -> Column:
    """livePhoto where the still is known as one or its partner is a movie, else rawJpeg; null without a partner."""
    live = F.coalesce(is_live_still, F.lit(False)) | extension(partner).isin(".mov", ".m4v")
    return F.when(F.coalesce(is_live_still, F.lit(False)), "livePhoto").when(partner.isNotNull(), F.when(live, "livePhoto").otherwise("rawJpeg"))


def fixes_for(text: Column) -> Column:
    """The kinds of remedy that a run's issue lines call for, in a fixed order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.array_max(F.array(*[low.contains(w) for w in words])), kind) for kind, words in REMEDIES]))


def phase_state(phase: Column, current: Column) -> Column:
    """complete, current or pending, by the order of phases."""
    order = F.array(*map(F.lit, PHASES))
    at, now = F.array_position(order, phase), F.array_position(order, current)
    return F.when(at < now, "complete").when(at == now, "current").otherwise("pending")


def found_event_folder(relative: Column) -> Column:
    """The event of YYYY/Mon/Event/name or Unknown_Date/Event/name, under Duplicate/ or not; else null."""
    parts = F.split(F.regexp_replace(relative, f"^{DUPLICATE_DIRECTORY}/", ""), "/")
    dated = (F.size(parts) == 4) & parts[0].rlike(r"^\d{4}$") & F.try_element_at(parts, F.lit(2)).isin(*MONTHS)
    unknown = (F.size(parts) == 3) & (parts[0] == UNKNOWN_DIRECTORY)
    return F.when(dated, F.try_element_at(parts, F.lit(3))).when(unknown, F.try_element_at(parts, F.lit(2)))


def severity(line: Column) -> Column:
    return F.when(line.startswith("ERROR:"), "error").when(line.startswith("WARNING:") | line.startswith("⚠"), "warning").otherwise("info")


def below(path: Column, root: str) -> Column:
    return (path == root) | path.startswith(f"{root.rstrip('/')}/")


def is_trusted_root(path: Column, destination: str, home: str) -> Column:
    """Whether a receipt's source root (resolved, and known to be a directory) lies below the home, the destination's parent or a volume."""
    clean = F.rtrim(F.trim(path), F.lit("/"))
    parents = [p for p in {home.rstrip("/"), destination.rstrip("/").rpartition("/")[0]} if p]
    return F.coalesce(F.array_max(F.array(*[clean.startswith(f"{p}/") for p in parents], clean.rlike(r"^/Volumes/[^/]"))), F.lit(False))
