"""Column functions: paths, hashes, capture data and text for people."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from nearfold.plans.schemas import EXIF, IMAGE_EXTENSIONS, KIND_LABELS, PHASE_LABELS, RAW_EXTENSIONS, STATUS_LABELS, TIFF_EXTENSIONS


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def prefix16(fingerprint: Column) -> Column:
    """The top 16 of 64 bits as 0 to 65535."""
    return F.shiftrightunsigned(fingerprint, 48)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_dir(path: Column) -> Column:
    """The part before the last slash; "/" for a file in the root, "" without a slash."""
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when((found == "") & path.startswith("/"), "/").otherwise(found)


def extension_lower(path: Column) -> Column:
    """Null for names without a dot and names that only begin with one."""
    return F.lower(F.nullif(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1), F.lit("")))


def file_stem(path: Column) -> Column:
    name = basename(path)
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(.+)\.[^.]*$", 1), F.lit("")), name)


def file_key(path: Column) -> Column:
    """stem.ext in lower case, null without an extension."""
    return F.concat(F.lower(file_stem(path)), F.lit("."), extension_lower(path))


def is_supported_image(path: Column) -> Column:
    return F.coalesce(extension_lower(path).isin(*IMAGE_EXTENSIONS), F.lit(False))


def is_raw_extension(extension: Column) -> Column:
    return F.coalesce(F.lower(extension).isin(*RAW_EXTENSIONS), F.lit(False))


def is_tiff_family(extension: Column) -> Column:
    return F.coalesce(F.lower(extension).isin(*TIFF_EXTENSIONS), F.lit(False))


def is_standalone_raw(path: Column) -> Column:
    extension = extension_lower(path)
    return is_raw_extension(extension) & ~is_tiff_family(extension)


def thumbnail_key(path: Column, size: Column) -> Column:
    """SHA-256 hex of the path in UTF-8 and the size as 8 bytes, lowest first."""
    pairs = F.regexp_extract_all(F.lpad(F.hex(size.cast("long")), 16, "0"), F.lit("(..)"), 1)
    return F.sha2(F.concat(F.encode(path, "UTF-8"), F.unhex(F.array_join(F.reverse(pairs), ""))), 256)


def pack_bytes(values: Column) -> Column:
    """Eight bytes (array of 0 to 255) as a long, the first in the lowest bits; missing ones are 0."""
    parts = [F.shiftleft(F.coalesce(F.get(values, i), F.lit(0)).cast("long"), 8 * i) for i in range(8)]
    found = parts[0]
    for p in parts[1:]:
        found = found.bitwiseOR(p)
    return found


def camera_key(make: Column, model: Column) -> Column:
    return F.concat_ws("|", F.coalesce(make, F.lit("")), F.coalesce(model, F.lit("")))


def exif_date(original: Column, plain: Column) -> Column:
    """The first of the two that parses as yyyy:MM:dd HH:mm:ss, read as UTC whatever the time zone of the session is.

    Texts without the shape of a date are not parsed: each failure would raise an exception inside Spark.
    """
    utc = lambda text: F.when(
        text.rlike(r"^[+-]?\d{4,}:\d\d:\d\d \d\d:\d\d:\d\d$"), F.try_to_timestamp(F.concat(text, F.lit("+0000")), F.lit("yyyy:MM:dd HH:mm:ssxx"))
    )
    return F.coalesce(utc(original), utc(plain))


def clean_ascii(values: Column) -> Column:
    """The first of an array of strings without NULs and then spaces at its ends; null without one."""
    return F.trim(F.regexp_replace(F.get(values, 0), "^\\x00+|\\x00+$", ""))


def first_rational(numerators: Column, denominators: Column) -> Column:
    return F.try_divide(F.get(numerators, 0).cast("double"), F.get(denominators, 0).cast("double"))


def format_aperture(value: Column) -> Column:
    """f/2.8; exact ties to the even digit."""
    return F.when(value.isNotNull(), F.format_string("f/%.1f", F.bround(value, 1)))


def format_focal(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.0fmm", F.bround(value, 0)))


def format_shutter(value: Column) -> Column:
    """1.5s from a second on, 1/250 below; null for zero and less."""
    slow = F.format_string("%.1fs", F.bround(value, 1))
    quick = F.concat(F.lit("1/"), F.round(F.try_divide(F.lit(1.0), value)).cast("long").cast("string"))
    return F.when(value >= 1, slow).when(value > 0, quick)


def exif_struct(text: Column) -> Column:
    """The capture data in a JSON text; null for malformed text and for null. The text is parsed once, however many fields are asked for."""
    parsed = F.from_json(text, EXIF, {"mode": "PERMISSIVE", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSS]X"})
    some = lambda e: F.exists(F.array(*(e[f.split(":")[0]].isNotNull() for f in EXIF[7:-1].split(","))), lambda x: x)
    return F.get(F.filter(F.array(parsed), some), 0)


def exif_json(exif: Column) -> Column:
    return F.to_json(exif)


def visual_confidence(least: Column, threshold: int) -> Column:
    """1 - distance / threshold as a float; ``least`` counts as ``threshold`` at most."""
    return (F.lit(1.0) - F.least(least, F.lit(threshold)).cast("double") / F.lit(float(max(threshold, 1)))).cast("float")


def format_bytes(value: Column) -> Column:
    """1.5 KB and so on, base 1024, up to TB; ties go up."""
    sizes = ["B", "KB", "MB", "GB", "TB"]
    found = F.when(value == 0, F.lit("0 B"))
    for i, unit in enumerate(sizes):
        tenths = F.floor(value.cast("double") / F.lit(float(1024**i)) * 10 + 0.5)
        text = F.format_string(f"%.1f {unit}", tenths.cast("double") / 10)
        found = found.when(value < 1024 ** (i + 1), text) if i + 1 < len(sizes) else found.otherwise(text)
    return F.when(value.isNotNull(), found)


def _some(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def exif_line(make: Column, model: Column, iso: Column, aperture: Column, shutter: Column, focal: Column) -> Column:
    body = _some(F.concat_ws(" ", _some(make), _some(model)))
    speed = F.when(iso != 0, F.concat(F.lit("ISO "), iso.cast("string")))
    return F.concat_ws(" · ", body, speed, _some(aperture), _some(shutter), _some(focal))


def dimensions_text(width: Column, height: Column) -> Column:
    known = F.coalesce((width != 0) & (height != 0), F.lit(False))
    return F.when(known, F.concat_ws("×", width.cast("string"), height.cast("string"))).otherwise("—")


def coded(value: Column, values: tuple[str, ...]) -> Column:
    """``value`` if it is one of ``values``, else the first of them."""
    return F.when(value.isin(*values), value).otherwise(values[0])


def _label(value: Column, labels: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)


def kind_label(kind: Column) -> Column:
    return _label(kind, KIND_LABELS)


def status_label(status: Column) -> Column:
    return _label(status, STATUS_LABELS)


def phase_label(phase: Column) -> Column:
    return _label(phase, PHASE_LABELS)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def parse_rfc3339(text: Column) -> Column:
    """Null for text that is no such time."""
    return F.try_to_timestamp(text)


def session_name(name: Column, root: Column) -> Column:
    return F.coalesce(_some(name), _some(basename(F.rtrim(root, F.lit("/")))), F.lit("Scan"))


def confidence_percent(confidence: Column) -> Column:
    return F.floor(confidence.cast("double") * 100 + 0.5).cast("int")


def new_session_id() -> Column:
    return F.expr("uuid()")
