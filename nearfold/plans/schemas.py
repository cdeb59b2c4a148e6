"""Schemas of the stored tables and the values of their coded columns."""

from __future__ import annotations

EXIF = (
    "struct<dateTaken:timestamp,cameraMake:string,cameraModel:string,iso:int,aperture:string,"
    "shutterSpeed:string,focalLength:string>"
)
SESSIONS = "session_id string, name string, root_path string, status string, config string, scan_generation long, created_at timestamp, updated_at timestamp"
FILES = (
    "file_id long, session_id string, path string, size long, mtime_ns long, width int, height int, inode long, "
    "scan_generation long, created_at timestamp, modified_at timestamp, deleted_at timestamp, "
    "companion_raw_path string, companion_raw_size long"
)
FINGERPRINTS = f"file_id long, content_hash string, dhash long, phash long, exif {EXIF}"
GROUPS = "group_id long, session_id string, kind string, confidence float, review_status string"
MEMBERS = "group_id long, session_id string, file_id long, is_keeper boolean"

# Values of coded columns; the first is the one that unknown text stands for.
STATUSES = ("scanning", "reviewing", "paused", "completed")
PHASES = ("walking", "hashing", "clustering", "complete")
KINDS = ("exact", "visual", "burst", "metadata")
REVIEW_STATUSES = ("pending", "resolved")

# Labels (fixed values).
KIND_LABELS = {"exact": "Exact copy", "visual": "Visually similar", "burst": "Burst sequence", "metadata": "Metadata match"}
STATUS_LABELS = {"scanning": "Scanning", "reviewing": "Ready to review", "paused": "Paused", "completed": "Completed"}
PHASE_LABELS = {
    "walking": "Walking directories",
    "hashing": "Hashing photos",
    "clustering": "Finding duplicate groups",
    "complete": "Scan complete",
}

# File name extensions (fixed values). The order of RAW_EXTENSIONS is the order of preference for companions.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "tiff", "tif", "heic", "heif")
RAW_EXTENSIONS = (
    "3fr", "ari", "arw", "bay", "braw", "crw", "cr2", "cr3", "cap", "data", "dcs", "dcr", "dng", "drf", "eip", "erf",
    "fff", "gpr", "iiq", "k25", "kdc", "mdc", "mef", "mos", "mrw", "nef", "nrw", "obm", "orf", "pef", "ptx", "pxn",
    "r3d", "raf", "raw", "rwl", "rw2", "rwz", "sr2", "srf", "srw", "tif", "x3f",
)
TIFF_EXTENSIONS = ("tif", "tiff")
