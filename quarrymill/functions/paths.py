"""Columns over file paths and names: categories, titles, storage paths, hashes and source addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: categories, and the bucket of each
CATEGORIES = ["templates", "national_regulations", "internal_policies", "examples", "other"]
BUCKETS = {"templates": "templates", "national_regulations": "regulations", "internal_policies": "policies", "examples": "examples"}
# fixed values: folder names and their categories; the first entry that a path has wins
FOLDERS = {
    "templates": "templates",
    "regulations": "national_regulations",
    "internal-policies": "internal_policies",
    "policies": "internal_policies",
    "examples": "examples",
}
# fixed value: bytes of an upload at most
MAX_UPLOAD = 50 * 1024 * 1024


def parts(path: Column) -> Column:
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")


def infer_category(path: Column, folders: dict[str, str] = FOLDERS) -> Column:
    """The category of the first entry of `folders` that equals a part of the path, file name included; else other."""
    lowered = F.transform(parts(path), F.lower)
    return F.coalesce(*[F.when(F.array_contains(lowered, name.lower()), F.lit(category)) for name, category in folders.items()], F.lit("other"))


def category_to_bucket(category: Column) -> Column:
    return F.coalesce(*[F.when(category == c, F.lit(b)) for c, b in BUCKETS.items()], F.lit("examples"))


def bucket_to_category(bucket: Column) -> Column:
    """Null for a bucket that isn't known."""
    return F.coalesce(*[F.when(bucket == b, F.lit(c)) for c, b in BUCKETS.items()])


def derive_title(path: Column, fallback: str = "document") -> Column:
    """The file name without its last suffix; a leading dot is no suffix."""
    name = F.element_at(parts(path), -1)
    return F.coalesce(F.nullif(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""), F.lit("")), F.lit(fallback))


def safe_storage_name(name: Column) -> Column:
    """A stem of safe characters, at most 80, and the suffix in lower case (.bin if there is none)."""
    suffix = F.regexp_extract(name, r"(?<=.)(\.[^./]+)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^./]+$", "")
    stem = F.btrim(F.regexp_replace(stem, r"[^a-zA-Z0-9._-]+", "_"), F.lit("_"))
    return F.concat(F.left(F.coalesce(F.nullif(stem, F.lit("")), F.lit("file")), F.lit(80)), F.when(suffix == "", ".bin").otherwise(F.lower(suffix)))


def storage_path(document: Column, version: Column, name: Column, sha: Column | None = None) -> Column:
    """<document>/v<n>/<name>, and the first 8 digits of a digest after the stem where one is given."""
    safe = safe_storage_name(name)
    if sha is not None:
        safe = F.concat(F.regexp_replace(safe, r"\.[^.]+$", ""), F.lit("-"), F.left(sha, F.lit(8)), F.regexp_extract(safe, r"(\.[^.]+)$", 1))
    return F.concat(document.cast("string"), F.lit("/v"), version.cast("string"), F.lit("/"), safe)


def parse_storage_path(path: Column) -> Column:
    """struct(document, version, name, skip): skip is null for a path of the storage form."""
    p = F.filter(F.split(path, "/"), lambda x: x != "")
    number = F.regexp_extract(F.coalesce(F.get(p, F.lit(1)), F.lit("")), r"(?i)^v(\d+)$", 1).try_cast("int")
    short = F.coalesce(F.size(p) < 3, F.lit(True))
    skip = F.when(short, "bad path").when(number.isNull(), "bad version segment")
    good = skip.isNull()
    return F.struct(
        F.when(good, F.get(p, F.lit(0))).alias("document"),
        F.when(good, number).alias("version"),
        F.when(good, F.array_join(F.slice(p, F.lit(3), F.greatest(F.size(p), F.lit(1))), "/")).alias("name"),
        skip.alias("skip"),
    )


def content_hash(text: Column) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(32))


def file_sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def sha_mismatch(stored: Column, content: Column) -> Column:
    return F.coalesce(stored != file_sha256(content), F.lit(False))


def slug(title: Column) -> Column:
    s = F.regexp_replace(F.trim(title), r"(?U)\s+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, r"(?U)[^\w-]", ""), F.lit("")), F.lit("doc"))


def source_uri(scheme: str, value: Column, bucket: Column | None = None) -> Column:
    """local://<path>, manual://<slug of a title>, upload://<name> or storage://<bucket>/<path>."""
    if scheme == "manual":
        return F.concat(F.lit("manual://"), slug(value))
    if scheme == "storage":
        return F.concat(F.lit("storage://"), bucket, F.lit("/"), value)
    return F.concat(F.lit(f"{scheme}://"), F.replace(value, F.lit("\\"), F.lit("/")))


def is_local_path(path: Column) -> Column:
    """The queue's rule: a backslash, a leading slash, or a colon in the first part."""
    return F.contains(path, F.lit("\\")) | F.startswith(path, F.lit("/")) | F.contains(F.get(F.split(path, "/"), F.lit(0)), F.lit(":"))


def is_absolute_path(path: Column) -> Column:
    """The draft writer's rule: a drive, a share or a leading slash."""
    return path.rlike(r"^(?:[A-Za-z]:[\\/]|\\\\|/)")


def validate_upload(category: Column, size: Column) -> Column:
    """Why an upload is rejected, or null."""
    return (
        F.when(~category.isin(*CATEGORIES) | category.isNull(), "unknown category")
        .when(category == "other", "category not allowed")
        .when(F.coalesce(size, F.lit(0)) == 0, "empty file")
        .when(size > MAX_UPLOAD, "file too large")
    )
