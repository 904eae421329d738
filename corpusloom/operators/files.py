"""File state: versions, admission, classification, change and drift detection, tombstones.

The vault's file table is an append-only log of versions. Every operator is a plan of built-in expressions; nulls in
a column that a predicate reads make the predicate false, unless stated otherwise.
"""

from __future__ import annotations

import re
from fnmatch import translate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86400.0
#: Extensions by queue lane, media types by extension, and errors worth another try.
FAST = ".txt .md .markdown .rst .py .js .ts .tsx .jsx .java .c .cpp .h .go .rs .rb .sh .yaml .yml .toml .json .xml .html .css .csv .log .sql .ini .cfg".split()
HEAVY = ".pdf .docx .xlsx .pptx .html .htm".split()
BACKGROUND = ".zip .tar .tar.gz .tgz .rar .jpg .jpeg .png .gif .tiff .webp .bmp .mp3 .wav .ogg .flac .m4a .mp4 .mkv .avi .mov".split()
TARBALLS = ".tar.gz .tar.bz2 .tar.xz".split()
MEDIA_TYPES = {
    ".txt": "text/plain", ".md": "text/markdown", ".html": "text/html", ".htm": "text/html", ".css": "text/css", ".csv": "text/csv", ".json": "application/json",
    ".xml": "text/xml", ".js": "text/javascript", ".py": "text/x-python", ".pdf": "application/pdf", ".zip": "application/zip", ".tar": "application/x-tar",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif",
    ".webp": "image/webp", ".mp3": "audio/mpeg", ".wav": "audio/x-wav", ".ogg": "audio/ogg", ".flac": "audio/flac",
}
RETRYABLE = ["failed to read file", "cannot stat file", "timeout", "connection", "disk", "permissionerror", "oserror"]


def latest(files: DataFrame, key: str = "id") -> DataFrame:
    """The newest version of each file (by updated_at, then by all columns); rows without a key are left out."""
    newest = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("updated_at", *[c for c in files.columns if c not in (key, "updated_at")])).alias("_v"))
    return newest.select(*(F.col(key) if c == key else F.col(f"_v.{c}").alias(c) for c in files.columns))


def list_files(files: DataFrame, status: str | None = None) -> DataFrame:
    """Files of a status, or all that aren't tombstones."""
    return files.where(F.col("status") == status) if status else files.where("status <> 'tombstone'")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a dotfile's name counts as one, no extension is empty."""
    return F.regexp_extract(F.lower(path), r"(\.[^./]*)$", 1)


def allowed(path: Column, *, roots: list[str], blocked: list[str] = (), exclude: list[str] = (), include: list[str] = (), symlink: Column | None = None) -> Column:
    """Scope gate: below a root, extension not blocked, no exclude pattern, some include pattern if there are any, no symlink."""
    def matches(patterns):
        out = F.lit(False)
        for p in patterns:
            out = out | path.rlike("^" + translate(p).replace("\\Z", "$").replace("\\z", "$"))
        return out

    below = F.lit(False)
    for root in roots:
        below = below | (path == root.rstrip("/")) | path.startswith(root.rstrip("/") + "/")
    gate = below & ~extension(path).isin(*[e.lower() for e in blocked]) & ~matches(exclude)
    if include:
        gate = gate & matches(include)
    if symlink is not None:
        gate = gate & ~F.coalesce(symlink, F.lit(False))
    return F.coalesce(gate, F.lit(False))


def within_size(size: Column, most: int) -> Column:
    return F.coalesce(size <= most, F.lit(False))


def lane(path: Column) -> Column:
    low = F.lower(path)
    tarball = F.lit(False)
    for t in TARBALLS:
        tarball = tarball | low.endswith(t)
    ext = extension(path)
    return F.when(tarball, "background").when(ext.isin(FAST), "fast").when(ext.isin(HEAVY), "heavy").when(ext.isin(BACKGROUND), "background").otherwise("heavy")


def media_type(path: Column, head: Column | None = None) -> Column:
    """Media type by extension, then by the first bytes of the content, else application/octet-stream."""
    by_extension = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])[extension(path)]
    if head is None:
        return F.coalesce(by_extension, F.lit("application/octet-stream"))
    h = F.hex(head)
    by_magic = (
        F.when(h.startswith("25504446"), "application/pdf").when(h.startswith("504B"), "application/zip").when(h.startswith("89504E47"), "image/png")
        .when(h.startswith("FFD8FF"), "image/jpeg").when(h.startswith("47494638"), "image/gif").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57415645"), "audio/wav")
        .when(h.startswith("494433") | h.startswith("FFFB"), "audio/mpeg").otherwise("application/octet-stream")
    )
    return F.coalesce(by_extension, by_magic)


def parser_of(path: Column, media: Column) -> Column:
    """The parser for a file, the most specific first."""
    low, ext = F.lower(path), extension(path)
    name = F.regexp_extract(low, r"([^/]*)$", 1)
    generic = low.rlike("copilot|microsoft|bing") & ext.isin(".json", ".csv", ".md") | low.contains("perplexity") & ext.isin(".json", ".md")
    chat = F.when(name.endswith("conversations.json") | (low.contains("chatgpt") & (ext == ".zip")), "chatgpt")
    chat = chat.when(low.contains("claude") & ext.isin(".json", ".zip"), "claude").when(low.rlike("gemini|bard") & ext.isin(".json", ".zip", ".html"), "gemini")
    chat = chat.when(low.contains("takeout") & (ext == ".zip"), "gemini").when(generic, "ai_generic")
    chat = chat.when((media == "application/pdf") | (ext == ".pdf"), "pdf").when(ext.isin(".docx", ".xlsx", ".pptx"), "office")
    chat = chat.when(media.startswith("image/"), "image").when(media.startswith("audio/"), "audio").when(ext.isin(".zip", ".tar", ".tgz", ".tar.gz"), "archive")
    return chat.when(media.startswith("text/") | media.isin("application/json", "application/xml") | ext.isin(FAST), "text").otherwise("none")


IDENTITY = ["inode", "device", "mtime", "size", "head_hash"]


def has_changed(new: str, old: str) -> Column:
    """Whether any part of the file identity differs, nulls counting as values."""
    out = F.lit(False)
    for c in IDENTITY:
        out = out | ~F.col(f"{new}.{c}").eqNullSafe(F.col(f"{old}.{c}"))
    return out


def physical_classes(files: DataFrame) -> DataFrame:
    """(id, class_id, links): files that are the same inode of a device, as classes named by their least id."""
    groups = files.where("inode <> 0").groupBy("inode", "device").agg(F.min("id").alias("class_id"), F.count("*").alias("links"))
    return files.join(groups, ["inode", "device"]).select("id", "class_id", "links")


def drift(vault: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, event): files of the vault that vanished from the listing or whose mtime or size differs there."""
    seen = listing.select("path", F.col("mtime").alias("now_mtime"), F.col("size").alias("now_size"), F.lit(True).alias("there"))
    both = vault.where("status <> 'tombstone'").join(seen, "path", "left")
    event = F.when(F.col("there").isNull(), "deleted").when(~F.col("mtime").eqNullSafe(F.col("now_mtime")) | ~F.col("size").eqNullSafe(F.col("now_size")), "modified")
    return both.select("path", event.alias("event")).where("event is not null").distinct()


def purgeable(files: DataFrame, now: float, days: int = 7) -> DataFrame:
    """Tombstones stamped more than ``days`` before ``now``."""
    return files.where((F.col("status") == "tombstone") & (F.col("deleted_at") < now - days * DAY))


def retryable(error: Column) -> Column:
    return F.coalesce(F.lower(error).rlike("|".join(re.escape(p) for p in RETRYABLE)), F.lit(False))
