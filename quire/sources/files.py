"""Raw file sources and file-level keys."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Admission settings (documented defaults).
MAX_FILE_SIZE_MB = 30
ALLOWED_EXTENSIONS = (".pdf", ".txt", ".docx", ".md")

# Bytes of a file that is held whole, at most, and of a piece of a longer one.
WHOLE_BYTES = 32 << 20
PIECE_BYTES = 8 << 20

# Extraction placeholder texts, by extension.
PDF_TEXT = ("[PDF Content] Filename: {f}\nThis is placeholder text content extracted from the "
            "PDF file. In production, this would use proper PDF parsing.")
DOC_TEXT = ("[Document Content] Filename: {f}\nThis is placeholder text content extracted from "
            "the document file. In production, this would use proper document parsing.")
OTHER_TEXT = "[File Content] Filename: {f}\nUnsupported file type for text extraction: {e}"


def scan_files(spark: SparkSession, path: str, glob: str | None = None,
               recursive: bool = True) -> DataFrame:
    """``path, modificationTime, length, content`` of every file below ``path``.

    Column pruning reaches the scan: selecting no ``content`` reads no bytes.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def file_inventory(files: DataFrame) -> DataFrame:
    """Name, directory, length, modified time (no bytes read)."""
    p = F.regexp_replace(F.col("path"), "^file:", "")
    return files.select(
        p.alias("path"),
        F.regexp_extract(p, "([^/]+)$", 1).alias("name"),
        F.regexp_replace(p, "/[^/]+$", "").alias("directory"),
        F.col("length"),
        F.col("modificationTime").alias("modified_at"))


def files_exist(requested: DataFrame, inventory: DataFrame, key: str = "path") -> DataFrame:
    """``exists`` flag per requested path (left join on the inventory)."""
    inv = inventory.select(F.col(key).alias("_k")).distinct().withColumn("_e", F.lit(True))
    return (requested.join(inv, requested[key] == inv["_k"], "left")
            .withColumn("exists", F.coalesce("_e", F.lit(False))).drop("_k", "_e"))


def extension(path: Column) -> Column:
    """``Path(path).suffix.lower()``: last ``.xyz`` of the file name, or ``''``."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1))


def admit(df: DataFrame, path_col: str = "path", size_col: str = "length",
          max_mb: int = MAX_FILE_SIZE_MB, allowed=ALLOWED_EXTENSIONS) -> DataFrame:
    """S3: ``admitted`` and ``reject_reason`` by extension and size; a file
    without a path or of unknown size is not admitted."""
    ext = extension(F.col(path_col))
    too_big = F.col(size_col) > F.lit(max_mb * 1024 * 1024)
    bad_ext = ~ext.isin(*allowed)
    reason = (F.when(F.col(path_col).isNull(), F.lit("path missing"))
              .when(F.col(size_col).isNull(), F.lit("size unknown"))
              .when(bad_ext, F.concat(F.lit("extension not allowed: "), ext))
              .when(too_big, F.lit("file too large")))
    return df.withColumn("extension", ext).withColumn("reject_reason", reason) \
        .withColumn("admitted", reason.isNull())


def extract_text(content: Column, filename: Column) -> Column:
    """Text by extension. ``.txt``/``.md`` decode UTF-8 (invalid bytes
    replaced); ``.pdf``, ``.doc``/``.docx`` fixed placeholders; others an
    "unsupported" text."""
    ext = extension(filename)

    def fill(template: str) -> Column:
        parts = template.split("{f}")
        out = [F.lit(parts[0]), filename]
        rest = parts[1]
        if "{e}" in rest:
            a, b = rest.split("{e}")
            out += [F.lit(a), ext, F.lit(b)]
        else:
            out.append(F.lit(rest))
        return F.concat(*out)

    # invalid bytes are dropped (as ``decode(errors="ignore")``): they become
    # U+FFFD natively and those marks are removed. A U+FFFD of the text itself
    # waits as the last private code point meanwhile.
    kept = F.unhex(F.regexp_replace(F.hex(content), r"\G((?:(?!EFBFBD)..)*)EFBFBD", "$1F48FBFBD"))
    cleaned = F.regexp_replace(F.make_valid_utf8(kept.cast("string")), "\uFFFD", "")
    decoded = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")) \
        .otherwise(F.regexp_replace(cleaned, "\U0010FFFD", "\uFFFD"))
    return (F.when(ext.isin(".txt", ".md"), decoded)
            .when(ext == ".pdf", fill(PDF_TEXT))
            .when(ext.isin(".doc", ".docx"), fill(DOC_TEXT))
            .otherwise(fill(OTHER_TEXT)))


def content_hash(content: Column) -> Column:
    """First 16 hex digits of SHA-256 of the content."""
    return F.substring(F.sha2(content, 256), 1, 16)


def _opened(path: str):
    """A stream over the file at a path of ``scan_files``."""
    at = re.match(r"([A-Za-z][A-Za-z0-9+.-]*://[^/]+)(/.*)$", path)
    if at:
        return fs.FileSystem.from_uri(f"{at[1]}/")[0].open_input_stream(at[2])
    return fs.LocalFileSystem().open_input_stream(re.sub("^file:/*", "/", path))


def hashed_files(files: DataFrame, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """S1 + G8: ``path, length, content_hash`` of ``scan_files``.

    A row holds a whole file, which neither fits the heap when the file is
    large nor exists beyond 2 GB. So only files of up to ``whole_bytes`` are
    read as rows; each longer one is read piece by piece by the task that
    lists it. Where only Spark can open the store, all files are read as rows."""
    rows = files.select("path", F.col("length").cast("bigint").alias("length"), content_hash(F.col("content")).alias("content_hash"))
    first = files.select("path").filter(F.col("length") > whole_bytes).first()
    if first is None:
        return rows
    try:
        _opened(first["path"]).close()
    except (OSError, ValueError, NotImplementedError):
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for path in pdf["path"]:
                h = hashlib.sha256()
                with _opened(path) as stream:
                    while piece := stream.read(PIECE_BYTES):
                        h.update(piece)
                found.append(h.hexdigest()[:16])
            yield pdf.assign(content_hash=found)
    # the filters reach the scan: it reads no long file
    long = files.filter(F.col("length") > whole_bytes).select("path", F.col("length").cast("bigint").alias("length"))
    return rows.filter(F.col("length") <= whole_bytes).unionByName(long.mapInPandas(run, "path string, length bigint, content_hash string"))


def wall_epoch(ts: Column) -> Column:
    """Epoch seconds of a timestamp's wall-clock reading taken as UTC (for
    naive times; independent of the session time zone)."""
    return (F.unix_date(F.to_date(ts)).cast("bigint") * 86400 + F.hour(ts) * 3600
            + F.minute(ts) * 60 + F.second(ts))


def file_key(user_id: Column, ts: Column, content: Column, epoch: Column | None = None) -> Column:
    """``{user}_{epoch seconds}_{hash16}``; the time is a column so reruns
    give the same key. ``epoch`` overrides ``unix_timestamp(ts)`` (e.g.
    ``wall_epoch`` for naive times)."""
    e = epoch if epoch is not None else F.unix_timestamp(ts)
    return F.concat_ws("_", user_id, e.cast("string"), content_hash(content))


def upload_path(base: str, catalog: str, schema: str, volume: str, file_name: Column) -> Column:
    """``base/catalog/schema/volume/file_name``."""
    return F.concat_ws("/", F.lit(base), F.lit(catalog), F.lit(schema), F.lit(volume), file_name)


def processed_path(path: Column) -> Column:
    """``Path(path).parent / "processed"``."""
    return F.concat(F.regexp_replace(path, "/[^/]+$", ""), F.lit("/processed"))


def placeholder_sql(template: str, name: str) -> str:
    """A placeholder text as SQL over the column ``name`` (for the oracles)."""
    lines = [" || ".join(f"'{x}'" if i % 2 == 0 else name for i, x in enumerate(line.replace("{f}", "\0f\0").split("\0")) if x)
             for line in template.split("\n")]
    return " || chr(10) || ".join(lines)
