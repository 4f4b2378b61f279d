"""WARC archives with a two-level capture index.

*Writing.* A page whose payload of at least ``MIN_SHARED`` bytes equals that
of a page with a larger id becomes a revisit of the largest such page; every
other page is a response. A task writes its records one after the other, each
a gzip member of its own, to archives of about ``ARCHIVE_BYTES``, and returns
what the index needs: the URL with its host reversed (``com,example)/path``),
the page id, archive, and the member's place and length. Files have names that
no other attempt uses, and only those of attempts that ended well are named by
the index, so a lost executor leaves no half archive in it.

*Index.* Entries are sorted by key and cut into compressed blocks, which stand
one after the other in block files; a sparse directory keeps each block's
first key and its place. Blocks grow with the number of records, so that the
directory never exceeds about ``MAX_DIRECTORY`` entries (it is the only part
every task holds).

*Reading.* A request finds its block by binary search in the directory, its
entry by binary search in the block, and its record by place and length in the
archive. Requests are ordered by block, then by archive and place; a task reads
just the byte ranges of the blocks and records that are asked for. No other
block or archive is opened.

Defined results: a null payload is empty; pages with a null url or id are
written, indexed (key ``""``) and read back like others; line ends in a url
are percent-encoded; of rows with a repeated id each is a record of its own;
an empty table writes no archive and gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import block_count, materialize, scratch_path

MIN_SHARED = 1000
ARCHIVE_BYTES = 32 << 20
#: Payload that one task writes, or that the ranges read by one hold, about.
TASK_BYTES = 16 << 20
BLOCK_ENTRIES = 512
MAX_DIRECTORY = 65_536
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
_URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)(.*)$", re.S)


def reversed_host_key(url: str | None) -> str:
    """``http://www.Example.com/a`` -> ``com,example,www)/a``; other text is
    its own key."""
    m = _URL.match(url or "")
    if not m:
        return url or ""
    host, _, port = m.group(1).lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (m.group(2) or "/")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if re.match("[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


class Ranges:
    """Byte ranges of files; the last file stays open."""

    def __init__(self):
        self.path, self.file = "", None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            self.close()
            system, name = file_system(path)
            self.path, self.file = path, system.open_input_file(name)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Writer:
    """Pieces of bytes one after the other, in files of about ``limit`` below
    ``folder`` whose names are new in every attempt."""

    def __init__(self, folder: str, suffix: str, limit: int):
        self.folder, self.suffix, self.limit = folder, suffix, limit
        self.stream, self.path, self.at = None, "", 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        """``(path, offset, length)`` of ``data``, just written."""
        if self.stream is None or self.at >= self.limit:
            self.close()
            name = f"part-{uuid.uuid4().hex}{self.suffix}"
            system, folder = file_system(self.folder)
            system.create_dir(folder, recursive=True)
            self.path, self.at = f"{self.folder}/{name}", 0
            self.stream = system.open_output_stream(f"{folder}/{name}", compression=None)
        self.stream.write(data)
        place = (self.path, self.at, len(data))
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
        self.stream = None


# ------------------------------------------------------------------- writing

def records(pages: DataFrame, tasks: int, id_col: str = "page_id", url_col: str = "url",
            payload_col: str = "html") -> DataFrame:
    """``(id, url, payload, size, digest, refers_to)``: what each page's
    record holds; ``refers_to`` is null for responses. Payloads are dealt to
    ``tasks`` here, once: the join keeps this partitioning."""
    url = F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), payload.alias("payload"))
    digest, size = F.sha1(F.encode("payload", "UTF-8")), F.octet_length("payload").cast("long")
    big = p.select("id", digest.alias("digest"), size.alias("size")).filter((F.col("size") >= MIN_SHARED) & F.col("id").isNotNull())
    shared = (big.groupBy("digest", "size").agg(F.max("id").alias("target"), F.min("id").alias("least"))
              .filter("least < target").drop("least"))
    revisits = big.join(shared, ["digest", "size"]).filter("id < target").select("id", F.col("target").alias("refers_to")).distinct()
    # an id may repeat with another payload: only equal payloads are revisits
    revisits = revisits.join(big.join(shared, ["digest", "size"]).filter("id < target").select("id", "digest"), "id").distinct()
    return (p.withColumn("digest", digest).withColumn("size", size).repartition(tasks, "id", "digest")
            .join(revisits, ["id", "digest"], "left").select("id", "url", "payload", "size", "digest", "refers_to"))


def record_text() -> Column:
    """One record without its final line ends."""
    revisit = F.col("refers_to").isNotNull()
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    head = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.coalesce(F.col("url"), F.lit(""))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("X-Payload-Length", F.col("size").cast("string")),
    ]
    parts = [F.lit("WARC/1.0\r\n")]
    for k, v in head:
        parts += [F.lit(f"{k}: "), v, F.lit("\r\n")]
    parts += [F.when(revisit, F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
        F.col("refers_to").cast("string"), F.lit(">\r\n"))).otherwise(F.lit(""))]
    parts += [F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
              F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string")), F.lit(END),
              F.when(revisit, F.lit("")).otherwise(F.col("payload"))]
    return F.concat(*parts)


ENTRY = "key string, id long, path string, offset long, length long"


def write_archives(recs: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``records`` to archives below ``path``; returns their entries
    (computed once: keep them in a table, as ``archive`` does)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = Writer(path, ".warc.gz", archive_bytes)
        try:
            for pdf in batches:
                rows = []
                for url, i, text in zip(pdf["url"], pdf["id"], pdf["record"]):
                    member = gzip.compress((text + END).encode(), 5, mtime=0)
                    rows.append((reversed_host_key(url), _sort_id(i), *out.add(member)))
                yield pd.DataFrame(rows, columns=["key", "id", "path", "offset", "length"])
        finally:
            out.close()

    return recs.select(F.coalesce("url", F.lit("")).alias("url"), F.col("id").cast("string").alias("id"), record_text().alias("record")) \
        .mapInPandas(run, ENTRY)


# ------------------------------------------------------------------- reading

def parse_record(data: bytes, at: int) -> tuple[dict[str, str], int, int]:
    """``(headers, payload start, payload end)`` of the record at ``at``."""
    body = data.index(b"\r\n\r\n", at) + 4
    lines = data[at:body - 4].decode().split("\r\n")
    if lines[0] != "WARC/1.0":
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return head, body, body + int(head["Content-Length"])


def _page(urn: str) -> int | None:
    n = urn[len("<urn:page:"):-1]
    return int(n) if n else None


def _sort_id(i: int | None) -> int:
    return -(1 << 63) if i is None else int(i)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "content")


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """``(offset, length, data)`` of the gzip members of an archive."""
    at = 0
    while at < len(content):
        z = zlib.decompressobj(31)
        data = z.decompress(memoryview(content)[at:])
        end = len(content) - len(z.unused_data)
        yield at, end - at, data
        at = end


def entries(files: DataFrame) -> DataFrame:
    """The entries of archives from elsewhere that hold one gzip member for
    each record."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for at, n, data in members(content):
                    head = parse_record(data, 0)[0]
                    rows.append((reversed_host_key(head["WARC-Target-URI"]), _sort_id(_page(head["WARC-Record-ID"])), path, at, n))
                yield pd.DataFrame(rows, columns=["key", "id", "path", "offset", "length"])
    return files.mapInPandas(run, ENTRY)


def build_index(found: DataFrame, path: str, n_records: int) -> DataFrame:
    """Sort the entries into compressed blocks below ``path``; returns the
    directory ``(first_key, first_id, n, path, offset, length)``, kept there
    as a table."""
    per_block = max(BLOCK_ENTRIES, -(-n_records // MAX_DIRECTORY))
    parts = max(1, min(2000, n_records // (16 * per_block)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = Writer(f"{path}/blocks", ".idx", ARCHIVE_BYTES)
        held: list[pd.DataFrame] = []
        n = 0
        try:
            for pdf in batches:
                held.append(pdf)
                n += len(pdf)
                if n >= 8 * per_block:
                    whole = pd.concat(held, ignore_index=True)
                    stop = len(whole) // per_block * per_block
                    yield blocks(whole.iloc[:stop], out)
                    held, n = [whole.iloc[stop:]], len(whole) - stop
            if n:
                yield blocks(pd.concat(held, ignore_index=True), out)
        finally:
            out.close()

    def blocks(rows: pd.DataFrame, out: Writer) -> pd.DataFrame:
        got = []
        for lo in range(0, len(rows), per_block):
            lines = list(rows.iloc[lo:lo + per_block].itertuples(index=False, name=None))
            got.append((lines[0][0], int(lines[0][1]), len(lines), *out.add(zlib.compress(json.dumps(lines).encode()))))
        return pd.DataFrame(got, columns=["first_key", "first_id", "n", "path", "offset", "length"])

    (found.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")
     .mapInPandas(cut, "first_key string, first_id long, n int, path string, offset long, length long")
     .write.parquet(f"{path}/directory"))
    return found.sparkSession.read.parquet(f"{path}/directory")


def _by_place(places: DataFrame, tasks: int) -> DataFrame:
    """Places in order, neighbours in one task."""
    return places.repartitionByRange(max(1, tasks), "path", "offset").sortWithinPartitions("path", "offset")


def look_up(requests: DataFrame, index: DataFrame, tasks: int = 1) -> DataFrame:
    """Places ``(path, offset, length)`` of all records with a requested
    ``(url, id)``; ``requests`` has these two columns. Only the blocks that
    may hold a request are read, each once by each of the ``tasks`` that its
    requests fall to."""
    # first keys only: about MAX_DIRECTORY rows at most
    directory = sorted(tuple(r) for r in index.select("first_key", "first_id", "path", "offset", "length").collect())
    firsts = [d[:2] for d in directory]

    def to_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, i in zip(pdf["url"], pdf["id"]):
                want = (reversed_host_key(url), _sort_id(i))
                # entries equal to the request may begin in the block before
                lo = max(0, bisect.bisect_left(firsts, want) - 1)
                rows += [(*directory[j][2:], *want) for j in range(lo, bisect.bisect_right(firsts, want))]
            yield pd.DataFrame(rows, columns=["path", "offset", "length", "key", "id"])

    def in_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges, held, keys, lines = Ranges(), None, [], []
        try:
            for pdf in batches:
                rows = []
                for path, offset, length, key, i in pdf.itertuples(index=False, name=None):
                    if (path, offset) != held:
                        lines = json.loads(zlib.decompress(ranges.read(path, offset, length)))
                        keys, held = [(x[0], x[1]) for x in lines], (path, offset)
                    want = (key, i)
                    rows += [tuple(lines[j][2:]) for j in range(bisect.bisect_left(keys, want), bisect.bisect_right(keys, want))]
                yield pd.DataFrame(rows, columns=["path", "offset", "length"])
        finally:
            ranges.close()

    asked = requests.select("url", F.col("id").cast("string").alias("id")).distinct() \
        .mapInPandas(to_blocks, "path string, offset long, length long, key string, id long")
    # records of one key and id stand next to each other, maybe in two blocks
    return _by_place(asked, tasks).mapInPandas(in_blocks, "path string, offset long, length long").distinct()


def read_records(places: DataFrame, tasks: int = 1) -> DataFrame:
    """``(id, url, record_type, refers_to, payload_bytes, payload_digest,
    payload)`` of the records at ``places``, read range by range."""
    cols = ["id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges = Ranges()
        try:
            for pdf in batches:
                for lo in range(0, len(pdf), 500):
                    rows = []
                    for path, at, n in pdf.iloc[lo:lo + 500].itertuples(index=False, name=None):
                        rec = gzip.decompress(ranges.read(path, at, n))
                        head, start, end = parse_record(rec, 0)
                        payload = rec[start:end]
                        revisit = head["WARC-Type"] == "revisit"
                        rows.append((_page(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"],
                                     _page(head["WARC-Refers-To"]) if revisit else None,
                                     int(head["X-Payload-Length"]) if revisit else len(payload),
                                     head["WARC-Payload-Digest"][5:] if revisit else hashlib.sha1(payload).hexdigest(),
                                     None if revisit else payload.decode()))
                    yield pd.DataFrame(rows, columns=cols).astype({"id": "Int64", "refers_to": "Int64"})
        finally:
            ranges.close()

    return _by_place(places, tasks).mapInPandas(
        read, "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string")


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives and their index below ``path``; returns the index's
    directory."""
    # not fewer than a join makes, which would deal the payloads out anew
    n = max(block_count(pages, F.octet_length(payload_col), TASK_BYTES),
            int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = write_archives(records(pages, n, id_col, url_col, payload_col), f"{path}/archives", archive_bytes)
    # the archives are written here, once; what sorts the entries reads the table
    found.write.parquet(f"{path}/entries")
    found = pages.sparkSession.read.schema(found.schema).parquet(f"{path}/entries")
    return build_index(found, f"{path}/index", found.count())


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive all pages, then read every one back through the index."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    index = archive(pages, path, id_col, url_col, payload_col, archive_bytes)
    n = block_count(pages, F.octet_length(payload_col), TASK_BYTES)
    url = F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A")
    # all copies of a request find the same records, so each is asked once
    asked = pages.select(url.alias("url"), F.col(id_col).cast("long").alias("id"))
    places = materialize(look_up(asked, index, n), "warc-places")
    return read_records(places, n)
