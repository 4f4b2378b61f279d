"""Tables whose every change is one atomic step.

Parquet has no transaction: overwriting folders in place leaves a window in
which readers see half a change, and a job that dies there loses rows. A
versioned table never touches a file that a version names::

    base/data/commit=<number>-<id>/_kb=<bucket>/*.parquet    rows, by bucket of the key
    base/versions/<number>.json                              what the table is made of

A change writes its rows to a folder of its own, then a manifest to a
temporary file, then renames that to the next number. The rename is the
change: before it nothing has happened, after it everything has. It fails when
the number is taken (another job was first), and the change is then made again
on the newer version. Folders that a dead job left are named by no manifest;
``vacuum`` removes them with the versions that nobody needs any more.

A manifest lists for every bucket the commits that hold its rows, so a merge
rewrites the buckets it touches and takes over the others as they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.sinks import _file_system, key_bucket

#: How often a change is made again because another job was first.
ATTEMPTS = 20
#: Rows that a bucket is meant for when a table is made without a number.
BUCKET_ROWS = 2_000_000
MAX_BUCKETS = 4096
#: Buckets of a new table to which every task may write files of its own.
FEW_BUCKETS = 16


class Conflict(Exception):
    """Another job has published this version number."""


@dataclass(frozen=True)
class Version:
    """One state of a table."""
    number: int
    schema: T.StructType
    key: tuple[str, ...]
    buckets: int
    parts: dict[int, list[str]] = field(default_factory=dict)
    #: last batch that each named writer has published
    done: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"number": self.number, "schema": json.loads(self.schema.json()), "key": list(self.key),
                           "buckets": self.buckets, "parts": {str(b): c for b, c in self.parts.items()}, "done": self.done})

    @staticmethod
    def from_json(text: str) -> "Version":
        d = json.loads(text)
        return Version(d["number"], T.StructType.fromJson(d["schema"]), tuple(d["key"]), d["buckets"],
                       {int(b): c for b, c in d["parts"].items()}, d["done"])


def _numbers(spark: SparkSession, base: str) -> list[int]:
    fs, p = _file_system(spark, f"{base}/versions")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def version(spark: SparkSession, base: str, number: int | None = None) -> Version | None:
    """The newest state of the table (or state ``number``), None without one."""
    if number is None:
        have = _numbers(spark, base)
        if not have:
            return None
        number = have[-1]
    fs, p = _file_system(spark, f"{base}/versions/{number:012d}.json")
    stream = fs.open(p)
    try:
        return Version.from_json(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read(spark: SparkSession, base: str, at: Version | int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
    """The rows of a version (the newest by default), all or of some buckets.
    The version is fixed here: changes made later aren't seen."""
    v = at if isinstance(at, Version) else version(spark, base, at)
    if v is None:
        raise FileNotFoundError(f"{base} holds no version")
    wanted = v.parts if buckets is None else {b: v.parts[b] for b in buckets if b in v.parts}
    paths = [f"{base}/data/commit={c}/_kb={b}" for b, commits in wanted.items() for c in commits]
    if not paths:
        return spark.createDataFrame([], v.schema)
    return spark.read.schema(v.schema).option("basePath", f"{base}/data").parquet(*paths).select(*v.schema.names)


# the steps of a change, in order

def _write_rows(rows: DataFrame, base: str, commit: str, key: Sequence[str], buckets: int, as_dealt: bool = False) -> dict[int, list[str]]:
    """Rows into a folder of their own; the buckets that got any. ``as_dealt``:
    tasks write the rows that they hold, to any bucket."""
    spark = rows.sparkSession
    out = f"{base}/data/commit={commit}"
    rows = rows.withColumn("_kb", key_bucket(key, buckets))
    # a bucket goes to one task, or to several where it is large
    ((rows if as_dealt else rows.hint("rebalance", "_kb"))
     .write.mode("error").partitionBy("_kb").parquet(out))
    fs, p = _file_system(spark, out)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return {int(n[4:]): [commit] for n in names if n.startswith("_kb=")}


def _write_manifest(spark: SparkSession, base: str, v: Version) -> str:
    """The manifest under a name that no reader looks at."""
    tmp = f"{base}/versions/.{v.number}-{uuid.uuid4().hex}.tmp"
    fs, p = _file_system(spark, tmp)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(v.to_json().encode()))
    finally:
        stream.close()
    return tmp


def _publish(spark: SparkSession, base: str, tmp: str, number: int) -> None:
    """The step that makes the change: a rename that fails when the version
    exists."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    src, dst = hadoop.Path(tmp), hadoop.Path(f"{base}/versions/{number:012d}.json")
    try:
        hadoop.FileContext.getFileContext(src.toUri(), spark._jsc.hadoopConfiguration()).rename(src, dst, none)
    except Exception as ex:  # noqa: BLE001 - told apart by asking the file system
        fs, p = _file_system(spark, f"{base}/versions/{number:012d}.json")
        if fs.exists(p):
            raise Conflict(f"{base}: version {number} exists") from ex
        raise


def _commit(spark: SparkSession, base: str, v: Version) -> Version:
    _publish(spark, base, _write_manifest(spark, base, v), v.number)
    return v


def _new_commit(number: int) -> str:
    return f"{number:012d}-{uuid.uuid4().hex[:12]}"


def default_buckets(rows: int) -> int:
    return max(1, min(MAX_BUCKETS, -(-rows // BUCKET_ROWS)))


def _already(v: Version | None, writer: str | None, batch: int | None) -> bool:
    return v is not None and writer is not None and batch is not None and v.done.get(writer, -1) >= batch


def _done(v: Version | None, writer: str | None, batch: int | None) -> dict[str, int]:
    return {**(v.done if v else {}), **({writer: batch} if writer is not None and batch is not None else {})}


def overwrite(rows: DataFrame, base: str, key: Sequence[str], buckets: int | None = None) -> Version:
    """``rows`` become the table, whatever it held. ``rows`` may read the
    table itself: its files stay."""
    spark = rows.sparkSession
    buckets = buckets or default_buckets(rows.count())
    commit = None
    for _ in range(ATTEMPTS):
        v = version(spark, base)
        number = v.number + 1 if v else 1
        if commit is None:
            commit = _new_commit(number)
            parts = _write_rows(rows, base, commit, key, buckets)
        try:
            return _commit(spark, base, Version(number, rows.schema, tuple(key), buckets, parts, _done(v, None, None)))
        except Conflict:
            continue
    raise Conflict(f"{base}: {ATTEMPTS} attempts")


def append(rows: DataFrame, base: str, key: Sequence[str], buckets: int | None = None,
           writer: str | None = None, batch: int | None = None) -> Version:
    """``rows`` are added to the table (made when missing). A ``batch`` that
    the named ``writer`` has published before adds nothing."""
    spark = rows.sparkSession
    commit = None
    for _ in range(ATTEMPTS):
        v = version(spark, base)
        if _already(v, writer, batch):
            return v
        n = v.buckets if v else buckets or default_buckets(rows.count())
        number = v.number + 1 if v else 1
        if commit is None or n != of:
            commit, of = _new_commit(number), n
            parts = _write_rows(rows.select(*v.schema.names) if v else rows, base, commit, key, n)
        both = {b: (v.parts.get(b, []) if v else []) + parts.get(b, []) for b in {*(v.parts if v else ()), *parts}}
        try:
            return _commit(spark, base, Version(number, v.schema if v else rows.schema, tuple(key), n, both, _done(v, writer, batch)))
        except Conflict:
            continue
    raise Conflict(f"{base}: {ATTEMPTS} attempts")


def rewrite(spark: SparkSession, base: str, change: Callable[[DataFrame], DataFrame], buckets: int | None = None) -> Version:
    """``change(rows)`` become the table, made from exactly the version that
    they replace: when another job is first, ``change`` starts again."""
    for _ in range(ATTEMPTS):
        v = version(spark, base)
        if v is None:
            raise FileNotFoundError(f"{base} holds no version")
        rows = change(read(spark, base, v))
        n = buckets or v.buckets
        parts = _write_rows(rows, base, _new_commit(v.number + 1), v.key, n)
        try:
            return _commit(spark, base, Version(v.number + 1, rows.schema, v.key, n, parts, v.done))
        except Conflict:
            continue
    raise Conflict(f"{base}: {ATTEMPTS} attempts")


def merge(batch_rows: DataFrame, base: str, key: Sequence[str], combine: Callable[[DataFrame, DataFrame], DataFrame],
          buckets: int | None = None, writer: str | None = None, batch: int | None = None) -> Version | None:
    """``combine(stored rows, batch rows)`` for the buckets of the batch; the
    others are taken over as they are. A missing table starts with no rows of
    the batch's columns. ``combine`` must give the same when rows come in that
    it has combined before, so that a replay changes nothing. The batch is kept
    while it is read several times; that of a missing table with a given number
    of ``buckets`` is read once, and isn't."""
    spark = batch_rows.sparkSession
    cur, kept = batch_rows, False
    try:
        for _ in range(ATTEMPTS):
            v = version(spark, base)
            if _already(v, writer, batch):
                return v
            once = v is None and bool(buckets)
            if not once and not kept:
                cur, kept = batch_rows.persist(StorageLevel.MEMORY_AND_DISK), True
            n = v.buckets if v else buckets or default_buckets(cur.count())
            if not once:
                touched = [r[0] for r in cur.select(key_bucket(key, n)).distinct().collect()]  # at most n
                if not touched:
                    return v
            stored = read(spark, base, v, touched) if v else spark.createDataFrame([], cur.schema)
            merged = combine(stored, cur)
            merged = merged.select(*v.schema.names) if v else merged
            parts = _write_rows(merged, base, _new_commit(v.number + 1 if v else 1), key, n, once and n <= FEW_BUCKETS)
            if once:
                touched = list(parts)
                if not touched and cur.isEmpty():
                    return v
            rest = {b: c for b, c in v.parts.items() if b not in touched} if v else {}
            new = Version(v.number + 1 if v else 1, v.schema if v else merged.schema, tuple(key), n, {**rest, **parts},
                          _done(v, writer, batch))
            try:
                return _publish_or_rebase(spark, base, v, new, touched)
            except Conflict:
                continue
    finally:
        if kept:
            cur.unpersist()
    raise Conflict(f"{base}: {ATTEMPTS} attempts")


def _publish_or_rebase(spark: SparkSession, base: str, old: Version | None, new: Version, touched: list[int]) -> Version:
    """Publish ``new``; when other jobs were first but left its buckets alone,
    their changes are taken over and the rows written here still hold."""
    for _ in range(ATTEMPTS):
        try:
            return _commit(spark, base, new)
        except Conflict:
            now = version(spark, base)
            same = old is not None and now.buckets == new.buckets and all(
                now.parts.get(b) == old.parts.get(b) for b in touched)
            if not same:
                raise
            rest = {b: c for b, c in now.parts.items() if b not in touched}
            mine = {b: c for b, c in new.parts.items() if b in touched}
            new = replace(new, number=now.number + 1, parts={**rest, **mine}, done={**now.done, **new.done})
    raise Conflict(base)


def vacuum(spark: SparkSession, base: str, keep: int = 3) -> int:
    """Remove versions but the newest ``keep``, and rows that those don't
    name. Folders of changes still being made (of a higher number than the
    oldest kept version) stay. Returns how many folders went."""
    numbers = _numbers(spark, base)
    if len(numbers) <= keep:
        return 0
    kept = [version(spark, base, n) for n in numbers[-keep:]]
    named = {(c, b) for v in kept for b, commits in v.parts.items() for c in commits}
    fs, p = _file_system(spark, f"{base}/data")
    gone = 0
    # manifests first: none may name a folder that is no more
    for n in numbers[:-keep]:
        fs.delete(_file_system(spark, f"{base}/versions/{n:012d}.json")[1], False)
    for s in fs.listStatus(p):
        commit = s.getPath().getName().removeprefix("commit=")
        if int(commit.split("-")[0]) > kept[0].number:
            continue
        inside = [x.getPath() for x in fs.listStatus(s.getPath())]
        buckets = [x for x in inside if x.getName().startswith("_kb=")]
        drop = [x for x in buckets if (commit, int(x.getName()[4:])) not in named]
        for x in drop:
            fs.delete(x, True)
        gone += len(drop)
        if len(drop) == len(buckets):
            fs.delete(s.getPath(), True)
    return gone
