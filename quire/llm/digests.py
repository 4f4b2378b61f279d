"""Exact dedup by a tree merge of sorted digest runs.

1. Every row gets a *record*: SHA-256 and byte length of its text, its id and
   its row number. A task sorts the records that it reads and collapses equal
   digests: one *run*.
2. ``2 ** bits`` nodes merge the runs in binomial rounds. A run starts at the
   node that its number names; a round sends each node's run on in pieces, to
   the nodes that differ from it in the next few bits, each piece holding the
   digests that belong there. After the last round every bit has been
   exchanged and a node holds all there is of its range of digests.
3. Each node merges the sorted pieces that reach it, in every round. Records
   are one group only when they agree in the sort key *and* in all that
   verifies it (the other 192 bits of the digest and the byte length); of a
   group the record with the smallest (or largest) id stays, with the number
   of rows it stands for.
4. Groups of two and more rows are joined back to the rows.

A group of copies is one record per run from the first step on, however large
it is, and a node's share of the digests is bounded by ``NODE_BYTES``. Rows
are joined back by digest and the partition they were read in, so that the
rows of a crowded group do not meet in one task.

Defined results: a null text counts as empty; of rows that share text and id
one stays; a row with a null id stays only where all ids of its group are
null (``keep_id`` is null there); an empty table gives an empty result; other
columns are ignored, or carried along in ``carry``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import from_payload, give_back, materialize, to_payload

#: Digest records of one node, about.
NODE_BYTES = 16 << 20
RECORD_BYTES = 80
#: Bits of the node number that one round exchanges (16-way merges).
ROUND_BITS = 4
#: A task sorts this many records to a run.
RUN_ROWS = 1 << 18
KEYS = ["k0", "k1", "k2", "k3", "n_bytes"]
FIELDS = [*KEYS, "has_id", "id", "row", "n"]


def merge_runs(runs: list[dict[str, np.ndarray]], largest: bool) -> dict[str, np.ndarray]:
    """Sorted runs as one sorted run, equal texts collapsed to the record that
    stays. The sort finds the runs in its input and merges them."""
    t = {c: np.concatenate([r[c] for r in runs]) for c in FIELDS}
    order = np.argsort(t["k0"], kind="stable")
    differs = np.zeros(max(len(order) - 1, 0), bool)
    for c in KEYS[1:]:
        differs |= t[c][order][1:] != t[c][order][:-1]
    if (differs & (t["k0"][order][1:] == t["k0"][order][:-1])).any():
        # other texts under the same sort key: by all that verifies it
        order = np.lexsort([t[c] for c in reversed(KEYS)])
    t = {c: v[order] for c, v in t.items()}
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([t[c][1:] != t[c][:-1] for c in KEYS])
    group = np.cumsum(new) - 1
    # of each group: rows with an id first, then by id, then by row
    best = np.lexsort((t["row"], ~t["id"] if largest else t["id"], 1 - t["has_id"], group))
    n = np.zeros(int(new.sum()), np.int64)
    np.add.at(n, group, t["n"])
    out = {c: v[best][new] for c, v in t.items()}
    out["n"] = n
    return out


def _pieces(run: dict[str, np.ndarray], node: int, bits: int, done: int, step: int) -> Iterator[tuple[int, bytes]]:
    """The run of ``node`` in pieces for the nodes that differ from it in bits
    ``done .. done + step`` (from the top) of ``bits``."""
    if not step:
        yield node, to_payload(pa.table(run))
        return
    digit = ((run["k0"] >> np.uint64(64 - done - step)) & np.uint64((1 << step) - 1)).astype(np.int64)
    shift = bits - done - step
    for d in np.unique(digit):
        at = digit == d
        target = node & ~(((1 << step) - 1) << shift) | (int(d) << shift)
        yield target, to_payload(pa.table({c: v[at] for c, v in run.items()}))


def _records(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    t = pa.Table.from_batches([b])
    sha = np.frombuffer(b"".join(t["sha"].to_pylist()), ">u8").reshape(-1, 4)
    ids = t["id"]
    out = {f"k{i}": sha[:, i].astype(np.uint64) for i in range(4)}
    out |= {"n_bytes": t["n_bytes"].to_numpy(), "has_id": ids.is_valid().to_numpy().astype(np.int8),
            "id": ids.fill_null(0).to_numpy(), "row": t["row"].to_numpy(), "n": np.ones(len(t), np.int64)}
    return out


def merge_tree(records: DataFrame, bits: int, round_bits: int = ROUND_BITS, largest: bool = False) -> DataFrame:
    """``(sha, n_bytes, keep_id, keep_row, size)`` of the groups with two and
    more of the ``records (sha, n_bytes, id, row)``."""
    steps = [min(round_bits, bits - b) for b in range(0, bits, round_bits)] or [0]
    starts = [sum(steps[:i]) for i in range(len(steps))]

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(_records(b))
            # any number does that spreads runs over the nodes
            number = number or (int(held[-1]["row"][0]) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32
            size += b.num_rows
            if size >= RUN_ROWS:
                yield from emit(held, number)
                held, size, number = [], 0, number + 1
        yield from emit(held, number)

    def emit(held: list[dict[str, np.ndarray]], number: int) -> Iterator[pa.RecordBatch]:
        if held:
            run = merge_runs(held, largest)
            got = list(_pieces(run, number % (1 << bits), bits, 0, steps[0]))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int64()),
                                              pa.array([p for _, p in got], pa.binary())], names=["node", "run"])

    def merged(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        give_back()
        tables = [from_payload(p) for p in pdf["run"]]
        return merge_runs([{c: t[c].to_numpy() for c in FIELDS} for t in tables], largest)

    def exchange(done: int, step: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            got = list(_pieces(merged(pdf), int(pdf["node"].iloc[0]), bits, done, step))
            return pd.DataFrame(got, columns=["node", "run"])
        return run

    def root(pdf: pd.DataFrame) -> pd.DataFrame:
        t = merged(pdf)
        t = {c: v[t["n"] > 1] for c, v in t.items()}
        sha = np.stack([t[f"k{i}"] for i in range(4)], axis=1).astype(">u8").tobytes()
        return pd.DataFrame({"sha": [sha[32 * i:32 * i + 32] for i in range(len(t["n"]))], "n_bytes": t["n_bytes"],
                             "keep_id": pd.array(t["id"], dtype="Int64").copy() if t["has_id"].all() else
                             pd.array([int(i) if h else None for i, h in zip(t["id"], t["has_id"])], dtype="Int64"),
                             "keep_row": t["row"], "size": t["n"]})

    runs = records.mapInArrow(leaves, "node long, run binary")
    for done, step in list(zip(starts, steps))[1:]:
        runs = runs.groupBy("node").applyInPandas(exchange(done, step), "node long, run binary")
    return runs.groupBy("node").applyInPandas(root, "sha binary, n_bytes long, keep_id long, keep_row long, size long")


def node_bits(n_rows: int, cores: int) -> int:
    """Bits of the node number: a node's records stay below ``NODE_BYTES``,
    and tables of some size have work for every core."""
    nodes = max(-(-n_rows * RECORD_BYTES // NODE_BYTES), min(2 * cores, n_rows >> 10), 1)
    return (nodes - 1).bit_length()


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
           normalise: Callable[[Column], Column] = lambda text: text, carry: bool = False,
           bits: int | None = None, round_bits: int = ROUND_BITS) -> DataFrame:
    """Every row's group of equal texts: ``(<id_col>, keep_id, group_size,
    kept, text_sha256)``. ``keep`` names the id that stays (``smallest`` or
    ``largest``); ``normalise`` changes texts before they are compared. With
    ``carry`` all columns of the input come along in a struct ``carried``."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: smallest or largest, not {keep}")
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"),
                       F.octet_length(text).cast("long").alias("n_bytes"),
                       *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried")] * carry)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    if bits is None:
        bits = node_bits(rows.count(), rows.sparkSession.sparkContext.defaultParallelism)
    groups = merge_tree(rows.select("sha", "n_bytes", "id", "row"), bits, round_bits, keep == "largest")
    # a partition's rows carry its number in the high bits of their row number
    rows = rows.withColumn("part", F.shiftright("row", 33))
    of_part = rows.select("sha", "n_bytes", "part").distinct().join(groups, ["sha", "n_bytes"])
    got = rows.join(of_part, ["sha", "n_bytes", "part"], "left")
    alone = F.col("size").isNull()
    kind = docs.schema[id_col].dataType
    return got.select(F.col("id").cast(kind).alias(id_col),
                      F.when(alone, F.col("id")).otherwise(F.col("keep_id")).cast(kind).alias("keep_id"),
                      F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
                      (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"), *["carried"] * carry)


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, one of each text, with their columns."""
    got = copies(docs, id_col, text_col, keep, carry=True).filter("kept")
    return got.select("carried.*")
