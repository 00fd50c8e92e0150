"""Questions of groups of documents, answered by buckets that hear all groups.

Documents are dealt to groups of bounded text by row, whatever their ids or texts, so that no group is hot. A group
asks about its distinct keys, hashes of 64 bits: each key's upper half chooses the bucket, its lower half is sent, in
ascending order. A bucket answers with a bit per key that it was sent, in the same order, so an answer is a few bytes;
the group finds the same keys again from its texts, in whatever order its rows arrive. Different hashes that share
bucket and lower half are asked as one key: what is decided from the bits alone may only ever let through too much.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import U, column
from ._util import dealt_by, fresh, groups_for, text_bytes

_LOW = U(0xFFFFFFFF)
ASKED = "bucket long, pid long, keys binary, counts binary"
_ASKED = pa.schema([("bucket", pa.int64()), ("pid", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERED = "pid long, stage int, bucket long, bits binary"
_ANSWERED = pa.schema([("pid", pa.int64()), ("stage", pa.int32()), ("bucket", pa.int64()), ("bits", pa.binary())])


def dealt(docs: DataFrame, each: int) -> tuple[DataFrame, str, int]:
    """``docs`` in groups of about ``each`` bytes of text, the group's column and the number of groups. Rows are dealt by
    their place in the input, so rows without id or with equal texts are spread like any others."""
    n = groups_for(text_bytes(docs), each)
    name = fresh("group", docs)
    return dealt_by(docs.withColumn(name, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))), name, n), name, n


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> U(32)) * U(n) >> U(32)).astype(np.int64)


def asked_keys(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket in the upper half, the hash's lower half below it."""
    return (((hashes >> U(32)) * U(n)) & ~_LOW) | (hashes & _LOW)


def parts(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """Bucket, first and end of each run of ascending buckets."""
    if not len(buckets):
        return []
    first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    return list(zip(buckets[first].tolist(), first.tolist(), np.append(first[1:], len(buckets)).tolist(), strict=True))


def compressed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def expanded(value: pa.Scalar, kind: str) -> np.ndarray:
    buffer = value.as_buffer()
    size = int.from_bytes(buffer[:8].to_pybytes(), "little")
    return np.frombuffer(pa.Codec("zstd").decompress(buffer[8:], size), kind) if size else np.zeros(0, kind)


def among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ascending, values)
    at[at == len(ascending)] = 0
    return ascending[at] == values


def question(pid: int, keys: np.ndarray, counts: np.ndarray, earlier: pa.Table | None = None) -> pa.Table:
    """Rows for the buckets of ascending distinct asked keys. Answers to earlier questions go along, to come back with
    those to this one, in a row whose bucket (below 0) no other group sends to."""
    rows = [(b, pid, compressed((keys[i:j] & _LOW).astype("<u4").tobytes()), compressed(counts[i:j].astype("<u4").tobytes())) for b, i, j in parts((keys >> U(32)).astype(np.int64))]
    if earlier is not None and earlier.num_rows:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _ANSWERED) as writer:
            writer.write_table(pa.table([column(earlier, n) for n in _ANSWERED.names], schema=_ANSWERED))
        rows.append((-1 - pid, pid, sink.getvalue().to_pybytes(), b""))
    return pa.table([list(c) for c in zip(*rows, strict=True)], schema=_ASKED) if rows else _ASKED.empty_table()


def answer(pids: list[int], numbers: list[int], yes: np.ndarray, stage: int, bucket: int) -> pa.Table:
    """Rows for the groups: the bits of what each of them asked, one after the other; none where all are unset."""
    rows, done = [], 0
    for pid, n in zip(pids, numbers, strict=True):
        if (bits := yes[done : done + n]).any():
            rows.append((pid, stage, bucket, np.packbits(bits).tobytes()))
        done += n
    return pa.table([list(c) for c in zip(*rows, strict=True)], schema=_ANSWERED) if rows else _ANSWERED.empty_table()


def counted(stage: int, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    """A bucket's answers: ``chosen(total count, number of groups)`` of each key."""

    def run(group: pa.Table) -> pa.Table:
        if column(group, "bucket")[0].as_py() < 0:
            return pa.concat_tables(pa.ipc.open_stream(k.as_buffer()).read_all() for k in column(group, "keys"))
        keys = [expanded(k, "<u4") for k in column(group, "keys")]
        counts = np.concatenate([expanded(c, "<u4") for c in column(group, "counts")]).astype(np.int64)
        distinct, code = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, code, counts)
        yes = chosen(total, np.bincount(code, minlength=len(distinct)))[code]
        return answer(column(group, "pid").to_pylist(), [len(k) for k in keys], yes, stage, column(group, "bucket")[0].as_py())

    return run


def answered(answers: pa.Table, stage: int, buckets: np.ndarray) -> np.ndarray:
    """The answers to a group's keys of ascending ``buckets``."""
    yes = np.zeros(len(buckets), bool)
    stages, numbers, bits = column(answers, "stage").to_numpy(), column(answers, "bucket").to_numpy(), column(answers, "bits")
    mine = np.flatnonzero(stages == stage)
    at = {int(numbers[i]): int(i) for i in mine}
    for b, i, j in parts(buckets):
        if b in at:
            yes[i:j] = np.unpackbits(np.frombuffer(bits[at[b]].as_buffer(), np.uint8), count=j - i) > 0
    return yes
