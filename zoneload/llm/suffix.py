"""Removal of passages that an earlier document has too, by sorted suffixes.

A byte goes if a window of ``WINDOW`` bytes that covers it also starts in a document with a smaller id. Windows
are judged on the input, as bytes of UTF-8, and never reach over two documents.

Every window has a key, the least hash of the ``GRAM``-byte grams in it, so equal windows have equal keys and
neighbouring windows mostly share one: a maximal run of windows of one key is a passage of some 60 bytes.
 1. Documents are dealt by row to groups of bounded size; each sends its distinct keys to the keys' buckets.
 2. A bucket returns to each group those of its keys that more documents than one have.
    Keys whose distinct passages (summed over groups) exceed ``KEY_BYTES``, such as those of a short line among ever
    other words, are returned as heavy: each window of theirs gets a key of its own, the hash of its bytes, and only
    windows that more documents than one have are kept, by a second round of 1 and 2.
 3. Groups send the passages of such keys, each distinct one once, with the least id of a document that has it. A
    window of a heavy key is a passage of its own.
 4. A bucket sorts the suffixes of its passages in two stages: suffixes smaller than their successors are sorted
    directly, the others are induced from them by a scan over the buckets of first bytes; adjacent suffixes with a
    common prefix of at least ``WINDOW`` bytes are equal windows, and the least id among them goes back to the groups.
 5. Groups mark windows whose least id is smaller than the document's own, and cut out what they cover.
A passage or document that a third of all rows share is sent once per group, not once per row.

Equal passages of several groups are told by a 64-bit hash of bytes and key, and only within a key's bucket: with n
distinct passages in a bucket two different ones meet by chance with a probability of some n * n / 2^65, which is
1e-8 for the half million that a bucket of the usual size holds. Windows themselves are compared byte by byte, but
for those of heavy keys, whose hash of 64 bits stands for their 50 bytes in the choice of what is sent.

Cases: a null text is empty; texts shorter than the window stay; a row without id stays whole and removes nothing
elsewhere; rows with the same id don't remove each other's text; an empty table gives no row. Where a cut leaves parts
of a character, ``trimmed`` drops those bytes from the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._exchange import dealt
from ._text import U, Block, blocks, column, mix

WINDOW, GRAM = 50, 20
GROUP_BYTES = 8 << 20
#: Distinct passages of a key, in bytes, beyond which its windows are told apart by their own hashes.
KEY_BYTES = 1 << 20
#: What a key without a weight of its own counts for in a group: a passage has mostly no more bytes.
_PASSAGE_BYTES = 128
_DEPTH = 56
#: Suffixes of longer runs of one byte are induced a run at a time.
_SHORT_RUN = 6
_UPPER = ~U(0xFFFF)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each ``GRAM`` (16 + 4) bytes, by doubling."""
    h = data.astype(U) + U(1)
    four = None
    for i, step in enumerate((1, 2, 4, 8)):
        h = h[:-step] * U(0x9E3779B97F4A7C15 ^ (i * 0x1234567890ABCDE << 1)) + h[step:]
        if step == 2:
            four = h
    return mix(h[: len(data) - GRAM + 1] * U(0xD6E8FEB86659FD93) + four[16 : 16 + len(data) - GRAM + 1])


def runs(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and key of each run."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    if len(block.data) < WINDOW:
        return none
    low = gram_hashes(block.data)
    span = WINDOW - GRAM + 1
    step = 1
    while 2 * step <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: len(block.data) - WINDOW + 1], low[span - step : span - step + len(block.data) - WINDOW + 1])
    inside = np.zeros(len(low) + 1, np.int8)
    sizes = np.diff(block.offsets)
    long = sizes >= WINDOW
    np.add.at(inside, block.offsets[:-1][long], 1)
    np.add.at(inside, block.offsets[1:][long] - WINDOW + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    change = np.ones(len(low), bool)
    change[1:] = low[1:] != low[:-1]
    change[block.offsets[:-1][long]] = True
    change[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(low)))
    keep = inside[first]
    first, count = first[keep], count[keep]
    # Least hashes are small numbers; mixed, they spread evenly over buckets.
    return first, count, mix(low[first] + U(1))


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> U(32)) * U(n) >> U(32)).astype(np.int64)


def _split(sorted_keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Bucket, first and end of the non-empty parts of ascending keys."""
    bucket = _bucket(sorted_keys, n)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return list(zip(bucket[first].tolist(), first.tolist(), np.append(first[1:], len(bucket)).tolist(), strict=True))


def _packed(keys: np.ndarray) -> bytes:
    """The upper six bytes of each key. Keys that differ below them meet, which costs some work and changes nothing."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _unpacked(value: pa.Scalar) -> np.ndarray:
    six = np.frombuffer(value.as_buffer(), np.uint8).reshape(-1, 6)
    eight = np.zeros((len(six), 8), np.uint8)
    eight[:, 2:] = six
    return eight.view("<u8").ravel().astype(U)


def _compressed(text: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(text, asbytes=True)


def _decompressed(value: pa.Scalar, size: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(value.as_buffer(), size), np.uint8)


def _rows_with_id(block: Block) -> np.ndarray:
    return np.asarray(column(block.batch, "doc_id").is_valid())


def two_stage(data: np.ndarray) -> np.ndarray:
    """The suffix array of ``data``, exact to at least the first ``_DEPTH`` bytes."""
    n = len(data)
    differs = np.flatnonzero(data[:-1] != data[1:])
    at = np.searchsorted(differs, np.arange(n))
    smaller = np.zeros(n, bool)  # than its successor
    some = at < len(differs)
    following = differs[at[some]]
    smaller[some] = data[following] < data[following + 1]
    direct = _sorted_directly(data, np.flatnonzero(smaller))
    bounds = np.searchsorted(data[direct], np.arange(257))
    # Where runs of one byte begin: a run's suffixes are all smaller than their successors, or none is.
    begins = np.concatenate([[0], differs + 1])
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        parts, repeat = [], np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        while len(repeat):  # suffixes cc... follow from those with one c less
            if len(parts) == _SHORT_RUN:  # what is left are long runs: each at once, its shorter suffixes first
                length = repeat - begins[np.searchsorted(begins, repeat, "right") - 1] + 1
                back = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                parts.append((np.repeat(repeat, length) - back)[np.argsort(back, kind="stable")])
                break
            parts.append(repeat)
            before = repeat[repeat > 0] - 1
            repeat = before[(data[before] == c) & ~smaller[before]]
        parts.append(direct[bounds[c] : bounds[c + 1]])
        suffixes = np.concatenate(parts)
        out.append(suffixes)
        before = suffixes[suffixes > 0] - 1
        before = before[(data[before] > c) & ~smaller[before]]
        letters = data[before]
        order = np.argsort(letters, kind="stable")
        letters, before = letters[order], before[order]
        for letter, part in zip(np.unique(letters), np.split(before, np.flatnonzero(letters[1:] != letters[:-1]) + 1), strict=False):
            waiting[letter].append(part)
    return np.concatenate(out)


def _word(padded: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number of the same order."""
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    return np.ascontiguousarray(view[positions]).view(">u8").ravel().astype(U)


def _sorted_directly(data: np.ndarray, positions: np.ndarray) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(_DEPTH + 8, np.uint8)])
    key = _word(padded, positions)
    order = np.argsort(key, kind="stable")
    positions, key = positions[order], key[order]
    same = np.concatenate([[False], key[1:] == key[:-1]]) if len(key) else np.zeros(0, bool)
    for depth in range(8, _DEPTH, 8):
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(~same)[at]
        key = _word(padded, positions[at] + depth)
        order = np.lexsort((key, group))
        positions[at] = positions[at][order]
        key = key[order]
        again = same[at]
        again[1:] &= key[1:] == key[:-1]
        same[at] = again
    return positions


def least_ids(passages: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every window of the concatenated passages, passage by passage: the least id of a passage that has it."""
    begin = np.cumsum(sizes) - sizes
    count = sizes - WINDOW + 1
    window = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    slot = np.full(len(passages), -1, np.int64)
    slot[window] = np.arange(len(window))
    order = two_stage(passages)
    order = order[slot[order] >= 0]
    padded = np.concatenate([passages, np.zeros(_DEPTH + 8, np.uint8)])
    equal = np.ones(max(0, len(order) - 1), bool)
    for depth in (0, 8, 16, 24, 32, 40, WINDOW - 8):  # the last two overlap
        at = np.flatnonzero(equal)
        equal[at] = _word(padded, order[at] + depth) == _word(padded, order[at + 1] + depth)
    first = np.flatnonzero(np.concatenate([[True], ~equal]))
    own = np.repeat(ids, count)
    ranked = own[slot[order]]
    least = np.repeat(np.minimum.reduceat(ranked, first), np.diff(np.append(first, len(order))))
    out = np.empty(len(window), np.int64)
    out[slot[order]] = least
    return out


def _split_windows(block: Block, heavy: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """First window, number of windows, key and row of the runs of rows with an id, and of each window of heavy keys."""
    first, count, key = runs(block)
    row = block.row_of(first)
    fine = _rows_with_id(block)[row]
    first, count, key, row = first[fine], count[fine], key[fine], row[fine]
    split = _among(key & _UPPER, heavy)
    n = count[split]
    window = np.repeat(first[split] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    own = mix(block.span_hash(block.prefix(), window, window + WINDOW) + U(1)) if len(window) else np.zeros(0, U)
    return (first[~split], count[~split], key[~split], row[~split]), (window, np.ones(len(window), np.int64), own, np.repeat(row[split], n))


def pieces(block: Block, heavy: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs and windows of heavy keys together."""
    return tuple(np.concatenate(p) for p in zip(*_split_windows(block, heavy), strict=True))


def _weights(key: np.ndarray, uid: np.ndarray, size: np.ndarray) -> np.ndarray:
    """By ascending key: bytes of its distinct passages."""
    order = np.lexsort((uid, key))
    key, uid, size = key[order], uid[order], size[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    new = first.copy()
    new[1:] |= uid[1:] != uid[:-1]
    return np.add.reduceat(np.where(new, size, 0), np.flatnonzero(first))


_KEYS = pa.schema([("bucket", pa.int64()), ("pid", pa.int64()), ("keys", pa.binary()), ("several", pa.binary()), ("at", pa.binary()), ("weights", pa.binary())])


def _key_rows(group: pa.Table, name: str, heavy: np.ndarray | None, n_buckets: int) -> pa.Table:
    """A group's distinct keys by bucket, with the weights of those that aren't small; or those of its heavy windows."""
    keys, several = [np.zeros(0, U)], [np.zeros(0, bool)]
    passages: list[tuple] = []
    for block in blocks(group):
        first, count, key, row = _split_windows(block, np.zeros(0, U))[0] if heavy is None else _split_windows(block, heavy)[1]
        if heavy is None:
            passages.append((key & _UPPER, _passage_id(block, first, count, key), count + WINDOW - 1))
        key = key & _UPPER
        order = np.lexsort((row, key))
        key, row = key[order], row[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        other = np.concatenate([[False], (key[1:] == key[:-1]) & (row[1:] != row[:-1])]) if len(key) else new
        at = np.flatnonzero(new)
        keys.append(key[at])
        several.append(np.add.reduceat(other, at) > 0 if len(at) else other)
    key, flag = np.concatenate(keys), np.concatenate(several)
    if not len(key):
        return _KEYS.empty_table()
    order = np.argsort(key, kind="stable")
    key, flag = key[order], flag[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    many = (np.diff(np.append(new, len(key))) > 1) | (np.add.reduceat(flag.astype(np.int64), new) > 0)
    key = key[new]
    weight = _weights(*(np.concatenate(p) for p in zip(*passages, strict=True))) if heavy is None else np.zeros(len(key), np.int64)
    pid = column(group, name)[0].as_py()
    rows = []
    for b, i, j in _split(key, n_buckets):
        at = np.flatnonzero(weight[i:j] > _PASSAGE_BYTES)
        rows.append((b, pid, _packed(key[i:j]), np.packbits(many[i:j]).tobytes(), at.astype("<u4").tobytes(), weight[i:j][at].astype("<i8").tobytes()))
    return pa.table([list(c) for c in zip(*rows, strict=True)], schema=_KEYS)


def _keys(name: str, n_buckets: int):
    return lambda group: _key_rows(group, name, None, n_buckets)


def _listed(table: pa.Table, name: str) -> np.ndarray:
    """Ascending keys of a column of packed ones."""
    return np.sort(np.concatenate([np.zeros(0, U), *[_unpacked(k) for k in column(table, name)]]))


def _window_keys(name: str, n_buckets: int):
    def run(group: pa.Table, listed: pa.Table) -> pa.Table:
        heavy = _listed(listed, "heavy")
        return _key_rows(group, name, heavy, n_buckets) if len(heavy) else _KEYS.empty_table()

    return run


_SHARED = pa.schema([("pid", pa.int64()), ("keys", pa.binary()), ("heavy", pa.binary())])


def _shared(limit: float):
    def run(group: pa.Table) -> pa.Table:
        """A bucket's keys of several documents, by group; those beyond the limit apart."""
        pids = column(group, "pid").to_pylist()
        keys = [_unpacked(k) for k in column(group, "keys")]
        many = np.concatenate([np.unpackbits(np.frombuffer(s.as_buffer(), np.uint8), count=len(k)) for s, k in zip(column(group, "several"), keys, strict=True)]) > 0
        _, code, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        often = counts > 1
        often[code[many]] = True
        ends = np.cumsum([len(k) for k in keys])
        weight = counts * _PASSAGE_BYTES
        for begin, at, w in zip([0, *ends[:-1].tolist()], column(group, "at"), column(group, "weights"), strict=True):
            np.add.at(weight, code[begin + np.frombuffer(at.as_buffer(), "<u4").astype(np.int64)], np.frombuffer(w.as_buffer(), "<i8") - _PASSAGE_BYTES)
        beyond = often & (weight > limit)
        light, heavy = (np.split(f[code], ends[:-1]) for f in (often & ~beyond, beyond))
        rows = [(pid, _packed(k[f]), _packed(k[h])) for pid, k, f, h in zip(pids, keys, light, heavy, strict=True) if f.any() or h.any()]
        return pa.table([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 3, schema=_SHARED)

    return run


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ascending, values)
    at[at == len(ascending)] = 0
    return ascending[at] == values


def _passage_id(block: Block, first: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(block.span_hash(block.prefix(), first, first + count + WINDOW - 1) ^ key)


def _passages(name: str, n_buckets: int):
    schema = pa.schema([(n, pa.int64()) for n in ("bucket", "pid")] + [(n, pa.binary()) for n in ("passages", "sizes", "uids", "ids", "several")])

    def run(group: pa.Table, listed: pa.Table) -> pa.Table:
        known, heavy = _listed(listed, "keys"), _listed(listed, "heavy")
        parts: list[tuple] = []
        for block in blocks(group):
            first, count, key, row = pieces(block, heavy)
            at = np.flatnonzero(_among(key & _UPPER, known))
            first, count, key, row = first[at], count[at], key[at], row[at]
            ids = column(block.batch, "doc_id").fill_null(0).to_numpy(zero_copy_only=False)[row]
            uid = _passage_id(block, first, count, key)
            order = np.lexsort((ids, uid))
            new = np.flatnonzero(np.concatenate([[True], uid[order][1:] != uid[order][:-1]])) if len(uid) else np.zeros(0, np.int64)
            last = order[np.append(new[1:], len(order)) - 1] if len(new) else new
            lead = order[new]
            size = count[lead] + WINDOW - 1
            body = block.data[np.repeat(first[lead] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            parts.append((key[lead], uid[lead], ids[lead], ids[last] != ids[lead], size, body))
        if not parts or not sum(len(p[0]) for p in parts):
            return schema.empty_table()
        key, uid, ids, several, size, body = (np.concatenate(p) for p in zip(*parts, strict=True))
        begin = np.cumsum(size) - size
        order = np.lexsort((ids, uid, key))
        new = np.concatenate([[True], uid[order][1:] != uid[order][:-1]])
        lead = order[new]
        at = np.flatnonzero(new)
        any_several = (np.add.reduceat(several[order].astype(np.int64), at) > 0) | (np.maximum.reduceat(ids[order], at) != ids[lead])
        key = key[lead]
        pid = column(group, name)[0].as_py()
        rows = []
        for b, i, j in _split(key, n_buckets):
            some = lead[i:j]
            text = b"".join(body[s : s + n].tobytes() for s, n in zip(begin[some].tolist(), size[some].tolist(), strict=True))
            rows.append((b, pid, _compressed(text), size[some].astype("<u4").tobytes(), uid[some].tobytes(), ids[some].tobytes(), any_several[i:j].tobytes()))
        return pa.table([list(c) for c in zip(*rows, strict=True)], schema=schema)

    return run


_LEAST = pa.schema([("pid", pa.int64()), ("uids", pa.binary()), ("parts", pa.binary()), ("lengths", pa.binary()), ("least", pa.binary())])


def _least(group: pa.Table) -> pa.Table:
    """Sort a bucket's suffixes; each group gets its passages' windows as stretches of one least id."""
    pids = column(group, "pid").to_pylist()
    read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in column(group, name)]
    uids, ids, sizes, several = read("uids", U), read("ids", np.int64), read("sizes", "<u4"), read("several", bool)
    numbers = [len(u) for u in uids]
    lengths = [int(n.sum(dtype=np.int64)) for n in sizes]
    body = np.concatenate([_decompressed(x, n) for x, n in zip(column(group, "passages"), lengths, strict=True)])
    uid, own, size, many = np.concatenate(uids), np.concatenate(ids), np.concatenate(sizes).astype(np.int64), np.concatenate(several)
    begin = np.cumsum(size) - size
    order = np.lexsort((own, uid))
    new = np.concatenate([[True], uid[order][1:] != uid[order][:-1]])
    lead = order[new]
    of = np.empty(len(uid), np.int64)
    of[order] = np.cumsum(new) - 1
    kept = size[lead]
    text = body[np.repeat(begin[lead] - (np.cumsum(kept) - kept), kept) + np.arange(kept.sum())]
    least = least_ids(text, kept, own[lead])
    count = kept - WINDOW + 1
    start = np.cumsum(count) - count
    change = np.concatenate([[True], least[1:] != least[:-1]])
    change[start] = True
    stretch = np.flatnonzero(change)
    length = np.diff(np.append(stretch, len(least)))
    value = least[stretch]
    first = np.searchsorted(stretch, start)
    parts = np.diff(np.append(first, len(stretch)))
    smallest = np.minimum.reduceat(value, first)
    tell = many | (smallest[of] < own)
    rows, done = [], 0
    for pid, n in zip(pids, numbers, strict=True):
        at = done + np.flatnonzero(tell[done : done + n])
        done += n
        if not len(at):
            continue
        p = parts[of[at]]
        pick = np.repeat(first[of[at]] - (np.cumsum(p) - p), p) + np.arange(p.sum())
        rows.append((pid, uid[at].tobytes(), p.astype("<u4").tobytes(), length[pick].astype("<u4").tobytes(), value[pick].tobytes()))
    return pa.table([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5, schema=_LEAST)


def removed(block: Block, uids: np.ndarray, parts: np.ndarray, lengths: np.ndarray, least: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Marks of the block's bytes that go. uids and heavy keys ascend; the stretches of the i-th uid are parts[i], one after the other."""
    gone = np.zeros(len(block.data) + 1, np.int64)
    if len(uids):
        first, count, key, row = pieces(block, heavy)
        uid = _passage_id(block, first, count, key)
        hit = np.flatnonzero(_among(uid, uids))
        at = np.searchsorted(uids, uid[hit])
        ids = column(block.batch, "doc_id").fill_null(0).to_numpy(zero_copy_only=False)[row[hit]]
        p = parts[at]
        begin = (np.cumsum(parts) - parts)[at]
        pick = np.repeat(begin - (np.cumsum(p) - p), p) + np.arange(p.sum())
        size = lengths[pick]
        # A stretch starts where those before it in its passage end.
        upto = np.cumsum(size) - size
        head = np.cumsum(p) - p
        start = np.repeat(first[hit], p) + upto - np.repeat(upto[head] if len(head) else head, p)
        smaller = least[pick] < np.repeat(ids, p)
        np.add.at(gone, start[smaller], 1)
        np.add.at(gone, (start + size + WINDOW - 1)[smaller], -1)
    return np.cumsum(gone)[:-1] > 0


def _results(found: pa.Table) -> tuple[np.ndarray, ...]:
    read = lambda name, kind: np.concatenate([np.zeros(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x in column(found, name)]])
    uids, parts, lengths, least = read("uids", U), read("parts", "<u4").astype(np.int64), read("lengths", "<u4").astype(np.int64), read("least", np.int64)
    order = np.argsort(uids, kind="stable")
    begin = (np.cumsum(parts) - parts)[order]
    p = parts[order]
    pick = np.repeat(begin - (np.cumsum(p) - p), p) + np.arange(p.sum())
    return uids[order], p, lengths[pick], least[pick], _listed(found, "heavy")


def _cut(fields: list[T.StructField], summary: bool):
    def run(group: pa.Table, found: pa.Table) -> pa.Table:
        known = _results(found)
        out: dict[str, list] = {}
        for block in blocks(group):
            gone = removed(block, *known)
            total = np.concatenate([[0], np.cumsum(gone)])
            edge = gone & ~np.concatenate([[False], gone[:-1]])
            edge[block.offsets[:-1][np.diff(block.offsets) > 0]] = gone[block.offsets[:-1][np.diff(block.offsets) > 0]]
            spans = np.concatenate([[0], np.cumsum(edge)])
            left, right = block.offsets[:-1], block.offsets[1:]
            texts = [block.data[a:b][~gone[a:b]].tobytes() for a, b in zip(left.tolist(), right.tolist(), strict=True)]
            if summary:
                values = {"doc_id": column(block.batch, "doc_id"), "n_bytes": pa.array(right - left), "n_removed": pa.array(total[right] - total[left]), "n_spans": pa.array(spans[right] - spans[left]), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts])}
            else:
                whole = total[right] == total[left]
                before = column(block.batch, "text")
                kept = [before[i].as_py() if w else t.decode("utf-8", "ignore") for i, (w, t) in enumerate(zip(whole.tolist(), texts, strict=True))]
                values = {f.name: column(block.batch, f.name) for f in fields if f.name != "text"} | {"text": pa.array(kept, pa.string())}
            for name, value in values.items():
                out.setdefault(name, []).append(value)
        return pa.table({f.name: pa.chunked_array(out[f.name]) for f in fields}) if out else pa.table({f.name: [] for f in fields})

    return run


_KEYS_DDL, _SHARED_DDL = "bucket long, pid long, keys binary, several binary, at binary, weights binary", "pid long, keys binary, heavy binary"


def _sent(groups: DataFrame, name: str, n_groups: int) -> tuple[DataFrame, DataFrame]:
    """The passages that groups send to buckets, and the heavy keys by group."""
    keys = groups.groupBy(name).applyInArrow(_keys(name, n_groups), _KEYS_DDL)
    shared = keys.groupBy("bucket").applyInArrow(_shared(KEY_BYTES), _SHARED_DDL)
    heavy = shared.where(F.octet_length("heavy") > 0)
    windows = groups.groupBy(name).cogroup(heavy.groupBy("pid")).applyInArrow(_window_keys(name, n_groups), _KEYS_DDL)
    both = shared.unionByName(windows.groupBy("bucket").applyInArrow(_shared(float("inf")), _SHARED_DDL))
    passages = groups.groupBy(name).cogroup(both.groupBy("pid")).applyInArrow(_passages(name, 4 * n_groups), "bucket long, pid long, passages binary, sizes binary, uids binary, ids binary, several binary")
    return passages, heavy


def _work(docs: DataFrame, fields: list[T.StructField], summary: bool) -> DataFrame:
    """``docs``: doc_id long, text string, maybe more."""
    # All passes over the texts read this one exchange.
    groups, name, n_groups = dealt(docs, GROUP_BYTES)
    passages, heavy = _sent(groups, name, n_groups)
    least = passages.groupBy("bucket").applyInArrow(_least, "pid long, uids binary, parts binary, lengths binary, least binary")
    found = least.withColumn("heavy", F.lit(b"")).unionByName(heavy.select("pid", *[F.lit(b"").alias(n) for n in ("uids", "parts", "lengths", "least")], "heavy"))
    return groups.groupBy(name).cogroup(found.groupBy("pid")).applyInArrow(_cut(fields, summary), T.StructType(fields))


def repeats(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, removed spans (maximal) and the digest of what is left."""
    fields = [T.StructField("doc_id", T.LongType())] + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    return _work(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fields, True)


def trimmed(docs: DataFrame) -> DataFrame:
    """The documents with all columns, their texts without the repeated passages."""
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    return _work(rows, list(rows.schema.fields), False)
