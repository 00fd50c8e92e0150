"""Packing of tokenised documents into fixed windows by multiway number differencing.

Pieces of at most ``piece`` tokens are grouped into blocks of a bounded number of tokens; in each block the
Karmarkar-Karp differencing method divides the pieces among as few windows as could hold them: the two partial
partitions with the largest imbalance are merged, the fullest window of one on the emptiest of the other, until
one partition is left. If its fullest window exceeds the capacity, the block is divided again among more
windows. Whole windows cut from long documents stay as they are.

Cases: a null text is an empty one; an empty document is its end id alone; repeated rows are packed each by
itself; a row without id is packed too and its pieces have none; an empty table gives no piece; other columns are
left out. Ids stay Arrow integers throughout, so that one that is null doesn't turn its neighbours into floats.
"""

from __future__ import annotations

import base64
import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import column, output
from ._util import checkpoint, groups_for

CAPACITY, PIECE, END_ID = 2048, 512, 1
#: Windows a block holds about: bounds each task's group.
BLOCK_WINDOWS = 128
#: Texts beyond this many characters go through the reference tokenizer, whose pattern matching has no depth limit.
LONG_TEXT = 400_000


@functools.cache
def encoder(json_path: str, ranks_path: str | None):
    """text -> ids. The rank file holds the same vocabulary for a faster matcher; ids are equal."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    encode_slow = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    if ranks_path is None:
        return encode_slow
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    special = {token.content: i for i, token in slow.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encode_slow(text) if len(text) > LONG_TEXT else fast.encode_to_numpy(text, allowed_special="all")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None, capacity: int, piece: int, end_id: int) -> DataFrame:
    """Tokenise whole texts and cut them: windows of ``capacity`` ids, then pieces of at most ``piece``."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    arrow = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                whole = len(ids) // capacity * capacity
                bounds = [*range(0, whole, capacity), *range(whole, len(ids), piece), len(ids)]
                body = memoryview(ids.tobytes())
                rows += [(doc_id, a, b - a, zlib.crc32(body[4 * a : 4 * b]), len(ids)) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield output(arrow, **dict(zip(arrow.names, map(list, zip(*rows, strict=True)) if rows else [[]] * 5, strict=True)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: item numbers by window, fullest first. A partial partition lists its non-empty windows
    as (sum, items), descending; ``floor`` is what has been taken off every window of it."""
    heap = [(-n, i, [(n, [i])]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = windows - len(a)
        kept = len(a) - max(0, len(b) - free)
        # Empty windows of a take the fullest of b; what is left of b meets the emptiest of the others.
        joined = a[:kept] + b[:free]
        joined += [(x + y, p + q) for (x, p), (y, q) in zip(reversed(a[kept:]), b[free:], strict=True)]
        joined.sort(key=lambda w: -w[0])
        if len(joined) == windows and joined[-1][0]:
            least = joined[-1][0]
            joined = [(x - least, p) for x, p in joined]
        spread = joined[0][0] - (joined[-1][0] if len(joined) == windows else 0)
        heapq.heappush(heap, (-spread, order, joined))
        order += 1
    return [items for _, items in heap[0][2]] if heap else []


def windows_of(lengths: list[int], capacity: int) -> list[list[int]]:
    """As few windows as the differencing method fills without exceeding the capacity."""
    count = -(-sum(lengths) // capacity)
    while True:
        parts = difference(lengths, count)
        if max((sum(lengths[i] for i in part) for part in parts), default=0) <= capacity:
            return parts
        count += 1


def pack(
    docs: DataFrame,
    json_path: str | None = None,
    ranks_path: str | None = None,
    capacity: int = CAPACITY,
    piece: int = PIECE,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: its document, place and ids' checksum there, its window and offset in that.

    ``sequence_id`` is unique; ``sequence_tokens`` is the window's fill, ``padding`` what it lacks to the
    capacity (0 where the fill is a power of two, which needs none).
    """
    if json_path is None:
        json_path, ranks_path = default_paths()
    cut = checkpoint(pieces(docs, json_path, ranks_path, capacity, piece, end_id))
    total = cut.agg(F.sum("length")).first()[0] or 0
    blocks = groups_for(total, capacity * BLOCK_WINDOWS)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    arrow = pa.schema([(n, pa.int64()) for n in [*names, "sequence_id", "offset", "sequence_tokens", "padding"]])

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([(n, "ascending") for n in ("doc_id", "start", "ids_crc32", "doc_tokens")])
        block = column(group, "block")[0].as_py()
        lengths = column(group, "length").to_numpy()
        sequence = np.full(len(lengths), -1, np.int64)
        partial = np.flatnonzero(lengths < capacity)
        parts = windows_of(lengths[partial].tolist(), capacity)
        for number, part in enumerate(parts):
            sequence[partial[part]] = number
        whole = np.flatnonzero(lengths == capacity)
        sequence[whole] = len(parts) + np.arange(len(whole))
        # Within a window, pieces follow each other in the group's order.
        order = np.argsort(sequence, kind="stable")
        upto = np.cumsum(lengths[order]) - lengths[order]
        fill = np.bincount(sequence, weights=lengths, minlength=len(parts) + len(whole)).astype(np.int64)
        offset = np.empty(len(lengths), np.int64)
        offset[order] = upto - (np.cumsum(fill) - fill)[sequence[order]]
        tokens = fill[sequence]
        padding = np.where(tokens & (tokens - 1) == 0, 0, capacity - tokens)
        placed = {"sequence_id": (block << 32) + sequence, "offset": offset, "sequence_tokens": tokens, "padding": padding}
        return pa.table([column(group, n) for n in names] + [pa.array(v, pa.int64()) for v in placed.values()], schema=arrow)

    schema = ", ".join(f"{n} long" for n in [*names, "sequence_id", "offset", "sequence_tokens", "padding"])
    # By row of what is checkpointed: pieces without id, and those of equal texts, are spread like any others.
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(blocks)).alias("block")
    return cut.select(*names, key).groupBy("block").applyInArrow(place, schema)
