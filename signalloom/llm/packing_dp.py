"""Packing of documents into training sequences, in corpus order, by dynamic programming.

A partition's documents are read as one stream of token ids. Cuts may fall at document ends
(free), at sentence ends (a small penalty), and, where neither comes for a while, inside a
sentence (a larger one). Over the cut positions p_0 < p_1 < ... the programme

    best[j] = min over i with p_j - p_i <= capacity of best[i] + padding(p_j - p_i) + penalty[j]

splits into ``best[i] + p_i``, whose sliding-window minimum a monotone queue keeps, and a term
of j alone. Lengths that are a power of two need no padding; those transitions are looked up by
position. Work and memory are linear in the cut positions. The stream is planned in blocks of
bounded size, and a block's last sequence is planned again with the next block; only a
partition's end is padded, or cut into powers of two where that costs less.

No rows are exchanged: order is kept within each partition of the input, as it is read.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, documents, values

CAPACITY = 2048
END_ID = 1
#: The public vocabulary's name in the package public_tokenizers.
VOCABULARY = "byte_bpe_50k"
#: Costs in tokens of padding.
SENTENCE_CUT, WORD_CUT, PER_SEQUENCE = 1.0, 24.0, 2.0
#: Tokens without a document or sentence end after which a cut inside the sentence is offered.
LONGEST_GAP = 64
BLOCK_TOKENS = 1 << 18

_SPECIAL = "<|endoftext|>"
#: Below this code point the libraries were compared one by one in every place of the splitting
#: pattern; beyond it their Unicode tables could differ.
COMPARED = 0x30000
_UNCOMPARED = re.compile(f"[{chr(COMPARED)}-\U0010ffff\ud800-\udfff]")


class Encoder:
    """Token ids of the byte-level vocabulary, and which of them end a sentence or line.

    ``tiktoken`` encodes by the same vocabulary several times faster than ``tokenizers``; texts
    with the special token, or with characters of the last planes, go to the latter.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path = public_tokenizers.path(f"{vocabulary}.json")
        self.ends = np.zeros(max(ranks.values()) + 2, bool)  # the special token follows the ranks
        self.ends[[i for t, i in ranks.items() if t[-1:] in b".!?\n"]] = True

    @cached_property
    def exact(self):
        """Loaded only where a text needs it; it takes some 30 MB of each worker."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        if _SPECIAL in text or _UNCOMPARED.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.ends[ids]) + 1


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def padding(length: int, capacity: int = CAPACITY) -> int:
    return 0 if length & (length - 1) == 0 else capacity - length


def plan(positions: list[int], penalties: list[float], capacity: int = CAPACITY) -> list[int]:
    """The cuts of least padding plus penalties: positions ascend from 0, no two neighbours
    further apart than the capacity; the last one is always cut."""
    n = len(positions)
    best, back, shifted = [0.0] * n, [0] * n, [0.0] * n
    at = {0: 0}
    sizes = [1 << k for k in range(6, capacity.bit_length()) if 1 << k <= capacity]
    queue = deque([0])
    for j in range(1, n):
        p = positions[j]
        while positions[queue[0]] < p - capacity:
            queue.popleft()
        i = queue[0]
        cost = shifted[i] + capacity - p
        for s in sizes:
            k = at.get(p - s)
            if k is not None and best[k] < cost:
                cost, i = best[k], k
        best[j] = cost = cost + penalties[j] + PER_SEQUENCE
        back[j], at[p] = i, j
        shifted[j] = f = cost + p
        while queue and shifted[queue[-1]] >= f:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(positions[j])
        j = back[j]
    return cuts[::-1]


def _tail(length: int, capacity: int) -> list[int]:
    """The last sequence: whole, or as powers of two where cuts cost less than its padding."""
    bits = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    return bits if (len(bits) - 1) * (WORD_CUT + PER_SEQUENCE) < padding(length, capacity) else [length]


class _Stream:
    """Segments (doc_id, doc_tokens, start, ids, cuts) that are not yet in a sequence."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.segments, self.tokens = capacity, [], 0

    def add(self, doc_id, ids: np.ndarray, cuts: np.ndarray) -> None:
        n = len(ids) + 1
        self.segments.append((doc_id, n, 0, np.append(ids, np.uint32(END_ID)).astype("<u4", copy=False), cuts))
        self.tokens += n

    def _offered(self) -> tuple[list[int], list[float]]:
        positions, penalties, base = [0], [0.0], 0
        for _, _, _, ids, cuts in self.segments:
            n = len(ids)
            soft = np.unique(np.append(cuts, n))
            gaps = np.diff(soft, prepend=0)
            if (gaps > LONGEST_GAP).any():
                hard = np.concatenate([np.arange(b - g + LONGEST_GAP, b, LONGEST_GAP) for b, g in zip(soft.tolist(), gaps.tolist()) if g > LONGEST_GAP])
                soft, kind = np.concatenate((soft, hard)), np.concatenate((np.full(len(soft), SENTENCE_CUT), np.full(len(hard), WORD_CUT)))
                order = np.argsort(soft, kind="stable")
                soft, kind = soft[order], kind[order]
            else:
                kind = np.full(len(soft), SENTENCE_CUT)
            kind[-1] = 0.0
            positions += (soft + base).tolist()
            penalties += kind.tolist()
            base += n
        return positions, penalties

    def sequences(self, last: bool) -> Iterator[list[tuple]]:
        """Planned sequences as lists of (doc_id, doc_tokens, start, ids); but for the last call
        the final one stays for the next block."""
        if not self.tokens:
            return
        cuts = plan(*self._offered(), self.capacity)
        lengths = np.diff(cuts, prepend=0).tolist()
        lengths = lengths[:-1] + _tail(lengths[-1], self.capacity) if last else lengths[:-1]
        k, used = 0, 0
        for length in lengths:
            pieces = []
            while length:
                doc_id, n, start, ids, cuts_ = self.segments[k]
                take = min(length, len(ids) - used)
                pieces.append((doc_id, n, start + used, ids[used : used + take]))
                length, used = length - take, used + take
                self.tokens -= take
                if used == len(ids):
                    k, used = k + 1, 0
            yield pieces
        self.segments = self.segments[k:]
        if used:
            doc_id, n, start, ids, cuts_ = self.segments[0]
            self.segments[0] = (doc_id, n, start + used, ids[used:], cuts_[cuts_ > used] - used)


_COLUMNS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def _pack_batches(capacity: int, vocabulary: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, stream = encoder(vocabulary), _Stream(capacity)
        sequence = TaskContext.get().partitionId() << 40
        schema = pa.schema(_COLUMNS + [("ids", pa.list_(pa.int32()))] * with_ids)

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows: list[tuple] = []
            for pieces in stream.sequences(last):
                offset = 0
                for doc_id, n, start, ids in pieces:
                    row = (doc_id, start, len(ids), zlib.crc32(ids), n, sequence, offset)
                    rows.append(row + (ids.view("<i4"),) if with_ids else row)
                    offset += len(ids)
                sequence += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), values(batch.column("text"))):
                ids = tokens.encode(text or "")
                stream.add(doc_id, ids, tokens.sentence_ends(ids))
                if stream.tokens >= BLOCK_TOKENS:
                    yield from packed(False)
        yield from packed(True)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its ids and the end id; each id lies in exactly one piece. Null or empty text
    is one piece of the end id. Repeated rows are packed each; a null doc_id stays null. Other
    columns are ignored; an empty table gives no rows. sequence_id is unique, not gapless.
    """
    if capacity < LONGEST_GAP:
        raise ValueError(f"capacity must be at least {LONGEST_GAP}")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _pack_batches(capacity, vocabulary, with_ids), schema)


def op6_packing_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


QUERIES = {"op6_packing_dp": op6_packing_dp}
ORACLE_SQL: dict[str, str] = {}
