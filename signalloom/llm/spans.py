"""Spans (start, end, kind) in code points, end exclusive, and their digests."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa

from .common import values

Span = tuple[int, int, str]

FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
FOUND_SQL = "array<struct<kind: string, start: int, end: int>>"


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()


class Covered:
    """What a list of spans covers, for overlap tests in logarithmic time."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b, _ in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, span: Span) -> bool:
        k = bisect_left(self.starts, span[1])
        return k > 0 and self.ends[k - 1] > span[0]


def masked(text: str, spans: list[Span], name: Callable[[str], str]) -> str:
    """The text with every span replaced; overlapping spans are replaced as one, by the first's name."""
    out, at = [], 0
    end, kind = -1, ""
    for a, b, k in sorted(spans):
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            out.append(name(kind))
            at = end
        out.append(text[at:a])
        end, kind = b, k
    if end >= 0:
        out.append(name(kind))
        at = end
    return "".join([*out, text[at:]])


def summary_batches(find: Callable[[str], tuple[list[Span], list[Span]]], kinds: tuple[str, ...], base_kinds: tuple[str, ...], order: Callable):
    """Rows doc_id, n_<kind>..., base_sha256, spans, found from find(text) -> (base, added)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in base_kinds]
            digests, joined, found = [], [], []
            for text in values(batch.column("text")):
                base, added = find(text or "")
                base.sort(key=order)
                every = sorted(base + added, key=order)
                for n, kind in zip(counts, base_kinds):
                    n.append(sum(k == kind for _, _, k in base))
                digests.append(digest(base))
                joined.append(listed(every))
                found.append([{"kind": k, "start": a, "end": b} for a, b, k in every])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(found, FOUND)],
                names=["doc_id", *(f"n_{k}" for k in base_kinds), "base_sha256", "spans", "found"],
            )

    return run


def masking_batches(find: Callable[[str], tuple[list[Span], list[Span]]], text_col: str, name: Callable[[str], str]):
    """The same rows with each found span replaced in the text column; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts = []
            for text in values(batch.column(k)):
                base, added = find(text or "")
                texts.append(masked(text, base + added, name) if base or added else text)
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return run
