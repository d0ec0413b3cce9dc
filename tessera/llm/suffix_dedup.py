"""Removal of repeated byte strings, keeping each string's first occurrence, by longest previous factors.

A byte goes when a string of ``length`` bytes that covers it starts earlier too: in a document of smaller id, or earlier in
its own. All windows of that length are judged, but few are ever compared:

1. Each window belongs to the cell of its minimiser, the least hash among its ``GRAM``-byte strings, so equal windows have
   equal minimisers. A cell is a run of windows with the same one. One narrow row for each cell, a few for 100 bytes, is
   dealt out by the minimiser's hash.
2. Cells of equal content are repeated as a whole, but for the first. Cells that share only the minimiser with others (edges
   of a passage, edited copies) are left.
3. The bytes of those are fetched and dealt out by a longer string that their windows hold. In each such group the windows'
   suffixes, cut at ``length``, are put in suffix order, with the common prefixes of neighbours. The previous and the next
   smaller position in that order give each suffix its longest previous factor; a window goes when that has ``length`` bytes.

Equal cells meet in a batch before they are shuffled, so a passage that a third of all documents holds costs a row for each
batch. The cells of a minimiser are judged in sorted order, one held at a time. Windows never cross documents. Texts move twice:
those with open cells, and those that lose bytes; a bitmap of bounded size keeps the others from the joins.

Defined results: null and empty texts have no bytes; texts under ``length`` bytes lose none; rows that repeat an id with an
equal text are the same document and judged alike, while rows of one id with different texts are ordered by position only; a
null id comes first; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, chunks, marked_by, mix, possible, prefix_hashes, span_hashes

GRAM = 44
#: Bytes left of the minimiser by which step 3 deals out windows that hold them; the others hold more bytes right of it.
LEFT = 28
#: Documents longer than this are taken in parts that overlap by a window.
PART = 1 << 23
NULL_ID = -(1 << 63)


def cells(data: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Cells of the texts that lie in ``data`` at ``begin`` with ``size``: (text, minimiser's place, first and last window, prefix hashes)."""
    width = length - GRAM + 1
    prefix = prefix_hashes(data)
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, prefix
    at = np.arange(len(data) - GRAM + 1)
    least = (span_hashes(prefix, at, at + GRAM) & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)  # leftmost of equal hashes
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: n], least[width - step : width - step + n])
    place = (least[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
    number = np.maximum(size - length + 1, 0)
    owner = np.repeat(np.arange(len(begin)), number)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + begin[owner]
    place = place[start]
    new = np.ones(len(owner), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(owner)]]) - 1 if len(first) else first
    return owner[first], place[first], start[first], start[last], prefix


def not_first(order_by: list[np.ndarray], same: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A sort order by ``same`` then ``order_by``, and which rows of it have an earlier row that is the same and strictly before."""
    order = np.lexsort([*reversed(order_by), *reversed(same)])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for s in same:
        new[1:] |= s[order][1:] != s[order][:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = np.zeros(len(order), bool)
    for x in order_by:
        y = x[order]
        later |= y != y[head]
    return order, later


NAMES = ["minimiser", "content", "doc", "low", "high", "place"]
CELLS = "minimiser long, content long, doc long, low long, high long, place long"


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, pa.int64()) for c in columns], NAMES)


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins the spans [start, end) of a document that touch."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    shift = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]) * np.int64(1 << 40) if len(doc) else doc
    reach = np.maximum.accumulate(end + shift) if len(doc) else end
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1 if len(first) else first
    return doc[first], start[first], (reach - shift)[last] if len(first) else end


def _cells(length: int):
    """Batches of texts to open cells, and to spans (place -1, low to high) that are known to be repeated."""

    def parts(ids: list[int], texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
        if len(texts) == 1 and len(texts[0]) > PART:
            for a in range(0, len(texts[0]) - length + 1, PART):
                yield ids, [a], [texts[0][a : a + PART + length - 1]]
        else:
            yield ids, [0] * len(ids), texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[np.ndarray]] = []
            keys = np.asarray(batch.column(0))
            for a, b, texts in chunks(batch, 1, 1 << 20):
                for ids, base, part in parts(keys[a:b], texts):
                    size = np.array([len(t) for t in part], np.int64)
                    begin = np.cumsum(size) - size
                    owner, place, low, high, prefix = cells(np.frombuffer(b"".join(part), np.uint8), begin, size, length)
                    if len(owner):
                        off = (np.array(base, np.int64) - begin)[owner]
                        held.append([span_hashes(prefix, place, place + GRAM), span_hashes(prefix, low, high + length), np.asarray(ids)[owner], low + off, high + off, place + off])
            if held:
                m, c, doc, low, high, place = (np.concatenate(x) for x in zip(*held, strict=True))
                order, later = not_first([doc, low], [c])
                keep = np.sort(order[~later])
                yield _batch(*(x[keep] for x in (m, c, doc, low, high, place)))
                gone = order[later]
                doc, start, end = _spans(doc[gone], low[gone], high[gone] + length)
                yield _batch(mix(doc.view(np.uint64) ^ start.view(np.uint64)), np.zeros(len(doc), np.int64), doc, start, end, np.full(len(doc), -1))

    return run


def _grouped(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Blocks of about ``least`` rows of a stream sorted by its first column, cut between its values; whether it is the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            key = np.asarray(held[-1].column(0))
            cut = int(np.searchsorted(key, key[-1]))
            whole = [*held[:-1], held[-1].slice(0, cut)]
            if cut or (len(held) > 1 and np.asarray(held[-2].column(0))[-1] != key[-1]):
                yield pa.Table.from_batches(whole)
                held = [held[-1].slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _judged(length: int):
    """Sorted by minimiser, content and position: repeated cells become spans, first cells of minimisers with several contents stay open.

    From one batch to the next, only the first cell of the last content is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, told = None, False  # the first cell of the content read last, and whether it has been yielded
        for batch in batches:
            rows = [np.asarray(batch.column(k)) for k in range(6)]
            known = rows[5] < 0
            yield _batch(*(x[known] for x in rows))
            rows = [x[~known] for x in rows] if first is None else [np.concatenate([f, x[~known]]) for f, x in zip(first, rows, strict=True)]
            m, c, doc, low, high, _ = rows
            if not len(m):
                continue
            new_m, new = np.ones(len(m), bool), np.ones(len(m), bool)
            new_m[1:] = m[1:] != m[:-1]
            new[1:] = new_m[1:] | (c[1:] != c[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
            later = (doc != doc[head]) | (low != low[head])  # not so for repeated rows of a document
            d, start, end = _spans(doc[later], low[later], high[later] + length)
            yield _batch(np.zeros(len(d), np.int64), np.zeros(len(d), np.int64), d, start, end, np.full(len(d), -1))
            group = np.cumsum(new_m) - 1
            several = np.zeros(group[-1] + 1, bool)
            several[group[new & ~new_m]] = True
            if first is not None and told:
                several[0] = True
            keep = new & several[group]
            if first is not None and told:
                keep[0] = False
            yield _batch(*(x[keep] for x in rows))
            told, first = bool(several[-1]), [x[head[-1] : head[-1] + 1] for x in rows]

    return run


def _windows(length: int):
    """Texts with their open cells to (key, doc, low, bytes): runs of windows that hold the string whose hash is the key."""
    right = length - LEFT  # windows that start less than LEFT before the minimiser reach this far beyond its start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc, text, open_cells in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py().encode()
                if not open_cells:
                    continue
                for x in open_cells:
                    low, high, p = x["low"], x["high"], x["place"]
                    for a, b, key in ((low, min(high, p - LEFT), (0, p - LEFT, p + GRAM)), (max(low, p - LEFT + 1), high, (1, p, p + 1 + right))):
                        if a <= b and high + length <= len(raw):
                            out[0].append(int.from_bytes(hashlib.blake2b(bytes([key[0]]) + raw[key[1] : key[2]], digest_size=8).digest(), "little", signed=True))
                            out[1].append(doc)
                            out[2].append(a)
                            out[3].append(raw[a : b + length])
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "doc", "low", "bytes"])

    return run


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``starts``, cut at ``length`` bytes; and how many bytes each shares with the one before it."""
    cut = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[starts]) if len(starts) else np.zeros((0, length), np.uint8)
    order = np.argsort(cut.view(f"S{length}").ravel(), kind="stable")  # of one width, so compared byte by byte
    shared = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 1 << 16):
        to = min(len(order), at + (1 << 16))
        apart = cut[order[at:to]] != cut[order[at - 1 : to - 1]]
        shared[at:to] = np.where(apart.any(1), apart.argmax(1), length)
    return order, shared


def _smaller(place: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each place, the bytes shared with the nearest smaller place before it in the order; 0 without one.

    Everything between a candidate and its suffix is larger than the suffix, so a candidate that is larger too can be replaced
    by its own candidate; all do so at once, until none is left.
    """
    n = len(place)
    candidate, low = np.arange(n) - 1, shared.copy()
    todo = np.arange(n)
    while len(todo):
        todo = todo[candidate[todo] >= 0]
        todo = todo[place[candidate[todo]] >= place[todo]]
        through = candidate[todo]
        new, least = candidate[through], np.minimum(low[todo], low[through])
        candidate[todo], low[todo] = new, np.where(new < 0, 0, least)
    return np.where(candidate < 0, 0, low)


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """For the suffix at each of ``starts``: the most bytes, up to ``length``, that it shares with one of a smaller ``place``.

    The best is the previous or the next smaller place in suffix order, as what lies beyond shares no more.
    """
    order, shared = suffix_order(data, starts, length)
    inside = place[order]
    after = np.concatenate([shared[1:], [0]]) if len(shared) else shared
    out = np.zeros(len(starts), np.int64)
    out[order] = np.maximum(_smaller(inside, shared), _smaller(inside[::-1], after[::-1])[::-1])
    return out


def _factored(length: int):
    """Sorted by key: spans whose windows have an earlier factor of the length."""

    def judge(block: pa.Table) -> pa.RecordBatch:
        key, doc, low = (np.asarray(block.column(k)) for k in range(3))
        count = np.unique(key, return_counts=True)
        alone = count[0][count[1] == 1]
        keep = np.flatnonzero(~np.isin(key, alone, assume_unique=False))
        order = keep[np.lexsort((low[keep], doc[keep], key[keep]))]
        none = np.zeros(0, np.int64)
        spans = [(none, none, none)]
        raw = block.column(3).combine_chunks().take(pa.array(order)).to_pylist() if len(order) else []
        if raw:
            # repeated rows of a document are judged alike: they must not find each other
            twin = np.zeros(len(order), bool)
            twin[1:] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & (low[order][1:] == low[order][:-1]) & np.array([x == y for x, y in zip(raw[1:], raw, strict=False)], bool)
            order, raw = order[~twin], [r for r, t in zip(raw, twin, strict=True) if not t]
            size = np.array([len(r) for r in raw], np.int64)
            begin = np.cumsum(size) - size
            number = size - length + 1
            owner = np.repeat(np.arange(len(raw)), number)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
            # windows of different keys are never equal: the key's string and its place in the window differ
            at = low[order][owner] + k
            place = np.empty(len(owner), np.int64)
            place[np.lexsort((at, doc[order][owner]))] = np.arange(len(owner))
            flags = longest_previous_factors(np.frombuffer(b"".join(raw), np.uint8), begin[owner] + k, place, length) >= length
            owner, start = order[owner[flags]], (k + low[order][owner])[flags]
            spans = [_spans(doc[owner], start, start + length)]
        d, start, end = spans[0]
        return pa.record_batch([pa.array(d, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _grouped(batches, 10_000):
            yield judge(block)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows, strict=True):
            raw = (text.as_py() or "").encode()
            kept, last, n = [], 0, 0
            for a, b in _merged(spans or ()):
                kept.append(raw[last:a])
                last, n = b, n + 1
            left = b"".join([*kept, raw[last:]])
            for column, v in zip(out, (doc, len(raw), len(raw) - len(left), n, left), strict=True):
                column.append(v)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc", "n_bytes", "n_removed", "n_spans", "kept"])


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["low"], s["high"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def deduplicate(docs: DataFrame, length: int = 100) -> DataFrame:
    """Every row's doc_id, n_bytes, n_removed, n_spans (runs removed) and kept (the bytes that stay)."""
    if length < GRAM + LEFT + 1:
        raise ValueError(f"strings of {GRAM + LEFT + 1} bytes or more can be found")
    work = Workspace(docs.sparkSession, "suffix-dedup")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(_cells(length), CELLS).repartition("minimiser").sortWithinPartitions("minimiser", "content", "doc", "low")
    judged = work.write(found.mapInArrow(_judged(length), CELLS), "cells")
    opened = work.write(judged.where("place >= 0").groupBy("doc").agg(F.collect_list(F.struct("low", "high", "place")).alias("cells")), "open")
    texts = possible(rows, F.col("doc"), opened, "doc").join(opened.hint("shuffle_hash"), "doc").select("doc", "text", "cells")
    windows = texts.mapInArrow(_windows(length), "key long, doc long, low long, bytes binary").repartition("key").sortWithinPartitions("key")
    factors = windows.mapInArrow(_factored(length), "doc long, low long, high long")
    spans = judged.where("place < 0").select("doc", "low", "high").union(factors)
    spans = work.write(spans.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "spans")
    kinds = "doc long, n_bytes long, n_removed long, n_spans long, kept binary"
    marked = marked_by(rows, F.col("doc"), spans, "doc", "maybe")
    changed = marked.where("maybe").join(spans.hint("shuffle_hash"), "doc", "left").select("doc", "text", "spans").mapInArrow(_kept, kinds)
    out = changed.union(marked.where("not maybe").select("doc", "text").mapInArrow(_kept, kinds))
    return out.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
