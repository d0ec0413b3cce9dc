"""Pattern packing by non-negative least squares.

Texts become token ids; the lengths of all pieces make a histogram with at most ``capacity`` bars, whatever the size of the
corpus. Patterns of one to three lengths that fill a sequence are given repeat counts by non-negative least squares against
the histogram; the counts are rounded down to what the histogram holds, and the residual pieces are packed best fit first.
The plan says, for each length, which runs of pieces go to which sequences and offsets. Its size follows the capacity.

Plan on Spark: one pass tokenizes and writes a narrow table (no texts); a piece's rank among those of its length is its rank
in the task that wrote it plus an offset from the counts of (length, task). Neither texts nor groups are gathered anywhere.

Defined results: null and empty texts are the end id alone; only documents longer than the capacity are cut, the first piece
taking the remainder; repeated rows are packed each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import CACHES, Workspace, release

#: Distinct words of each of two generations that a worker keeps the ids of; a full generation replaces the older one.
KEPT_WORDS = 300_000
#: By the tokenizer's digest: what this worker process has made last, for its later tasks; of one tokenizer only.
_MADE: dict[str, WordIds] = {}
CACHES["packing"] = _MADE


class _Known(dict):
    """Ids by word; a missing word's come from the older generation, or are made."""

    def __init__(self, make, older: dict[str, bytes]) -> None:
        super().__init__()
        self.make, self.older = make, older

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.older.get(word) or self.make(word)
        return ids


class WordIds:
    """Token ids by words: byte-level BPE never merges over the words its own splitter makes, so each is encoded once.

    Texts that hold an added token's string are encoded whole by the library.
    """

    def __init__(self, model: str) -> None:
        import json
        import os
        import re

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(model)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None
        # fixed values: the word pattern of byte-level BPE
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.find = regex.compile(pattern).findall if plain else None
        # the same for texts of ASCII and Latin letters beyond it, where the classes are short ranges
        latin, space = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r" \t\n\r\f\v"
        self.beyond = re.compile(rf"[^\x00-\x7f{latin}]").search
        self.find_latin = re.compile(rf" ?[{latin}]++|'(?:s|t|re|ve|m|ll|d)| ?[0-9]++| ?[^{space}{latin}0-9]++|[{space}]+(?![^{space}])|[{space}]+").findall
        plain_bytes = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]  # written as themselves by byte-level BPE, the others as 256 and on
        self.letters = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain_bytes)}
        pieces, letters = self.tokenizer.model.tokenize, self.letters

        def make(word: str) -> bytes:  # not a method: a cycle would keep the words after the last reader
            return array("I", [x.id for x in pieces(word.encode().decode("latin-1").translate(letters))]).tobytes()

        self.known = _Known(make, {})

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > KEPT_WORDS:
            older, self.known.older = dict(self.known), {}
            self.known = _Known(self.known.make, older)
        get, out = self.known.__getitem__, []
        for t in texts:
            if self.find is None or any(a in t for a in self.added):
                out.append(array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(map(get, (self.find_latin if t.isascii() or not self.beyond(t) else self.find)(t))))
        return out if sys.byteorder == "little" else [np.frombuffer(x, np.uint32).astype("<u4").tobytes() for x in out]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def _pieces(model: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, made = TaskContext.get().partitionId(), defaultdict(int), hashlib.sha256(model.encode()).hexdigest()
        release("packing")
        for batch in batches:
            if made not in _MADE:
                _MADE.clear()
                _MADE[made] = WordIds(model)
            ids = _MADE[made]
            keys, texts, at = batch.column(0).to_pylist(), batch.column(1), 0
            while at < len(keys):
                size, till, held = 0, at, []
                while till < len(keys) and (not held or size < 1 << 20):
                    held.append(texts[till].as_py() or "")
                    size += len(held[-1])
                    till += 1
                out = []
                for doc_id, row in zip(keys[at:till], ids.encode(held), strict=True):
                    row += end
                    n = len(row) // 4
                    first = n % capacity or capacity
                    start = 0
                    for piece, stop in enumerate(range(first, n + 1, capacity)):
                        length = stop - start
                        out.append((doc_id, piece, start, length, zlib.crc32(row[4 * start : 4 * stop]), task, seen[length]))
                        seen[length] += 1
                        start = stop
                at = till
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 5), strict=True)], PIECES.replace(" long", "").replace(" int", "").split(", "))

    return run


def patterns(counts: np.ndarray, capacity: int, limit: int = 60_000) -> np.ndarray:
    """Patterns of one to three lengths, non-increasing and padded by 0, that fill a sequence exactly.

    Triples are taken with their smallest part from the lengths that hold most tokens, as many as ``limit`` allows.
    """
    have = np.flatnonzero(counts)
    isin = np.zeros(capacity + 1, bool)
    isin[have] = True
    out = [np.array([[capacity, 0, 0]] if isin[capacity] else np.zeros((0, 3), int))]
    a = have[(have * 2 >= capacity) & (have < capacity)]
    a = a[isin[capacity - a]]
    out.append(np.stack([a, capacity - a, 0 * a], 1))
    room = limit
    for c in have[np.argsort(-counts[have], kind="stable")]:
        a = have[(have < capacity - c)]
        b = capacity - c - a
        keep = (b >= c) & (a >= b)
        a, b = a[keep], b[keep]
        ok = isin[b]
        a, b = a[ok], b[ok]
        out.append(np.stack([a, b, np.full(len(a), c)], 1))
        room -= len(a)
        if room <= 0:
            break
    return np.unique(np.concatenate(out).astype(np.int64), axis=0)


def fit(pattern: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared distance of the pattern's lengths from the histogram, by accelerated projected gradient."""
    n = len(counts)
    flat, mask = pattern.ravel(), (pattern > 0).ravel()
    rows = np.repeat(np.arange(len(pattern)), pattern.shape[1])[mask]
    cols = flat[mask]
    scale = np.maximum(counts, 1) ** -0.5  # long bars would else hide the short ones
    apply = lambda x: scale * np.bincount(cols, x[rows], n)
    back = lambda y: np.bincount(rows, (scale * y)[cols], len(pattern))
    target, v = scale * counts, np.ones(len(pattern))
    for _ in range(30):
        v = back(apply(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / max(np.linalg.norm(back(apply(v))) * 1.05, 1e-12)
    x = z = np.zeros(len(pattern))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(z - step * back(apply(z) - target), 0)
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z = new + (was - 1) / t * (new - x)
        x = new
    return x


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) that use every counted length up exactly; of a size that follows the capacity."""
    left, out = counts.astype(np.int64).copy(), []
    found = patterns(left, capacity)
    repeats = np.floor(fit(found, left.astype(float)) + 0.5).astype(np.int64) if len(found) else np.zeros(0, np.int64)
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] <= 0:
            break
        parts = [int(p) for p in found[k] if p]
        n = min(int(repeats[k]), *(int(left[p]) // parts.count(p) for p in parts))
        if n > 0:
            for p in parts:
                left[p] -= n
            out.append((tuple(parts), n))
    # the residual, longest first, each to the fullest sequence that has room
    rooms: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        room = length
        while todo:
            while room <= capacity and not rooms[room]:
                room += 1
            if room > capacity:
                each = min(todo, capacity // length)
                full = todo // each
                rooms[capacity - each * length][key] = rooms[capacity - each * length].get(key := (length,) * each, 0) + full
                if todo := todo - full * each:
                    rooms[capacity - todo * length][key] = rooms[capacity - todo * length].get(key := (length,) * todo, 0) + 1
                break
            key, have = next(iter(rooms[room].items()))
            n = min(have, todo)
            if have == n:
                del rooms[room][key]
            else:
                rooms[room][key] = have - n
            new = (*key, length)
            rooms[room - length][new] = rooms[room - length].get(new, 0) + n
            todo -= n
    return out + [x for r in rooms for x in r.items()]


def slots(packed: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of runs of pieces, the sequence of a run's first piece, the offset of all of them."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for parts, n in packed:
        offset = 0
        for p in parts:
            runs[p].append((used[p], base, offset))
            used[p] += n
            offset += p
        base += n
    return {p: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for p, r in runs.items()}


def _placed(where: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.asarray(b.column(3)), np.asarray(b.column(5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, base, at = where[int(length[part[0]])]
                k = np.searchsorted(first, rank[part], "right") - 1
                sequence[part], offset[part] = base[k] + rank[part] - first[k], at[k]
            yield pa.record_batch([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    work = Workspace(docs.sparkSession, "packing")
    model = Path(tokenizer_path).read_text("utf-8")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = work.write(rows.mapInArrow(_pieces(model, capacity, end_id), PIECES), "pieces")
    groups = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length, of which there are capacity
        counts[r["length"]] = r["n"]
    where = slots(plan(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = groups.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placed(where), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
