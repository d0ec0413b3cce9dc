"""Removal of repeated strings against a search over all windows."""

import hashlib
import random

import numpy as np
import pytest
from cases import awkward, data, empty
from tessera.llm import queries
from tessera.llm.suffix_dedup import _judged, deduplicate, longest_previous_factors, suffix_order


def brute(docs, length=100):
    first = {}
    raws = [(d, (t or "").encode()) for d, t in docs]
    for d, raw in raws:
        for i in range(len(raw) - length + 1):
            at = (d is not None, d or 0, i)
            if at < first.get(w := raw[i : i + length], (True, 1 << 62, 0)):
                first[w] = at
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (d is not None, d or 0, i):
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((d, len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=False) if not g)).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()], key=repr)


def test_query_against_all_windows(spark):
    docs = [(r["doc_id"], r["text"]) for r in data("documents", "sf0.01")]
    expected = brute(docs)
    assert sorted((tuple(r) for r in queries.op10_suffix_dedup(spark, "/root/testdata/sf0.01").collect()), key=repr) == expected
    assert any(r[2] for r in expected)


def test_awkward_rows(spark):
    df = awkward(spark)
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert got(deduplicate(df)) == brute(docs)
    assert deduplicate(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_edges_edits_and_runs(spark, seed):
    rng = random.Random(seed)
    letter = lambda n, of="abcdé ": "".join(rng.choice(of) for _ in range(n))
    shared = [letter(rng.randrange(90, 400)) for _ in range(6)] + ["x" * 260, "ab" * 120]
    docs = []
    for d in range(120):
        text = "".join(rng.choice([lambda: letter(rng.randrange(0, 60)), lambda: (p := rng.choice(shared))[rng.randrange(0, 30) : len(p) - rng.randrange(0, 30)]])() for _ in range(rng.randrange(0, 7)))
        docs.append((rng.randrange(1000) * 200 + d, text))
    assert got(deduplicate(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))) == brute(docs)


def test_long_texts_are_taken_in_parts(spark, monkeypatch):
    from tessera.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "PART", 500)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    docs = [(k, passage.join("".join(rng.choice("abcdefgh ") for _ in range(450)) for _ in range(5))) for k in range(3)]
    held = list(suffix_dedup._cells(100)(iter([__import__("pyarrow").record_batch([[k] , [t]], ["doc", "text"]) for k, t in docs])))
    covered = sum(h - l + 1 for b in held for l, h, p in zip(b["low"].to_pylist(), b["high"].to_pylist(), b["place"].to_pylist(), strict=True) if p >= 0)
    assert covered + sum(h - l - 99 for b in held for l, h, p in zip(b["low"].to_pylist(), b["high"].to_pylist(), b["place"].to_pylist(), strict=True) if p < 0) >= sum(len(t) - 99 for _, t in docs) - 3 * 1500


def test_result_of_texts_beyond_a_part(spark, monkeypatch):
    """Cells of parts that overlap, judged in the workers' own process: the same rows as brute force."""
    import pyarrow as pa
    from tessera.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "PART", 700)
    rng = random.Random(9)
    letter = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, edge = letter(900), letter(130)
    docs = [(k, letter(650) + passage[k * 10 :] + letter(300) + edge + letter(800) + passage[: 500 + k] + edge) for k in range(4)]
    cells = pa.Table.from_batches([b for k, t in docs for b in suffix_dedup._cells(100)(iter([pa.record_batch([[k], [t]], ["doc", "text"])]))])
    judged = pa.Table.from_batches(_judged(100)(iter(cells.sort_by([(c, "ascending") for c in ("minimiser", "content", "doc", "low")]).to_batches(max_chunksize=50)))).to_pylist()
    opened = {k: [r for r in judged if r["place"] >= 0 and r["doc"] == k] for k, _ in docs}
    held = pa.record_batch([[k for k, _ in docs], [t for _, t in docs], [opened[k] for k, _ in docs]], ["doc", "text", "cells"])
    windows = pa.Table.from_batches(suffix_dedup._windows(100)(iter([held]))).sort_by("key")
    spans = [*(r for r in judged if r["place"] < 0), *pa.Table.from_batches(suffix_dedup._factored(100)(iter(windows.to_batches()))).to_pylist()]
    out = next(suffix_dedup._kept(iter([pa.record_batch([[k for k, _ in docs], [t for _, t in docs], [[r for r in spans if r["doc"] == k] for k, _ in docs]], ["doc", "text", "spans"])]))).to_pylist()
    assert sorted((r["doc"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out) == brute(docs)


@pytest.mark.parametrize("seed", range(12))
def test_cells_are_judged_alike_however_they_come_in_batches(seed):
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    made = {(int(m), int(c), int(d), int(w)) for m, c, d, w in rng.integers(0, [6, 3, 9, 4], (80, 4))}
    rows = sorted((m, c, d, 1000 * w, 1000 * w, 1000 * w + 5) for m, c, d, w in made)
    rows = sorted([*rows, *rows[::9]])  # repeated rows
    table = pa.table([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["minimiser", "content", "doc", "low", "high", "place"])
    out = [tuple(r.values()) for b in _judged(100)(iter(table.to_batches(max_chunksize=int(rng.integers(1, 30))))) for r in b.to_pylist()]
    first = {}
    for r in rows:
        first.setdefault(r[:2], r)
    several = {m for m, _ in first if len({c for n, c in first if n == m}) > 1}
    assert sorted(r for r in out if r[5] >= 0) == sorted(r for k, r in first.items() if k[0] in several)
    assert {(r[2], r[3]) for r in out if r[5] < 0} == {(r[2], r[3]) for r in rows if r[2:4] != first[r[:2]][2:4]}


@pytest.mark.parametrize("seed", range(20))
def test_longest_previous_factors_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.integers(2, 9))
    data = rng.integers(0, [2, 3, 1][seed % 3] + 1, 90).astype(np.uint8)  # zero bytes too
    starts = np.sort(rng.choice(90 - length + 1, 60, replace=False))
    place = rng.permutation(60)
    agree = lambda a, b: next((k for k in range(length) if data[a + k] != data[b + k]), length)
    expected = [max([0, *(agree(a, b) for b, q in zip(starts, place, strict=True) if q < p)]) for a, p in zip(starts, place, strict=True)]
    assert longest_previous_factors(data, starts, place, length).tolist() == expected
    order, shared = suffix_order(data, starts, length)
    texts = [bytes(data[starts[i] : starts[i] + length]) for i in order]
    assert texts == sorted(texts) and shared[1:].tolist() == [agree(starts[a], starts[b]) for a, b in zip(order, order[1:], strict=False)]


def test_previous_factors_of_a_text():
    data = np.frombuffer(b"abcabcabcx", np.uint8)
    assert longest_previous_factors(data, np.arange(8), np.arange(8), 3).tolist() == [0, 0, 0, 3, 3, 3, 3, 2]
    assert longest_previous_factors(data, np.zeros(0, np.int64), np.zeros(0, np.int64), 3).tolist() == []
