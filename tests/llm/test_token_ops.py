"""Token counts and packing against the tokenizer libraries themselves."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import awkward, data, empty
from tessera.llm import packing, queries
from tessera.llm.token_counts import token_counts

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def piece():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def byte_level():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def expected_counts(docs, piece):
    return sorted([(d, len((t or "").encode()), n := len(piece.encode(t or "")), n > 4096) for d, t in docs], key=repr)


def test_counts_of_awkward_rows(spark, piece):
    df = awkward(spark)
    got = sorted([tuple(r)[:4] for r in token_counts(df, PIECES).collect()], key=repr)
    assert got == expected_counts([(r["doc_id"], r["text"]) for r in df.collect()], piece)
    assert token_counts(empty(spark), PIECES).count() == 0


def test_counts_query_against_library(spark, piece):
    got = sorted([tuple(r)[:4] for r in queries.op9_token_counts(spark, "/root/testdata/sf0.01").collect()], key=repr)
    assert got == expected_counts([(r["doc_id"], r["text"]) for r in data("documents", "sf0.01")], piece)


def test_cache_holds_each_text_once_and_is_reused(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    df = awkward(spark)
    token_counts(df, PIECES, cache).collect()
    texts = {r["text"] or "" for r in df.collect()}  # this tokenizer counts blanks
    assert spark.read.parquet(cache).count() == len(texts)
    token_counts(df.unionByName(df), PIECES, cache).collect()
    assert spark.read.parquet(cache).count() == len(texts)  # nothing new was encoded
    token_counts(df, BYTES, cache).collect()
    assert spark.read.parquet(cache).count() == 2 * len(texts)  # another tokenizer has counts of its own


def test_query_joins_the_counts_of_a_cache(spark, piece, tmp_path):
    spark.conf.set("spark.tessera.token.cache", f"file://{tmp_path}/cache")
    try:
        first = sorted(map(repr, queries.op9_token_counts(spark, "/root/testdata/sf0.001").collect()))
        parts = lambda: sum(1 for _ in tmp_path.rglob("part-*"))
        table = spark.read.parquet(f"file://{tmp_path}/cache")
        assert table.count() == len({r["text"] or "" for r in data("documents")})
        # a stored count is what the query returns; it encodes nothing twice
        files = parts()
        assert sorted(map(repr, queries.op9_token_counts(spark, "/root/testdata/sf0.001").collect())) == first
        assert sum(r.num_rows for r in map(__import__("pyarrow.parquet").parquet.read_table, tmp_path.rglob("part-*.parquet"))) == len({r["text"] or "" for r in data("documents")})
        assert parts() >= files
    finally:
        spark.conf.unset("spark.tessera.token.cache")


def test_texts_that_differ_in_blanks_share_a_count_where_blanks_collapse(spark, piece, tmp_path, monkeypatch):
    from tessera.llm import token_counts as module

    assert not module._collapses(PIECES, open(PIECES, "rb").read()) and not module._collapses(BYTES, b"")
    monkeypatch.setattr(module, "_collapses", lambda name, model: True)
    df = spark.createDataFrame([(1, "two words"), (2, "  two   words "), (3, None), (4, " ")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts(df, PIECES, f"file://{tmp_path}/c").collect()}
    n = len(piece.encode("two words"))
    assert got == {1: (9, n), 2: (14, n), 3: (0, 0), 4: (1, 0)} and spark.read.parquet(f"file://{tmp_path}/c").count() == 2


def test_hot_texts(spark, piece):
    df = spark.range(6000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a very common text', concat('text ', id)) AS text")
    got = sorted([tuple(r)[:4] for r in token_counts(df, PIECES).collect()], key=repr)
    assert got == expected_counts([(r["doc_id"], r["text"]) for r in df.collect()], piece)


def check_packing(result, docs, byte_level, capacity=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in result:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    expected = defaultdict(list)
    for d, t in docs:
        ids = [*byte_level.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        expected[d] += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert {d: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rs) for d, rs in by_doc.items()} == {d: sorted(x) for d, x in expected.items()}
    return len(by_sequence)


def test_packing_of_awkward_rows(spark, byte_level):
    df = awkward(spark)
    check_packing(packing.pack(df, BYTES).collect(), [(r["doc_id"], r["text"]) for r in df.collect()], byte_level)
    assert packing.pack(empty(spark), BYTES).count() == 0


def test_packing_query_is_whole_and_tight(spark, byte_level):
    result = queries.op5_packing(spark, "/root/testdata/sf0.01").collect()
    n = check_packing(result, [(r["doc_id"], r["text"]) for r in data("documents", "sf0.01")], byte_level)
    assert n <= 1.01 * -(-sum(r["length"] for r in result) // 2048) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 200))
    counts = np.zeros(capacity + 1, np.int64)
    counts[1:] = rng.integers(0, [2, 9, 400][seed % 3], capacity)
    used = np.zeros_like(counts)
    for parts, n in packing.plan(counts, capacity):
        assert sum(parts) <= capacity
        for p in parts:
            used[p] += n
    assert (used == counts).all()


def test_packing_in_small_batches_with_two_tokenizers(spark, byte_level):
    """A worker that meets both tokenizers and the same ids again keeps them apart, and one encoder at most."""
    import json

    df = awkward(spark)
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    other = json.loads(open(BYTES).read())
    other["added_tokens"] = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        import tempfile

        from tokenizers import Tokenizer

        with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
            json.dump(other, f)
            f.flush()
            plain = Tokenizer.from_file(f.name)
            for _ in range(2):
                check_packing(packing.pack(df.coalesce(1), BYTES).collect(), docs, byte_level)
                check_packing(packing.pack(df.coalesce(1), f.name).collect(), docs, plain)
        assert byte_level.encode("<|endoftext|>").ids != plain.encode("<|endoftext|>").ids
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_packing_makes_one_encoder_for_all_batches(monkeypatch):
    from pathlib import Path
    from types import SimpleNamespace

    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(packing, "_MADE", made := {})
    batches = [pa.record_batch([pa.array([k], pa.int64()), pa.array(["some text"])], ["doc_id", "text"]) for k in (11, 12, 13)]
    out = list(packing._pieces(Path(BYTES).read_text("utf-8"), 2048, 0)(iter(batches)))
    assert [b.column(0).to_pylist() for b in out] == [[11], [12], [13]] and len(made) == 1


def test_a_worker_that_serves_another_operator_gives_up_what_packing_kept():
    from tessera.llm import common

    packing._MADE["digest"] = object()
    common.release("packing")
    assert packing._MADE
    common.release()
    assert not packing._MADE


def test_what_packing_kept_goes_back_to_the_system_at_once(tmp_path):
    """In a process of its own, without the collector's help, as a worker may not meet it for long."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import gc, re, weakref
from pathlib import Path
from tessera.llm import common, packing
gc.disable()
memory = lambda: sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
packing._MADE["digest"] = ids = packing.WordIds(Path({BYTES!r}).read_text("utf-8"))
ids.encode(["warm"])
start = memory()
ids.encode([" ".join(f"word{{k}}" for k in range(at, at + 1000)) for at in range(0, 150_000, 1000)])
full, ref = memory(), weakref.ref(ids)
del ids
common.release("packing")
assert ref() is not None
common.release()
assert ref() is None, "the words are kept by a cycle"
assert full - memory() > 0.8 * (full - start), (start, full, memory())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[2])
