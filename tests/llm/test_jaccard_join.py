"""The Jaccard join and its components against all pairs."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, data, empty
from pyspark.sql import functions as F
from tessera.llm import queries
from tessera.llm.common import Workspace, mix
from tessera.llm.components import _star, components
from tessera.llm.jaccard_join import FETCHES, SKETCH_BITS, SLICE, _scan, _shared, bins_of, frequent_tokens, least_apart, near_copies, one_of_each, prefix, signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, width=4, percent=85):
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders, order = {}, sorted(range(len(docs)), key=lambda i: len(sets[i]))
    for j in order:
        shared = {}
        for s in sets[j]:
            for i in holders.setdefault(s, []):
                shared[i] = shared.get(i, 0) + 1
            holders[s].append(j)
        for i, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted([(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)], key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_all_pairs(spark):
    docs = [(r["doc_id"], r["text"]) for r in data("documents", "sf0.01")]
    expected = brute(docs)
    assert rows(queries.op7_jaccard_join(spark, "/root/testdata/sf0.01")) == expected
    assert any(d != c for d, _, c in expected)


def test_awkward_rows(spark):
    df = awkward(spark)
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = rows(near_copies(df))
    assert [r[:2] for r in got] == [r[:2] for r in brute(docs)]
    named = {d: c for d, _, c in got if d not in (7, 8, None)}
    assert named == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 9: 9, 10: 10}
    assert near_copies(empty(spark)).count() == 0
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 3, 4, 5, 6, 8, 8, 9, 10, None], key=repr)


def test_null_and_repeated_ids_against_all_pairs(spark):
    rng = random.Random(5)
    docs = [(r["doc_id"], r["text"]) for r in awkward(spark).collect()]
    for k in range(12):
        text = [f"t{rng.randrange(9000)}" for _ in range(90)]
        # near copies with and without ids, one under an id of other texts; without any id; a repeated row without an id
        docs += [(100 + k, " ".join(text)), (None, " ".join([*text, "more"])), (8, " ".join([*text, "and", "more"])), (None, " ".join([*text[:45], "x", *reversed(text)]))]
        docs += [(None, " ".join([*reversed(text), "less"])), (None, " ".join([*reversed(text), "or"]))] + [(None, " ".join([*reversed(text), "or"]))]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = brute(docs)
    assert rows(near_copies(df)) == expected
    assert sum(d is None and c is not None for d, _, c in expected) == 12
    kept = [tuple(r) for r in one_of_each(df).collect()]
    assert len(kept) == len(set(kept))
    # all that is kept stands alone, and all that is not has a near copy in it
    assert len({c for d, n, c in brute([(i, t) for i, (_, t) in enumerate(kept)]) if n}) == sum(n > 0 for _, n, _ in brute(kept))
    ids = brute([(i, t) for i, (_, t) in enumerate(docs)])
    assert len({c for _, n, c in ids if n}) == sum(n > 0 for _, n, _ in brute(kept))


def chains(seed):
    """Near copies in chains around shared boilerplate that most documents hold."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    licence, docs = [word() for _ in range(120)], []
    for _ in range(60):
        text = licence + [word() for _ in range(rng.choice([0, 5, 9, 16, 20, 24, 300]))]
        for _ in range(rng.choice([1, 1, 2, 9])):
            docs.append(" ".join(text))
            text = list(text)
            for _ in range(rng.choice([1, 1, 2, 4])):
                text[rng.randrange(len(text))] = word()
    for _ in range(40):
        docs.append(" ".join(licence[: rng.randrange(1, 14)]))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_boilerplate_and_chains(spark, seed):
    docs = chains(seed)
    assert rows(near_copies(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


@pytest.mark.parametrize("seed", range(40))
def test_linking_sets_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    frequent = np.packbits(rng.random(1 << SKETCH_BITS) < rng.choice([0.0, 0.1, 0.8, 0.95, 1.0]))
    n = int(rng.choice([1, 2, 5, 9, 10, 11, 12, 13, 14, 40, 180, 210, 600, 2100]))
    base = mix(rng.integers(1, 1 << 62, 3 * n).astype(np.uint64))
    for _ in range(20):
        a = base[:n]
        change = int(rng.integers(0, max(1, n // 7) + 1))
        b = np.concatenate([a[change:], base[n : n + int(rng.integers(0, change + 1))]])
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            (x, y), mixed = signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)]), frequent, 85)
            shared = np.intersect1d(x, y)
            assert len(shared)
            # the bound by which pairs with too few signatures in common are dropped
            if not mixed.all() and not (shared & np.uint64(1)).any():
                rest = max(len(a) - prefix(len(a), 85), len(b) - prefix(len(b), 85))
                assert len(shared) + rest >= both


@pytest.mark.parametrize("seed", range(10))
def test_odd_sketches_never_exceed_the_difference(seed):
    rng = np.random.default_rng(seed)
    tokens = np.unique(mix(rng.integers(1, 1 << 62, 9000).astype(np.uint64)))
    sets = [np.sort(rng.choice(tokens[: rng.integers(500, len(tokens))], rng.integers(1, 400), replace=False)) for _ in range(6)] + [tokens, tokens[7:], tokens[:1200]]
    large = bins_of(np.concatenate(sets), np.array([len(s) for s in sets]))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert least_apart(large[i], large[j]) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("seed", range(20))
def test_shared_signatures_across_batches(seed):
    rng = np.random.default_rng(seed)
    rows = sorted((int(s), int(c)) for s, c in zip(rng.integers(0, 12, 60), rng.integers(0, 3, 60), strict=True))
    table = pa.table({"signature": [r[0] for r in rows], "component": [r[1] for r in rows], "n": [None if r[1] else 5 for r in rows]}, schema=pa.schema([(c, pa.int64()) for c in ("signature", "component", "n")]))
    got = [tuple(r.values())[:2] for b in _shared(iter(table.to_batches(max_chunksize=int(rng.integers(1, 20))))) for r in b.to_pylist()]
    many = {s for s, _ in rows if len({c for t, c in rows if t == s}) > 1}
    assert got == sorted({r for r in rows if r[0] in many})


def test_the_sketch_comes_to_the_driver_in_few_jobs(spark):
    texts = [("one common passage of words " if k % 2 else "") + f"text {k} with {k * 7} own words {k * 13}" for k in range(400)]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, key long")
    raw = docs.repartition(4).mapInArrow(_scan(4, SKETCH_BITS), "doc_id long, key long, node long, n long, sketch array<long>, bins binary, counts binary")
    counts = raw.where("n = -1").select(F.col("key").alias("part"), "counts").localCheckpoint()
    total = np.zeros(1 << SKETCH_BITS, np.uint64)
    for part, packed in counts.collect():
        total[part * SLICE : (part + 1) * SLICE] += np.frombuffer(zlib.decompress(packed), np.uint16)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "48"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("sketch", "sketch")
        got = frequent_tokens(counts, SKETCH_BITS, Workspace(spark, "sketch"))
    finally:
        spark.sparkContext.setJobGroup("tests", "tests")
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == np.packbits(total > 2 * total.mean() + 64).tobytes() and any(got)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("sketch")) <= FETCHES + 4  # a job for each partition of the shuffle, before


def test_components_of_random_links_without_a_broadcast(spark):
    rng = np.random.default_rng(7)
    links = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (260, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    up = {}
    for a, b in links:
        one, other = (min(c) for c in (up.setdefault(a, {a}), up.setdefault(b, {b})))
        if one != other:
            both = up[a] | up[b]
            up |= dict.fromkeys(both, both)
    edges = spark.createDataFrame(links, "u long, v long")
    got = components(edges, Workspace(spark, "links")).collect()
    assert sorted(map(tuple, got)) == sorted((x, min(c)) for x, c in up.items() if len(c) > 1)
    for large in (True, False):
        assert "Broadcast" not in _star(edges, large)._jdf.queryExecution().executedPlan().toString()
