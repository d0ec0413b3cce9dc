"""Decontamination against a word-by-word search."""

import hashlib
import re

from cases import awkward, data, empty
from tessera.llm import decontamination, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, items):
    word = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = word(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = word(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= found
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark):
    got = rows(queries.op3_decontamination(spark, "/root/testdata/sf0.01"))
    docs, items = data("documents", "sf0.01"), data("benchmark", "sf0.01")
    assert got == brute([(r["doc_id"], r["text"]) for r in docs], [(r["item_id"], r["text"]) for r in items])
    assert any(r[5] for r in got)


def items(spark):
    texts = [(1, "alpha BETA gamma"), (2, None), (3, ""), (4, "..."), (5, "alpha beta gamma"), (6, " ".join("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split())), (None, "theta iota")]
    return spark.createDataFrame(texts, "item_id long, text string")


def test_awkward_rows_and_blocks(spark):
    df, bench = awkward(spark), items(spark)
    expected = brute([(r["doc_id"], r["text"]) for r in df.collect()], [(r["item_id"], r["text"]) for r in bench.collect() if r["item_id"] is not None])
    assert rows(decontamination.contamination(df, bench)) == expected
    found = decontamination.scan(df, bench, "_found", block_windows=10)  # several blocks
    assert sorted((r["doc_id"], r["_found"]["n_words"], sum(s["b"] - s["a"] for s in r["_found"]["spans"]), len(r["_found"]["items"])) for r in found.collect() if r["doc_id"]) == sorted(x[:4] for x in expected if x[0])
    assert decontamination.contamination(empty(spark), bench).count() == 0
    assert not any(r["contaminated"] for r in decontamination.contamination(df, bench.limit(0)).collect())


def test_removal_of_documents_and_spans(spark):
    df, bench = awkward(spark), items(spark)
    kept = decontamination.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6, 8, 9, 10}
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(df, bench, spans=True).collect()}
    assert cut[1] == " omicron pi rho sigma tau upsilon" and cut[3] is None


def test_items_without_an_id_are_hits(spark):
    docs = spark.createDataFrame([(1, "one Theta-Iota two"), (2, "theta two iota"), (3, "alpha beta gamma theta iota")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "theta iota"), (None, "theta iota"), (1, "alpha beta gamma")], "item_id long, text string")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows(decontamination.contamination(docs, bench)) == [(1, 4, 2, 0, digest(""), True), (2, 3, 0, 0, digest(""), False), (3, 5, 5, 1, digest("1"), True)]
    assert {r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()} == {2}
    found = decontamination.scan(docs, bench, "_found", block_windows=2).collect()  # several blocks
    assert sorted((r["doc_id"], sum(s["b"] - s["a"] for s in r["_found"]["spans"])) for r in found) == [(1, 2), (2, 0), (3, 5)]


def test_columns_of_clashing_names_and_windows_of_many_items(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, 8, 9), (1, "a b c", 7, 8, 9), (None, "x", None, 0, 0)], "doc_id long, text string, found int, row int, mark int")
    bench = spark.createDataFrame([(k, "A b") for k in range(40)], "item_id long, text string")
    assert decontamination.decontaminate(docs, bench).collect() == docs.where("doc_id is null").collect()
    for windows in (3, 1 << 21):
        found = decontamination.scan(docs, bench, "hits", block_windows=windows)
        assert found.columns == [*docs.columns, "hits"]
        assert sorted((r["hits"]["n_words"], len(r["hits"]["items"]), [(s["a"], s["b"]) for s in r["hits"]["spans"]]) for r in found.collect()) == [(1, 0, []), (3, 40, [(0, 2)]), (3, 40, [(0, 2)])]
