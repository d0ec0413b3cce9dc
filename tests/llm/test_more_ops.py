"""Toxicity, surrogates, nearest neighbours, sharding and URL filter on awkward rows and whole tables."""

import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import awkward, data, empty
from tessera.llm import queries, surrogates
from tessera.llm.nearest import nearest
from tessera.llm.sharding import balance_bytes, difference
from tessera.llm.toxicity import SAMPLE, WORDS, LabelModel, Model, clean, toxicity
from tessera.llm.url_filter import filter_urls

SF = "/root/testdata/sf0.01"


# --- toxicity ---
def test_toxicity_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in data("labels", "sf0.1")]
    held = [(got[d], y) for d, y in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(r["held_out"] for r, _ in held) and all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    hit = sum(r["predicted"] and y for r, y in held)
    assert hit >= 0.95 * sum(r["predicted"] for r, _ in held) and hit >= 0.75 * sum(y for _, y in held)


def test_toxicity_of_awkward_rows(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(1, 0), (2, 0), (9, None), (None, 1)], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity(df, labels).collect()] == [0.0] * df.count()
    assert clean(df, labels).columns == df.columns and clean(df, labels).count() == df.count()
    assert toxicity(empty(spark), labels).count() == 0


def test_awkward_rows_scored_by_a_trained_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    # the awkward rows, a long text among them, have ids that train, one with two labels and one without; an id of many rows trains once
    more = awkward(spark).selectExpr("IF(doc_id IS NULL, NULL, doc_id + 5000000) AS doc_id", "text")
    long_text = spark.createDataFrame([(6000000, "gentle words " * 200_000), (6000000, "other words"), (6000001, "you idiot moron, worthless scum and pathetic trash, clown and loser " * 30_000)], "doc_id long, text string")
    marked = labels.select("doc_id", "toxic").union(more.where("doc_id is not null").selectExpr("doc_id", "0")).union(spark.createDataFrame([(5000009, None), (6000000, 0), (6000000, 1), (5000001, None)], "doc_id long, toxic int"))
    got = [(r["doc_id"], r["score"], r["held_out"]) for r in toxicity(docs.union(more).union(long_text), marked).collect()]
    assert len(got) == docs.count() + more.count() + 3 and all(0 < s < 1 for _, s, _ in got)
    score = {d: s for d, s, _ in got}
    empty_text = {score[5000003], score[5000004]}
    assert len(empty_text) == 1 and empty_text.pop() < 0.7 and score[6000001] >= 0.7
    assert [h for d, _, h in got if d is None] == [False]


def test_toxicity_is_the_same_for_any_partitioning(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    one, other = ({r["doc_id"]: r["score"] for r in toxicity(docs.repartition(n), labels.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-9 for k in one)


def test_label_model_finds_the_accurate_voter():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.95, y, ~y) * 2 - 1
    noise = rng.integers(-1, 2, (4000, 4))
    known = np.where(rng.random(4000) < 0.5, y * 2 - 1, 0)
    post = LabelModel().fit(np.concatenate([good[:, None], noise, known[:, None]], 1).astype(np.int8))
    assert ((post > 0.5) == y).mean() > 0.93


@pytest.mark.parametrize("given", [1.0, 0.6])
def test_label_model_overrules_wrong_labels(given):
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    votes = np.where(rng.random((4000, 12)) < 0.95, y[:, None], ~y[:, None]) * 2 - 1
    wrong, some = rng.random(4000) < 0.2, rng.random(4000) < given
    labels = np.where(some, np.where(wrong, ~y, y) * 2 - 1, 0)
    model = LabelModel()
    post = model.fit(np.concatenate([votes, labels[:, None]], 1).astype(np.int8)) > 0.5
    assert (post == y)[wrong & some].mean() >= 0.98 and (post == y).mean() >= 0.98
    assert all(0.75 < r < 0.85 for r in model.right)  # what the labels are worth is found out


def test_label_model_counts_copies_of_a_voter_once():
    rng = np.random.default_rng(2)
    y = rng.random(6000) < 0.5
    vote = lambda p, n: np.where(rng.random((6000, n)) < p, y[:, None], ~y[:, None]) * 2 - 1
    copied = np.repeat(vote(0.7, 1), 4, axis=1)
    labels = np.where(rng.random(6000) < 0.5, vote(0.9, 1)[:, 0], 0)
    model = LabelModel()
    post = model.fit(np.concatenate([copied, vote(0.8, 4), labels[:, None]], 1).astype(np.int8)) > 0.5
    assert sum(model.parent[j] in range(4) for j in range(4)) == 3
    assert (post == y)[labels == 0].mean() > 0.88  # a vote of four equal voters would decide by the copies


def test_fitting_holds_the_sample_as_bytes():
    rng = np.random.default_rng(3)
    x = (rng.random((SAMPLE, WORDS)) < 0.05).astype(np.uint8)
    y = x[:, :40].sum(1) > 3
    chosen = [(b"word%d" % k, 3.0 if k < 20 else 1.5 if k < 40 else -0.5) for k in range(WORDS)]
    tracemalloc.start()
    try:
        model = Model(chosen, x, (rng.random((SAMPLE, 7)) < 0.1).astype(np.int8), y * 2 - 1, 0.7)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert (model.posterior > 0.5).any() and np.isfinite(model.word_weights).all()
    assert peak < 60, peak  # one copy of the sample in double precision is 50 MB, and there were several


# --- surrogates ---
def private(spark):
    texts = [
        "Mail ann.lee@mail.example.org or ANN.LEE@MAIL.EXAMPLE.ORG, call +1 (212) 555-0147 or +1 212-555-0147.", "Card 4111 1111 1111 1111 and 4111-1111-1111-1111, host 8.8.8.8.",
        'token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" for Mrs. Maria Gomez and Mrs Gomez; г-жа Иванова', "nothing here 12 3.14", None, "",
    ]
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate([*texts, texts[0]])], "doc_id long, text string, i string")


def test_surrogates_keep_type_format_and_coreference(spark):
    out = surrogates.replace(private(spark))
    assert out.columns == ["doc_id", "text", "i", "n_entities"]
    t = {r["doc_id"]: r["text"] for r in out.collect()}
    mail, shout = re.findall(r"\S+@[\w.]+\w", t[0])
    assert mail.upper() == shout and mail.endswith(".example.org") and "ann" not in mail and mail == re.findall(r"\S+@[\w.]+\w", t[6])[0]
    first, second = re.search(r"\+1 \((\d{3})\) 555-(\d{4}) or \+1 (\d{3}-555-\d{4})", t[0]).group(1, 2), re.search(r"or \+1 (\d{3})-555-(\d{4})", t[0]).groups()
    assert first == second and first != ("212", "0147")
    cards = re.findall(r"(?:\d{4}[ -]){3}\d{4}", t[1])
    digits = [re.sub(r"\D", "", c) for c in cards]
    assert digits[0] == digits[1] != "4" + "1" * 15 and sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[0])) % 10 == 0
    assert re.search(r"host 10\.\d+\.\d+\.\d+\.", t[1])
    assert re.search(r'token = "[0-9a-f]{40}"', t[2]) and "9c8b4543" not in t[2]
    given, family, again = re.search(r"Mrs\. (\w+) (\w+) and Mrs (\w+);", t[2]).groups()
    assert given in surrogates.GIVEN["f", "latin"] and family == again != "Gomez" and re.search(r"г-жа [А-Я][а-я]+", t[2]) and "Иванова" not in t[2]
    assert (t[3], t[4], t[5]) == ("nothing here 12 3.14", None, "")


def test_surrogates_are_distinct_even_where_draws_collide(spark):
    from pyspark.sql import functions as F
    from tessera.llm.common import Workspace

    cards = spark.range(3000).select(F.lit("phone").alias("kind"), F.concat(F.lit("1212555"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("canonical"))
    table = surrogates.surrogate_table(cards, "key", Workspace(spark, "test")).collect()
    assert len({r["surrogate"] for r in table}) == 3000 and not {r["surrogate"] for r in table} & {r["canonical"] for r in table}


def test_surrogates_are_distinct_where_more_entities_than_forms(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "SYLLABLES", {"latin": ["ba", "bel"], "cyrillic": ["ба", "вел"], "greek": ["βα", "γαλ"]})
    letters = lambda n: "".join(chr(97 + n // 26**i % 26) for i in range(3))
    rule = "sk" + "_" * 20
    texts = [f"+1{n:03} a@b.{letters(n)} Mrs A{letters(n)} {rule}" for n in range(700)]
    out = {r["doc_id"]: r["text"].split(" ") for r in surrogates.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for at in (0, 1, 3):
        new = {w[at] for w in out.values()}
        assert len(new) == 700 and not new & {t.split(" ")[at] for t in texts}
    assert all(re.fullmatch(r"\+1\d{3,8}", w[0]) and re.fullmatch(r"[a-z]+@[a-z]\.example\.com", w[1]) for w in out.values())
    assert len({w[4] for w in out.values()}) == 1 and out[0][4] != rule and out[0][4].startswith(rule)


@pytest.mark.parametrize("kind, real, shape", [("ip", "8.8.8.8", r"(25[6-9]|2[6-9]\d|[3-9]\d\d)(\.\d{1,3}){3}"), ("card", "4111111111111111", r"\d{18}"), ("iban", "DE44500105175407324931", r"DE\d{22}"), ("secret", "a" * 32, "[0-9a-f]{34}"), ("phone", "12125550147", r"1\d{3}555\d{6}")])
def test_wider_surrogates_keep_their_kind(spark, kind, real, shape):
    from pyspark.sql import functions as F

    row = spark.range(1).select(surrogates.surrogate(F.lit(kind), F.lit(real), F.lit(13), "key", 2).alias("s")).first()
    assert re.fullmatch(shape, row["s"])
    assert kind != "card" or sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(row["s"])) % 10 == 0


def surrogated(spark, texts, **options):
    out = surrogates.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options)
    return [r["text"] for r in out.orderBy("doc_id").collect()]


def test_long_and_short_mentions_agree_for_many_people(spark):
    letters = lambda n: "".join(chr(97 + n // 26**i % 26) for i in range(2))
    people = [(f"A{letters(k)}", "Gomez") for k in range(60)] + [(f"B{letters(k)}", f"F{letters(k % 40)}") for k in range(200)]
    out = surrogated(spark, [f"Mrs {g} {f} met Mrs {f}, then {g} {f} and {f} left." for g, f in people])
    seen, families = set(), {}
    for (g, f), text in zip(people, out, strict=True):
        m = re.fullmatch(r"Mrs ([\w-]+) (\w+) met Mrs (\w+), then ([\w-]+) (\w+) and (\w+) left\.", text)
        given, family, *again = m.groups()
        assert again == [family, given, family, family] and family != f
        assert families.setdefault(f, family) == family and all(x in surrogates.GIVEN["f", "latin"] for x in given.split("-"))
        seen.add((given, family))
    assert len(seen) == len(people) and len(set(families.values())) == len(families)


def test_titles_genders_capitals_and_hyphens(spark):
    out = surrogated(spark, ["Mrs Anna Gomez; Dr Anna Gomez; MRS ANNA GOMEZ; Anna Gomez; GOMEZ; Prof. Dr Anna Gomez; Gomezian", "Herr Jürgen Müller-Schmidt and Herr Müller-Schmidt", "Dr Anna Sole", "Mr Robin Gomez", "κύριος; Dr Ελένη Παππά", "I MISS PARIS and miss London"])
    given, family = re.match(r"Mrs (\w+) (\w+);", out[0]).groups()
    assert out[0] == f"Mrs {given} {family}; Dr {given} {family}; MRS {given.upper()} {family.upper()}; {given} {family}; {family.upper()}; Prof. Dr {given} {family}; Gomezian"
    one, two, again = re.fullmatch(r"Herr (\w+) (\w+-\w+) and Herr (\w+-\w+)", out[1]).groups()
    assert two == again and two.istitle() and one in surrogates.GIVEN["m", "latin"] and not set(two.split("-")) & {*surrogates.GIVEN["m", "latin"], "Müller", "Schmidt"}
    assert re.fullmatch(r"Dr (\w+) \w+", out[2])[1] in surrogates.GIVEN["f", "latin"]  # Anna is a woman elsewhere
    assert re.fullmatch(rf"Mr (\w+) {family}", out[3])[1] in surrogates.GIVEN["m", "latin"]
    assert re.fullmatch(r"κύριος; Dr ([^ ]+) ([α-ωΑ-Ω]+)", out[4])[1] in surrogates.GIVEN["n", "greek"]
    assert out[5] == "I MISS PARIS and miss London"


def iban_rest(iban):
    c = iban.replace(" ", "")
    return int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97


def test_check_digits_of_ibans_and_cards(spark):
    real = ["DE44 5001 0517 5407 3249 31", "GB29NWBK60161331926819", "DE45 5001 0517 5407 3249 31"]
    out = surrogated(spark, [f"to {i}." for i in real])
    got = [re.fullmatch(r"to ([A-Z0-9 ]+)\.", t)[1] for t in out]
    assert [iban_rest(g) == 1 for g in got] == [iban_rest(i) == 1 for i in real] == [True, True, False]
    assert all(re.sub("[A-Z]", "A", re.sub("[0-9]", "0", g)) == re.sub("[A-Z]", "A", re.sub("[0-9]", "0", i)) and g != i and g[:2] == i[:2] for g, i in zip(got, real, strict=True))


def test_few_free_values_end_distinct_and_apart_from_real_ones(spark):
    texts = [f"+1 0{k:02}" for k in range(60)]
    out = surrogated(spark, texts)
    digits = lambda t: re.sub(r"\D", "", t)
    assert len({digits(t) for t in out}) == 60 and not {digits(t) for t in out} & {digits(t) for t in texts}


def test_long_text_with_entities_and_clashing_columns(spark):
    text = "filler words " * 100_000 + "Mail ann@b.org. Mrs Anna Gomez " + "more words " * 100_000 + "ANN@B.ORG, Anna Gomez"
    df = spark.createDataFrame([(1, text, 5, "x"), (None, "Mrs Gomez ann@b.org", 6, None), (None, "Mrs Gomez ann@b.org", 6, None), (1, "plain", None, None)], "doc_id long, text string, n_entities int, kind string")
    out = surrogates.replace(df, count_col=None)
    assert out.columns == df.columns
    got = out.collect()
    long_text = next(r["text"] for r in got if r["text"].startswith("filler"))
    mail, given, family = re.search(r"Mail (\S+)\. Mrs (\w+) (\w+) more", long_text).groups()
    assert long_text == text.replace("ann@b.org", mail).replace("ANN@B.ORG", mail.upper()).replace("Anna Gomez", f"{given} {family}")
    assert sorted((r["text"], r["n_entities"]) for r in got if r["n_entities"] == 6) == [(f"Mrs {family} {mail}", 6)] * 2
    assert sorted(r["n_entities"] for r in surrogates.replace(df).collect()) == [0, 2, 2, 3]


#: Kinds of the mentions in the test tables, found without the operator's patterns.
PLAIN = re.compile(r"\S+@mail\d+\.example\.com|\d{4}(?:[ -]?\d{4}){3}|\(\d{3}\) 555-\d{4}|[0-9a-f]{40}|(?<![\d.])\d+\.\d+\.\d+\.\d+")


def test_surrogates_query_against_a_plain_reading(spark):
    """Text around mentions stays byte for byte; equal mentions have equal surrogates, others others; formats hold."""
    docs = {r["doc_id"]: r["text"] for r in data("documents", "sf0.01")}
    got = {r["doc_id"]: r["text"] for r in queries.op2_surrogates(spark, SF).collect()}
    assert got.keys() == docs.keys()
    shape = lambda m: re.sub(r"\d", "0", m) if "@" not in m and not re.fullmatch(r"[0-9.]+|[0-9a-f]{40}", m) else re.sub(r"[0-9a-f]", "0", m) if len(m) == 40 else "@" if "@" in m else "."
    to = {}
    for d, text in docs.items():
        found = PLAIN.findall(text)
        if not found:
            continue
        around, at = PLAIN.split(text), 0
        new = got[d]
        for k, m in enumerate(found):
            assert new.startswith(around[k], at)
            at += len(around[k])
            end = new.index(around[k + 1], at) if around[k + 1] else len(new)
            s, at = new[at:end], end
            assert to.setdefault(m, s) == s != m and shape(s) == shape(m), (m, s)
        assert new[at:] == around[-1]
    digits = lambda m: re.sub(r"[ ()-]", "", m).lower()
    assert len({digits(s) for s in to.values()}) == len({digits(m) for m in to}) > 10 and not {digits(s) for s in to.values()} & {digits(m) for m in to}


def test_surrogates_query_leaves_no_original(spark):
    got = {r["doc_id"]: r for r in queries.op2_surrogates(spark, SF).collect()}
    secret = re.compile(r"\S+@mail\d+\.example\.com|\d{16}|\(\d{3}\) 555-\d{4}|[0-9a-f]{40}|(?<![\d.])\d+\.\d+\.\d+\.\d+")
    known = {m for r in data("documents", "sf0.01") for m in secret.findall(r["text"])}
    assert known and not {m for r in got.values() for m in secret.findall(r["text"])} & known
    assert all(got[r["doc_id"]]["text"] == r["text"] for r in data("documents", "sf0.01") if not secret.search(r["text"]) and not got[r["doc_id"]]["n_entities"])


def test_surrogates_of_awkward_rows(spark):
    df = awkward(spark)
    out = surrogates.replace(df).drop("n_entities")
    assert sorted(map(repr, out.collect())) == sorted(map(repr, df.collect()))
    assert surrogates.replace(empty(spark)).count() == 0


# --- nearest neighbours ---
def brute(vectors, k=5):
    usable = [(i, np.array(v, float)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in usable:
        if q % 50 == 0:
            scored = sorted((-(w @ v) / np.sqrt((w @ w) * (v @ v)), i) for i, w in usable if i != q)
            out[q] = [i for _, i in scored[:k]]
    return out


def test_nearest_recall(spark):
    got = defaultdict(list)
    for r in queries.op4_nearest(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    expected = brute([(r["vec_id"], r["embedding"]) for r in data("embeddings", "sf0.1")])
    assert got.keys() == expected.keys() and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(e)) for q, e in expected.items()) >= 0.9 * 5 * len(expected)


def test_nearest_of_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (50, [0.0, 1.0]), (100, None)]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = [tuple(r)[:3] for r in nearest(df, df.where("vec_id % 50 = 0"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert nearest(df.limit(0), df.limit(0), 2).count() == 0


def test_nearest_of_repeated_rows_and_exact_scores(spark):
    rng = np.random.default_rng(8)
    made = [(i, rng.standard_normal(8).round(3).tolist()) for i in range(300)]
    rows = [*made, made[0], made[0], made[1], *((50, None), (100, [0.0] * 8), (150, made[7][1])), *made[200:]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in nearest(df, df.where("vec_id % 50 = 0"), 8).collect()}
    kept = dict(made)
    kept[150] = min(made[150][1], made[7][1])
    for q in range(0, 300, 50):
        a = np.array(kept[q])
        exact = sorted(((float((np.array(v) * a).sum() / (np.sqrt((np.array(v) ** 2).sum()) * np.sqrt((a * a).sum()))), -i) for i, v in kept.items() if i != q), reverse=True)[:5]
        assert [got[q, k][0] for k in range(1, 6)] == [-i for _, i in exact]
        assert all(abs(got[q, k + 1][1] - s) < 1e-12 for k, (s, _) in enumerate(exact))
    assert len(got) == 30


def test_nearest_recall_without_near_neighbours(spark):
    made = np.random.default_rng(3).standard_normal((10_000, 64))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(made.tolist())], "vec_id long, embedding array<double>")
    unit = made / np.sqrt((made * made).sum(1))[:, None]
    got = defaultdict(set)
    for r in nearest(df, df.where("vec_id % 50 = 0"), 64).collect():
        got[r["query_id"]].add(r["vec_id"])
    scores = unit[::50] @ unit.T
    scores[np.arange(200), np.arange(0, 10_000, 50)] = -2
    expected = np.argsort(-scores, axis=1)[:, :5]
    assert sum(len(got[50 * q] & set(e)) for q, e in enumerate(expected.tolist())) >= 0.985 * expected.size


# --- sharding ---
def check_shards(result, docs):
    slots, groups, sizes = defaultdict(list), defaultdict(set), [0] * 8
    for r in result:
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"], r["size"]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in groups.values())
    expected = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in result), key=repr) == expected
    return sizes


def test_sharding_query_is_tight(spark):
    result = queries.op6_sharding(spark, SF).collect()
    sizes = check_shards(result, [(r["doc_id"], r["text"]) for r in data("documents", "sf0.01")])
    assert max(sizes) - min(sizes) <= 8 and {(r["law"], r["grown_shard"]) for r in result} == {("bytes", None)}


def test_sharding_of_awkward_rows(spark):
    df = awkward(spark)
    check_shards(balance_bytes(df).collect(), [(r["doc_id"], r["text"]) for r in df.collect()])
    assert balance_bytes(empty(spark)).count() == 0


def plain_differencing(sizes, shards):
    """Karmarkar-Karp over a list: the sums of the shards."""
    parts = [sorted([s] + [0] * (shards - 1)) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1])
        a, b = parts.pop(0), parts.pop(0)
        parts.append(sorted(x + y for x, y in zip(a, reversed(b), strict=True)))
    return parts[0]


def test_sharding_is_plain_differencing_within_a_block(spark):
    docs = spark.createDataFrame([(k, "x" * (k * k % 9973)) for k in range(400)], "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        sizes = check_shards(balance_bytes(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = defaultdict(int)
    for r in docs.collect():
        groups[r["text"]] += len(r["text"]) + 1
    plain = plain_differencing(list(groups.values()), 8)
    assert max(sizes) - min(sizes) == plain[-1] - plain[0]


@pytest.mark.parametrize("numbers", [[], [5], [8, 7, 6, 5, 4], list(range(1, 200))])
def test_differencing(numbers):
    slots = difference([[n, 0, 0] for n in numbers])
    sums = [sum(n for n, s in zip(numbers, slots, strict=True) if s[0] == k) for k in range(3)]
    assert sum(sums) == sum(numbers) and max(sums) - min(sums) <= max([0, *numbers])
    assert not numbers or all(sorted(s) == [0, 1, 2] for s in slots)


# --- URL filter ---
def test_url_rules_and_awkward_rows(spark):
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/1?q=/a", "http://www.example.com/en/", "http://m.example.com/en/x#y", "http://x.net/es/1", "http://net/fr/", "http://x.net/esx", "http://com", "nothing", None, "", "http://notexample.com/en/", "http://a.org?u=http://b.com/"]
    df = spark.createDataFrame([(k, u, None, "v") for k, u in enumerate([*urls, urls[1]])], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in filter_urls(df).collect()}
    assert [got[k] for k in range(14)] == [
        ("a.com", "/x", "com/", "allow"), ("example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("m.example.com", "/en/x", "example.com/en/", "block"),
        ("x.net", "/es/1", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block"), ("x.net", "/esx", None, "allow"), ("com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("notexample.com", "/en/", "com/", "allow"), ("a.org", "", None, "allow"), ("example.com", "/en/1", "example.com/en/", "block"),
    ]
    assert filter_urls(df.limit(0)).count() == 0


def test_distrust_flows_to_those_who_link_to_blocked_hosts(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    rows = [(1, "http://bad.net/es/1", ""), (2, "http://friend.org/a", link("bad.net")), (3, "http://mixed.org/a", link("bad.net", "good.com", "other.org")), (4, "http://good.com/", link("kept.org")), (5, "http://kept.org/", link("bad.net")), (6, "http://other.org/", "")]
    got = {r["page_id"]: r["verdict"] for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "block" and got[4] == "allow" and got[6] == "allow" and got[5] == "allow"
    only = [(1, "http://bad.net/es/1", ""), (2, "http://friend.org/a", link("bad.net"))]
    assert {r["page_id"]: r["verdict"] for r in filter_urls(spark.createDataFrame(only, "page_id long, url string, html string")).collect()} == {1: "block", 2: "block"}


def plain_scores(pages, rules):
    """Trust less distrust of hosts, by the plain iteration to convergence."""
    judged, links = defaultdict(list), defaultdict(lambda: defaultdict(int))
    for host, verdict, targets in pages:
        judged[host].append(verdict)
        for t in targets:
            if t != host:
                links[host][t] += 1
    net = defaultdict(float)
    for sign, what, forward in ((1, "allow", True), (-1, "block", False)):
        arcs = defaultdict(dict)
        for a, to in links.items():
            for b, n in to.items():
                arcs[a if forward else b][b if forward else a] = n
        seed = {h: sum(v == what for v in vs) / len(vs) for h, vs in judged.items()}
        now = dict(seed)
        for _ in range(300):
            new = defaultdict(float, seed)
            for a, to in arcs.items():
                for b, n in to.items():
                    new[b] += 0.85 * now.get(a, 0.0) * n / sum(to.values())
            now = new
        for h, v in now.items():
            net[h] += sign * v
    return net


def link_graph(seed):
    """Pages of 60 hosts with chains, cycles and hubs; targets with ports, user names, case and blanks."""
    rng = np.random.default_rng(seed)
    hosts = [f"h{k}.{['org', 'info', 'com'][k % 3]}" for k in range(55)] + [f"b{k}.net" for k in range(5)]
    rows = []
    for k, host in enumerate(hosts):
        for page in range(int(rng.integers(1, 5))):
            targets = [hosts[k - 1]] if k < 40 and k else [hosts[i] for i in rng.integers(0, 60, rng.integers(0, 6))] + [hosts[-1]] * int(rng.integers(0, 4))
            shown = [f"{'user@' * int(rng.integers(0, 2))}{t.upper() if rng.integers(0, 2) else t}{['', ':80', '.', ':'][int(rng.integers(0, 4))]}" for t in targets]
            html = "".join(f'<a class=x href{" " * int(rng.integers(0, 15))}= "http://{t}/p?q">y</a><img src="//elsewhere.net/i">' for t in shown)
            start = ["/es/", "/fr/", "/x"][int(rng.integers(0, 3))] if host.endswith("net") else "/p"
            rows.append((len(rows), f"http://{host}{[':8080', ''][int(rng.integers(0, 2))]}{start}", html, host, targets))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_propagation_against_plain_iteration(spark, seed):
    rows = link_graph(seed)
    verdict = lambda u, h: "allow" if h.endswith(".com") and ":" not in u[5:] else "block" if h.endswith(".net") and ":" not in u[5:] and re.search("/es/|/fr/", u) else None
    net = plain_scores([(h, verdict(u, h), t) for _, u, _, h, t in rows], None)
    assert all(abs(v + 0.5) > 1e-3 for v in net.values())
    expected = {p: verdict(u, h) or ("block" if net[h] < -0.5 else "allow") for p, u, _, h, _ in rows}
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in filter_urls(df).collect()} == expected
    assert sum(v == "block" and not verdict(u, h) for (p, u, _, h, _), v in zip(rows, expected.values(), strict=True)) > 3


def test_url_sql_on_a_link_graph_and_awkward_pages(spark, tmp_path):
    import duckdb

    rows = [r[:3] for r in link_graph(4)] + [(900, None, None), (901, "no host", "<a href='//b0.net/'>"), (902, "http://b0.net/es/", None), (902, "http://b0.net/es/", None), (903, "http://H1.org?x#y", ""), (904, "http://u@x.h1.org:9/\n?", "x" * 300_000 + '<A\nHREF=//b1.net>')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(f"file://{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted((tuple(r) for r in queries.op8_url_filter(spark, f"file://{tmp_path}").select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)
    assert got == sorted(con.execute(queries.ORACLE_SQL["op8_url_filter"]).fetchall(), key=repr)


# --- pipeline ---
def test_pipeline_stage_by_stage(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_decontamination import brute as contaminated
    from test_jaccard_join import brute as copies

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r["doc_id"]: r["predicted"] for r in queries.op1_toxicity(spark, SF).collect()}
    now = {r["doc_id"]: r["text"] for r in docs.collect()}
    now = {d: t for d, t in now.items() if not scores[d]}
    now = {d: now[d] for d, _, c in copies(sorted(now.items())) if d == c}
    bad = {r[0] for r in contaminated(sorted(now.items()), [(r["item_id"], r["text"]) for r in data("benchmark", "sf0.01")]) if r[5]}
    now = {d: t for d, t in now.items() if d not in bad}
    from test_token_ops import BYTES, check_packing
    from tokenizers import Tokenizer

    for name, stage in pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == now
    # the fourth stage changes mentions alone, each to the surrogate it has everywhere
    docs = pipeline.STAGES[3][1](spark, docs, SF)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    new, to = {r["doc_id"]: r["text"] for r in docs.collect()}, {}
    assert new.keys() == now.keys()
    for d, text in now.items():
        found, kept = PLAIN.findall(text), PLAIN.split(text)
        at = 0
        for m, before, after in zip(found, kept, kept[1:], strict=False):
            assert new[d].startswith(before, at)
            at += len(before)
            end = new[d].index(after, at) if after else len(new[d])
            assert to.setdefault(m, new[d][at:end]) == new[d][at:end] != m
            at = end
        assert new[d][at:] == kept[-1]
    assert len(to) > 5
    # the last one packs the ids of those texts
    check_packing(pipeline.run(spark, SF).collect(), sorted(new.items()), Tokenizer.from_file(BYTES))


def test_pipeline_stages_take_awkward_rows_and_empty_tables(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf, df = "/root/testdata/sf0.001", awkward(spark)
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns, name
        kept = sorted(map(repr, out.collect()))
        assert set(kept) <= set(map(repr, df.collect())), name
        assert len(kept) == {"near_copies": 10}.get(name, df.count()), name
        assert stage(spark, empty(spark), sf).count() == 0, name
    assert {r["doc_id"] for r in pipeline.STAGES[4][1](spark, df, sf).collect()} == {r["doc_id"] for r in df.collect()}
    assert pipeline.STAGES[4][1](spark, empty(spark), sf).count() == 0
