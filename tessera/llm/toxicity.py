"""Toxicity by weak supervision.

Voters look at a text: lexicons of words, and patterns of characters and layout. A generative label model estimates, by
expectation maximisation, how often each voter is right and how it leans on the voter it depends on most (a tree of
correlations). The given labels are one voter more, whose accuracy is estimated like the others', so that voters who agree
overrule a wrong label; rows without a label take part too. The posterior labels train a linear classifier over word presence
and votes. Scores put the cut that fits the posterior labels best at ``cut``.

Fitting uses a sample of the training folds, by the hash of the ids: at most ``SAMPLE`` rows with a label, and ``UNLABELLED``
times as many without. Its texts stay in Spark: words are counted there, and the driver gets the ``WORDS`` that tell most and, for each row,
which of them it has and its pattern votes; their size is bounded by these parameters, however long the texts are. The fitted
weights go to the executors, and every whole text is scored in one pass without a shuffle. Labels, language, source and ids are
never inputs.

Defined results: null and empty texts have no words and get the score of such a text; repeated rows score alike, and one text of
each id, the least, may train; rows without a label or with a null one train without it; several labels of an id count as their
largest; without any usable label, or with one class only, every score is 0; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, release

#: Bound of the fitting sample in rows with a label, rows without one for each of them, and the bound of the words that carry a weight.
SAMPLE, UNLABELLED, WORDS = 16_000, 1 / 16, 400
#: Rows of the sample that must hold a word.
LEAST = 8
#: Bytes to bytes: what isn't a letter becomes a space, capitals small.
LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
#: Bytes of a stem.
STEMS = (4, 5, 6)
#: Rows of the sample that fitting holds as floating point numbers at once.
BLOCK = 1024
#: The most log odds that all voters together may have.
CLIP = 12.0
PATTERNS = ["shouting", "exclaiming", "symbols", "digits", "repeating", "short", "lines"]


def words(text: bytes) -> set[bytes]:
    """The distinct words of a text, and their stems: the first letters of longer words, marked by a hyphen."""
    whole = set(text.translate(LETTERS).split())
    return whole | {w[:n] + b"-" for n in STEMS for w in whole if len(w) > n}


def patterns(text: bytes, n_words: int) -> list[int]:
    """Votes of the pattern voters: 1 where the pattern shows, else 0."""
    n = max(1, len(text))
    capitals = n - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = text.count(b"!")
    symbols = n - len(text.translate(None, b"#$%&*@^~|<>{}"))
    digits = n - len(text.translate(None, b"0123456789"))
    return [int(capitals > 0.3 * n), int(marks > 0.01 * n), int(symbols > 0.03 * n), int(digits > 0.1 * n), int(n_words * 12 < len(text) // 6), int(n_words < 12), int(text.count(b"\n") > n / 40)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (word, toxic rows, other rows) of each batch."""
    release()
    for batch in batches:
        held: dict[bytes, list[int]] = {}
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            for w in words((text.as_py() or "").encode()):
                held.setdefault(w, [0, 0])[not toxic] += 1
        yield pa.record_batch([pa.array(list(held), pa.binary()), *(pa.array([v[k] for v in held.values()], pa.int64()) for k in (0, 1))], ["word", "p", "q"])


def lexicon(sample: DataFrame, a: int, b: int) -> list[tuple[bytes, float]]:
    """The words that tell most about the label by their likelihood ratio, with their log odds; of ``a`` toxic rows and ``b`` others."""
    counts = sample.where("toxic is not null").select("text", "toxic").mapInArrow(_counted, "word binary, p long, q long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).where(F.col("p") + F.col("q") >= LEAST)
    share = (F.col("p") + F.col("q")) / float(a + b)
    cells = ((F.col("p"), a * share), (F.col("q"), b * share), (a - F.col("p"), a * (1 - share)), (b - F.col("q"), b * (1 - share)))
    tells = sum((F.when(n > 0, n * F.log(n / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0) for n, expected in cells), F.lit(0.0))
    odds = F.log((F.col("p") + 0.5) / (a - F.col("p") + 0.5)) - F.log((F.col("q") + 0.5) / (b - F.col("q") + 0.5))
    best = counts.select("word", odds.alias("odds"), F.round(tells, 9).alias("tells")).orderBy(F.desc("tells"), "word").limit(WORDS)
    return [(bytes(r["word"]), r["odds"]) for r in best.collect()]


def _described(index: dict[bytes, int]):
    """(text, toxic) to (which words of ``index`` it has, as bits; pattern votes; toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0):
                raw = (text.as_py() or "").encode()
                w = words(raw)
                has = np.zeros(len(index), np.uint8)
                has[[index[x] for x in index.keys() & w]] = 1
                out.append((np.packbits(has).tobytes(), bytes(patterns(raw, len(w)))))
            yield pa.record_batch([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary()), batch.column(1)], ["words", "patterns", "toxic"])

    return run


def voters(chosen: list[tuple[bytes, float]]) -> list[tuple[frozenset[bytes], int]]:
    """Lexicon voters (words, vote): the strongest words alone, the others in groups of like odds."""
    strong = [w for w, o in chosen if o > 2.5]
    out = [(frozenset([w]), 1) for w in strong[:30]]
    for low, high, vote in ((2.5, 99, 1), (1.2, 2.5, 1), (0.5, 1.2, 1), (-99, -1.0, -1), (-1.0, -0.4, -1)):
        group = [w for w, o in chosen if low < o <= high and w not in strong[:30]]
        out += [(frozenset(group[k::3]), vote) for k in range(3) if group[k::3]]
    return out


def blocks(n: int) -> Iterator[slice]:
    return (slice(k, k + BLOCK) for k in range(0, n, BLOCK))


class LabelModel:
    """P(votes, y) with a tree of dependencies: each voter depends on y and on one other voter."""

    def fit(self, votes: np.ndarray, rounds: int = 40) -> np.ndarray:
        """Posterior P(y = 1) of each row. Votes are -1, 0 (abstains) or 1; the last column holds the given labels, 0 where there is none."""
        n, m = votes.shape
        v = votes.astype(np.int64) + 1
        given = votes[:, -1]
        base = np.clip((given > 0).sum() / max(1, (given != 0).sum()), 0.01, 0.99)
        post = np.where(given == 0, base, (given > 0) * 0.8 + 0.1)
        self.parent = np.full(m, -1)
        for r in range(rounds):
            if r in (0, 8):
                self.parent = self._tree(v[:, :-1], post)
            log = np.zeros((n, 2))
            for j in range(m - 1):
                p = self.parent[j]
                above = v[:, p] if p >= 0 else np.zeros(n, np.int64)
                for y, weight in ((0, 1 - post), (1, post)):
                    joint = np.bincount(3 * above + v[:, j], weight, 9).reshape(3, 3) + 0.1
                    log[:, y] += np.log(joint / joint.sum(1, keepdims=True))[above, v[:, j]]
            # what the given labels are worth is estimated too; a row without one has no vote there
            self.right = np.array([((given == s) * w).sum() + 2 for s, w in ((-1, 1 - post), (1, post))]) / np.array([((given != 0) * w).sum() + 2.5 for w in (1 - post, post)])
            false, true = self.right
            label = np.where(given > 0, np.log(true / (1 - false)), np.where(given < 0, np.log((1 - true) / false), 0.0))
            prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
            new = 1 / (1 + np.exp(-(np.clip(log[:, 1] - log[:, 0], -CLIP, CLIP) + label + np.log(prior / (1 - prior)))))
            done = np.abs(new - post).max() < 1e-4
            post = new
            if done and r > 8:
                break
        return post

    def _tree(self, v: np.ndarray, post: np.ndarray) -> np.ndarray:
        """The maximum spanning tree of the voters' mutual information given y; a voter's parent joined before it. Votes are 0 to 2."""
        n, m = v.shape
        info = np.zeros((m, m))
        for weight in (1 - post, post):
            total = weight.sum() + 1e-9
            joint, single = np.zeros((3 * m, 3 * m)), np.zeros(3 * m)
            for at in blocks(n):
                flat = (v[at, :, None] == np.arange(3)).reshape(-1, 3 * m).astype(float)
                weighed = flat * weight[at, None]
                joint += flat.T @ weighed
                single += weighed.sum(0)
            joint = joint.reshape(m, 3, m, 3).transpose(0, 2, 1, 3) / total + 1e-6
            single = single.reshape(m, 3) / total + 1e-6
            info += total / n * (joint * (np.log(joint) - np.log(single)[:, None, :, None] - np.log(single)[None, :, None, :])).sum((2, 3))
        parent, known = np.full(m, -1), []
        rest = list(range(m))
        while rest:
            gain, j, p = max((info[j, p], -j, p) for j in rest for p in known) if known else (0, -rest[0], -1)
            parent[-j] = p if gain > 0.002 else -1
            known.append(-j)
            rest.remove(-j)
        return parent


def classify(x: np.ndarray, target: np.ndarray, penalty: float = 3.0, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression (the first is the intercept, without penalty), by Newton's method."""
    ridge = np.full(x.shape[1] + 1, penalty)
    ridge[0] = 1e-6
    w = np.zeros(len(ridge))
    for _ in range(steps):
        gradient, hessian = ridge * w, np.diag(ridge)
        for at in blocks(len(x)):
            rows = np.concatenate([np.ones((len(x[at]), 1)), x[at]], 1)
            p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
            gradient += rows.T @ (p - target[at])
            hessian += (rows * (p * (1 - p) + 1e-9)[:, None]).T @ rows
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Weights by word, lexicon voters and pattern voters."""

    def __init__(self, chosen: list[tuple[bytes, float]], x: np.ndarray, shown: np.ndarray, given: np.ndarray, cut: float) -> None:
        """``x``: which of the chosen words each row has; ``shown``: its pattern votes; ``given``: its label as -1 or 1, 0 for none."""
        self.index = {w: k for k, (w, _) in enumerate(chosen)}
        self.voters = voters(chosen)
        ruled = [vote * x[:, [self.index[w] for w in lex]].any(1) for lex, vote in self.voters]
        ruled = np.concatenate([np.array(ruled, np.int8).reshape(len(ruled), len(x)).T, shown.astype(np.int8)], 1)
        self.posterior = LabelModel().fit(np.concatenate([ruled, given.astype(np.int8)[:, None]], 1))
        x = np.concatenate([x.astype(np.int8), ruled], 1)
        weights = classify(x, self.posterior)
        self.bias, self.word_weights, self.vote_weights = weights[0], weights[1 : 1 + len(chosen)], weights[1 + len(chosen) :]
        raw = np.concatenate([x[at].astype(float) @ weights[1:] for at in blocks(len(x))]) + self.bias
        # the cut of the best F measure against the posterior labels, in the middle of its gap
        order = np.argsort(-raw, kind="stable")
        hit = np.cumsum(self.posterior[order])
        f = 2 * hit / (np.arange(1, len(raw) + 1) + self.posterior.sum())
        k = int(np.argmax(f))
        at = raw[order[k]]
        below = raw[order[k + 1]] if k + 1 < len(raw) else at - 1
        self.shift = np.log(cut / (1 - cut)) - (at + below) / 2

    def score(self, text: bytes) -> float:
        s = words(text)
        known = [self.index[w] for w in self.index.keys() & s]
        z = self.bias + self.word_weights[known].sum() + self.shift
        votes = [vote * bool(s & lex) for lex, vote in self.voters] + patterns(text, len(s))
        return float(1 / (1 + np.exp(-np.clip(z + self.vote_weights @ np.array(votes, float), -40, 40))))


def _scored(model: Model | None, name: str = "score"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            scores = [model.score((t.as_py() or "").encode()) if model else 0.0 for t in batch.column(batch.num_columns - 1)]
            yield pa.record_batch([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], name])

    return run


def training_fold(doc_id):
    """True for ids whose rows may train; the others are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1


def sampled(docs: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame:
    """(text, toxic) of the fitting sample; toxic is null for rows without a label."""
    marked = labels.where("toxic is not null and doc_id is not null").where(training_fold(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") >= 1).cast("int").alias("toxic"))
    by_hash = lambda ids, most: ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    other = docs.select("doc_id").where("doc_id is not null").where(training_fold(F.col("doc_id"))).join(labels.where("toxic is not null").select("doc_id"), "doc_id", "left_anti").distinct()
    ids = work.write(by_hash(marked, SAMPLE), "ids")
    more = work.write(by_hash(other.withColumn("toxic", F.lit(None).cast("int")), int(ids.count() * UNLABELLED)), "ids")
    # the rows of an id, of which there may be many, meet in each task first
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids.union(more)), "doc_id")
    return work.write(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "sample")


def fit(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> Model | None:
    sample = sampled(docs, labels, Workspace(docs.sparkSession, "toxicity"))
    total = sample.agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b")).first()
    if not total["a"] or not total["b"]:
        return None
    chosen = lexicon(sample, total["a"], total["b"])
    rows = sample.mapInArrow(_described({w: k for k, (w, _) in enumerate(chosen)}), "words binary, patterns binary, toxic int").toArrow()
    # in an order of their own, so that sums don't depend on that of the tasks
    rows = sorted(zip(*(c.to_pylist() for c in rows.columns), strict=True), key=repr)
    x = np.unpackbits(np.array([list(r[0]) for r in rows], np.uint8).reshape(len(rows), -1), axis=1, count=len(chosen))
    return Model(chosen, x, np.array([list(r[1]) for r in rows], np.int8), np.array([0 if r[2] is None else 2 * r[2] - 1 for r in rows]), cut)


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """Every row's doc_id, held_out, score and predicted (score >= cut)."""
    scored = docs.select("doc_id", "text").mapInArrow(_scored(fit(docs, labels, cut)), "doc_id long, score double")
    held_out = F.coalesce(~training_fold(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score stays under the cut, each judged by its own text; without usable labels, all."""
    model = fit(docs, labels, cut)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.select("*", F.col("text").alias("__scored")).mapInArrow(_scored(model, "__score"), f"{kinds}, __score double").where(F.col("__score") < cut).select(*[f"`{c}`" for c in docs.columns])
