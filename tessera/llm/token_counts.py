"""Token counts with a digest cache.

Every text is normalised and reduced to a digest; a cache table maps (tokenizer digest, text digest) to a token count. Only
digests that the cache lacks are encoded, one text for each, and their counts are appended to the cache. Normalising makes null
empty and, for a tokenizer that collapses blanks, does so first, so that texts which differ in blanks only share a count.

Plan: the rows' ids, sizes and digests are written once, without texts. One narrow aggregate picks a row for each missing
digest; its text comes by a hash join on (digest, id), so a text with a third of all rows is spread by id and encoded once.
Digests that hold at least one of ``HOT`` parts of the rows, of which there are ``HOT`` at most, meet their counts by a
broadcast; so no digest brings more than that part of the rows to one task of the other join.

Defined results: null and empty texts count as empty (0 tokens); rows with equal texts share a count; repeated rows each
appear; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace


#: Parts of the rows from which on a digest counts as hot, and so a bound of the hot digests.
HOT = 1024


def _collapses(name: str, model: bytes) -> bool:
    """Whether blanks at either end, and all but one of a run of them, make no difference to the tokenizer.

    A sentencepiece model says so; it has no piece of several blanks, which would count runs of them.
    """
    if not name.endswith(".model"):
        return False
    import sentencepiece

    piece = sentencepiece.SentencePieceProcessor(model_proto=model)
    blanks = any(p.count("\u2581") > 1 or "  " in p for p in (piece.id_to_piece(k) for k in range(piece.get_piece_size())))
    same = all(piece.encode(f"{' ' * a}x{' ' * n}y{' ' * b}") == piece.encode("x y") for a in (0, 1, 3) for n in (1, 2, 5, 40) for b in (0, 1, 3))
    return same and not blanks and piece.encode(" ") == piece.encode("")


def _encoder(name: str, model: bytes):
    """A function from a list of texts to their token counts, without any added tokens, truncation or padding."""
    if name.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(x) for x in piece.encode(texts, num_threads=1, add_bos=False, add_eos=False)]
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_str(model.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _counted(name: str, model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = None, set()
        for batch in batches:
            encode = encode or _encoder(name, model)
            fresh = [k for k, d in enumerate(batch.column(0).to_pylist()) if d not in seen and not seen.add(d)]  # repeated rows arrive together
            batch = batch.take(pa.array(fresh, pa.int64()))
            texts, counts, size, held = batch.column(1), [], 0, []
            for v in texts:
                t = v.as_py() or ""
                held.append(t)
                size += len(t)
                if size > 1 << 20:
                    counts += encode(held)
                    size, held = 0, []
            counts += encode(held) if held else []
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Counts tokens of every row: id, n_bytes, n_tokens, over_limit (more than ``limit``), digest.

    ``cache`` is a folder of a Parquet table in a shared store, made if missing and appended to; without one, a new cache is
    made for this call. ``tokenizer_path`` is read on the driver; its bytes go to the executors.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "token-counts")
    cache = cache or work.path("cache")
    model = Path(tokenizer_path).read_bytes()
    version = hashlib.sha256(model).hexdigest()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    normal = F.trim(F.regexp_replace(text, " {2,}", " ")) if _collapses(tokenizer_path, model) else text
    digest = F.unhex(F.sha2(normal, 256))
    keys = work.write(docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest")), "keys")
    held = work.write(keys.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "digests")
    missing = held.join(_stored(spark, cache, version), "digest", "left_anti").select(F.col("digest").alias("d"), "first")
    rows = docs.select(F.col(id_col).alias("id"), normal.alias("text"), digest.alias("digest"))
    chosen = rows.join(missing.hint("shuffle_hash"), (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("first")))
    encoded = chosen.select("digest", "text").mapInArrow(_counted(tokenizer_path, model), "digest binary, n_tokens long")
    encoded.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    known = _stored(spark, cache, version)
    total = held.agg(F.sum("n")).first()[0] or 0
    hot = work.write(held.where(F.col("n") * HOT >= total).join(known, "digest").select(F.col("digest").alias("d"), F.col("n_tokens").alias("hot")), "hot")
    keys = work.write(keys.join(F.broadcast(hot), F.col("digest") == F.col("d"), "left").select("id", "n_bytes", "digest", "hot"), "marked")
    counted = keys.where("hot is not null").select("id", "n_bytes", F.col("hot").alias("n_tokens"), "digest").union(keys.where("hot is null").join(known, "digest").select("id", "n_bytes", "n_tokens", "digest"))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")


def _stored(spark, cache: str, version: str) -> DataFrame:
    """The counts that the cache holds for a tokenizer, one row for each digest; the folder of another is not read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/tokenizer={version}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    table = spark.read.schema("digest binary, n_tokens long").parquet(path.toString())
    return table.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
