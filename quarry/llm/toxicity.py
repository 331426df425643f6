"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words is fitted in numpy from documents confirmed as toxic and from text
taken as unlabelled, under the risk estimator of Kiryo et al. (2017): with the class prior pi, the negative
risk is that of unlabelled text less pi times that of the positives counted as negatives, and where this
falls below zero its gradient is turned back. Scores are the logistic function of the sum over a text's
distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.llm.common import HASH_BYTES, Scratch, bytes_of, chunks, small_batches, text_array, tidy, word_hashes, word_spans

#: Hash buckets of words, words that become features, and the bound on rows the fit takes of each kind.
BUCKETS, FEATURES, SAMPLE = 1 << 20, 1000, 12_000
FOLDS = 5


def held_out(doc: Column) -> Column:
    """The fold whose labels are never learned from: crc32(id as text) mod 5 is 0; a null id is never held out."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


#: Marks that stand at the edges of a word, as a table by byte.
_EDGE = np.zeros(256, np.bool_)
_EDGE[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct word buckets, row after row, and the rows' bounds.

    Words are parted by white space, lower-cased in A-Z and freed of ASCII marks at their ends.
    """
    data, offs = bytes_of(texts)
    starts, ends, first = word_spans(data, offs)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    # next byte from each place on that is no mark, and the last up to each place
    plain = np.flatnonzero(~_EDGE[data])
    if not len(plain):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    lo = plain[np.minimum(np.searchsorted(plain, starts), len(plain) - 1)]
    hi = plain[np.maximum(np.searchsorted(plain, ends) - 1, 0)] + 1
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    real = (lo >= starts) & (hi <= ends) & (lo < hi)
    hashed = (word_hashes(data, lo[real], hi[real]) % np.uint64(BUCKETS)).astype(np.int64)
    keys = np.unique(row[real] * BUCKETS + hashed)
    return keys % BUCKETS, np.searchsorted(keys, np.arange(len(offs)) * BUCKETS)


def choose_features(counts: DataFrame, n_p: int, n_u: int, features: int = FEATURES) -> np.ndarray:
    """The buckets whose share in positives exceeds that in unlabelled text most clearly, in ascending order.

    ``counts`` is ``(bucket, in_p, in_u)``; no more than ``features`` buckets reach the driver.
    """
    share, base = F.col("in_p") / F.lit(float(n_p)), F.col("in_u") / F.lit(float(n_u))
    spread = F.sqrt((base * (1 - base) + F.lit(1.0 / n_u)) / F.lit(float(n_p)))
    best = counts.where("in_p >= 3").withColumn("clear", (share - base) / spread).where("clear > 4").orderBy(F.col("clear").desc(), "bucket").limit(features)
    return np.sort(np.array([r[0] for r in best.select("bucket").collect()], np.int64))


def fit(chosen: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.1, shrink: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, their weights and the bias of a non-negative PU logistic classifier on the ``chosen`` buckets."""
    if not positive or not unlabelled or not 0 < prior < 1:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p)))
    n_p, n_u = len(positive), len(unlabelled)
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        c = place[np.concatenate(rows)]
        return r[c >= 0], c[c >= 0]

    (pr, pcol), (ur, ucol) = matrix(positive), matrix(unlabelled)
    k = len(chosen)
    w = np.zeros(k + 1)
    w[k] = np.log(prior / (1 - prior))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        zp = w[k] + np.bincount(pr, w[pcol], n_p)
        zu = w[k] + np.bincount(ur, w[ucol], n_u)
        # logistic losses: log(1 + exp(-z)) for a positive, log(1 + exp(z)) for a negative
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_pos, g_neg_p, g_neg_u = prior * (sigmoid(zp) - 1) / n_p, -prior * sigmoid(zp) / n_p, sigmoid(zu) / n_u
        if negative >= 0:
            gp, gu = g_pos + g_neg_p, g_neg_u
        else:
            gp, gu = -g_neg_p, -g_neg_u
        g = np.append(np.bincount(pcol, gp[pr], k) + np.bincount(ucol, gu[ur], k), gp.sum() + gu.sum())
        g[:k] += shrink * w[:k]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return chosen, w[:k], float(w[k])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit from training folds only.

    The prior is the toxic share of labelled training documents. At most about ``sample`` confirmed and
    ``sample`` unlabelled documents - of least hash of their id - enter the fit; labels that disagree on a
    document count as toxic; labels without document, or null, count for nothing. The sample's words stay in a
    table: the driver gets the features, and which of them each row of the sample has. Rows that repeat an id with one
    text count once; where an id has so many texts that the sample is passed, hashes of id and text thin them out.
    """
    small_batches(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    n, n_toxic = marked.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    total = texts.count()
    place = (F.xxhash64("doc_id") / float(2**63) + 1) / 2  # even in 0 to 1
    share = lambda count: F.lit(min(1.0, sample / max(1, count)))
    chosen = F.broadcast(marked.where("toxic = 1").where(place < share(n_toxic)).select("doc_id"))  # about ``sample`` ids at most
    toxic = texts.join(chosen, "doc_id", "left_semi").select(F.lit(1).alias("kind"), "doc_id", "text")
    plain = texts.where(place < share(total)).select(F.lit(0).alias("kind"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "text", HASH_BYTES):
            flat, bounds = word_buckets(text_array(t["text"]))
            yield pa.RecordBatch.from_arrays([*(t[n].combine_chunks() for n in ("kind", "doc_id", "key")), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))], ["kind", "doc_id", "key", "words"])

    scratch = Scratch(docs.sparkSession, "toxicity")
    taken = toxic.unionByName(plain).withColumn("key", F.xxhash64("doc_id", "text"))
    rows = scratch.table(taken.mapInArrow(tidy(run), "kind int, doc_id long, key long, words array<int>").dropDuplicates(["kind", "doc_id", "key"]), "sample")
    count = lambda: rows.agg(F.count_if(F.col("kind") == 1), F.count_if(F.col("kind") == 0)).first()
    n_p, n_u = count()
    if max(n_p, n_u) > 1.5 * sample:  # ids with many texts
        even = (F.xxhash64(F.lit(1), "key") / float(2**63) + 1) / 2
        rows = rows.where(even < F.when(F.col("kind") == 1, share(n_p)).otherwise(share(n_u)))
        n_p, n_u = count()
    prior = n_toxic / n if n else 0.0
    if not n_p or not n_u:
        return fit(np.zeros(0, np.int64), [], [], prior)
    each = rows.select("kind", F.explode("words").alias("bucket")).groupBy("bucket")
    chosen = choose_features(each.agg(F.count_if(F.col("kind") == 1).alias("in_p"), F.count_if(F.col("kind") == 0).alias("in_u")), n_p, n_u)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = np.asarray(lists.flatten())
            kept = np.isin(flat, chosen)
            ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[kept].astype(np.int32)))], ["kind", "doc_id", "words"])

    found = rows.select("kind", "doc_id", "words").mapInArrow(tidy(features), "kind int, doc_id long, words array<int>").where(F.size("words") > 0).toArrow()  # rows of the sample, features of a thousand
    found = found.sort_by([("kind", "ascending"), ("doc_id", "ascending")])
    lists, kinds = found["words"].combine_chunks(), np.asarray(found["kind"])
    flat, offs = np.asarray(lists.values), np.asarray(lists.offsets)
    words = [flat[a:b] for a, b in zip(offs[:-1], offs[1:])]
    of = lambda kind, count: [w for w, k in zip(words, kinds) if k == kind] + [np.zeros(0, np.int32)] * (count - int((kinds == kind).sum()))
    scratch.drop("sample")
    return fit(chosen, of(1, n_p), of(0, n_u), prior)


def score_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in one more column, which replaces one of that name.

    Null and empty texts have the bias's score; rows that repeat stay, with equal scores for equal texts.
    """
    docs = docs.drop(score)
    chosen, weights, bias = model
    table = np.zeros(BUCKETS, np.float32)
    table[chosen] = weights
    shared = docs.sparkSession.sparkContext.broadcast((table, bias))  # 4 MB, whatever the data
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for t in chunks(batches, text, HASH_BYTES):
            flat, bounds = word_buckets(text_array(t[text]))
            row = np.repeat(np.arange(t.num_rows), np.diff(bounds))
            z = np.bincount(row, table[flat].astype(np.float64), t.num_rows)  # row by row, in the buckets' order
            s = 1 / (1 + np.exp(-np.clip(z + bias, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in t.column_names), pa.array(s)], [*t.column_names, score])

    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])
    return docs.mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
