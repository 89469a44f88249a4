"""Language-model scores of documents by a hashed maximum-entropy model.

A word's probability is that of its class in its context times its own within the class. The class comes from the
word's ending (the end of a document is a class of its own). Class probabilities are a softmax over sums of weights of
hashed features: the word before, the two words before, and the word before that alone (a skip). The number of buckets
that features are hashed to grows in proportion to the training tokens. Weights are trained
by gradient updates on all training documents: each task descends through its documents in mini-batches from shared
weights, and the weights of all tasks are averaged, weighted by tokens, block by block. Within a class words have their
smoothed training counts.

Counts are of all training words and are exact. The most frequent words, up to a fixed number, are broadcast with
their counts; all others of a document meet theirs in a join, one row for each document and word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.caching import Known
from millrace.session import checkpoint_dir

CLASSES, FEATURES = 32, 3
#: Least number of buckets, and the training tokens for each bucket beyond it.
BUCKETS, TOKENS_A_BUCKET = 1 << 15, 4096
SMOOTHING = 0.1
END = b"\n"  # no word holds a line feed
#: Most words that are broadcast with their counts.
HEAD_WORDS = 200_000
FLUSH_WORDS, CACHE_WORDS, SLICE_ROWS = 300_000, 500_000, 256
BATCH, RATE, MOST_WEIGHT = 8192, 0.12, 20.0
ONES = np.ones(CLASSES, np.float32)
BLOCK, SALTS = 64, 64
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def words_of(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z), then the end."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


def class_of(word: bytes) -> int:
    return CLASSES - 1 if word == END else zlib.crc32(word[-2:]) % (CLASSES - 1)


def code_of(word: bytes) -> int:
    """Class and 32-bit hash of a word in one number."""
    return class_of(word) << 32 | zlib.crc32(word)


def buckets_for(tokens: int) -> int:
    """Number of feature buckets, a power of two, that grows in proportion to the training tokens."""
    return max(BUCKETS, 1 << (-(-tokens // TOKENS_A_BUCKET)).bit_length())


def contexts(texts: list[np.ndarray], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the words of texts, given as codes, and the feature buckets of their contexts, a row per feature."""
    start = np.zeros(2, np.int64)
    codes = np.concatenate([x for text in texts for x in (start, text)])
    h = (codes & 0xFFFFFFFF).astype(np.uint64)
    one, two = h[1:-1] + np.uint64(1), h[:-2] + np.uint64(3)
    own = np.ones(len(codes), bool)  # all but the marks of the starts
    at = np.cumsum([0] + [len(t) + 2 for t in texts[:-1]])
    own[at] = own[at + 1] = False
    shift = np.uint64(64 - buckets.bit_length() + 1)
    a, b, c, d = MULTIPLIERS
    mixed = (one * a * a, ((one * b) ^ (two * c)) * a, two * d * a)
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32  # short ones are sorted faster
    return (codes >> 32)[own], np.stack([(m >> shift).astype(kind)[own[2:]] for m in mixed])


def log_odds(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Unnormalised log probabilities of the classes. They stay far from the range of 32-bit floats: see `descend`."""
    z = weights.take(features[0], 0)
    for f in features[1:]:
        z += weights.take(f, 0)
    z += bias
    return z


def descend(weights: np.ndarray, seen: np.ndarray, bias: np.ndarray, classes: np.ndarray, features: np.ndarray) -> None:
    """One gradient step on a mini-batch; a bucket's step shrinks with the root of how often it was seen. Weights are
    held between -MOST_WEIGHT and MOST_WEIGHT."""
    p = np.exp(log_odds(weights, bias, features))
    p *= (-1 / (p @ ONES))[:, None]
    p[np.arange(len(classes)), classes] += 1
    for f in features:
        order = np.argsort(f, kind="stable")
        own = f[order]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        at = own[starts]
        seen[at] += np.diff(np.r_[starts, len(own)])
        step = np.add.reduceat(p.take(order, 0), starts, 0)
        step *= (RATE / np.sqrt(seen[at]))[:, None]
        weights[at] = np.clip(weights[at] + step, -MOST_WEIGHT, MOST_WEIGHT)


class Vocabulary:
    """Numbers of the words that a worker met, with their codes and the log10 of their counts (nan for rare words)."""

    def __init__(self, head: dict[bytes, float]):
        self.head = head
        self.clear()

    def clear(self) -> None:
        self.index, self.codes, self.logs = Known(self.learn), np.empty(1 << 16, np.int64), np.empty(1 << 16)

    def learn(self, word: bytes) -> int:
        i = len(self.index)
        if i == len(self.codes):
            self.codes, self.logs = np.resize(self.codes, 2 * i), np.resize(self.logs, 2 * i)
        self.codes[i], self.logs[i] = code_of(word), self.head.get(word, np.nan)
        return i

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Places of words in `codes` and `logs`, which may be made anew: look them up after this."""
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def trim(self) -> None:
        if len(self.index) > CACHE_WORDS:
            self.clear()


@dataclass
class Scorer:
    """bias and weights of the class model; log10 of the denominators by class."""

    bias: np.ndarray
    weights: np.ndarray
    spread: np.ndarray

    def class_scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Of each text the sum of log10 of class probabilities over denominators."""
        classes, features = contexts(texts, len(self.weights))
        scores = np.empty(len(classes))
        for at in range(0, len(classes), BATCH):
            c = classes[at : at + BATCH]
            z = log_odds(self.weights, self.bias, features[:, at : at + BATCH])
            own = z[np.arange(len(c)), c]
            scores[at : at + BATCH] = own - np.log(np.exp(z, out=z) @ ONES)
        scores /= np.log(10)
        scores -= self.spread[classes]
        return np.add.reduceat(scores, np.cumsum([0] + [len(t) for t in texts[:-1]]))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, class, n) of the texts, the end among the words. Tasks count before anything is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            words = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(map(class_of, words), pa.int32()), pa.array(counts.values(), pa.int64())], ["word", "class", "n"])
            counts.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for text in batch.column(0).slice(at, SLICE_ROWS).to_pylist():
                    counts.update(words_of(text))
                if len(counts) > FLUSH_WORDS:
                    yield flush()
        if counts:
            yield flush()

    return docs.mapInArrow(run, "word binary, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


def train_weights(docs: DataFrame, bias: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Weights after one pass over the texts, averaged over the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast({})  # a worker keeps its copy, and so the codes that it found

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, salt = shared.value.setdefault("vocabulary", Vocabulary({})), TaskContext.get().partitionId() % SALTS
        weights, seen, tokens = np.zeros((buckets, CLASSES), np.float32), np.ones(buckets, np.float32), 0
        held: list[np.ndarray] = []
        waiting = 0

        def step():
            classes, features = contexts(held, buckets)
            for at in range(0, len(classes), BATCH):
                descend(weights, seen, bias, classes[at : at + BATCH], features[:, at : at + BATCH])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for text in batch.column(0).slice(at, SLICE_ROWS).to_pylist():
                    numbers = known.numbers(words_of(text))
                    held.append(known.codes[numbers])
                    tokens += len(held[-1])
                    waiting += len(held[-1])
                    if waiting >= BATCH:
                        step()
                        waiting = 0
                known.trim()
        if held:
            step()
        if tokens:
            sums = weights.astype(np.float64).reshape(-1, BLOCK * CLASSES) * tokens
            n = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array([salt] * n, pa.int32()), pa.array([tokens] * n, pa.int64()), pa.array([x.astype("<f4").tobytes() for x in sums], pa.binary())], ["block", "salt", "tokens", "sums"])

    schema = "block int, salt int, tokens long, sums binary"

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK * CLASSES)
        for x in group["sums"].to_pylist():
            total += np.frombuffer(x, "<f4")
        return pa.table({"block": group["block"][:1], "salt": pa.array([0], pa.int32()), "tokens": pa.array([sum(group["tokens"].to_pylist())], pa.int64()), "sums": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    # Each group holds the blocks of a 64th of the tasks, then of all 64.
    merged = docs.mapInArrow(run, schema).groupBy("block", "salt").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    out = np.zeros((buckets, CLASSES), np.float32)
    for r in merged.collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = (np.frombuffer(r["sums"], "<f4") / r["tokens"]).reshape(BLOCK, CLASSES)
    return out


def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """One row per row of `docs`: `id_col`, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that fulfil `training` and scores all. Words are lower-cased (A-Z) runs without white space,
    and each text ends with one more token. n_known counts the tokens that occur in training, train_tokens all tokens
    of the training texts; base_score is log10 of the unigram probability with add-0.1 smoothing, score that of the
    model. Null and empty texts are the end alone; repeated rows are scored each; without training rows all counts
    are 0; other columns are left out; an empty table gives an empty table.
    """
    checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(training, F.lit(False)).alias("fit"))
    fit = rows.where("fit").select("text")
    counts = word_counts(fit).checkpoint()
    by_class = {r["class"]: (r["n"], r["words"]) for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()}
    n, v = (np.array([by_class.get(c, (0, 0))[i] for c in range(CLASSES)], float) for i in (0, 1))
    tokens, words = int(n.sum()), int(v.sum())
    bias = np.log((n + 1) / (n + 1).sum()).astype(np.float32)
    spread = np.log10(n + SMOOTHING * (v + 1))
    # Counts in steps of an eighth of a power of two: the head takes whole steps from the top while it fits.
    level = F.floor(F.log2("n") * 8)
    head, room = [], head_words
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["level"]):
        room -= r["words"]
        if room < 0:
            break
        least = r["level"]
        head.append(least)
    frequent = {bytes(r["word"]): float(np.log10(r["n"] + SMOOTHING)) for r in counts.where(level >= head[-1]).select("word", "n").toLocalIterator()} if head else {}
    weights = train_weights(fit, bias, buckets_for(tokens))
    shared = docs.sparkSession.sparkContext.broadcast({"weights": weights, "head": frequent})

    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", kind), T.StructField("word", T.BinaryType()), *[T.StructField(c, t()) for c, t in (("times", T.LongType), ("tokens", T.LongType), ("logs", T.DoubleType), ("classes", T.DoubleType))]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box, row = shared.value, TaskContext.get().partitionId() << 40
        known, scorer = box.setdefault("vocabulary", Vocabulary(box["head"])), Scorer(bias, box["weights"], spread)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out: list[list] = [[] for _ in range(7)]
                split = [words_of(text) for text in part.column(1).to_pylist()]
                numbers = [known.numbers(words) for words in split]
                classes = scorer.class_scores([known.codes[n] for n in numbers])
                for name, words, own, n in zip(part.column(0).to_pylist(), split, classes.tolist(), numbers):
                    logs = known.logs[n]
                    at_rare = np.flatnonzero(np.isnan(logs)).tolist()
                    for word, times in Counter([words[i] for i in at_rare]).items():
                        out[0].append(row)
                        out[2].append(word)
                        out[3].append(times)
                    out[0].append(row)
                    # A row for each rare word, then one for the document.
                    for column, value in zip(out[1:], (name, None, len(words) - len(at_rare), len(words), float(np.nansum(logs)), own)):
                        column.extend([None] * (len(out[0]) - 1 - len(column)))
                        column.append(value)
                    row += 1
                known.trim()
                types = (pa.int64(), batch.schema.field(0).type, pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], schema.fieldNames())

    flat = rows.select("id", "text").mapInArrow(run, schema)
    rare = counts.where(level < head[-1]) if head else counts
    # Rows with a word hold how often the document has it, rows without one what the task summed up of the document.
    met = flat.join(rare.select("word", "n"), "word", "left")
    counted = F.when(F.col("word").isNull() | F.col("n").isNotNull(), F.col("times")).otherwise(0)
    logs = F.when(F.col("word").isNull(), F.col("logs")).otherwise(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING))
    summed = met.groupBy("row").agg(F.max("id").alias("id"), F.max("tokens").alias("tokens"), F.sum(counted).alias("known"), F.sum(logs).alias("logs"), F.max("classes").alias("classes"))
    return summed.select(
        F.col("id").alias(id_col),
        F.col("tokens").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("tokens") * float(np.log10(tokens + SMOOTHING * (words + 1)))).alias("base_score"),
        (F.col("logs") + F.col("classes")).alias("score"),
    )
