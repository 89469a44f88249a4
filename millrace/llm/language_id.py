"""Language identification by cross-parsing entropy.

Training text of each language goes into a suffix automaton, stored as a dense transition table. A text is parsed
greedily into the longest phrases that occur in a language's training text: the automaton walks on until it has no
transition, which ends the phrase. With c phrases over training text of n symbols, c * log2(n) estimates the bits that
the text costs in that language; the language with the fewest wins. Phrases end at block borders, so that the blocks of
many texts and all languages advance together in one numpy step per symbol.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

BLOCK = 256
#: Bounds of the training sample: documents and symbols a language, characters a document, languages.
SAMPLE_DOCS, SAMPLE_SYMBOLS, SAMPLE_CHARS, MOST_LANGUAGES = 48, 12_000, 2_000, 64
UNDETERMINED = "und"
SLICE_ROWS, SLICE_BLOCKS = 256, 4096


def suffix_automaton(symbols: Iterable[int]) -> list[dict[int, int]]:
    """Transitions of the states of the suffix automaton; state 0 is the root. Each path spells a substring."""
    edges, link, depth, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(edges)
        edges.append({})
        link.append(0)
        depth.append(depth[last] + 1)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if depth[q] == depth[p] + 1:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                depth.append(depth[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return edges


@dataclass
class LanguageModel:
    """languages: names in order. symbols: byte to symbol. table: next state times width, or its complement where a
    new phrase starts. starts: states before the first phrase. weights: log2 of the training sizes."""

    languages: list[str]
    symbols: np.ndarray
    width: int
    table: np.ndarray
    starts: np.ndarray
    weights: np.ndarray

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Weighted phrases of each text in each language, shape (texts, languages)."""
        pad = self.width - 1
        blocks, owner = [], []
        for i, text in enumerate(texts):
            s = fold(text, self.symbols)
            n = -(-len(s) // BLOCK)
            padded = np.full(n * BLOCK, pad, np.int32)
            padded[: len(s)] = s
            blocks.append(padded.reshape(n, BLOCK))
            owner += [i] * n
        out = np.zeros((len(texts), len(self.languages)))
        if owner:
            every, owner = np.concatenate(blocks), np.array(owner)
            for at in range(0, len(every), SLICE_BLOCKS):
                part = np.ascontiguousarray(every[at : at + SLICE_BLOCKS].T)
                state = np.repeat(self.starts[:, None], part.shape[1], 1)
                count = np.zeros(state.shape, np.int32)
                for symbol in part:
                    state += symbol
                    state = self.table.take(state)
                    new = state >> 31  # -1 where a new phrase starts
                    count -= new
                    state ^= new
                np.add.at(out, owner[at : at + SLICE_BLOCKS], count.T)
        return out * self.weights


def fold(text: bytes, symbols: np.ndarray) -> np.ndarray:
    """Symbols of a text: letters in lower case, other bytes above 127 as they are, runs of all else as one gap."""
    s = symbols[np.frombuffer(text, np.uint8)]
    if not len(s):
        return s
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    return s[keep]


def byte_symbols(seen: Iterable[int]) -> tuple[np.ndarray, int]:
    """A symbol for each byte, and the width of a table row: gap 0, a-z, the bytes seen, one for bytes never seen, and
    one for padding."""
    out = np.zeros(256, np.int32)
    for i in range(26):
        out[ord("a") + i] = out[ord("A") + i] = 1 + i
    seen = sorted(b for b in seen if b > 127)
    out[128:] = 27 + len(seen)
    out[seen] = 27 + np.arange(len(seen))
    return out, 27 + len(seen) + 2


def build_model(samples: dict[str, bytes]) -> LanguageModel:
    """A model of a training text for each language."""
    languages = sorted(samples)
    symbols, width = byte_symbols(set().union(*samples.values()) if samples else ())
    tables, starts, weights, base = [], [], [], 0
    for name in languages:
        text = fold(samples[name], symbols)[:SAMPLE_SYMBOLS]
        edges = suffix_automaton(text.tolist())
        idle = len(edges)  # the state before a phrase, and after a symbol that the language lacks
        table = np.full((idle + 1, width), -1, np.int64)
        for i, out in enumerate(edges):
            if out:
                table[i, list(out)] = list(out.values())
        restart = np.where(table[0] >= 0, table[0], idle)
        goes_on = table >= 0
        table = (np.where(goes_on, table, restart) + base) * width
        table = np.where(goes_on, table, ~table)
        table[:, width - 1] = (base + np.arange(idle + 1)) * width
        tables.append(table.astype(np.int32))
        starts.append((base + idle) * width)
        weights.append(np.log2(max(2, len(text))))
        base += idle + 1
    return LanguageModel(languages, symbols, width, np.concatenate([*tables, np.zeros((0, width), np.int32)]).ravel(), np.array(starts, np.int32), np.array(weights))


def train_languages(docs: DataFrame, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """A model from a bounded sample of the labelled rows that fulfil `training`.

    Of each language the documents with the smallest hashes of their id are taken: SAMPLE_DOCS documents of up to
    SAMPLE_CHARS characters, SAMPLE_SYMBOLS symbols in all. Rows with a null id, text or language take no part; over
    MOST_LANGUAGES languages raise an error. The first pass reads ids and languages only.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (F.lit(True) if training is None else F.coalesce(training, F.lit(False))).alias("fit"))
    rows = rows.where("fit and id is not null and text is not null and lang is not null").withColumn("h", F.xxhash64(F.col("id").cast("string")))
    order = Window.partitionBy("lang").orderBy("h")
    first = rows.select("lang", "h").withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample_docs)
    bounds = [(r["lang"], r["most"]) for r in first.groupBy("lang").agg(F.max("h").alias("most")).take(MOST_LANGUAGES + 1)]
    if len(bounds) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    samples: dict[str, list[bytes]] = {lang: [] for lang, _ in bounds}
    if bounds:
        within = F.lit(False)
        for lang, most in bounds:
            within = within | ((F.col("lang") == lang) & (F.col("h") <= most))
        taken = rows.where(within).groupBy("lang", "h").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text"))
        for r in sorted(taken.collect(), key=lambda r: (r["lang"], r["h"])):
            samples[r["lang"]].append(r["text"].encode("utf-8", "replace"))
    return build_model({lang: b"\n".join(texts) for lang, texts in samples.items()})


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: Iterable[str] = ("doc_id",), lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """The columns `keep` of every row, with the language of its whole text and a score from 0 to 1.

    The score is 1 less the ratio of the best language's phrases to the second's (1 if there is but one language). A
    text that is null or has no letter is `und` with score 0, as is any text if nothing was learned; ties go to the
    first language by name. Repeated rows are judged each; an empty table gives an empty table.
    """
    keep = list(keep)
    if {lang_out, score_out} & set(keep):
        raise ValueError("the new columns need names of their own")
    source = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LanguageModel(*shared.value)
        for batch in batches:
            langs, scores = [], []
            column = batch.column(batch.num_columns - 1)
            for at in range(0, batch.num_rows, SLICE_ROWS):
                texts = column.slice(at, SLICE_ROWS).cast(pa.binary()).to_pylist()
                fit = [i for i, t in enumerate(texts) if t and known.languages and (LETTERS[np.frombuffer(t, np.uint8)].any() or has_letter(t))]
                lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                if fit:
                    cost = known.phrases([texts[i] for i in fit])
                    best = cost.argmin(1)
                    for row, (i, k) in enumerate(zip(fit, best)):
                        lang[i] = known.languages[k]
                        second = np.delete(cost[row], k).min() if cost.shape[1] > 1 else np.inf
                        score[i] = float(1 - cost[row, k] / second)
                langs += lang
                scores += score
            arrays = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema.fieldNames())

    return source.mapInArrow(run, schema)
