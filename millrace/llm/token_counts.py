"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; dynamic programming carries
the best score and the number of pieces of the best path only, no back pointers. Ties are resolved as in unigram
tokenizers: candidates arrive by increasing start, and a later one wins only with a strictly higher score; a
character that no one-character piece covers is an unknown of the lowest score less 10, and costs as many byte
pieces as it has UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN_PENALTY = 10.0
SPACE = "▁"
CACHE_WORDS = 400_000
SLICE_ROWS = 256


def unigram_pieces(model_path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and their scores from a sentencepiece model file; control, unknown and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not special(i)]


class ViterbiCounter:
    """Counts the pieces of words; each word is segmented on its own, after a leading space mark."""

    def __init__(self, pieces: Iterable[tuple[str, float]], cache_words: int = CACHE_WORDS):
        import ahocorasick

        self.automaton, self.known, self.tails, self.limit = ahocorasick.Automaton(), {}, {}, cache_words
        low, self.splits_lines = 0.0, True
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
            low = min(low, score)
            self.splits_lines &= "\n" not in piece
        self.automaton.make_automaton()
        self.unknown = low - UNKNOWN_PENALTY

    def pieces_in(self, word: str) -> int:
        """Pieces of the best segmentation of `word`, as it stands."""
        n, unknown = len(word), self.unknown
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        reached = 0  # ends up to here have their score

        def bare(end: int) -> None:  # no piece ends here
            best[end], count[end] = best[end - 1] + unknown, count[end - 1] + len(word[end - 1].encode("utf-8", "replace"))

        at, top, top_count, single = 0, None, 0, False
        for last, (size, score) in self.automaton.iter(word):
            end = last + 1
            if end != at:
                if at:
                    if not single and (top is None or best[at - 1] + unknown > top):
                        bare(at)
                    else:
                        best[at], count[at] = top, top_count
                    reached = at
                for gap in range(reached + 1, end):
                    bare(gap)
                reached, at, top, single = end - 1, end, None, False
            value = best[end - size] + score
            if top is None or value > top:
                top, top_count = value, count[end - size] + 1
            single |= size == 1
        if at:
            if not single and (top is None or best[at - 1] + unknown > top):
                bare(at)
            else:
                best[at], count[at] = top, top_count
            reached = at
        for gap in range(reached + 1, n + 1):
            bare(gap)
        return count[n]

    def count(self, text: bytes | None) -> int:
        """Pieces of a whole text: each space starts a new word, whatever else it holds stays in the word."""
        if not text:
            return 0
        words, known = text.split(b" "), self.known
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        new = set(words).difference(known)
        if len(known) + len(new) > self.limit:
            known.clear()
            self.tails.clear()
            new = set(words)
        for word in new:
            known[word] = self.of_word(word)
        return sum(map(known.__getitem__, words))

    def of_word(self, word: bytes) -> int:
        """A piece of the vocabulary holds no line feed, so what stands before and after one is segmented on its own."""
        first, *rest = word.split(b"\n") if self.splits_lines else (word,)
        total = self.pieces_in(SPACE + first.decode("utf-8", "replace"))
        for part in rest:
            if part not in self.tails:
                self.tails[part] = 1 + self.pieces_in(part.decode("utf-8", "replace"))
            total += self.tails[part]
        return total


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """One row per row of `docs`: `id_col` and the number of unigram tokens of the whole text.

    Null and empty texts have 0 tokens; repeated rows are counted each; other columns are left out; an empty table
    gives an empty table. Work is in one pass over the scan, with no shuffle.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField(out_col, T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ViterbiCounter(unigram_pieces(model_path))
        for batch in batches:
            found = [counter.count(text) for at in range(0, batch.num_rows, SLICE_ROWS) for text in batch.column(1).slice(at, SLICE_ROWS).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], schema.fieldNames())

    return source.mapInArrow(run, schema)
