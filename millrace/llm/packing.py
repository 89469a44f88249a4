"""Packing documents into training sequences by non-negative least squares.

Each task packs groups of a bounded number of tokens. Per group: whole windows of long documents stand alone;
the histogram of the remainders is written as a sum of shallow combinations of lengths that fill a window exactly
(two to four pieces), whose repeat counts come from a non-negative least-squares fit; the counts are rounded, and
what is left over is laid end to end and cut at the window. The last, partial window of a group is cut into powers
of two, which need no padding. Groups are independent, so there is no shuffle, no hot key and nothing to collect.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.caching import Known

WINDOW = 4096
END_ID = 2
GROUP_TOKENS = 1 << 20
CACHE_WORDS = 200_000
SLICE_ROWS = 256


class CachedTokenizer:
    """Token ids of texts by a `tokenizers` BPE file that lower-cases, drops white space, and never joins letters with
    other characters.

    A text's ids are the ids of its words, one after another, so each worker keeps the ids of the words it met last,
    `words` of them at least and twice that at most. Words of Latin letters, alone or before one comma or full stop, go
    straight to the merge rules; all others take the whole way through the tokenizer.
    """

    def __init__(self, path: str, words: int = CACHE_WORDS):
        self.path, self.limit, self.known, self.tokenizer = path, words, None, None

    def open(self) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.merge, self.known = self.tokenizer.model.tokenize, Known(self.learn)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        other = iter(range(256, 512))
        self.letters = [chr(b if b in plain else next(other)) for b in range(256)]
        self.marks = {m: self.through([m])[0] for m in (",", ".")}

    def through(self, words: list[str]) -> list[bytes]:
        got: list[list[int]] = [[] for _ in words]
        encoded = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        for word, token in zip(encoded.word_ids, encoded.ids):
            got[word].append(token)
        return [array("I", ids).tobytes() for ids in got]

    def of_letters(self, word: str) -> bytes:
        raw = word.lower().encode()
        return array("I", [t.id for t in self.merge(raw.decode() if len(raw) == len(word) else "".join([self.letters[b] for b in raw]))]).tobytes()

    def learn(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8", "replace")
        core = word[:-1] if word[-1] in self.marks else word
        if not core.isalpha() or (not core.isascii() and (max(core) >= "\u0250" or "\u0130" in core)):
            return self.through([word])[0]
        return self.of_letters(core) if core is word else self.known[raw[:-1]] + self.marks[word[-1]]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null text has none."""
        if self.tokenizer is None:
            self.open()
        self.known = self.known.bounded(self.limit)
        look = self.known.__getitem__
        return [b"".join(map(look, (t or b"").split())) for t in texts]


def fit_counts(lengths: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths that fill `window` exactly, with rounded repeat counts that `lengths` can pay for."""
    have = np.array(sorted(lengths), np.int64)
    if not len(have):
        return []
    present, combos = set(have.tolist()), set()
    for a in present:
        if window - a in present:
            combos.add(tuple(sorted((a, window - a))))
        for k in (2, 3):
            if (rest := window - k * a) in present:
                combos.add(tuple(sorted((*[a] * k, rest))))
        for k in (3, 4):
            if a * k == window:
                combos.add((a,) * k)
    common = [n for n, _ in Counter(lengths).most_common(96)]
    for i, a in enumerate(common):
        for b in common[i:]:
            if (c := window - a - b) in present:
                combos.add(tuple(sorted((a, b, c))))
    if not combos:
        return []
    columns = sorted(combos)
    row = {int(n): i for i, n in enumerate(have)}
    rows = np.array([row[n] for c in columns for n in c])
    cols = np.array([j for j, c in enumerate(columns) for _ in c])
    h = np.array([lengths[int(n)] for n in have], float)
    x = np.full(len(columns), h.sum() / len(cols))
    target = np.bincount(cols, h[rows], len(columns))
    for _ in range(150):  # multiplicative steps keep x >= 0 and never raise |Ax - h|
        fitted = np.bincount(rows, x[cols], len(h))
        x *= target / np.maximum(np.bincount(cols, fitted[rows], len(columns)), 1e-12)
    left, out = dict(lengths), []
    for j in np.argsort(-x, kind="stable"):
        need = Counter(columns[j])
        n = min(int(np.rint(x[j])), *(left[v] // k for v, k in need.items()))
        if n > 0:
            for v, k in need.items():
                left[v] -= n * k
            out.append((columns[j], n))
    return out


def plan_group(sizes: list[int], window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences over documents of these sizes: lists of (document, start, length)."""
    rest: dict[int, deque] = defaultdict(deque)
    for d, n in enumerate(sizes):
        for start in range(0, n - window + 1, window):
            yield [(d, start, window)]
        if n % window:
            rest[n % window].append(d)
    for combo, times in fit_counts({n: len(v) for n, v in rest.items()}, window):
        for _ in range(times):
            yield [((d := rest[n].popleft()), sizes[d] - n, n) for n in combo]
    line = [(d, sizes[d] - n, n) for n in sorted(rest, reverse=True) for d in rest[n]]
    total = sum(n for _, _, n in line)
    room, current = (window if total >= window else 1 << (total.bit_length() - 1) if total else 0), []
    for d, start, n in line:
        while n:
            take = min(n, room)
            current.append((d, start, take))
            start, n, room, total = start + take, n - take, room - take, total - take
            if not room:
                yield current
                current, room = [], (window if total >= window else 1 << (total.bit_length() - 1) if total else 0)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pieces of all documents, laid into sequences of at most `window` tokens.

    Returns `id_col`, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.
    A null or empty text is the end token alone; every row of `docs` is packed, repeated rows too; other columns are
    left out; an empty table gives no pieces. Sequences are full or a power of two long, so none needs padding.
    `window` has to be a power of two. Texts are never cut short; a group holds one text of any length.
    """
    if window & (window - 1):
        raise ValueError("window has to be a power of two")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = source.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset"))])
    end = int(end_id).to_bytes(4, "little")
    shared = docs.sparkSession.sparkContext.broadcast({})  # a worker keeps its copy, and so the words that it met

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task = shared.value.setdefault("tokenizer", CachedTokenizer(tokenizer_path)), TaskContext.get().partitionId()
        names, ids, held, sequence = [], [], 0, task << 36
        out_type = None

        def flush():
            nonlocal sequence
            columns: list[list] = [[] for _ in range(7)]
            for pieces in plan_group([len(x) // 4 for x in ids], window):
                offset = 0
                for d, start, n in pieces:
                    for column, value in zip(columns, (names[d], start, n, ids[d][4 * start : 4 * (start + n)], len(ids[d]) // 4, sequence, offset)):
                        column.append(value)
                    offset += n
                sequence += 1
            arrays = [pa.array(columns[0], out_type), *(pa.array(c, pa.binary() if i == 2 else pa.int64()) for i, c in enumerate(columns[1:]))]
            return pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

        for batch in batches:
            out_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for name, tokens in zip(part.column(0).to_pylist(), tokenizer.encode(part.column(1).to_pylist())):
                    names.append(name)
                    ids.append(tokens + end)
                    held += len(tokens) // 4 + 1
                    if held >= group_tokens:
                        yield flush()
                        names, ids, held = [], [], 0
        if ids:
            yield flush()

    return source.mapInArrow(run, schema)
