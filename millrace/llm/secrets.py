"""Secret scans: fixed patterns, and a battery of randomness tests on opaque tokens.

A token is a run of 20 or more characters of the usual encodings. Its encoding is inferred from the characters it
uses (hexadecimal, base 32, letters and digits, base 64 in both alphabets). Against the hypothesis "drawn uniformly
from that alphabet" three tests give p-values: chi-squared of the character counts, runs above and below the middle of
the alphabet, and lag-one serial correlation of the character values; a token whose combined p-value is low isn't
random. Against the hypothesis "made of words" the chi-squared statistic gives another p-value: word-like text has a
statistic that rises with its length, so a low statistic on a long token is strong evidence and on a short one weak.
Over the tokens of a text these p-values pass a weighted Benjamini-Hochberg step-up, in which longer tokens weigh more
and the mean weight is 1; what it rejects, and the battery lets pass, is reported.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns and least lengths of the base kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "random")

TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: A token with characters of both base-64 alphabets is tested in parts, each of one of them.
PART = re.compile(r"[A-Za-z0-9+/]{20,}={0,2}|[A-Za-z0-9_-]{20,}={0,2}")
DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "alnum": UPPER + UPPER.lower() + DIGITS,
    "base64": UPPER + UPPER.lower() + DIGITS + "+/",
    "base64url": UPPER + UPPER.lower() + DIGITS + "-_",
}
VALUES = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ENCODINGS.items()}
SETS = {name: frozenset(alphabet) for name, alphabet in ENCODINGS.items()}
#: Sum of squared letter shares of running text in Latin script, somewhat low to be cautious.
WORD_REPEAT = 0.06
RANDOM_LEVEL, FALSE_DISCOVERY = 0.001, 0.01


def upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_tail(x: float, k: float) -> float:
    """Upper tail of chi-squared with k degrees of freedom, by the cube-root normal approximation."""
    return upper_normal(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def infer_encoding(token: str) -> str | None:
    used = set(token)
    return next((name for name, letters in SETS.items() if used <= letters), None)


def battery(token: str) -> tuple[float, float] | None:
    """(p-value of "random", p-value of "made of words"); None where no encoding fits."""
    body = token.rstrip("=")
    name = infer_encoding(body)
    n = len(body)
    if name is None or n < 16:
        return None
    values, size = VALUES[name], len(ENCODINGS[name])
    codes = [values[c] for c in body]
    counts = [0] * size
    for c in codes:
        counts[c] += 1
    squares = sum(c * c for c in counts)
    chi = squares * size / n - n
    p_chi = chi_tail(chi, size - 1)
    middle = (size - 1) / 2
    high = [c > middle for c in codes]
    ups = sum(high)
    downs = n - ups
    if ups and downs:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 1 + 2 * ups * downs / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * upper_normal(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    mean = sum(codes) / n
    power = sum((c - mean) ** 2 for c in codes)
    serial = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / power if power else 1.0
    p_serial = 2 * upper_normal(abs(serial + 1 / n) * math.sqrt(n))
    random = min(1.0, 3 * min(p_chi, p_runs, p_serial))
    # Words: pairs of equal characters are a share WORD_REPEAT of all pairs, or more. Fewer speak against words.
    pairs = n * (n - 1) / 2
    equal = (squares - n) / 2
    repeat = max(WORD_REPEAT, 1.3 / size)
    words = upper_normal((repeat * pairs - equal) / math.sqrt(pairs * repeat * (1 - repeat)))
    # Case and digits are mixed at random in an encoding; in words they come in blocks.
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 for c in body]
    mixed = sum(a != b for a, b in zip(kinds, kinds[1:]))
    if len(set(kinds)) == 1 and name not in ("hex", "HEX", "base32"):
        words = 1.0
    elif name in ("alnum", "base64", "base64url"):
        expected, rare = 0.12 * (n - 1), 0.12
        words = min(words, upper_normal((mixed - expected) / math.sqrt((n - 1) * rare * (1 - rare))))
    elif name in ("hex", "HEX", "base32") and len(set(kinds)) == 1:
        words = 1.0
    return random, words


def random_spans(text: str) -> list[tuple[int, int]]:
    """Spans of tokens that the battery calls random, with false discoveries held down over the text's tokens."""
    whole = [m.span() for m in TOKEN.finditer(text)]
    spans = [x for s, e in whole for x in ([(s, e)] if infer_encoding(text[s:e].rstrip("=")) else [m.span() for m in PART.finditer(text, s, e)])]
    tested = [(s, e, p) for s, e in spans if (p := battery(text[s:e])) is not None]
    if not tested:
        return []
    mean = sum(math.log(e - s) for s, e, _ in tested) / len(tested)
    scored = sorted((p[1] * mean / math.log(e - s), s, e, p[0]) for s, e, p in tested)
    last = max((i for i, x in enumerate(scored, 1) if x[0] <= FALSE_DISCOVERY * i / len(scored)), default=0)
    return sorted((s, e) for _, s, e, p in scored[:last] if p >= RANDOM_LEVEL)


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets in a text, in code points, by start and then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    taken = sorted((s, e) for _, s, e in found)
    reach = list(accumulate((e for _, e in taken), max))  # the farthest end of the spans up to each
    for s, e in random_spans(text):
        before = bisect_left(taken, (e, 0))  # spans that start before this one ends
        if not before or reach[before - 1] <= s:
            found.append(("random", s, e))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `id_col` and spans, an array of (kind, start, end) over the whole text.

    Kinds: assign, access, hex (fixed patterns; leftmost, not overlapping within a kind) and random (the battery,
    on tokens that overlap no other span).
    A null or empty text has no spans; repeated rows are scanned each; other columns are left out; an empty table gives
    an empty table. One pass over the scan, no shuffle.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("spans", SPANS)])
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(1).slice(at, 256).to_pylist():
                    found.append([{"kind": k, "start": s, "end": e} for k, s, e in find_spans(text)] if text else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], schema.fieldNames())

    return source.mapInArrow(run, schema)

