import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.lm_scoring import CLASSES, Scorer, code_of, contexts, descend, score_documents
from millrace.llm.queries import op7_lm_scoring
from millrace.sources.tables import table

from .conftest import SMALL, TRICKY


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["\n"]


def base_scores(docs, fits):
    counts = Counter(t for i, text in docs if fits(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    for i, text in docs:
        own = tokens(text)
        yield i, len(own), sum(t in counts for t in own), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def test_query_agrees_with_plain_counts_and_beats_the_base(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    got = {r.doc_id: r for r in op7_lm_scoring(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for i, n, known, total, base in base_scores(docs, lambda i: not held(i)):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("head", [0, 7, 10_000])
def test_tricky_rows(spark, docs_of, head):
    rows = score_documents(docs_of(TRICKY), F.col("doc_id") % 2 == 0, head_words=head).collect()
    got = sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) for r in rows)
    want = list(base_scores(TRICKY, lambda i: i is not None and i % 2 == 0))
    assert got == sorted((repr(i), n, known, total) for i, n, known, total, _ in want)
    base = {i: b for i, _, _, _, b in want}
    assert all(r.base_score == pytest.approx(base[r.doc_id]) and r.score < 0 for r in rows)


def test_no_training_rows_and_no_rows(spark, docs_of):
    rows = score_documents(docs_of(TRICKY), F.lit(False)).collect()
    assert len(rows) == len(TRICKY) and all(r.n_known == r.train_tokens == 0 and math.isfinite(r.score) for r in rows)
    assert score_documents(docs_of([]), F.lit(True)).collect() == []


def test_class_probabilities_sum_to_one_and_learn():
    rng = np.random.default_rng(1)
    words = [b"aa", b"bb", b"cc", b"dd"]
    sequence = [words[i % 4] for i in range(4000)]
    codes = np.array([code_of(w) for w in sequence])
    classes, features = contexts([codes])
    weights, seen, bias = rng.normal(0, 0.01, (1 << 15, CLASSES)).astype(np.float32), np.ones(1 << 15, np.float32), np.zeros(CLASSES, np.float32)
    score = lambda *texts: Scorer(bias, weights, np.zeros(CLASSES)).class_scores([np.array(t) for t in texts])
    before = score(codes)[0]
    for at in range(0, 4000, 500):
        descend(weights, seen, bias, classes[at : at + 500], features[:, at : at + 500])
    assert score(codes)[0] > before / 4
    total = sum(10 ** x for x in score(*[[*codes[:5], c << 32] for c in range(CLASSES)]))
    assert total == pytest.approx(10 ** score(codes[:5])[0], rel=1e-4)
    assert score(codes[:7], codes[:1], codes[:300]).tolist() == pytest.approx([score(codes[:n])[0] for n in (7, 1, 300)])


def test_a_vocabulary_grows_and_is_trimmed(monkeypatch):
    from millrace.llm import lm_scoring

    known = lm_scoring.Vocabulary({b"w7": -1.5})
    words = [b"w%d" % i for i in range(200_000)]
    n = known.numbers(words)
    assert known.codes[n].tolist() == [code_of(w) for w in words] and known.logs[n[7]] == -1.5 and np.isnan(known.logs[n[8:]]).all()
    monkeypatch.setattr(lm_scoring, "CACHE_WORDS", 10)
    known.trim()
    assert not known.index and known.codes[known.numbers([b"w7"])].tolist() == [code_of(b"w7")]
