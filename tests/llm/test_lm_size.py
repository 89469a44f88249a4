"""What the language model learns of contexts grows with the training texts."""

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import lm_scoring
from millrace.llm.lm_scoring import CLASSES, contexts, score_documents


def test_buckets_grow_with_the_training_tokens(spark, docs_of, monkeypatch):
    assert CLASSES >= 32
    assert lm_scoring.buckets_for(0) == 1 << 15
    sizes = [lm_scoring.buckets_for(4096 << k) for k in range(12, 24)]
    assert all(b >= 2 * a or a == 1 << 15 for a, b in zip(sizes, sizes[1:])) and sizes[-1] >= 1 << 23
    codes = np.random.default_rng(1).integers(0, 1 << 32, 200_000)
    _, features = contexts([codes], 1 << 22)
    assert all(len(np.unique(f)) > 150_000 for f in features)

    used = []
    train = lm_scoring.train_weights
    monkeypatch.setattr(lm_scoring, "buckets_for", lambda tokens: 1 << 17)
    monkeypatch.setattr(lm_scoring, "train_weights", lambda *a: used.append(train(*a)) or used[-1])
    rows = score_documents(docs_of([(i, f"one two three four w{i}") for i in range(50)]), F.lit(True)).collect()
    assert used[0].shape == (1 << 17, CLASSES) and np.flatnonzero(used[0].any(1)).max() >= 1 << 16
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
