import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm.decontamination import drop_contaminated, find_contamination, remove_spans
from millrace.llm.queries import op8_decontamination
from millrace.sources.tables import table

from .conftest import SMALL, TRICKY


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, bench):
    w, hit, items = words(text), set(), set()
    for item, passage in bench:
        p = words(passage)
        k = min(13, len(p))
        own = {tuple(p[i : i + k]) for i in range(len(p) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in own:
                hit |= set(range(i, i + k))
                if item is not None:
                    items.add(str(item))
    return len(w), len(hit), tuple(sorted(items)), bool(hit) and 20 * len(hit) >= len(w)


BENCH = [(1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "short item"), (3, None), (4, " ... "), (5, "ΑΣ Β"), (None, "row without an"), (10, "word " * 15), (10, "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (7, "x")]


def texts():
    rng = random.Random(9)
    vocabulary = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen short item ΑΣ Β word".split()
    out = list(TRICKY)
    for i in range(100, 160):
        lead = " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))
        run = " ".join(vocabulary[rng.randint(0, 2) : rng.randint(12, 15)])
        out.append((i, f"{lead}, {run.title()}!\n{lead}"))
    return out


@pytest.mark.parametrize("most", [200_000, 3])
def test_agrees_with_brute_force(spark, docs_of, most):
    docs = texts()
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = sorted(repr((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated)) for r in find_contamination(docs_of(docs), bench, most_hashes=most).collect())
    assert got == sorted(repr((i, *brute(t, BENCH))) for i, t in docs)


def test_query_agrees_with_brute_force(spark):
    bench = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    docs = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    for r in op8_decontamination(spark, SMALL).collect():
        n, hit, items, flag = brute(docs[r.doc_id], bench)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(items), flag)
        assert r.items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest()


def test_dropping_and_cutting(spark, docs_of):
    docs = texts()
    frame = docs_of(docs)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    kept = drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, t in docs if not brute(t, BENCH)[3])
    cut = remove_spans(frame, bench)
    assert cut.columns == frame.columns
    for r in cut.where("doc_id >= 100").collect():
        text = dict(docs)[r.doc_id]
        n, hit, _, flag = brute(text, BENCH)
        assert (len(words(r.text)) == n - hit) if flag else r.text == text


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert find_contamination(docs_of([]), bench).collect() == []
    assert not find_contamination(docs_of(TRICKY), bench.limit(0)).where("contaminated or n_hit > 0").count()
    assert drop_contaminated(docs_of(TRICKY), bench.where(F.lit(False))).count() == len(TRICKY)
