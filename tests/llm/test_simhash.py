import random
import re
from itertools import combinations

import pytest
import xxhash

from millrace.llm.components import connected_components
from millrace.llm.queries import op4_simhash_near_dedup
from millrace.llm.simhash import MASKS, keep_one, near_documents, near_links, signed
from millrace.sources.tables import table

from .conftest import SMALL, TRICKY


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    """Least id reachable of each id, over all pairs."""
    up = dict.fromkeys(range(len(fps)))
    root = lambda x: x if up[x] is None else root(up[x])
    for a, b in combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3 and root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(len(fps))]


def test_every_pair_within_the_radius_collides():
    for n in (1, 2, 3):
        for bits in combinations(range(64), n):
            diff = sum(1 << b for b in bits)
            assert any(not diff & m for m in MASKS)


def test_query_agrees_with_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect())
    fps = [plain_fingerprint(t) for _, t in docs]
    want = {(i, f"{fp:016x}", docs[g][0]) for (i, _), fp, g in zip(docs, fps, groups(fps))}
    assert {tuple(r) for r in op4_simhash_near_dedup(spark, SMALL).collect()} == want


@pytest.mark.parametrize("most", [8192, 4])
def test_links_are_exact_in_small_and_large_buckets(spark, most):
    rng = random.Random(2)
    center = rng.getrandbits(64)
    fps = {0, 1 << 63, 7, (1 << 64) - 1}
    for _ in range(150):
        fps.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    fps |= {rng.getrandbits(64) for _ in range(60)}
    fps = sorted(fps)
    rng.shuffle(fps)
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    roots = {r.node % 2**64: r.root % 2**64 for r in connected_components(near_links(frame, most)).collect()}
    want = groups(fps)
    classes = {}
    for fp, g in zip(fps, want):
        classes.setdefault(g, set()).add(fp)
    got = {}
    for fp in fps:
        got.setdefault(roots.get(fp, fp), set()).add(fp)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))


def test_a_run_longer_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = spark.range(60).selectExpr("shiftleft(1L, CAST(id AS INT)) AS fp")
        roots = connected_components(near_links(frame))
        assert roots.count() == 60 and roots.select("root").distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tricky_rows(spark, docs_of):
    rows = near_documents(docs_of(TRICKY)).collect()
    assert len(rows) == len(TRICKY)
    by = {r.doc_id: r for r in rows}
    for i, t in TRICKY:
        assert by[i].fp % 2**64 == plain_fingerprint(t)
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1 and by[None].component_id is None
    frame = docs_of([*TRICKY, (60, "one  TWO"), (None, "a row without an id")])
    kept = keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [1, 4, 5, 6, None, 7, 8, 9, -3]))
    assert keep_one(docs_of([(5, "a b c d"), (7, "a b c d"), (8, "x y z w")])).count() == 2
    assert near_documents(docs_of([])).collect() == [] and keep_one(docs_of([])).collect() == []
