import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from millrace.llm.packing import CachedTokenizer, fit_counts, pack_documents, plan_group
from millrace.llm.queries import op10_packing, tokenizer_file
from millrace.sources.tables import table

from .conftest import SMALL, TRICKY

PATH = tokenizer_file("word_bpe_49k.json")


def check(pieces, docs):
    """pieces hold every id of docs exactly once, gapless, in sequences that need no padding."""
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for name, text in docs:
        want[name].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [2])
    got, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        got[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    assert set(got) == set(want)
    for name, own in want.items():
        for ids in own:
            assert sum(p["length"] for p in got[name]) == sum(map(len, own))
        if len(own) == 1:
            at = 0
            for p in sorted(got[name], key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(own[0])
                part = np.array(own[0][at : at + p["length"]], "<u4").tobytes()
                assert p["ids_crc32"] == zlib.crc32(part)
                at += p["length"]
            assert at == len(own[0])
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 4096 and at & (at - 1) == 0


def test_query_on_small_tables(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    check(op10_packing(spark, SMALL).collect(), docs)


def test_tricky_rows(spark, docs_of):
    from pyspark.sql import functions as F

    pieces = pack_documents(docs_of(TRICKY), PATH, group_tokens=5000).withColumn("ids_crc32", F.crc32("ids"))
    check(pieces.collect(), TRICKY)
    assert pack_documents(docs_of([]), PATH).collect() == []


def test_words_on_their_own_give_the_ids_of_the_text():
    plain, cached = Tokenizer.from_file(PATH), CachedTokenizer(PATH, words=50)
    rng = random.Random(5)
    alphabet = "abcXYZ 09 .,'s'll é\u0301Ñ漢\U0001f600ΣΑ\t\n\x0b\x0c\r\x1c\x85\u00a0\u2003\u200b<|endoftext|>İ"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(400)] + ["it's we'll <|endoftext|> x<|startoftext|>y", "don't I'd"]
    for at in range(0, len(texts), 50):
        for text, ids in zip(texts[at : at + 50], cached.encode([t.encode() for t in texts[at : at + 50]])):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_counts_never_use_more_than_there_is():
    rng = random.Random(1)
    lengths = {n: rng.randint(1, 9) for n in rng.sample(range(1, 4096), 900)} | {1024: 40, 1365: 3, 1366: 6}
    used = defaultdict(int)
    combos = fit_counts(lengths, 4096)
    for combo, times in combos:
        assert sum(combo) == 4096 and times > 0
        for n in combo:
            used[n] += times
    assert combos and all(used[n] <= lengths[n] for n in used)


def test_plan_covers_any_sizes():
    rng = random.Random(2)
    for sizes in ([], [1], [4096], [4096 * 3 + 5, 4091], [rng.randint(1, 9000) for _ in range(500)], [7] * 3000):
        seen = [0] * len(sizes)
        for sequence in plan_group(sizes):
            total = sum(n for _, _, n in sequence)
            assert total == 4096 or total & (total - 1) == 0
            for d, _, n in sequence:
                seen[d] += n
        assert seen == sizes
