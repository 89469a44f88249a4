import random

from tokenizers import Tokenizer, models, pre_tokenizers

from millrace.llm.queries import op5_token_counts, tokenizer_file
from millrace.llm.token_counts import ViterbiCounter, count_tokens, unigram_pieces
from millrace.sources.tables import table

from .conftest import SMALL, TRICKY

PATH = tokenizer_file("piece_bpe_32k.model")


def reference(pieces):
    """A unigram tokenizer of the same pieces, with byte pieces for what they don't cover."""
    vocab = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)] + list(pieces)
    low = min(s for _, s in pieces)
    vocab = [(p, low if p.startswith("<0x") or p == "<unk>" else s) for p, s in vocab]
    tokenizer = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="never")
    return lambda text: len(tokenizer.encode(" " + text, add_special_tokens=False).ids) if text else 0


def test_query_agrees_with_a_unigram_tokenizer(spark):
    count = reference(unigram_pieces(PATH))
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    got = {r.doc_id: r.n_tokens for r in op5_token_counts(spark, SMALL).collect()}
    assert got == {k: count(v) for k, v in texts.items()}


def test_random_texts_and_ties():
    pieces = [("▁", -3.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -4.0), ("bb", -1.5), ("c", -2.5), ("é", -2.0), ("ac", -3.5), ("xyz", -1.0)]
    count, counter = reference(pieces), ViterbiCounter(pieces, cache_words=20)
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices("aabbc xyzé漢\n", k=rng.randint(0, 14)))
        assert counter.count(text.encode()) == count(text), repr(text)


def test_tricky_rows(spark, docs_of):
    count = reference(unigram_pieces(PATH))
    got = sorted((str(r.doc_id), r.n_tokens) for r in count_tokens(docs_of(TRICKY), PATH).collect())
    assert got == sorted((str(k), count(v or "")) for k, v in TRICKY)
    assert count_tokens(docs_of([]), PATH).collect() == []
