"""Each component of near documents keeps a row of its own, whatever the ids."""

from millrace.llm.simhash import keep_one


def test_unrelated_documents_without_an_id_or_with_the_same_stay(spark, docs_of):
    texts = ["alpha beta gamma delta", "one two three four five", "red green blue and white", "north south east west"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (None, texts[3]), (5, texts[3])]
    frame = docs_of(rows)
    kept = keep_one(frame)
    assert kept.columns == frame.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3])], key=repr)
