import random

import pytest
from tokenizers import Tokenizer

from sluicegate.llm import common, tokens
from sluicegate.llm.queries import TOKENIZER

PARTS = [" ", "  ", "\n", " \n", "the", "aaaa", "é", "漢字", "😀", "'s", "'ll", "1", "23", "!!", "<|endoftext|>", " x", " and"]


@pytest.mark.parametrize(("chunk", "overlap"), [(200, 60), (97, 40)])
def test_spliced_counts_as_the_library(spark, chunk, overlap):
    random.seed(chunk)
    texts = [None, "", "a"] + ["".join(random.choices(PARTS, k=random.randint(0, 400))) for _ in range(150)]
    # Runs without a boundary in the overlap: chunks have to grow.
    texts += ["a" * 3000 + " b" * 50, " " * 2000 + "x" * 700, "ab " * 1500] * 2
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, N_TOKENS string")
    counted = tokens.count_tokens(docs.repartition(3), TOKENIZER, chunk=chunk, overlap=overlap)
    assert counted.columns == ["doc_id", "text", "n_bytes", "n_tokens"]
    library = Tokenizer.from_file(TOKENIZER)
    got = {row.doc_id: (row.n_bytes, row.n_tokens) for row in counted.collect()}
    for i, text in enumerate(texts):
        encoded = (text or "").encode()
        assert got[i] == (len(encoded), len(library.encode(text or "", add_special_tokens=False).ids))
    assert len(got) == len(texts)


def test_boundaries_near_the_end_are_not_trusted(spark):
    counter = tokens.Counter(open(TOKENIZER, encoding="utf-8").read())
    assert counter.margin > len("<|endoftext|>")
    total, places, before = counter.word_starts("one two 'll")
    assert places == [0, 3, 7, 9] and before[0] == 0 and total >= len(places)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.count_tokens(docs, TOKENIZER).count() == 0


def test_one_huge_text_in_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    huge = "some words of a huge text é " * 100
    rows = [(i, huge) for i in range(40)] + [(i, f"{huge} {i}") for i in range(40, 60)] + [(i, "short") for i in range(60, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs, TOKENIZER, chunk=512, overlap=64).collect()}
    library = Tokenizer.from_file(TOKENIZER)
    assert len(found) == 120
    for key, text in rows:
        assert found[key] == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))


def test_chunks_are_encoded_once(spark):
    """One stage of the plan encodes chunks: what the splice joins with itself is stored."""
    docs = spark.createDataFrame([(1, "word and word " * 3000)], "doc_id long, text string")
    encoded = spark.sparkContext.accumulator(0)
    real = tokens._summaries

    def counted(chunks, counter, overlap):
        def watch(batches):
            for batch in batches:
                encoded.add(batch.num_rows)
                yield batch

        return real(chunks.mapInArrow(watch, chunks.schema), counter, overlap)

    tokens._summaries = counted
    try:
        assert tokens.count_tokens(docs, TOKENIZER, chunk=1024, overlap=64).first().n_tokens > 0
    finally:
        tokens._summaries = real
    assert encoded.value == len(tokens.cut("word and word " * 3000, 1024, 64))
