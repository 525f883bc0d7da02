import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from sluicegate.llm import bpe
from sluicegate.llm.queries import TOKENIZER

PARTS = [
    " ", "  ", "\n", " \n", "\t", " ", "　", "a", "th", "the", "aaaa", "zzzz", "é", "漢字", "😀", "'s", "'ll",
    "'", "1", "23", "!!", "<|endoftext|>", "<|endof", "\x1c", "\x85", "​", "ß", "́", "Ⅷ", "٣", "abab", " x",
]


@pytest.fixture(scope="module")
def encoder():
    with open(TOKENIZER, encoding="utf-8") as file:
        return bpe.ByteBpe(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def ids(data):
    return np.frombuffer(data, dtype="<u4").tolist()


def test_odd_texts_as_the_library(encoder, library):
    random.seed(5)
    texts = ["".join(random.choices(PARTS, k=random.randint(0, 25))) for _ in range(5000)]
    wanted = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    encoded = encoder.encode(texts)
    assert [ids(data) for data in encoded] == wanted
    assert [encoder.decode(data) for data in encoded] == texts


def test_long_runs_as_the_library(encoder, library):
    for text in ("a" * 30_000 + "xyz" * 5_000, " " * 3_000, "é" * 4_000):
        assert ids(encoder.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_most_words_need_no_repair_and_some_do(encoder):
    encoder.cache, encoder.words, encoder.counts = {}, {}, {"words": 0, "repaired": 0}
    encoder.encode(["the house and the garden that were there before, thndea onheerthly thereatouble hetiontheat anoued"])
    assert 0 < encoder.counts["repaired"] < encoder.counts["words"]


def test_neighbours_that_the_check_keeps_apart_are_those_that_merging_keeps(encoder):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 50_000, 4000), rng.integers(0, 50_000, 4000)
    apart = encoder.apart(a, b)
    for x, y, kept in zip(a.tolist(), b.tolist(), apart.tolist()):
        assert (encoder.merge_exactly(encoder.text_of[x] + encoder.text_of[y]) == [x, y]) == kept


def test_words_split_alike_for_all_stable_characters(encoder):
    for code in range(1, ord(bpe.STABLE)):
        piece = f" a{chr(code)}1{chr(code)}!{chr(code)}x {chr(code)}{chr(code)}"
        mine = [word.encode("latin-1").decode() for word in encoder.split(piece)]
        theirs = [piece[a:b] for _, (a, b) in encoder.splitter.pre_tokenize_str(piece)]
        assert mine == theirs


def test_bytes_that_are_no_text(encoder, library):
    for data in ([228], [228, 184], [162, 50256, 50257, 99_999], []):
        known = [i for i in data if i < 50_257]
        assert encoder.decode(np.array(data, "<u4").tobytes()) == library.decode(known, skip_special_tokens=False)


def test_columns_of_frames(spark, library):
    rows = [(1, None, "x", 1), (1, None, "x", 1), (None, "", "y", 2), (3, "the <|endoftext|> end", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string, n_tokens int")
    encoded = bpe.encode_column(docs, TOKENIZER)
    assert encoded.columns == ["doc_id", "text", "n_tokens", "ids"]
    wanted = [library.encode(text or "").ids for _, text, *_ in rows]
    assert [row.ids for row in encoded.collect()] == wanted
    decoded = bpe.decode_column(encoded, TOKENIZER, text="again").collect()
    assert [row.again for row in decoded] == ["", "", "", "the <|endoftext|> end"]
    summary = bpe.round_trip(docs, TOKENIZER).collect()
    assert [row.n_tokens for row in summary] == [len(x) for x in wanted]
    assert bpe.round_trip(docs.limit(0), TOKENIZER).count() == 0
