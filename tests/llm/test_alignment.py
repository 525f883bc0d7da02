"""Alignments against whole texts encoded by the libraries and compared byte by byte."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from sluicegate.llm import alignment
from sluicegate.llm.queries import op13_alignment

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(BYTES)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECES)
STAND_IN = {}
for byte in range(256):
    shown = 33 <= byte < 127 or 161 <= byte < 173 or 174 <= byte
    STAND_IN[chr(byte) if shown else chr(256 + sum(c > "\xff" for c in STAND_IN))] = byte

ODD = [
    "", None, "a", " ", "  ", "\n", " a", "a ", "a  b", "a\n b", "x  y", "▁a", "a ▁ b", "€ 王伟 \U0001f600 x",
    "é é ́ a", "<|endoftext|> <s> </s> <unk> <0x41>", "ﬁ ½ ²", "  a 　b", "it's 12345 don't", "\x00 \x7f",
    "日本語 テキスト", "กำ क्ष", "﻿ a", "a\t\tb   c", "​ ​",
]


def tokens(text):
    """Ids and bytes of the tokens of both, of the whole text; none if the bytes aren't the text's."""
    if not text:
        return [], []
    one = [(i, bytes(STAND_IN[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    other = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        other.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    data = (" " + text).encode()
    if b"".join(b for _, b in one) != data or b"".join(b for _, b in other) != data:
        return [], []
    return one, other


def owners(found):
    return [place for place, (_, data) in enumerate(found) for _ in data]


def expected(rows):
    """Per key the columns of the query, by going through the bytes of every text."""
    links, shapes = {}, {}
    for key, text in rows:
        one, other = tokens(text)
        pairs = sorted(set(zip(owners(one), owners(other))))
        links[key] = [(one[i][0], other[j][0]) for i, j in pairs]
        groups = []  # tokens whose links form one chain
        for i, j in pairs:
            if groups and (i in groups[-1][0] or j in groups[-1][1]):
                groups[-1][0].append(i) if i not in groups[-1][0] else None
                groups[-1][1].append(j) if j not in groups[-1][1] else None
            else:
                groups.append(([i], [j]))
        shown = ";".join(
            ",".join(str(one[i][0]) for i in a) + "|" + ",".join(str(other[j][0]) for j in b) for a, b in groups
        )
        shapes[key] = (len(one), len(other), len(groups), len(pairs), shown)
    counts = Counter(pair for found in links.values() for pair in found)
    best = {}
    for (a, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return {
        key: (
            *shapes[key][:4],
            sum(counts[pair] == best[pair[1]] for pair in found),
            sum(counts[pair] for pair in found),
            hashlib.sha256(shapes[key][4].encode()).hexdigest() if found else "",
        )
        for key, found in links.items()
    }


def test_query_against_the_libraries(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    found = {row.doc_id: tuple(row[c] for c in names) for row in op13_alignment(spark, folder).collect()}
    assert found == expected(rows) and len(found) == len(rows)


def counted(docs, most):
    aligned = alignment.align(docs, BYTES, PIECES)
    return alignment.add_counts(aligned, alignment.vocabulary_size(BYTES), most).collect()


def test_odd_texts_in_any_number_of_passes(spark, monkeypatch):
    monkeypatch.setattr(alignment, "LINKS_AT_A_TIME", 7)
    rng = random.Random(3)
    parts = [t for t in ODD if t] + ["the", "ünter", "Ελλάδα", "ab12", "\U0001f9d1‍\U0001f680"]
    texts = ODD + ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(150)]
    texts += [" ".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(150)] + ["a b"] * 5
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, links int, `text of the row` int")
    wanted = expected(rows)
    assert sum(1 for row in wanted.values() if row[0]) > 150
    for most in (10**6, 40):
        found = counted(docs.repartition(3), most)
        assert len(found) == len(rows)
        for row in found:
            shown = hashlib.sha256(row.groups.encode()).hexdigest() if row.groups else ""
            got = (row.n_a, row.n_b, row.n_groups, row.n_links, row.n_best, row.count_sum, shown)
            assert got == wanted[row.doc_id], texts[row.doc_id]
        assert found[0]["text of the row"] == 8


def test_text_cut_into_segments_is_the_whole_text(spark):
    rng = random.Random(5)
    with open(BYTES, encoding="utf-8") as file, open(PIECES, "rb") as model:
        aligner = alignment.Aligner(file.read(), model.read())
    assert aligner.cuts
    texts = ["".join(rng.choice("ab é\n\t €. 王1") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += ["plain words only"] * 3
    # All segments learned together, then put together again.
    columns = [column.to_pylist() for column in aligner.align(texts)]
    for number, text in enumerate(texts):
        one, other = tokens(text)
        n_a, n_b, _, n_links, groups, links = (column[number] for column in columns)
        assert (n_a, n_b, n_links) == (len(one), len(other), len(links)), text
        parts = [group.split("|") for group in groups.split(";") if group]
        assert [int(i) for a, _ in parts for i in a.split(",")] == [i for i, _ in one], text
        assert [int(i) for _, b in parts for i in b.split(",")] == [i for i, _ in other], text


def test_spans_that_do_not_fit_give_way_to_bytes():
    def ends(spans, sizes):
        return alignment.byte_ends(np.array(spans), np.array(sizes)).tolist()

    # A character of three bytes in three byte tokens: empty spans, then one that holds the whole character.
    assert ends([(0, 1), (1, 1), (1, 1), (1, 4), (4, 6)], [1, 1, 1, 1, 2]) == [1, 2, 3, 4, 6]
    # Two tokens that share a character report it both.
    assert ends([(0, 4), (1, 4), (4, 5)], [2, 2, 1]) == [2, 4, 5]


def test_passes_hold_whole_ids():
    assert alignment.passes([(3, 5), (1, 4), (7, 9), (8, 1)], 9) == [(1, 3), (7, 7), (8, 8)]
    assert alignment.passes([], 9) == []


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert counted(empty, 10) == []
    long = "lorem ipsum é " * 60_000
    docs = spark.createDataFrame([(1, long), (2, "x" * 200_000), (None, "lorem")], "doc_id long, text string")
    rows = {row.doc_id: row for row in counted(docs, 10**6)}
    wanted = expected([(1, long)])[1]
    assert (rows[1].n_a, rows[1].n_b, rows[1].n_groups, rows[1].n_links) == wanted[:4]
    assert rows[2].n_a > 0 and rows[None].n_groups >= 1


def test_a_small_memory_gives_the_same(monkeypatch):
    with open(BYTES, encoding="utf-8") as file, open(PIECES, "rb") as model:
        spec, pieces = file.read(), model.read()
    rng = random.Random(9)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7))} é{rng.randrange(9)}" for _ in range(40)) for _ in range(120)]
    whole = alignment.Aligner(spec, pieces)
    wanted = [column.to_pylist() for column in whole.align(texts)]
    monkeypatch.setattr(alignment, "CACHED_SEGMENTS", 60)
    small = alignment.Aligner(spec, pieces)
    found = [[], [], [], [], [], []]
    sizes = []
    for at in range(0, len(texts), 3):
        for column, values in zip(found, small.align(texts[at : at + 3])):
            column += values.to_pylist()
        sizes.append(len(small.place))
    assert found == wanted
    # A batch adds some hundred segments at most; what is rare goes before the next one.
    assert max(sizes) < len(whole.place)
