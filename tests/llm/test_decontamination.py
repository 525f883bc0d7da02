import random
import re

from pyspark.sql import functions as F

from sluicegate.llm.decontamination import find_benchmark

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return WORD.findall(lowered)


def brute(docs, items):
    out = {}
    for key, text in docs:
        words, hit, names = words_of(text), set(), set()
        for item, passage in items:
            parts = words_of(passage)
            size = min(10, len(parts))
            windows = {tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)} if size else set()
            for at in range(len(words) - size + 1) if size else ():
                if tuple(words[at : at + size]) in windows:
                    hit |= set(range(at, at + size))
                    names |= {item} - {None}
        out[key] = (len(words), len(hit), sorted(names))
    return out


def test_against_brute_force_in_one_block_and_many(spark):
    rng = random.Random(2)
    vocabulary = ["the", "of", "and", "Éa", "x9", "lamp", "stone", "bird"]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [("0", items[0][1]), (None, items[3][1]), ("20", None), ("21", "..."), ("22", "")]
    docs = [(0, None), (1, ""), (2, "the of and")]
    for i in range(3, 60):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        if i % 2:
            passage = rng.choice(items[:12])[1].split()
            words[len(words) // 2 : len(words) // 2] = passage
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words).upper() if i % 3 else " ".join(words)))
    wanted = brute(docs, items)
    frame = spark.createDataFrame([(k, t, "clash") for k, t in docs], "doc_id long, text string, N_HIT string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    for size in (200_000, 40):
        found = find_benchmark(frame.repartition(3), benchmark, block_windows=size)
        assert found.columns == ["doc_id", "text", "n_words", "hit_spans", "items", "n_hit", "contaminated"]
        assert {row.doc_id: (row.n_words, row.n_hit, row["items"]) for row in found.collect()} == wanted
    assert any(n_hit for _, n_hit, _ in wanted.values())


def test_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(5, "b")], "item_id long, text string")
    assert [row.n_hit for row in find_benchmark(docs, benchmark).collect()] == [1, 1]
    assert [row.n_hit for row in find_benchmark(docs, benchmark.limit(0)).collect()] == [0, 0]
    assert find_benchmark(docs.limit(0), benchmark).count() == 0


def test_whole_long_texts(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("repeat('the ', 300000) || 'rare end'").alias("text"))
    benchmark = spark.createDataFrame([(5, "the rare end"), (6, "the the the")], "item_id long, text string")
    row = find_benchmark(docs, benchmark).first()
    assert (row.n_words, row.n_hit, row["items"]) == (300_002, 300_002, ["5", "6"])
