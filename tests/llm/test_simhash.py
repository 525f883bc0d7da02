import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sluicegate.llm import common, simhash
from sluicegate.llm.graph import components
from sluicegate.llm.queries import op7_simhash


def fingerprint(text):
    words = (text or "").encode().translate(simhash.LOWER).split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    votes = [0] * 64
    for part in parts:
        value = xxhash.xxh64_intdigest(part, 42)
        for bit in range(64):
            votes[bit] += value >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(parts))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_spark_hash_is_the_same(spark):
    for text in ("", "a", "the house is", "é" * 50):
        value = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
        assert value % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


def test_links_are_all_and_only_the_near_pairs(spark):
    rng = random.Random(4)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        start = rng.getrandbits(64)
        values.add(start)
        for _ in range(5):
            other = start
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                other ^= 1 << bit
            values.add(other)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    for most in (1, 3, 5):
        near = {
            (a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= most
        }
        found = [(row.a, row.b) for row in simhash.links(frame, most).collect()]
        assert len(found) == len(set(found)) and set(found) == near


def test_components_of_chains_and_stars(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, n) for n in range(300, 340)] + [(7, 7), (None, 3)]
    links += [(rng.randint(400, 600), rng.randint(400, 600)) for _ in range(80)]
    good = [(a, b) for a, b in links if a is not None and a != b]
    wanted = roots({n for pair in good for n in pair}, good)
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {row.node: row.root for row in found.collect()} == wanted
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    prints = {row.doc_id: fingerprint(row.text) for row in rows}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    wanted = {i: (f"{prints[i]:016x}", root) for i, root in roots(prints, near).items()}
    found = op7_simhash(spark, folder).collect()
    assert {row.doc_id: (row.fingerprint, row.component_id) for row in found} == wanted
    assert len(found) == len(rows)


def test_odd_rows(spark):
    rows = [(4, None), (3, ""), (3, " \n"), (9, "One two"), (8, "one  TWO"), (None, "one two"), (None, "zz"), (None, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.group_documents(docs).collect()
    assert len(found) == len(rows)
    assert sorted((row.doc_id, row.component_id) for row in found if row.fingerprint == 0) == [(3, 3), (3, 3), (4, 3)]
    assert sorted(row.component_id or 0 for row in found if row.fingerprint != 0) == [0, 0, 8, 8, 8]
    assert simhash.group_documents(docs.limit(0)).count() == 0


def survivors(rows):
    """doc_ids of rows (doc_id, text) that stay: of each component of linked fingerprints the smallest."""
    prints = [fingerprint(text) for _, text in rows]
    near = [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if (prints[a] ^ prints[b]).bit_count() <= simhash.MOST_BITS
    ]
    groups = {}
    for place, root in roots(range(len(rows)), near).items():
        groups.setdefault(root, []).append(rows[place][0])
    return sorted(min((i is None, i or 0) for i in ids) for ids in groups.values())


def test_one_of_each_group_stays(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]
    rows, number = [], 0
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(40, 300))
        for _ in range(rng.randint(1, 5)):
            copy = list(words)
            for _ in range(rng.randint(0, len(words) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((number, " ".join(copy)))
            number += 1
    rng.shuffle(rows)
    rows += [(9001, None), (9001, None), (9002, ""), (9003, " "), (None, "only one such text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = simhash.keep_one_of_each(docs).collect()
    assert sorted((row.doc_id is None, row.doc_id or 0) for row in kept) == survivors(rows)
    assert 60 < len(kept) < len(rows) and [row.doc_id for row in kept].count(9001) == 1
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0


def test_ties_are_decided_by_all_columns(spark):
    rows = [(1, "one text of some words", source, {"a": n}) for source in "cab" for n in (1, 2)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `row one` map<string,int>")
    kept = {tuple(map(str, simhash.keep_one_of_each(docs.repartition(n)).collect())) for n in (1, 3, 7)}
    assert len(kept) == 1 and len(next(iter(kept))) == 1
    assert simhash.keep_one_of_each(docs).columns == docs.columns


def test_large_families_collapse(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(600):
        copy = list(words)
        copy[rng.randrange(3000)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [row.doc_id for row in simhash.keep_one_of_each(docs).collect()] == [0]


def test_a_hot_text_is_joined_where_its_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = [(i, "the same text of all these rows") for i in range(500)] + [(i, f"w{i} " * 9) for i in range(500, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {row.doc_id: row.component_id for row in simhash.group_documents(docs).collect()}
    assert len(found) == 900 and {found[i] for i in range(500)} == {0}
    assert {found[i] for i in range(500, 900)} <= set(range(500, 900))


def test_the_index_is_shuffled_once(spark):
    frame = spark.range(5000).select(F.xxhash64("id").alias("fingerprint"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = simhash.links(frame)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in plan


def test_majority_of_many_hashes():
    values = np.arange(1, 200_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = [(2 * int(((values >> np.uint64(b)) & np.uint64(1)).sum()) > len(values)) for b in range(64)]
    assert simhash.majority(values) % (1 << 64) == sum(1 << b for b in range(64) if bits[b])


def test_the_index_is_never_broadcast(spark, tmp_path):
    path = str(tmp_path / "fingerprints")
    spark.range(1000).select(F.xxhash64("id").alias("fingerprint")).write.parquet(path)
    plan = simhash.links(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
