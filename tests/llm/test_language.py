import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicegate.llm import language
from sluicegate.llm.queries import op2_language

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), rows_per_language=60)


def best_path(labeller, parts):
    """Viterbi, one text and one step at a time."""
    value, back = np.zeros(len(labeller.model.languages)), []
    for t, part in enumerate(parts):
        jump = value.max() - (labeller.penalty if t else 0)
        back.append((value >= jump, value.argmax()))
        value = np.maximum(value, jump) + labeller.scores[labeller.place[part]]
    state, path = value.argmax(), []
    for stays, comes in reversed(back):
        path.append(int(state))
        state = state if stays[state] else comes
    return path[::-1]


def test_paths_as_one_by_one(spark, model):
    texts = [row.text for row in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").limit(300).collect()]
    random.seed(2)
    cut = [" ".join(random.choice(texts).split()[: random.randint(0, 9)] * 2) for _ in range(100)]
    mixed = [f"{a} {b}" for a, b in zip(cut, reversed(cut))] + ["", " ", "12 34", "Привет мир the"]
    labeller = language.Labeller(model, 10.0)
    parts, paths, *_ = labeller.paths(mixed)
    assert [p.tolist() for p in paths] == [best_path(labeller, p) for p in parts]


def test_spans_and_odd_texts(spark, model):
    text = "the thing and of the house was der die und nicht ist das auch sich"
    rows = [(1, text, 0.5), (1, text, 0.5), (2, None, 0.1), (None, "", None), (4, "12 !!", 0.0), (5, "Привет мир", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").coalesce(1)
    found = language.label(docs, model).collect()
    assert [row.lang_pred for row in found[2:5]] == ["und"] * 3
    assert found[0] == found[1] and found[0].n_spans == 2
    spans = [(text[s.begin : s.end].split()[0], s.lang) for s in found[0].spans]
    assert spans == [("the", "en"), ("der", "de")]
    assert found[5].lang_pred == model.languages[0] and found[5].score == 0.0


def test_scripts_narrow_the_candidates():
    assert language.SCRIPTS[language.script_of("слово")] == "cyrillic"
    assert language.SCRIPTS[language.script_of("ñandú")] == "latin"
    assert language.SCRIPTS[language.script_of("漢字かな")] in ("han", "kana")


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "the house", None)], "doc_id long, text string, lang string")
    nothing = language.fit(docs)
    assert language.label(docs, nothing).first().lang_pred == "und"
    assert language.label(docs.limit(0), nothing).count() == 0


def test_held_out_accuracy(spark):
    predicted = op2_language(spark, FOLDER).filter("held_out")
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    right = predicted.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95


def plainly_labelled(model, text, penalty=language.PENALTY):
    """The language and the score of a text, one word, one letter and one language at a time."""
    pieces = (text or "").lower().split()
    rows = []
    for piece in pieces:
        words, word = [], ""
        for char in piece + " ":
            if char.isalpha():
                word += char
            elif word:
                words.append(word)
                word = ""
        sums, known = [0.0] * len(model.languages), 0
        for word in words:
            scripts = [language.SCRIPTS[language.script_of(char)] for char in word]
            most = max(sorted(set(scripts)), key=scripts.count)
            able = model.allowed[language.SCRIPTS.index(most)]
            if able.any():
                known += len(word)
                for n in range(len(sums)):
                    marked = f"<{word}>"
                    parts = [marked[i : i + 3] for i in range(len(marked) - 2)] + [f"={word}"]
                    own = sum(model.scores[zlib.crc32(p.encode()) % len(model.scores)][n] for p in parts)
                    sums[n] += own if able[n] else language.EXCLUDED
        rows.append((sums, sum(map(len, words)), known))
    letters = sum(n for _, n, _ in rows)
    if not letters:
        return "und", 0.0
    best = [([], 0.0)] * len(model.languages)
    for t, (sums, _, _) in enumerate(rows):
        top = max(range(len(best)), key=lambda n: (best[n][1], -n))
        jump = best[top][1] - (penalty if t else 0.0)
        best = [
            ((best[n][0] if best[n][1] >= jump else best[top][0]) + [n], max(best[n][1], jump) + sums[n])
            for n in range(len(best))
        ]
    path = max(best, key=lambda way: way[1])[0]
    shares = [sum(known for (_, _, known), n in zip(rows, path) if n == k) for k in range(len(model.languages))]
    return model.languages[shares.index(max(shares))], max(shares) / letters


def test_labels_and_scores_by_brute_force(spark, model):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").limit(60).collect()
    odd = ["½ ²", "Ⅷ", "³", "½ ² the", "12a3b", "ʰ", "a½b", "ª", "Привет", "Привет der Mann", "漢字 the house", "_a_", "é", "ا", "①"]
    texts = [row.text for row in rows] + odd
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {row.doc_id: row for row in language.label(docs, model).collect()}
    for number, text in enumerate(texts):
        name, score = plainly_labelled(model, text)
        assert found[number].lang_pred == name and found[number].score == pytest.approx(score), text
    labels = {text: found[60 + n].lang_pred for n, text in enumerate(odd)}
    assert all(labels[text] == "und" for text in ("½ ²", "Ⅷ", "³", "①")) and labels["½ ² the"] != "und"
    assert found[60 + odd.index("½ ²")].score == 0.0 and labels["ª"] != "und"
