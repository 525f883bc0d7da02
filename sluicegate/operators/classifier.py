"""Class-weighted text classifier: training, selection, scoring, attributions.

A scorer is any callable ``scorer(frame, text_column) -> frame with a risk column``. It may also have
``add_risks(frame, texts_column, out)``, which adds an array of risks, one per text of an array column, where the
rows are, and, beside it, ``text_margins(frame)``, a function for workers from texts to margins, with ``risk_of_margin``
for columns of them; and ``token_weights(tokens)``, which adds a weight to rows with a word, for attributions. Attributions of
a scorer without weights come from scoring texts with a word left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, IDFModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit, TrainValidationSplitModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from sluicegate import fixed_values as fv
from sluicegate.functions import text as tx
from sluicegate.functions.portable import portable
from sluicegate.operators.joins import dimension_join

LABEL_NAMES = {0: "benign", 1: "jailbreak/malicious"}
WORD_BREAKS = r"[^\p{L}\p{N}]+"
# Up to so many coefficients a linear model is part of the plan; beyond, it is broadcast.
PLAN_WORDS = 2000
# Texts that a worker has as Python strings at a time, and different words whose weights it remembers.
TEXTS_PER_STEP = 512
REMEMBERED = 200_000
# Bytes of the texts that a worker splits, or has left words out of, at a time; one text more may go beyond.
BYTES_PER_STEP = 1 << 21
# What a byte of a Latin-1 text becomes: a lower-case letter or digit of a word, or a blank.
LATIN_WORDS = bytes(
    ord(char if unicodedata.category(char)[0] in "LN" else " ") for char in (chr(i).lower() for i in range(256))
)


def model_words(text: Column) -> Column:
    """All words of a text, as a classifier sees them."""
    return F.array_remove(F.split(F.lower(text), WORD_BREAKS), "")


def model_line(text: Column) -> Column:
    """A text for ``plain_line``: in any characters but those of Latin-1, its lower-case words and blanks alone."""
    latin = (F.octet_length(text) == F.char_length(text)) | text.rlike(r"\A[\x00-\xFF]*+\z")
    return F.when(text.isNull() | latin, text).otherwise(F.regexp_replace(F.lower(text), WORD_BREAKS, " "))


@portable
def plain_line(line: str | None) -> str | None:
    """The words of ``model_words`` with blanks between them, out of ``model_line``."""
    try:
        return line and line.encode("latin-1").translate(LATIN_WORDS).decode("latin-1")
    except UnicodeEncodeError:
        return line


# What stands between the words of ``model_words``.
NO_WORD = re.compile(r"[\W_]+")


@portable
def word_line(text: str | None) -> str | None:
    """The words of ``model_words`` with blanks between them."""
    try:
        return text and text.encode("latin-1").translate(LATIN_WORDS).decode("latin-1")
    except UnicodeEncodeError:
        return NO_WORD.sub(" ", text.lower())


@portable
def steps(texts: pa.Array) -> list[tuple[int, int]]:
    """First and last places of parts of about ``BYTES_PER_STEP``."""
    parts = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) // BYTES_PER_STEP
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(texts)]
    return list(zip(cuts, cuts[1:]))


def model_windows(words: Column, size: int = fv.MODEL_TOKENS) -> Column:
    """Inputs of a fitted classifier: windows of its input length that overlap by half, one of a short text.

    The last window ends with the text. A text's risk is that of its riskiest window; a passage of up to half a
    window stands in one of them whole, wherever it is.
    """
    stride = size // 2

    def cut(whole: Column) -> Column:
        spare = F.greatest(F.size(whole) - size, F.lit(0))
        starts = F.sequence(F.lit(0), F.ceil(spare / stride).cast("int"))
        return F.transform(starts, lambda k: F.slice(whole, F.least(k * stride, spare) + 1, size))

    # Bound to a name: words are found once a text then, not once a window.
    return tx.let(words, cut)


def riskiest_sum(words: Column, weight: Callable[[Column], Column], size: int = fv.MODEL_TOKENS) -> Column:
    """The largest sum of weights over all windows of ``size`` consecutive words, of all words if they are fewer.

    ``weight`` gives a word's decimal, or null. Only words with a weight change the sum from one window to the next:
    each comes in with one window and leaves with a later one. These changes, in order, give a running sum, and its
    largest value is taken wherever a window begins. Sums are exact, whatever the order.
    """
    kind = "decimal(20,6)"
    zero = F.lit(0).cast(kind)

    def plain(window: Column) -> Column:
        weights = F.array_compact(F.transform(window, weight))
        return F.aggregate(weights, zero, lambda total, w: (total + w).cast(kind))

    def sliding(window: Column) -> Column:
        placed = F.transform(window, lambda w, i: F.struct(i.alias("at"), weight(w).cast(kind).alias("change")))
        heavy = F.filter(placed, lambda p: p["change"].isNotNull())

        def changes(marks: Column) -> Column:
            come = F.transform(
                marks, lambda p: F.struct(F.greatest(p["at"] - (size - 1), F.lit(0)).alias("at"), p["change"].alias("change"))
            )
            go = F.transform(marks, lambda p: F.struct((p["at"] + 1).alias("at"), (-p["change"]).alias("change")))
            both = F.filter(F.concat(come, go), lambda p: p["at"] <= F.size(window) - size)
            start = F.struct(F.lit(0).alias("at"), zero.alias("total"), F.lit(None).cast(kind).alias("most"))

            def step(state: Column, p: Column) -> Column:
                # All changes at one place belong to the window that begins there.
                most = F.when(p["at"] > state["at"], F.greatest(state["most"], state["total"])).otherwise(state["most"])
                total = (state["total"] + p["change"]).cast(kind)
                return F.struct(p["at"].alias("at"), total.alias("total"), most.alias("most"))

            return F.aggregate(F.array_sort(both), start, step, lambda state: F.greatest(state["most"], state["total"]))

        return tx.let(heavy, changes)

    return tx.let(words, lambda w: F.when(F.size(w) <= size, plain(w)).otherwise(sliding(w)))


# -- results ----------------------------------------------------------------


def argmax(values: Column) -> Column:
    """Position of the largest value, the first one on ties, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def label_name(label: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LABEL_NAMES.items() for x in pair])
    return F.try_element_at(names, label)


def prediction(probabilities: Column) -> Column:
    """struct(label, confidence, is_dangerous) of two class probabilities."""
    picked = argmax(probabilities)
    return F.struct(
        label_name(picked).alias("label"),
        F.array_max(probabilities).alias("confidence"),
        (picked == 1).alias("is_dangerous"),
    )


def risk_of(result: Column) -> Column:
    """Confidence of a dangerous verdict, what is left of a harmless one's."""
    return F.when(result["is_dangerous"], result["confidence"]).otherwise(1.0 - result["confidence"])


def prediction_of_risk(risk: Column) -> Column:
    return prediction(F.array(1.0 - risk, risk))


# -- scorers ----------------------------------------------------------------


class LinearScorer:
    """Logistic score with given word coefficients.

    ``risk`` is the score as an expression, for up to ``PLAN_WORDS`` coefficients; ``add_risks`` uses it. Texts of a
    column, and those of arrays beyond that number, have their words looked up by Arrow batch, in a broadcast.
    """

    def __init__(self, coefficients: dict[str, float], intercept: float):
        self.coefficients, self.intercept = coefficients, intercept

    @property
    def in_row(self) -> bool:
        return len(self.coefficients) <= PLAN_WORDS

    def _logistic(self, margin: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-(margin + self.intercept)))

    def risk(self, text: Column) -> Column:
        table = F.create_map(*[F.lit(x) for pair in self.coefficients.items() for x in pair])
        known = list(self.coefficients)

        def weight(word: Column) -> Column:
            return F.when(word.isin(known), F.try_element_at(table, word).cast("decimal(18,6)"))

        return self._logistic(riskiest_sum(model_words(text), weight).cast("double"))

    def __call__(self, frame: DataFrame, text: str) -> DataFrame:
        """Rows are scored by Arrow batch: a Python worker looks words up in a fraction of the time of an expression."""
        margins = self._largest_margins(frame)

        @arrow_udf(T.DoubleType())
        @portable
        def margin(lines: pa.Array) -> pa.Array:
            return margins(lines)

        lines = frame.withColumn("line_", tx.pinned(model_line(F.col(text))))
        scored = lines.withColumn("margin_", tx.pinned(margin("line_")))
        return scored.withColumn("risk", self._logistic(F.col("margin_"))).drop("line_", "margin_")

    def add_risks(self, frame: DataFrame, texts: str, out: str) -> DataFrame:
        """Add an array of risks, one per text of an array column."""
        if self.in_row:
            return frame.withColumn(out, F.transform(texts, self.risk))
        margins = self._largest_margins(frame)

        @arrow_udf(T.ArrayType(T.DoubleType()))
        @portable
        def margin_lists(lists: pa.Array) -> pa.Array:
            number = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(number)]).astype(np.int32))
            return pa.ListArray.from_arrays(offsets, margins(lists.flatten()), mask=lists.is_null())

        lines = tx.pinned(F.transform(texts, lambda text: model_line(text)))
        return (
            frame.withColumn("lines_", lines)
            .withColumn("margins_", tx.pinned(margin_lists("lines_")))
            .withColumn(out, F.transform("margins_", self._logistic))
            .drop("lines_", "margins_")
        )

    def risk_of_margin(self, margin: Column) -> Column:
        return self._logistic(margin)

    def text_margins(self, frame: DataFrame) -> Callable[[pa.Array], pa.Array]:
        """A function for workers: the margin of each text, of its riskiest window; null for null."""
        return self._largest_margins(frame, word_line)

    def _largest_margins(self, frame: DataFrame, as_line: Callable = plain_line) -> Callable[[pa.Array], pa.Array]:
        """A function for workers: the largest sum of weights over the windows of each ``model_line``."""
        # A word stands with the blank after it; those without a weight have the last place, -1.
        blanked = pa.array([f"{word} " for word in self.coefficients], pa.string())
        numbers = np.array([*(round(weight * 1e6) for weight in self.coefficients.values()), 0], dtype=np.int64)
        shared = frame.sparkSession.sparkContext.broadcast((blanked, numbers))
        size = fv.MODEL_TOKENS

        @portable
        def largest_margins(lines: pa.Array) -> pa.Array:
            known, numbers = shared.value
            found = [np.zeros(0)]
            for first, last in steps(lines):
                # All texts in one buffer, cut behind every blank and line end: words are looked up where they lie.
                plain = [as_line(line) or "" for line in lines.slice(first, last - first).to_pylist()]
                data = np.frombuffer((" \n".join(plain) + " \n").encode(), np.uint8)
                cuts = np.concatenate([[0], np.flatnonzero(data <= ord(" ")) + 1]).astype(np.int32)
                words = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))
                real = np.diff(cuts) > 1
                places = pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                sums = np.concatenate([[0], np.cumsum(numbers[places[real]])])
                bounds = np.concatenate([[0], np.cumsum(real)[data[cuts[1:] - 1] == ord("\n")]])
                margins = sums[bounds[1:]] - sums[bounds[:-1]]
                for at in np.flatnonzero(np.diff(bounds) > size):
                    own = sums[bounds[at] : bounds[at + 1] + 1]
                    margins[at] = (own[size:] - own[:-size]).max()
                found.append(margins / 1e6)
            return pa.array(np.concatenate(found), pa.float64(), mask=lines.is_null().to_numpy(zero_copy_only=False))

        return largest_margins

    def token_weights(self, tokens: DataFrame) -> DataFrame:
        table = tokens.sparkSession.createDataFrame(
            list(self.coefficients.items()), "word string, weight double"
        )
        return dimension_join(tokens, table, "word", "inner", F.col("prompt_id"))


@portable
def spark_hash(data: bytes) -> int:
    """The number that Spark's HashingTF reduces to a bucket: murmur3, 32 bits, signed, with its seed."""
    most, value = 0xFFFFFFFF, 42

    def mixed(block: int) -> int:
        block = block * 0xCC9E2D51 & most
        return (block << 15 | block >> 17) * 0x1B873593 & most

    whole = len(data) & ~3
    for at in range(0, whole, 4):
        value ^= mixed(int.from_bytes(data[at : at + 4], "little"))
        value = ((value << 13 | value >> 19) & most) * 5 + 0xE6546B64 & most
    if whole < len(data):
        value ^= mixed(int.from_bytes(data[whole:], "little"))
    value ^= len(data)
    value = (value ^ value >> 16) * 0x85EBCA6B & most
    value = (value ^ value >> 13) * 0xC2B2AE35 & most
    value ^= value >> 16
    return value - (1 << 32) if value >> 31 else value


@portable
def largest_margin(values: np.ndarray, size: int) -> float:
    """The largest sum over the windows of ``model_windows``."""
    spare, stride = max(len(values) - size, 0), size // 2
    return max(float(values[at : at + size].sum()) for at in {*range(0, spare, stride), spare})


def bucket_weights(model: PipelineModel) -> tuple[np.ndarray, float] | None:
    """A weight per bucket and the intercept, if a fitted pipeline is what ``train`` makes, with two classes; else None."""
    kinds = [type(stage) for stage in model.stages]
    if kinds != [HashingTF, IDFModel, LogisticRegressionModel]:
        return None
    hashing, rarity, regression = model.stages
    chained = hashing.getInputCol() == "words" and hashing.getOutputCol() == rarity.getInputCol()
    chained = chained and rarity.getOutputCol() == regression.getFeaturesCol()
    if not chained or hashing.getBinary() or regression.numClasses != 2:
        return None
    return rarity.idf.toArray() * regression.coefficients.toArray(), float(regression.intercept)


class ModelScorer:
    """Scores with a fitted pipeline; the model reaches every task once.

    A pipeline of ``train`` is linear in the counts of its buckets: it has ``add_risks``, and texts are scored where
    they are. Any other one gets rows.
    """

    def __init__(self, model: PipelineModel):
        self.model = model
        self.weights = bucket_weights(model)
        if self.weights:
            self.add_risks, self.text_margins = self._add_risks, self._text_margins

    in_row = False

    def risk_of_margin(self, margin: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-(margin + self.weights[1])))

    def _text_margins(self, frame: DataFrame) -> Callable[[pa.Array], pa.Array]:
        """A function for workers: the margin of each text, of its riskiest window; null for null."""
        shared, size = frame.sparkSession.sparkContext.broadcast(self.weights[0]), fv.MODEL_TOKENS
        known: dict[str, float] = {}

        @portable
        def margins(texts: pa.Array) -> pa.Array:
            weights, found = shared.value, []
            if len(known) > REMEMBERED:
                known.clear()
            for first, last in steps(texts):
                for text in texts.slice(first, last - first).to_pylist():
                    if text is None:
                        found.append(None)
                        continue
                    words = word_line(text).split()
                    values = [known.get(word) for word in words]
                    if None in values:
                        for at, word in enumerate(words):
                            if values[at] is None:
                                known[word] = values[at] = float(weights[spark_hash(word.encode()) % len(weights)])
                    found.append(largest_margin(np.array(values, dtype=np.float64), size))
            return pa.array(found, pa.float64())

        return margins

    def _add_risks(self, frame: DataFrame, texts: str, out: str) -> DataFrame:
        """Add an array of risks, one per text of an array column; a text has that of its riskiest window."""
        shared, size = frame.sparkSession.sparkContext.broadcast(self.weights[0]), fv.MODEL_TOKENS
        known: dict[str, float] = {}

        @arrow_udf(T.ArrayType(T.DoubleType()))
        @portable
        def margins(lists: pa.Array) -> pa.Array:
            weights, found = shared.value, []
            if len(known) > REMEMBERED:
                known.clear()

            def weight(word: str) -> float:
                value = known.get(word)
                if value is None:
                    value = known[word] = float(weights[spark_hash(word.encode()) % len(weights)])
                return value

            flat = lists.flatten()
            for at in range(0, len(flat), TEXTS_PER_STEP):
                for text in flat.slice(at, TEXTS_PER_STEP).to_pylist():
                    if text is None:
                        found.append(None)
                    else:
                        values = np.array([weight(word) for word in text.split(" ") if word], dtype=np.float64)
                        found.append(largest_margin(values, size))
            number = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(number)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found, pa.float64()))

        # The words of ``model_words`` have no blank in them.
        blank = F.transform(texts, lambda text: F.regexp_replace(F.lower(text), WORD_BREAKS, " "))
        scored = frame.withColumn("blank_", tx.pinned(blank)).withColumn("margins_", tx.pinned(margins("blank_")))
        return scored.withColumn(out, F.transform("margins_", self.risk_of_margin)).drop("blank_", "margins_")

    def _scored(self, frame: DataFrame) -> DataFrame:
        scored = self.model.transform(frame)
        return scored.withColumn("risk", F.get(vector_to_array("probability"), F.lit(1))).drop(
            "words", "counts", "features", "rawPrediction", "probability", "prediction"
        )

    def __call__(self, frame: DataFrame, text: str) -> DataFrame:
        """Without ``add_risks``, texts of one window are scored in their row; of longer ones, every window, by content."""
        if self.weights:
            risks = self._add_risks(frame.withColumn("texts_", F.array(text)), "texts_", "risks_")
            return risks.withColumn("risk", F.get("risks_", F.lit(0))).drop("texts_", "risks_")
        words = frame.withColumn("words", model_words(F.col(text)))
        long = F.coalesce(F.size("words") > fv.MODEL_TOKENS, F.lit(False))
        keyed = words.filter(long).withColumn("text_key", F.sha2(F.col(text).cast("binary"), 256))
        windows = keyed.select("text_key", F.explode_outer(model_windows(F.col("words"))).alias("words"))
        worst = self._scored(windows).groupBy("text_key").agg(F.max("risk").alias("risk"))
        joined = keyed.drop("words").join(worst, "text_key").drop("text_key")
        return self._scored(words.filter(~long)).unionByName(joined)

    def token_weights(self, tokens: DataFrame) -> DataFrame:
        """A word's weight is what it adds to the margin of an otherwise empty text."""
        scored = self.model.transform(tokens.withColumn("words", F.array("word")))
        margin = F.get(vector_to_array("rawPrediction"), F.lit(1)) - F.lit(
            float(self.model.stages[-1].intercept)
        )
        return scored.withColumn("weight", margin).select(*tokens.columns, "weight")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_scorer(path: str) -> ModelScorer:
    return ModelScorer(PipelineModel.load(path))


def _linear_parts(prompts: DataFrame, scorer, text: str) -> DataFrame:
    """prompt_id, pos, word, part: what each different word adds to the margin, by the scorer's own weights."""
    words = prompts.select(
        "prompt_id", F.posexplode_outer(model_words(F.col(text))).alias("pos", "word")
    ).filter("word is not null")
    counted = words.groupBy("prompt_id", "word").agg(
        F.min("pos").alias("pos"), F.count("*").alias("times")
    )
    weighted = scorer.token_weights(counted)
    return weighted.select("prompt_id", "pos", "word", (F.col("weight") * F.col("times")).alias("part"))


def _margin(risk: Column) -> Column:
    kept = F.least(F.greatest(risk, F.lit(1e-15)), F.lit(1 - 1e-15))
    return F.log(kept / (1 - kept))


@portable
def without_each_word(line: str) -> Iterator[tuple[str, str]]:
    """Each different word of a line of words with a blank between them, and the line without it."""
    places: dict[str, list[int]] = {}
    at, line = 0, line + " "
    for word in line[:-1].split(" "):
        places.setdefault(word, []).append(at)
        at += len(word) + 1
    for word, starts in places.items():
        kept, last = [], 0
        for start in starts:
            kept.append(line[last:start])
            last = start + len(word) + 1
        yield word, "".join([*kept, line[last:]])[:-1]


def occlusion_parts(prompts: DataFrame, scorer, text: str) -> DataFrame:
    """prompt_id, pos, word, part: what the margin of the riskiest window loses without each of its words.

    For any scorer: the windows of a text are scored, and then the riskiest one again, once without each different
    word. So a row has at most as many rows here as a window has words, however long its text is, and they are
    scored where they arise; only windows, words and numbers move.
    """
    windows = prompts.select(
        "prompt_id", F.posexplode_outer(model_windows(model_words(F.col(text)))).alias("window", "words")
    ).select("prompt_id", "window", F.array_join("words", " ").alias("window_text"))
    best = F.max_by(F.struct("window_text", "risk"), F.struct("risk", -F.col("window"))).alias("best")
    riskiest = (
        scorer(windows, "window_text")
        .groupBy("prompt_id")
        .agg(best)
        .select("prompt_id", F.col("best.risk").alias("whole"), F.col("best.window_text").alias("window_text"))
        .filter("window_text <> ''")
    )
    schema = T.StructType(riskiest.select("prompt_id", "whole").schema.fields)
    schema = schema.add("pos", T.IntegerType()).add("word", T.StringType()).add("rest", T.StringType())

    @portable
    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.select(["prompt_id", "whole"])
            names = [*whole.schema.names, "pos", "word", "rest"]

            def rows(found: list[tuple[int, int, str, str]]) -> pa.RecordBatch:
                row, pos, word, rest = zip(*found)
                taken = whole.take(pa.array(row, pa.int64())).columns
                texts = [pa.array(word, pa.string()), pa.array(rest, pa.string())]
                return pa.RecordBatch.from_arrays([*taken, pa.array(pos, pa.int32()), *texts], names)

            found, held = [], 0
            for row, line in enumerate(batch.column("window_text")):
                for pos, (word, rest) in enumerate(without_each_word(line.as_py())):
                    found.append((row, pos, word, rest))
                    held += len(rest)
                    if held > BYTES_PER_STEP:
                        yield rows(found)
                        found, held = [], 0
            if found:
                yield rows(found)

    return scorer(riskiest.mapInArrow(left_out, schema), "rest").select(
        "prompt_id", "pos", "word", (_margin(F.col("whole")) - _margin(F.col("risk"))).alias("part")
    )


def attributions(
    prompts: DataFrame, scorer, text: str = "prompt", floor: float = fv.ATTRIBUTION_FLOOR
) -> DataFrame:
    """prompt_id, features array(word, impact): words that drove a verdict, in text order.

    A word's impact is its share of the whole contribution vector, scaled to length one. A scorer with
    ``token_weights`` gives the contributions to the whole text, any other one those to its riskiest window, by
    occlusion. Give only the dangerous prompts; a group is one prompt's distinct words.
    """
    parts = (_linear_parts if hasattr(scorer, "token_weights") else occlusion_parts)(prompts, scorer, text)

    def share(p: Column) -> Column:
        # Without any contribution no word has a share.
        return F.struct(
            p["word"].alias("word"), F.when(F.col("norm") > 0, p["part"] / F.col("norm")).alias("impact")
        )

    return (
        parts.groupBy("prompt_id")
        .agg(
            F.sqrt(F.sum(F.col("part") * F.col("part"))).alias("norm"),
            F.array_sort(F.collect_list(F.struct("pos", "word", "part"))).alias("parts"),
        )
        .select("prompt_id", F.filter(F.transform("parts", share), lambda p: p["impact"] >= floor).alias("shares"))
        .select(
            "prompt_id",
            F.transform(
                "shares",
                lambda p: F.struct(p["word"].alias("word"), F.round(p["impact"], 3).alias("impact")),
            ).alias("features"),
        )
    )


def classify(prompts: DataFrame, scorer) -> DataFrame:
    """Add prediction(label, confidence, is_dangerous) and risk."""
    return scorer(prompts, "prompt").withColumn("prediction", prediction_of_risk(F.col("risk")))


def analyze_classifier(prompts: DataFrame, scorer) -> DataFrame:
    """prompt_id, text_preview, prediction, bottleneck_features; words only for dangerous prompts."""
    scored = classify(prompts, scorer)
    slim = scored.select(
        "prompt_id", tx.preview(F.col("prompt"), fv.SHORT_PREVIEW_CHARS).alias("text_preview"), "prediction"
    )
    features = attributions(scored.filter("prediction.is_dangerous").select("prompt_id", "prompt"), scorer)
    return slim.join(features, "prompt_id", "left").select(
        "prompt_id",
        "text_preview",
        "prediction",
        F.coalesce("features", F.expr("cast(array() as array<struct<word:string,impact:double>>)")).alias(
            "bottleneck_features"
        ),
    )


# -- training ---------------------------------------------------------------


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, n, weight: total over classes times class size. One row per class."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    classes = counts.agg(F.count("*")).scalar()
    return counts.select(label, "n", (total / (classes * F.col("n"))).alias("weight"))


def training_rows(rows: DataFrame) -> DataFrame:
    """label, words (of the whole text), class_weight from rows with text and label."""
    weights = class_weights(rows).select("label", F.col("weight").alias("class_weight"))
    return dimension_join(
        rows.select("label", model_words(F.col("text")).alias("words")), weights, "label", "inner"
    )


def _stages(features: int, iterations: int, reg: float) -> list:
    return [
        HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(
            featuresCol="features",
            labelCol="label",
            weightCol="class_weight",
            maxIter=iterations,
            regParam=reg,
        ),
    ]


def train(rows: DataFrame, features: int = 1 << 16, iterations: int = 20, reg: float = 0.01) -> PipelineModel:
    """Fit a class-weighted logistic regression over hashed words."""
    return Pipeline(stages=_stages(features, iterations, reg)).fit(training_rows(rows))


def select_model(
    rows: DataFrame, regs: tuple[float, ...] = (0.001, 0.01, 0.1), features: int = 1 << 16, seed: int = 42
) -> TrainValidationSplitModel:
    """Keep the fit with the best F1 of class 1 on a held-out part."""
    stages = _stages(features, 20, regs[0])
    grid = ParamGridBuilder().addGrid(stages[-1].regParam, list(regs)).build()
    search = TrainValidationSplit(
        estimator=Pipeline(stages=stages),
        estimatorParamMaps=grid,
        evaluator=MulticlassClassificationEvaluator(
            labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0
        ),
        trainRatio=0.8,
        seed=seed,
    )
    return search.fit(training_rows(rows))


def classification_metrics(rows: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """accuracy, precision, recall, f1 of class 1 in one pass; a zero denominator gives 0."""

    def count(condition: Column) -> Column:
        return F.sum(condition.cast("long"))

    counted = rows.agg(
        F.count("*").alias("n"),
        count((label == 1) & (predicted == 1)).alias("tp"),
        count((label == 0) & (predicted == 1)).alias("fp"),
        count((label == 1) & (predicted == 0)).alias("fn"),
        count(label == predicted).alias("right"),
    )

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.select(
        "n",
        share(F.col("right"), F.col("n")).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
