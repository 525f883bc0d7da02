"""Exact nearest signature by cosine distance.

Signatures are a reference table. While their measured matrix is small it goes to every task
and the search happens inside the query's own row: no shuffle at all.

Beyond that, signatures are cut into *parts* of similar ones: each goes to the nearest of some
pivots, and a pivot with many to several parts. Of a part its *bounds* are known: the least and
largest value in every dimension, the centre and the largest angle to it. They say how similar a
member can be to a query at most (the sum over dimensions of the larger product; the cosine of the
angle to the centre less the radius) and, the other way round, how similar the best one is at least.
A query goes first to the part that can hold the most similar one, then to those that can still hold
a nearer one, or one below a limit if it is given; every other pair is never compared, and the
result stays exact. Parts can be a stored table
(``SignatureStore``) whose folders a search reads only as far as queries need them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from sluicegate import fixed_values as fv
from sluicegate.functions import embedding as em
from sluicegate.functions import text as tx
from sluicegate.functions.embedding import DIMENSIONS, blocks, text_buckets, unit_rows
from sluicegate.functions.portable import portable
from sluicegate.functions.text import chunk_list
from sluicegate.operators.joins import is_small
from sluicegate.session import stored
from sluicegate.sources.snapshots import Snapshots

MATRIX_BYTES = 64 * 1024 * 1024
PART_SIGNATURES = 8192
MOST_PIVOTS = 1024
# Above it the bounds of the parts don't go to the tasks, and every query goes to every part.
BOUND_BYTES = 64 * 1024 * 1024
# Distances in memory at a time: 16 MB, and as much again to round them.
PAIRS_PER_STEP = 1 << 21
BLOCK_QUERIES = 20_000
# Prompts that a worker has as Python strings at a time.
PROMPTS_PER_STEP = 256
FOUND = T.StructType(
    [T.StructField("sig_id", T.StringType()), T.StructField("distance", T.DoubleType())]
)
BOUNDS = "part int, n long, low array<double>, high array<double>, centre array<double>, radius double"
# Distances are rounded to 12 digits, and angles close to 0 have half the digits of their cosine.
SLACK = 1e-7


@portable
def _best(matrix: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and distance of each row's nearest signature; the first one on ties.

    A step compares at most PAIRS_PER_STEP pairs, or one row with all signatures.
    """
    at, nearest = np.zeros(len(matrix), dtype=np.int64), np.zeros(len(matrix))
    rows = max(1, PAIRS_PER_STEP // max(1, len(signatures)))
    for start in range(0, len(matrix), rows):
        distances = np.round(1.0 - matrix[start : start + rows] @ signatures.T, 12)
        best = distances.argmin(axis=1)
        at[start : start + rows] = best
        nearest[start : start + rows] = distances[np.arange(len(best)), best]
    return at, nearest


@portable
def _least(matrix: np.ndarray, signatures: np.ndarray) -> np.ndarray:
    """Distance of each row's nearest signature alone, NaN without any; in the same steps."""
    nearest = np.full(len(matrix), np.nan)
    rows = max(1, PAIRS_PER_STEP // max(1, len(signatures)))
    for start in range(0, len(matrix) if len(signatures) else 0, rows):
        nearest[start : start + rows] = np.round(1.0 - (matrix[start : start + rows] @ signatures.T).max(axis=1), 12)
    return nearest


def matrix_fits(signatures: DataFrame, dimensions: int) -> bool:
    return is_small(
        signatures.select("sig_id", "features"), rows=MATRIX_BYTES // (8 * dimensions), size=MATRIX_BYTES
    )


def with_nearest(
    frame: DataFrame,
    features: str,
    signatures: DataFrame,
    kind: str = "bag",
    dimensions: int = em.DIMENSIONS,
    key: str = "prompt_id",
    out: str = "nearest",
    broadcast: bool | None = None,
    limit: float | None = None,
) -> DataFrame:
    """Add an array of (sig_id, distance), one entry per element of the array column ``features``.

    ``signatures`` has sig_id and features; no entry is found while it is empty. With a ``limit`` an entry may be
    null where no signature is at a distance below it.
    """
    signatures = signatures.select(F.col("sig_id").cast("string").alias("sig_id"), "features")
    if broadcast is None:
        broadcast = matrix_fits(signatures, dimensions)
    if not broadcast:
        parted = stored(in_parts(signatures, kind, dimensions), "parts")
        return with_nearest_of_parts(
            frame, features, parted, bounds_of(parted, kind, dimensions), kind, dimensions, key, out, limit
        )
    table = signatures.orderBy("sig_id").toArrow()  # bounded by the check above
    ids = np.array(table["sig_id"].to_pylist() + [None], dtype=object)
    features_array = table["features"].combine_chunks()
    if isinstance(features_array, pa.ChunkedArray):
        features_array = pa.concat_arrays(features_array.chunks)
    matrix = unit_rows(features_array, kind, dimensions)
    shared = frame.sparkSession.sparkContext.broadcast((ids, matrix))

    @arrow_udf(T.ArrayType(FOUND))
    def search(lists: pa.Array) -> pa.Array:
        ids, matrix = shared.value
        flat = lists.flatten()
        found_at, found = [np.zeros(0, dtype=int)], [np.zeros(0)]
        for block in blocks(flat):
            if len(matrix):
                at, distance = _best(unit_rows(block, kind, dimensions), matrix)
            else:
                at, distance = np.full(len(block), -1), np.full(len(block), np.nan)
            found_at.append(at)
            found.append(distance)
        distance = np.concatenate(found)
        entries = pa.StructArray.from_arrays(
            [
                pa.array(ids[np.concatenate(found_at)], pa.string()),
                pa.array(distance, pa.float64(), mask=np.isnan(distance)),
            ],
            names=["sig_id", "distance"],
        )
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)

    # Named twice, the array stays a column of its own below the Python call; merged into the
    # call, nested lambdas would keep Spark from recognising it.
    whole = F.when(F.size(features) >= 0, F.col(features))
    return frame.withColumn(out, search(whole))


def text_distances(signatures: DataFrame) -> Callable[[Column], Column]:
    """An expression: the distances of a text, then of its sentence chunks, to the nearest of few signatures (word buckets).

    Texts are cut and hashed in the worker that compares them: nothing but distances comes back. They are null while
    there is no signature.
    """
    table = signatures.orderBy("sig_id").select("features").toArrow()  # bounded by the caller's check
    features = table["features"].combine_chunks()
    if isinstance(features, pa.ChunkedArray):
        features = pa.concat_arrays(features.chunks)
    matrix = unit_rows(features, "bag", em.DIMENSIONS)
    shared, limit = signatures.sparkSession.sparkContext.broadcast(matrix), fv.WORDS_PER_CHUNK
    known: dict[str, int] = {}

    @arrow_udf(T.ArrayType(T.DoubleType()))
    @portable
    def distances(texts: pa.Array) -> pa.Array:
        matrix, ends, found = shared.value, [0], [np.zeros(0)]
        for at in range(0, len(texts), PROMPTS_PER_STEP):
            chunks, numbers = [], []
            for text in texts.slice(at, PROMPTS_PER_STEP).to_pylist():
                own = () if text is None else chunk_list(text, limit)
                chunks += [chunk.lower() for chunk in own]
                numbers.append(None if text is None else len(own))
            bags = text_buckets(pa.array(chunks, pa.string()), known)
            cuts, buckets = bags.offsets.to_numpy(), bags.values.to_numpy()
            # A text has the words of its chunks.
            sizes, values, first = [], [np.zeros(0, np.int32)], 0
            for number in numbers:
                if number is not None:
                    own = cuts[first : first + number + 1]
                    sizes += [own[-1] - own[0], *np.diff(own)]
                    values += [buckets[own[0] : own[-1]]] * 2
                    first += number
                ends.append(ends[-1] + (0 if number is None else number + 1))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            for block in blocks(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values)))):
                found.append(_least(unit_rows(block, "bag", DIMENSIONS), matrix))
        values = np.concatenate(found)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, mask=np.isnan(values)))

    return distances


def in_parts(
    signatures: DataFrame, kind: str = "bag", dimensions: int = em.DIMENSIONS, rows_per_part: int | None = None
) -> DataFrame:
    """sig_id, features, part: signatures that are alike have the same part, of about ``rows_per_part`` rows."""
    rows_per_part = rows_per_part or PART_SIGNATURES
    number = min(MOST_PIVOTS, -(-signatures.count() // rows_per_part))
    if number <= 1:
        return signatures.select("sig_id", "features", F.lit(0).alias("part"))
    # Different signatures, drawn by a hash of their ids.
    drawn = signatures.orderBy(F.xxhash64("sig_id"), "sig_id").limit(number).select("features").toArrow()
    pivots = unit_rows(pa.concat_arrays(drawn["features"].chunks), kind, dimensions)
    shared = signatures.sparkSession.sparkContext.broadcast(pivots)

    @arrow_udf(T.IntegerType())
    def nearest_pivot(lists: pa.Array) -> pa.Array:
        found = [np.zeros(0, dtype=np.int32)]
        for block in blocks(lists):
            found.append((unit_rows(block, kind, dimensions) @ shared.value.T).argmax(axis=1).astype(np.int32))
        return pa.array(np.concatenate(found))

    placed = stored(signatures.withColumn("pivot", nearest_pivot("features")), "placed")
    counts = placed.groupBy("pivot").count().orderBy("pivot").collect()  # a row per pivot
    pieces = {row["pivot"]: -(-row["count"] // rows_per_part) for row in counts}
    first, table = 0, []
    for pivot, n in pieces.items():
        table.append((pivot, first, n))
        first += n
    dimension = signatures.sparkSession.createDataFrame(table, "pivot int, first int, pieces int")
    piece = F.pmod(F.xxhash64("sig_id"), F.col("pieces")).cast("int")
    return placed.join(F.broadcast(dimension), "pivot").select(
        "sig_id", "features", (F.col("first") + piece).alias("part")
    )


def bounds_of(parted: DataFrame, kind: str = "bag", dimensions: int = em.DIMENSIONS) -> DataFrame:
    """The bounds of each part; a group is one part."""

    def bound(group: pa.Table) -> pa.Table:
        matrix = unit_rows(pa.concat_arrays(group["features"].chunks), kind, dimensions)
        centre = matrix.sum(axis=0)
        norm = np.linalg.norm(centre)
        centre = centre / norm if norm else centre
        angles = np.arccos(np.clip(matrix @ centre, -1, 1))
        return pa.table(
            {
                "part": pa.array([group["part"][0].as_py()], pa.int32()),
                "n": pa.array([len(matrix)], pa.int64()),
                "low": [matrix.min(axis=0).tolist()],
                "high": [matrix.max(axis=0).tolist()],
                "centre": [centre.tolist()],
                "radius": pa.array([float(angles.max())], pa.float64()),
            }
        )

    return stored(parted.select("part", "features").groupBy("part").applyInArrow(bound, BOUNDS), "bounds")


@portable
def reachable(matrix: np.ndarray, bounds: tuple[np.ndarray, ...], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows by parts: the highest similarity a part can hold, and whether the row's nearest signature can be there.

    ``least`` is the similarity below which nothing counts.
    """
    low, high, centre, radius = bounds
    up, down = np.maximum(matrix, 0), np.minimum(matrix, 0)
    most = up @ high.T + down @ low.T
    sure = np.full(len(matrix), least)
    some = (matrix != 0).any(axis=1)  # without direction a row has the same distance to all
    if len(radius) and some.any():
        angle = np.arccos(np.clip(matrix[some] @ centre.T, -1, 1))
        most[some] = np.minimum(most[some], np.cos(np.maximum(angle - radius, 0)))
        # The nearest signature of a part is at least as near as its farthest, by either bound.
        far = np.cos(np.minimum(angle + radius, np.pi))
        inside = (up @ low.T + down @ high.T)[some]
        sure[some] = np.maximum(sure[some], np.maximum(far, inside).max(axis=1))
    return most, most >= sure[:, None] - SLACK


def with_parts(
    queries: DataFrame, bounds: DataFrame, kind: str, dimensions: int, limit: float | None = None
) -> DataFrame:
    """Add ``parts``, an array of (part, most): where a query's (``features``) nearest signature can be, the part
    that can hold the most similar one first."""
    size = bounds.count()
    if size * dimensions * 24 > BOUND_BYTES:
        every = F.array_sort(F.collect_list(F.struct("part", F.lit(1.0).alias("most"))))
        return queries.withColumn("parts", bounds.agg(every).scalar())
    table = bounds.orderBy("part").toArrow()
    columns = [
        np.array(table[name].to_pylist(), dtype=np.float64).reshape(size, -1) for name in ("low", "high", "centre")
    ]
    numbers = table["part"].to_numpy().astype(np.int32)
    shared = queries.sparkSession.sparkContext.broadcast((numbers, (*columns, table["radius"].to_numpy())))
    least = -2.0 if limit is None else 1.0 - limit

    @arrow_udf(T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("most", T.DoubleType())])))
    def find(lists: pa.Array) -> pa.Array:
        parts, known = shared.value
        sizes, found, values = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)], [np.zeros(0)]
        for block in blocks(lists):
            most, possible = reachable(unit_rows(block, kind, dimensions), known, least)
            row, column = np.nonzero(possible)
            order = np.lexsort((column, -most[row, column], row))
            sizes.append(possible.sum(axis=1))
            found.append(parts[column[order]])
            values.append(most[row, column][order])
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        entries = [pa.array(np.concatenate(found)), pa.array(np.concatenate(values))]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(entries, names=["part", "most"]))

    return queries.withColumn("parts", tx.pinned(find("features")))


def _search(sent: DataFrame, parted: DataFrame, per_bin: int, kind: str, dimensions: int, key: str) -> DataFrame:
    """key, pos, sig_id, distance: the nearest signature of each query in the ``parts`` it is sent to, once per bin.

    A bin is ``per_bin`` parts that follow each other: a query goes there once, whichever of them it needs.
    """
    bins = F.array_distinct(F.transform("parts", lambda p: F.floor(p / per_bin).cast("int")))
    binned = sent.withColumn("bin", F.explode(bins))
    # A bin that many queries need is searched in several shards.
    shards = F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("shards")
    needed = stored(binned.groupBy("bin").agg(shards), "shards")  # a row per bin
    shard = F.pmod(F.xxhash64(key, "pos"), F.col("shards")).cast("int")
    left = binned.join(F.broadcast(needed), "bin").withColumn("shard", shard).drop("shards")
    parts = sent.select(F.explode("parts").alias("part")).distinct()  # a row per part
    wanted = [row["part"] for row in parts.collect()]
    right = (
        parted.filter(F.col("part").isin(wanted))
        .withColumn("bin", F.floor(F.col("part") / per_bin).cast("int"))
        .join(F.broadcast(needed), "bin")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .drop("shards")
    )

    def search(group: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("sig_id")
        if not len(known) or not len(group):
            group = group.slice(0, 0)
        ids = np.array(known["sig_id"].to_pylist() + [None], dtype=object)
        part_of = known["part"].to_numpy()
        at, distance = [np.zeros(0, dtype=int)], [np.zeros(0)]
        if len(group):
            matrix = unit_rows(pa.concat_arrays(known["features"].chunks), kind, dimensions)
            features, lists = pa.concat_arrays(group["features"].chunks), pa.concat_arrays(group["parts"].chunks)
            for block, parts in zip(blocks(features), blocks(lists)):
                queries = unit_rows(block, kind, dimensions)
                row = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy(zero_copy_only=False))
                part = parts.flatten().to_numpy(zero_copy_only=False)
                best, nearest = np.full(len(block), len(ids) - 1), np.full(len(block), np.inf)
                for number in np.unique(part_of).tolist():
                    rows, members = row[part == number], np.flatnonzero(part_of == number)
                    if not len(rows):
                        continue
                    a, d = _best(queries[rows], matrix[members])
                    a = members[a]
                    # Signatures are sorted by id: the first one stays on ties.
                    nearer = (d < nearest[rows]) | ((d == nearest[rows]) & (a < best[rows]))
                    best[rows[nearer]], nearest[rows[nearer]] = a[nearer], d[nearer]
                at.append(best)
                distance.append(nearest)
        found = np.concatenate(distance)
        return pa.table(
            {
                key: group[key],
                "pos": group["pos"],
                "sig_id": pa.array(ids[np.concatenate(at)], pa.string()),
                "distance": pa.array(found, pa.float64(), mask=np.isinf(found)),
            }
        )

    schema = T.StructType(
        [T.StructField(key, sent.schema[key].dataType), T.StructField("pos", T.IntegerType()), *FOUND.fields]
    )
    found = left.groupBy("bin", "shard").cogroup(right.groupBy("bin", "shard")).applyInArrow(search, schema)
    return found.filter("distance is not null")


def search_parts(
    queries: DataFrame,
    parted: DataFrame,
    bounds: DataFrame,
    kind: str = "bag",
    dimensions: int = em.DIMENSIONS,
    key: str = "prompt_id",
    limit: float | None = None,
) -> tuple[DataFrame, list[DataFrame]]:
    """key, pos, best (distance, sig_id) of queries (key, pos, features), and what was sent to which part.

    The first round looks into one part of each query; what it finds is what the others have to reach. The other
    parts are found again in the second round: with how near they can be, they would take more room than the queries.
    """
    row = [key, "pos", "features"]
    per_bin = max(1, PART_SIGNATURES // max(1, bounds.agg(F.max("n")).first()[0] or 1))
    possible = with_parts(queries, bounds, kind, dimensions, limit)
    one = F.transform(F.slice("parts", 1, 1), lambda p: p["part"]).alias("parts")
    placed = stored(possible.select(*row, one, (F.size("parts") > 1).alias("more")), "queries")
    first = placed.filter(F.size("parts") > 0).select(*row, "parts")
    best = F.min(F.struct("distance", "sig_id")).alias("best")
    found = stored(_search(first, parted, per_bin, kind, dimensions, key).groupBy(key, "pos").agg(best), "first")
    reached = F.coalesce(1.0 - F.col("best.distance"), F.lit(-2.0)) - SLACK
    again = with_parts(placed.filter("more").drop("parts").join(found, [key, "pos"], "left"), bounds, kind, dimensions, limit)
    others = F.filter(F.slice("parts", F.lit(2), F.greatest(F.size("parts"), F.lit(1))), lambda p: p["most"] >= reached)
    rest = again.select(*row, F.transform(others, lambda p: p["part"]).alias("parts")).filter(F.size("parts") > 0)
    rest = stored(rest, "rest")
    more = _search(rest, parted, per_bin, kind, dimensions, key)
    both = found.select(key, "pos", "best.sig_id", "best.distance").unionByName(more)
    sent = [frame.select(*row, F.explode("parts").alias("part")) for frame in (first, rest)]
    return both.groupBy(key, "pos").agg(best), sent


def with_nearest_of_parts(
    frame: DataFrame,
    features: str,
    parted: DataFrame,
    bounds: DataFrame,
    kind: str = "bag",
    dimensions: int = em.DIMENSIONS,
    key: str = "prompt_id",
    out: str = "nearest",
    limit: float | None = None,
) -> DataFrame:
    """``with_nearest`` over signatures in parts. ``key`` tells the rows of the frame apart."""
    queries = frame.select(key, F.posexplode_outer(features).alias("pos", "features")).filter("pos is not null")
    found, _ = search_parts(queries, parted, bounds, kind, dimensions, key, limit)
    entry = F.struct("pos", F.struct("best.sig_id", "best.distance"))
    entries = found.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("entries"))
    nothing = F.lit(None).cast(FOUND)
    listed = F.transform(features, lambda _, i: F.coalesce(F.try_element_at("entries", i), nothing))
    return frame.join(entries, key, "left").withColumn(out, listed).drop("entries")


def compared(sent: list[DataFrame], bounds: DataFrame) -> int:
    """How many pairs are compared if queries are sent to parts so."""
    total = 0
    for queries in sent:
        met = queries.groupBy("part").agg(F.count("*").alias("queries")).join(bounds.select("part", "n"), "part")
        total += met.agg(F.sum(F.col("queries") * F.col("n"))).first()[0] or 0
    return total


class SignatureStore:
    """Signatures in parts, as a versioned table: a folder per part, and the parts' bounds beside it."""

    def __init__(self, spark, root: str, kind: str = "bag", dimensions: int = em.DIMENSIONS):
        self.kind, self.dimensions = kind, dimensions
        self.rows, self.bounds = Snapshots(spark, f"{root}/rows"), Snapshots(spark, f"{root}/bounds")

    def write(self, signatures: DataFrame, append: bool = False, rows_per_part: int | None = None) -> int:
        """Publish signatures (sig_id, features), alone or beside those there are; the version's number.

        An append puts the new ones in parts of their own. Rows are whole before bounds name them.
        """
        older = self.bounds.read() if append else None
        first = 0 if older is None else older.agg(F.max("part")).first()[0] + 1
        signatures = signatures.select(F.col("sig_id").cast("string").alias("sig_id"), "features")
        parted = in_parts(signatures, self.kind, self.dimensions, rows_per_part)
        parted = stored(parted.withColumn("part", F.col("part") + first), "parts")
        version = self.rows.write(parted, ("part",), append)
        bounds = bounds_of(parted, self.kind, self.dimensions)
        return self.bounds.write(bounds, append=append, notes={"rows": version})

    def read(self) -> tuple[DataFrame, DataFrame] | None:
        """Parts and bounds of the latest version, which stays as it is whatever is published later."""
        latest = self.bounds.manifest()
        if latest is None:
            return None
        return self.rows.read(latest["notes"][-1]["rows"]), self.bounds.read(latest["version"])

    def with_nearest(
        self,
        frame: DataFrame,
        features: str,
        key: str = "prompt_id",
        out: str = "nearest",
        limit: float | None = None,
    ) -> DataFrame:
        found = self.read()
        if found is None:
            raise ValueError("nothing has been published")
        return with_nearest_of_parts(frame, features, *found, self.kind, self.dimensions, key, out, limit)


def encode_signatures(
    signatures: DataFrame, encoder: em.WordBuckets | em.BatchEncoder | None = None
) -> DataFrame:
    """sig_id, features: as they are if they have been encoded, else from the texts."""
    if "features" in signatures.columns:
        return signatures.select("sig_id", "features")
    texts = signatures.select("sig_id", F.array("text").alias("texts_"))
    coded = (encoder or em.WordBuckets()).encode(texts, "texts_", "coded_")
    return coded.select("sig_id", F.get("coded_", F.lit(0)).alias("features"))


def add_similarity(
    prompts: DataFrame,
    signatures: DataFrame | SignatureStore,
    whole_limit: float = fv.WHOLE_PROMPT_DISTANCE,
    sentence_limit: float = fv.SENTENCE_DISTANCE,
    encoder: em.WordBuckets | em.BatchEncoder | None = None,
    broadcast: bool | None = None,
) -> DataFrame:
    """Add similarity_score and similarity_details: the whole prompt, then its sentences in order.

    ``signatures``: sig_id, text, or sig_id, features of a stored index, or a store. A sentence counts below its
    own limit; the score is one minus the least distance that counted, 0 if none did.
    """
    encoder = encoder or em.WordBuckets()
    queried = prompts.withColumn("sentences_", tx.sentence_chunks(F.col("prompt")))
    known = few_buckets(signatures, encoder, broadcast)
    if known is not None:
        found = queried.withColumn("distances_", tx.pinned(text_distances(known)(F.col("prompt"))))
    else:
        pieces = queried.withColumn("pieces_", F.concat(F.array("prompt"), "sentences_"))
        coded, limit = encoder.encode(pieces, "pieces_", "bags_"), max(whole_limit, sentence_limit)
        if isinstance(signatures, SignatureStore):
            found = signatures.with_nearest(coded, "bags_", out="nearest_", limit=limit)
        else:
            known = encode_signatures(signatures, encoder)
            found = with_nearest(
                coded, "bags_", known, encoder.kind, encoder.dimensions, out="nearest_", broadcast=broadcast, limit=limit
            )
        found = found.withColumn("distances_", tx.pinned(F.transform("nearest_", lambda hit: hit["distance"])))

    counts = _counts(whole_limit, sentence_limit)
    named = F.transform(
        "distances_",
        lambda distance, i: F.when(
            counts(distance, i),
            F.struct(
                F.when(i == 0, F.lit("ENTIRE PROMPT"))
                .otherwise(F.get(F.col("sentences_"), i - 1))
                .alias("text"),
                distance.alias("distance"),
                (1.0 - distance).alias("score"),
            ),
        ),
    )
    return (
        found.withColumn("similarity_details", F.array_compact(named))
        .withColumn("similarity_score", score_of_distances(F.col("distances_"), whole_limit, sentence_limit))
        .drop("sentences_", "pieces_", "bags_", "nearest_", "distances_")
    )


def _counts(whole_limit: float, sentence_limit: float) -> Callable[[Column, Column], Column]:
    """Whether the distance at a place counts: the whole prompt's is the first."""
    return lambda distance, i: distance < F.when(i == 0, whole_limit).otherwise(sentence_limit)


def score_of_distances(
    distances: Column, whole_limit: float = fv.WHOLE_PROMPT_DISTANCE, sentence_limit: float = fv.SENTENCE_DISTANCE
) -> Column:
    """The similarity score of what ``text_distances`` finds."""
    return similarity_score(F.array_min(F.filter(distances, _counts(whole_limit, sentence_limit))))


def few_buckets(
    signatures: DataFrame | SignatureStore,
    encoder: em.WordBuckets | em.BatchEncoder | None = None,
    broadcast: bool | None = None,
) -> DataFrame | None:
    """sig_id, features of signatures that are compared with words where the text is, if they are few by measure."""
    encoder = encoder or em.WordBuckets()
    if type(encoder) is not em.WordBuckets or broadcast is False:
        return None
    if isinstance(signatures, SignatureStore):
        found = signatures.read() if signatures.kind == "bag" else None
        known = found and found[0].select("sig_id", "features")
    else:
        known = encode_signatures(signatures, encoder)
    return known if known is not None and (broadcast or matrix_fits(known, em.DIMENSIONS)) else None


def similarity_score(distance: Column) -> Column:
    """Score of the least distance that counted; null, no distance, is 0."""
    # greatest and least skip nulls, so a missing distance has to be told apart first.
    return F.when(distance.isNull(), 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - distance))
    )
