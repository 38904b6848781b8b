"""Resampling documents towards a target corpus by the importance of their hashed n-grams.

Separators (all ASCII but letters and digits) collapse to single spaces, and one overlapped regex scan with boundary
lookarounds gives, at each word, the spans of the n-grams that start there; a longer span's CRC goes on from the
shorter one's. A CRC's remainder is the n-gram's bucket. Buckets are counted over all documents and over the target;
a bucket's gain is the log ratio of its two smoothed shares, in thousandths, and a document's weight the mean gain of
its n-grams. Draws add Gumbel noise, hashed from the identifier, to the weight, and the highest sums are drawn.

On Spark: every text is scanned once, and its buckets are written as 16-bit numbers. Counts are partial sums of
one row a bucket and task; the gains (one for each bucket) are the only table that tasks get as a whole. Scores are whole
numbers within some ten thousands of zero, so counts per score give each score's offset, the draw stops at a score, and
only rows above it are ranked, in one window a score. Noise spreads copies of one text over thousands of scores.

Nulls and empty texts have no n-grams and weight 0; a null identifier is hashed as an empty one and comes last among
ties. Repeated rows are drawn one by one. An empty table gives an empty table, and an empty target equal shares. Only the identifier
is taken along, so no other column can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import importable, materialize

SEPARATORS = regex.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spans_pattern(longest: int) -> regex.Pattern:
    """Matches at the start of each word; group ``longest`` is its word, and each group before it one word longer where there is one."""
    inner = rb"([^ ]+)"
    for _ in range(longest - 1):
        inner = rb"(" + inner + rb"(?: [^ ]+)?)"
    return regex.compile(rb"(?<![^ ])" + inner + rb"(?![^ ])")


def crcs_of(text: bytes, pattern: regex.Pattern, longest: int) -> tuple[int, list[int]]:
    """Number of words, and the CRC of every run of 1 to ``longest`` words."""
    line = SEPARATORS.sub(b" ", text.lower()).strip(b" ")  # bytes: lower() is for A to Z alone
    out, words = [], 0
    for found in pattern.finditer(line, overlapped=True):
        words += 1
        end, crc = found.end(longest), crc32(found[longest])
        out.append(crc)
        for group in range(longest - 1, 0, -1):
            start, end = end, found.end(group)
            if start == end:
                break
            crc = crc32(line[start:end], crc)
            out.append(crc)
    return words, out


def scan(batches: Iterator[pa.RecordBatch], buckets: int, longest: int) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n_words, n_features, buckets as 16-bit numbers), in pieces of some megabytes."""
    pattern = spans_pattern(longest)
    names = ["id", "n_words", "n_features", "buckets"]
    for batch in batches:
        ids, rows, held, first = batch.column(0), [], 0, 0
        for text in batch.column(1):
            words, crcs = crcs_of(text.as_py() or b"", pattern, longest)
            cells = (np.array(crcs, np.uint32) % np.uint32(buckets)).astype("<u2").tobytes()
            rows.append((words, len(crcs), cells))
            held += len(cells)
            if held > 1 << 22:
                yield _scanned(ids.slice(first, len(rows)), rows, names)
                first, rows, held = first + len(rows), [], 0
        yield _scanned(ids.slice(first, len(rows)), rows, names)


def _scanned(ids: pa.Array, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    words, features, cells = ([r[k] for r in rows] for k in range(3))
    return pa.RecordBatch.from_arrays([ids, pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(cells, pa.binary())], names=names)


def count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(buckets) to (bucket, n), one row for each bucket that the task met."""
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=buckets)
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])


def scanned(texts: DataFrame, id_col: str | None, text_col: str, buckets: int, longest: int) -> DataFrame:
    own = F.col(f"`{id_col}`") if id_col else F.lit(None).cast("bigint")
    rows = importable(texts).select(own.alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: scan(it, buckets, longest), f"id {kind}, n_words long, n_features long, buckets binary")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    found = rows.select("buckets").mapInArrow(lambda it: count(it, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains_of(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, for each bucket."""
    buckets, s, t = len(own), float(own.sum()), float(target.sum())
    pairs = zip(own.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + buckets) / ((a + 1.0) * (t + buckets)))) for a, b in pairs], np.int64)


def noise(key: object, seed: int) -> int:
    h = int(sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(batches: Iterator[pa.RecordBatch], gains: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    """(id, n_words, n_features, buckets) to (id, n_words, n_features, weight, score)."""
    for batch in batches:
        cells = (np.frombuffer(b, "<u2") for b in batch.column(3).to_pylist())
        weights = [int(gains[c].sum()) // len(c) if len(c) else 0 for c in cells]
        scores = [w + noise(key, seed) for w, key in zip(weights, batch.column(0).to_pylist())]
        columns = [*batch.columns[:3], pa.array(weights, pa.int64()), pa.array(scores, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_features", "weight", "score"])


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10_000, longest: int = 2,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """One row per document: ``id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``, which is null where it isn't drawn.

    ``percent`` of the documents with ``least_words`` words are drawn, without replacement. ``buckets`` is at most 65,536.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")
    features = materialize(scanned(docs, id_col, text_col, buckets, longest), "ngram-buckets")
    gains = gains_of(bucket_counts(features, buckets), bucket_counts(scanned(target, None, target_col, buckets, longest), buckets))
    kind = features.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_features long, weight long, score long"
    scored = materialize(features.mapInArrow(lambda it: score(it, gains, seed), schema), "resample-scores")

    able = F.col("n_words") >= least_words
    by_score = sorted(scored.filter(able).groupBy("score").count().collect(), reverse=True)  # whole numbers of bounded size, see above
    wanted, before, offsets = sum(r["count"] for r in by_score) * percent // 100, 0, []
    for r in by_score:
        if before >= wanted:
            break
        offsets.append((r["score"], before))
        before += r["count"]
    offsets = docs.sparkSession.createDataFrame(offsets, "score long, before long")
    same = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "weight", "n_features", "n_words")
    place = F.col("before") + F.row_number().over(same)
    last = F.lit(by_score[-1]["score"] + 1 if not before else min(r[0] for r in offsets.collect())) if by_score else F.lit(0)
    high = able & (F.col("score") >= last) & F.lit(wanted > 0)
    drawn = scored.filter(high).join(F.broadcast(offsets), "score").withColumn("rank", place)  # one row a score
    drawn = drawn.select(*scored.columns, F.when(F.col("rank") <= wanted, F.col("rank")).cast("bigint").alias("rank"))
    return drawn.unionByName(scored.filter(~high).withColumn("rank", F.lit(None).cast("bigint")))
