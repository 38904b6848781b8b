"""Similarity join of texts on word n-grams: MinHash bands propose, whole n-gram sets decide.

1. Equal texts become one class with a representative; only representatives go on.
2. Each gets a MinHash signature in bands. The numbers of bands and of rows a band are chosen from the threshold and the
   recall wanted at it. Texts that meet in a band bucket are linked to the bucket's least text, so a bucket of any size gives as
   many rows as it has texts, and the components of these links are the candidate groups.
3. A group is cut into blocks; every pair of blocks is one small group of rows in which all pairs of texts are compared on their
   whole n-gram sets. Only the number of links of each text and a spanning forest of its links leave the task.
4. The components of the links are the near-duplicate classes.

Texts are equal or not as they are; words are runs without the blanks U+0020 and U+0009 to U+000D. A text with fewer words than an
n-gram has one n-gram of all of them; texts without words (null or blank) are similar to equal texts only. Null
identifiers come last when a representative is chosen; classes of rows without any identifier have a null ``class_id``.
Repeated rows are copies. An empty table gives an empty table. Extra columns are never read here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import importable, materialize
from fleetpulse.llm.components import connected_components
from fleetpulse.llm.exact_dedup import located
from fleetpulse.llm.shingles import BandHasher, Shingler, bands_for

#: Texts and characters that a block of a candidate group should hold.
BLOCK_TEXTS = 100
BLOCK_CHARS = 4_000_000
#: n-grams whose signatures are made at once.
NGRAMS_AT_ONCE = 1 << 15


def signatures(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(digest, place, text) to (digest, place, chars, bands); no bands for a text without words."""
    shingler, hasher = Shingler(words), BandHasher(bands, rows)
    for batch in batches:
        texts = batch.column(3).to_pylist()
        out: list[list[int] | None] = [None] * len(texts)
        some, size = [], 0

        def flush(some, out=out):
            if some:
                for (k, _), row in zip(some, hasher.of([s for _, s in some])):
                    out[k] = row.tolist()

        for k, text in enumerate(texts):
            grams = shingler.all(text)
            if len(grams):
                some.append((k, grams))
                size += len(grams)
            if size > NGRAMS_AT_ONCE:
                flush(some)
                some, size = [], 0
        flush(some)
        chars = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], chars, pa.array(out, pa.list_(pa.int64()))], names=["digest", "id", "place", "chars", "bands"]
        )


def compare(texts: list[str], sides: np.ndarray, across: bool, threshold: float, shingler: Shingler) -> np.ndarray:
    """Links between texts of different sides (or between all, unless ``across``) as a symmetric matrix."""
    if across and sides.min() == sides.max():  # the other block is empty
        return np.zeros((len(texts), len(texts)), bool)
    sets = [shingler.set(t) for t in texts]
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # n-grams of one text only can't be common
    held = times[column] > 1
    column, owner = shared[column[held]], owner[held]
    table = np.zeros((int(shared[-1]) + 1 if len(shared) else 0, len(sets)), np.uint8)
    table[column, owner] = 1
    ends = np.searchsorted(owner, np.arange(len(sets) + 1))
    common = np.array([table[column[ends[k] : ends[k + 1]]].sum(axis=0, dtype=np.int64) for k in range(len(sets))])
    links = common / (n[:, None] + n[None, :] - common) >= threshold
    np.fill_diagonal(links, False)
    if across:
        links &= sides[:, None] != sides[None, :]
    return links


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest."""
    new, out = np.ones(len(links), bool), []
    for start in range(len(links)):
        if not new[start]:
            continue
        new[start] = False
        queue = [start]
        while queue:
            k = queue.pop()
            found = np.flatnonzero(links[k] & new)
            new[found] = False
            out += [(k, j) for j in found.tolist()]
            queue += found.tolist()
    return out


def verify(batches: Iterator[pa.RecordBatch], words: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group to (a, null, links, copies linked) for each linked text and (a, b, 0, 0) for a spanning forest."""
    shingler = Shingler(words)

    def done(group: list[dict]) -> pa.RecordBatch:
        across = group[0]["low"] != group[0]["high"]
        links = compare([r["text"] for r in group], np.array([r["side"] for r in group]), across, threshold, shingler)
        ids, copies = [r["tid"] for r in group], np.array([r["copies"] for r in group])
        number, linked = links.sum(axis=1).tolist(), (links @ copies).tolist()
        rows = [(ids[k], None, number[k], linked[k]) for k in range(len(ids)) if number[k]]
        rows += [(ids[i], ids[j], 0, 0) for i, j in forest(links)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["a", "b", "links", "copies"])

    key, group = None, []
    for batch in batches:
        for row in batch.to_pylist():
            at = (row["root"], row["low"], row["high"])
            if at != key and group:
                yield done(group)
                group = []
            key = at
            group.append(row)
    if group:
        yield done(group)


def jaccard_classes(
    docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.9999, hashes: int = 200, id_col: str = "doc_id", text_col: str = "text",
    place_col: str | None = None,
) -> DataFrame:
    """One row per input row: ``place``, ``id``, ``class_id`` (least identifier of its near-duplicate class), ``text_id`` (least
    identifier with the same text), ``n_text_links`` (other texts linked), ``n_links`` (other rows linked, copies included), ``kept``
    (one row of each class). ``place_col`` names the places of rows that are located already.
    """
    bands, rows = bands_for(threshold, recall, hashes)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs, place = (importable(docs), place_col) if place_col else located(importable(docs))
    every = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{place}`").alias("place"), text.alias("text"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "place")

    marked = every.mapInArrow(
        lambda it: signatures(it, words, bands, rows), every.drop("text").selectExpr("*", "0L AS chars", "CAST(NULL AS ARRAY<BIGINT>) AS bands").schema
    )
    classes = marked.groupBy("digest").agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("chars").alias("chars"), F.max("bands").alias("bands")
    )
    classes = materialize(classes.withColumn("tid", F.monotonically_increasing_id()), "classes")

    met = classes.select("tid", F.explode("bands").alias("bucket"))
    buckets = materialize(met.groupBy("bucket").agg(F.min("tid").alias("root"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "buckets")
    near = met.join(buckets, "bucket").filter("tid <> root").select(F.col("tid").alias("a"), F.col("root").alias("b"))
    groups = connected_components(near)
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())

    members = materialize(
        groups.join(classes, groups.node == classes.tid).select("root", "tid", "copies", "chars", F.col("first.place").alias("place")), "members"
    )
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("all_chars"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("all_chars") / BLOCK_CHARS)).cast("int")
    sizes = materialize(sizes.select("root", blocks.alias("blocks")), "group-sizes")
    dealt = members.join(sizes, "root").withColumn("side", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
    dealt = materialize(dealt.select("place", "root", "tid", "copies", "side", "blocks"), "dealt")
    texts = every.select("place", "text").join(dealt.hint("shuffle_hash"), "place")
    pairs = texts.select(
        "root", "tid", "copies", "side", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("root", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "tid", "copies", "side", "text")
    sorted_groups = pairs.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    found = materialize(sorted_groups.mapInArrow(lambda it: verify(it, words, threshold), "a long, b long, links long, copies long"), "links")

    counts = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"), F.sum("copies").alias("linked"))
    linked = connected_components(found.filter("b is not null").select("a", "b"))
    linked = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    own = classes.select("digest", "tid", "first", "copies").join(linked.withColumnRenamed("node", "tid"), "tid", "left")
    own = own.join(counts.withColumnRenamed("a", "tid"), "tid", "left")
    own = materialize(own.withColumn("root", F.coalesce("root", "tid")), "own")
    heads = materialize(own.groupBy("root").agg(F.min("first").alias("head")), "heads")
    own = own.join(heads, "root").select(
        "digest", F.col("head.id").alias("class_id"), F.col("first.id").alias("text_id"), F.col("head.place").alias("head"),
        F.coalesce("links", F.lit(0)).alias("n_text_links"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
    )
    own = materialize(own, "by-text")
    return every.select("digest", "id", "place").join(own, "digest").select(
        "place", "id", "class_id", "text_id", "n_text_links", "n_links", (F.col("place") == F.col("head")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, **settings) -> DataFrame:
    """One row of each class, with the columns it came with."""
    rows, place = located(docs)
    dropped = jaccard_classes(rows, **settings, place_col=place).filter("not kept").select(F.col("place").alias(place))
    return rows.join(dropped, place, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
