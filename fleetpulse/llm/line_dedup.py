"""Line duplicates: lines that many documents hold stay in one of them only; decisions travel as bitmaps, not as text.

Hashes of the long lines are range-partitioned and sorted by document and position. A stream over each range meets the rows of a
hash together, the largest document first, and gives one row for a document's first line with it. Their
numbers say which hashes are common and which document keeps them. All other lines with a common hash are dropped: for each
document 64 lines are one number, numbers without a dropped line are left out, and documents that keep all lines
have no bitmap at all. The bitmap meets the text once, where lines are filtered by position.

A hash that a third of all rows hold is split: ranges are cut by hash and slice, a slice being one of 256 by the document's hash, so that
documents are counted per slice first. Keys are compared by 128-bit hashes. Built-in functions do everything.

A line's key has the blanks U+0020 and U+0009 to U+000D cut off at both ends and A to Z in lower case. A null or empty text is one
empty line. Rows with equal identifiers are one document, null identifiers the smallest one; all rows of the document that
keeps a line keep all its lines. An empty table gives an empty table. Extra columns meet no internal ones: texts find their
bitmaps by file and row. Columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import let
from fleetpulse.llm.common import materialize
from fleetpulse.llm.exact_dedup import located

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICES = 256
ADDED = ("n_lines", "n_dropped", "kept_text")


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case; texts of ASCII alone take the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def spot_of(place: Column) -> Column:
    """24 bytes that name a row: hash of its file, and its number there."""
    return F.unhex(F.concat(F.md5(place["file"].cast("binary")), F.lpad(F.hex(place["row"]), 16, "0")))


def long_lines(rows: DataFrame, least_chars: int) -> DataFrame:
    """(id, spot, text) to one lean row for each line with a long key."""
    lines = rows.select("id", "spot", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    keys = lines.filter(F.length("line") >= least_chars).select("id", "spot", "at", F.trim("line", F.lit(BLANKS)).alias("key"))
    keys = keys.filter(F.length("key") >= least_chars)
    part = F.pmod(F.xxhash64("id"), F.lit(SLICES)).cast("int")
    return keys.select(F.unhex(F.md5(lower_ascii(F.col("key")).cast("binary"))).alias("hash"), part.alias("part"), "id", "spot", "at")


def common_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """(hash, part, last) of the hashes that enough documents hold, ``last`` being the document that keeps them."""
    along = Window.partitionBy("hash", "part").orderBy(F.col("id").desc_nulls_last(), "spot", "at")
    ranged = lines.repartitionByRange("hash", "part")
    firsts = ranged.withColumns({"nth": F.row_number().over(along), "before": F.lag("id").over(along)})
    firsts = firsts.filter((F.col("nth") == 1) | ~F.col("before").eqNullSafe(F.col("id")))
    heads = firsts.groupBy("hash", "part").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    whole = Window.partitionBy("hash")  # a row for each slice
    heads = heads.select("hash", "part", F.sum("n").over(whole).alias("n_docs"), F.max("last").over(whole).alias("last"))
    return heads.filter(F.col("n_docs") >= least_docs).select("hash", "part", "last")


def drop_bitmaps(lines: DataFrame, least_docs: int) -> DataFrame:
    """(spot, n_dropped, drops): numbers of 64 lines each with a bit set for every dropped line, in order, without zeros."""
    common = common_lines(lines, least_docs)
    dropped = lines.join(common, ["hash", "part"]).filter(~F.col("id").eqNullSafe(F.col("last")))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at") % 64)
    words = dropped.groupBy("spot", F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    listed = F.sort_array(F.collect_list(F.struct("word", "bits")))
    return words.groupBy("spot").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped"), listed.alias("drops"))


def keep_lines(text: Column, drops: Column) -> Column:
    """The text without the lines that the bitmap marks."""
    found = F.map_from_entries(drops)
    last = F.element_at(drops, -1)["word"]
    dense = let(found, lambda m: F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.element_at(m, w), F.lit(0).cast("bigint"))))

    def stays(bits: Column, at: Column) -> Column:
        word = F.coalesce(F.get(bits, F.floor(at / 64).cast("int")), F.lit(0).cast("bigint"))
        return F.call_function("shiftrightunsigned", word, at % 64).bitwiseAND(F.lit(1)) == 0

    return let(dense, lambda bits: F.array_join(F.filter(F.split(text, "\n"), lambda _, at: stays(bits, at)), "\n"))


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row without its text, with ``n_lines`` (before), ``n_dropped`` and ``kept_text``."""
    own = [c for c in docs.columns if c != text_col and c not in ADDED]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    rows, place = located(docs)
    spot = spot_of(F.col(place)).alias("spot")
    lines = materialize(long_lines(rows.select(F.col(f"`{id_col}`").alias("id"), spot, text), least_chars), "line-hashes")
    bitmaps = materialize(drop_bitmaps(lines, least_docs), "line-bitmaps")
    rows = rows.select(*[F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(own)], spot, text)
    met = rows.join(bitmaps.hint("shuffle_hash"), "spot", "left")
    return met.select(
        *[F.col(f"own_{k}").alias(c) for k, c in enumerate(own)],
        F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(keep_lines(F.col("text"), F.col("drops"))).alias("kept_text"),
    )
