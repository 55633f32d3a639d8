"""Problem 2: cutting oversized texts at natural boundaries with one bounded-quantifier regular expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip
from tessera.operators.chunkers import fold
from tessera.session import spread

#: What a piece may end behind, from strong to weak: blank line, line end, sentence end, white space.
BOUNDARIES = (r"(?<=\n[ \t]{0,8}\r?\n)", r"(?<=\n)", r"(?<=[.!?;。！？])(?=\s)", r"(?<=\s)")


def pattern(limit: Column) -> Column:
    """The piece regex for a size limit: try each boundary strength over the later half of the limit, then over the whole of it, then hard cut.

    Each alternative is `.{half,limit}` or `.{1,limit}` that must end right behind its boundary (a bounded lookbehind), so no piece is ever longer
    than the limit.
    A text's remainder within the limit is taken whole by the first alternative.
    """
    most = limit.cast("string")
    least = F.greatest(F.lit(1), (limit / 2).cast("int")).cast("string")
    parts: list[Column] = [F.lit("(?s)(?:.{1,"), most, F.lit(r"}\z")]
    for at_least in (least, F.lit("1")):
        for behind in BOUNDARIES:
            parts += [F.lit("|.{"), at_least, F.lit(","), most, F.lit("}"), F.lit(behind)]
    parts += [F.lit("|.{1,"), most, F.lit("})")]
    return F.concat(*parts)


def overlapped(raw: Column, overlap: Column) -> Column:
    """Prefix each piece but the first with the `overlap` code points that precede it in the text (fewer where there are not so many).

    The pieces are folded with the end of the text so far, so that short pieces cost no more than long ones.
    """

    def step(acc: Column, piece: Column) -> Column:
        whole = F.concat(acc["tail"], piece)
        return F.struct(F.concat(acc["out"], F.array(whole)).alias("out"), F.right(whole, overlap).alias("tail"))

    return F.when(overlap > 0, fold(raw, {"tail": F.lit("")}, step, lambda acc: acc["out"])).otherwise(raw)


def split(items: DataFrame, key: list[str], size_col: str = "chunk_size", overlap_col: str = "chunk_overlap") -> DataFrame:
    """items(key..., text, chunk_size, chunk_overlap, ...) -> key..., the other columns, chunk_index, piece, start.

    piece carries its overlap in front. The pieces without overlap concatenate to the text exactly. NULL or empty texts and NULL or non-positive limits give no rows. Very long texts are cut in one
    linear pass; nothing leaves the JVM.
    """
    usable = items.where(F.col("text").isNotNull() & (F.col("text") != "") & (F.col(size_col) > 0))
    rest = [c for c in usable.columns if c not in {*key, "text", size_col, overlap_col}]
    over = F.greatest(F.coalesce(F.col(overlap_col), F.lit(0)), F.lit(0))
    cutup = usable.withColumn("_p", pattern(F.col(size_col))).withColumn("_raw", F.expr("regexp_extract_all(text, _p, 0)"))
    return cutup.select(*key, *rest, F.posexplode(overlapped(F.col("_raw"), over)).alias("chunk_index", "piece"))


def oversized(extractions: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """item_kind, item_id, directory, file_path, content_type, meta, text and limits of every item over its limit.

    Files count without the white space at both ends (chunk_size is their limit), chunks as they stand (chunk_size + chunk_overlap).
    NULL content types count as plain_text; types without a limit have no oversized items. limits is a fixed table (one row per
    content type), so broadcasting it is bounded. A repeated chunk id is one item: its longest text, ties by the text itself.
    """
    kind = lambda c: F.coalesce(F.col(c), F.lit("plain_text"))
    lim = limits.select(kind("content_type").alias("_type"), "chunk_size", F.coalesce("chunk_overlap", F.lit(0)).alias("chunk_overlap"))
    lim = F.broadcast(lim.groupBy("_type").agg(F.max("chunk_size").alias("chunk_size"), F.max("chunk_overlap").alias("chunk_overlap")))
    cols = ["directory", "file_path", "content_type", "meta"]
    files = (
        spread(extractions.select(F.lit("file").alias("item_kind"), F.col("file_id").cast("string").alias("item_id"), *cols, "text"))
        .join(lim, kind("content_type") == F.col("_type"))
        .where(F.length("text") > F.col("chunk_size"))
        .withColumn("text", strip(F.col("text")))
        .where(F.length("text") > F.col("chunk_size"))
    )
    big = (
        chunks.select(F.lit("chunk").alias("item_kind"), F.col("id").alias("item_id"), *cols, "text")
        .join(lim, kind("content_type") == F.col("_type"))
        .where(F.length("text") > F.col("chunk_size") + F.col("chunk_overlap"))
    )
    fields = [c for c in big.columns if c not in ("item_kind", "item_id", "text")]
    big = (
        big.groupBy("item_kind", "item_id")
        .agg(F.max_by(F.struct("text", *fields), F.struct(F.length("text"), "text", F.coalesce("directory", F.lit("")), F.coalesce("file_path", F.lit("")))).alias("_r"))
        .select("item_kind", "item_id", "_r.*")
    )
    return files.unionByName(big).drop("_type")


def split_oversized(extractions: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Ordered pieces of every oversized file and chunk, with the metadata of its origin (see `oversized` and `split`)."""
    return split(oversized(extractions, chunks, limits), ["item_kind", "item_id"])


def rebuilt(pieces: DataFrame, limits: DataFrame) -> DataFrame:
    """item_kind, item_id, n_chars, text_md5 of what the pieces of each item give without their overlaps; within: no piece exceeds its limit;
    lapped: every overlap repeats what stands before it; natural: no piece but the last ends inside a word unless it holds no white space."""
    kind = F.coalesce("content_type", F.lit("plain_text"))
    lim = limits.select(F.coalesce("content_type", F.lit("plain_text")).alias("_type"), "chunk_size", F.coalesce("chunk_overlap", F.lit(0)).alias("chunk_overlap"))
    rows = pieces.join(F.broadcast(lim.groupBy("_type").agg(F.max("chunk_size").alias("size"), F.max("chunk_overlap").alias("over"))), kind == F.col("_type"))
    item = rows.groupBy("item_kind", "item_id").agg(F.first("size").alias("size"), F.first("over").alias("over"), F.sort_array(F.collect_list(F.struct("chunk_index", "piece"))).alias("p"))
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("last"), F.lit(True).alias("within"), F.lit(True).alias("lapped"), F.lit(True).alias("natural"))

    def step(acc: Column, r: Column) -> Column:
        lap = F.least(F.col("over"), F.length(acc["text"]))
        raw = F.substring(r["piece"], lap + 1, F.length(r["piece"]))
        cut_well = (acc["last"] == "") | acc["last"].rlike(r"[\s.!?;。！？]\z") | ~acc["last"].rlike(r"\s")
        return F.struct(
            F.concat(acc["text"], raw).alias("text"), raw.alias("last"), (acc["within"] & (F.length(raw) <= F.col("size"))).alias("within"),
            (acc["lapped"] & (F.left(r["piece"], lap) == F.right(acc["text"], lap))).alias("lapped"), (acc["natural"] & cut_well).alias("natural"),
        )

    out = item.withColumn("r", F.aggregate("p", start, step))
    return out.select("item_kind", "item_id", F.length("r.text").cast("bigint").alias("n_chars"), F.md5("r.text").alias("text_md5"), "r.within", "r.lapped", "r.natural")
