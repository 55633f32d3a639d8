"""Problem 4: frequency of every distinct term over all records, with bounds for rare and common ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.repeats import by_repetition
from tessera.session import cut

RARE_BELOW = 3
COMMON_ABOVE = 0.05


def records(corpus: DataFrame, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """The valid tokens of one row per id. Rows whose id is unique stay where they are; of repeated ids (the only rows that are shuffled) the
    greatest token array counts, so that the result does not depend on row order. NULL ids, NULL or empty arrays and NULL or
    '' elements do not count; a record without a valid token is no record."""
    valid = F.filter(F.col(tokens_col), lambda t: t.isNotNull() & (t != ""))
    one, more = by_repetition(corpus.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens")), "id")
    one, more = (x.select("id", valid.alias("tokens")).where(F.size("tokens") > 0) for x in (one, more))
    return one.select("tokens").unionByName(more.groupBy("id").agg(F.max("tokens").alias("tokens")).select("tokens"))


def frequencies(
    corpus: DataFrame,
    rare_below: int = RARE_BELOW,
    common_above: float = COMMON_ABOVE,
    id_col: str = "id",
    tokens_col: str = "tokens",
) -> DataFrame:
    """term, occurrences, records, mark ('rare', 'common' or NULL) for every distinct term.

    Each record emits its tokens and, once each, its distinct terms; both are counted by hash on the map side, and only the counts
    are shuffled by term. So a term that a third of all records holds arrives as one row per map task. The number of records travels
    along as the count of a sentinel NULL term. An empty table gives no rows. A term that is both too rare and too common (tiny
    corpora) is marked 'rare'.
    """
    t = F.col("tokens")
    both = F.concat(t, F.array(F.lit(None).cast("string")), F.array_distinct(t))
    emitted = records(corpus, id_col, tokens_col).select(F.size("tokens").alias("_n"), F.posexplode(both).alias("_i", "term"))
    first = F.col("_i") >= F.col("_n")  # from here on the distinct terms
    stats = cut(emitted.groupBy("term").agg(F.count_if(~first).alias("occurrences"), F.count_if(first).alias("records")))
    total = stats.where(F.col("term").isNull()).select("records").first()
    n = total[0] if total else 0
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * n, "common")
    return stats.where(F.col("term").isNotNull()).select("term", "occurrences", "records", mark.alias("mark"))
