"""Mix sources to target weights by repeating documents.

A source's repetition rate is its target over its size in words. Each document
is taken ``floor(rate)`` times, and once more if its hash-seeded draw falls
below the rate's fraction. The draw is one of 4096 equal slots. The acceptance
threshold is the number of slots whose words come nearest to the fraction of the
source, so the realised words follow the target even where a source holds a few
documents of very different length; a slot is as likely as any other, so each
document's chance is the fraction.

Everything is counted before it is shuffled: at most 4096 rows for each source
and task. Documents themselves are never shuffled, they meet a table of one row
for each source.

Defined cases: NULL or empty text has size 0. NULL is a source of its own, the
last. A source without words has target 0 and nothing is taken from it. Repeated
rows share their draw. Extra columns, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderboard.llm.tables import WORD, stored, whole_row

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A slot from 0 to 4095 that depends on the document and the seed alone."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), doc_id.cast("string"), text).cast("binary"))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """Add ``target`` to one row (source, source_size) for each source.

    A source stops at ``max_repeat`` times its size and the rest is shared by
    weight. In order of size over weight the stopped sources come first, so one
    running sum finds them: a source is stopped if, with all before it stopped,
    its share still exceeds its limit. The windows see one row for each source.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighted = sizes.select(
        "source",
        "source_size",
        F.element_at(cycle, F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights))) + 1)
        .cast("long")
        .alias("weight"),
    )
    limit = F.col("source_size") * max_repeat
    everything = Window.partitionBy()
    in_turn = Window.orderBy(
        (F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = weighted.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        (F.sum("weight").over(everything) - F.sum("weight").over(in_turn) + F.col("weight")).alias("open_weight"),
        (F.sum(limit).over(in_turn) - limit).alias("stopped_before"),
    )
    above = limit * F.col("open_weight") < F.col("weight") * (F.col("total") - F.col("stopped_before"))
    marked = ranked.withColumn("stopped", F.min(above.cast("int")).over(in_turn) == 1)
    stopped_sum = F.sum(F.when(F.col("stopped"), limit).otherwise(0)).over(everything)
    open_sum = F.sum(F.when(F.col("stopped"), 0).otherwise(F.col("weight"))).over(everything)
    share = (F.col("weight") * (F.col("total") - stopped_sum)).cast("double") / open_sum.cast("double")
    return marked.select(
        "source",
        "source_size",
        F.when(F.col("stopped"), limit.cast("double")).otherwise(share).alias("target"),
    )


def mixing_plan(sized: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """One row for each source: source_size, target, full copies and accepted slots.

    ``sized`` has source, size and slot of every document.
    """
    slots = stored(sized.groupBy("source", "slot").agg(F.sum("size").alias("words")), "mix-slots")
    rates = targets(
        slots.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeat
    ).select(
        "*",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0)
        .alias("full"),
    ).withColumn("need", F.col("target") - (F.col("full") * F.col("source_size")).cast("double"))
    upwards = Window.partitionBy("source").orderBy("slot")
    reached = slots.select(
        F.col("source").alias("of"),
        "slot",
        F.sum("words").over(upwards).alias("reached"),
    )
    choice = rates.join(reached, F.col("source").eqNullSafe(F.col("of")))
    near = F.struct(F.abs(F.col("reached") - F.col("need")).alias("gap"), (F.col("slot") + 1).alias("accept"))
    none = F.struct(F.abs(F.col("need")).alias("gap"), F.lit(0).cast("long").alias("accept"))
    return choice.groupBy("source", "source_size", "target", "full", "need").agg(
        F.min(near).alias("best")
    ).select(
        "source",
        "source_size",
        "target",
        F.col("full").cast("long").alias("full"),
        F.least(none, F.col("best"))["accept"].alias("accept"),
    )


def with_copies(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    seed: str = SEED,
) -> DataFrame:
    """One row for each document: ``row`` (its columns), size, source_size, target, copies."""
    sized = docs.select(
        whole_row(docs).alias("row"),
        F.col("source").alias("source"),
        words(F.col("text")).alias("size"),
        draw(F.col("doc_id"), F.col("text"), seed).alias("slot"),
    )
    plan = stored(mixing_plan(sized.drop("row"), weights, max_repeat), "mix-plan")
    per_source = plan.withColumnRenamed("source", "of")
    return sized.join(per_source, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "row",
        "size",
        "source_size",
        "target",
        (F.col("full") + (F.col("slot") < F.col("accept")).cast("long")).alias("copies"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    seed: str = SEED,
) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, columns unchanged."""
    taken = with_copies(docs, weights, max_repeat, seed).filter(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
