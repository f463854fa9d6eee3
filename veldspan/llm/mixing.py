"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time [0, 1], piecewise linear between
knots.  The integral of a schedule is the source's share of the mix; shares of the whole
corpus become word targets, limited to ``max_epochs`` times what the source has, with the
excess shared anew by weight.  The cumulative demand of a source up to time t is its
target times the normalised integral up to t; a document whose words start at offset c in
its source's seeded order is needed when the demand reaches c, so its training position is
the inverse of that curve at c / target.  Documents are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import group_key, materialise, running_before, seeded_unit, shuffle_width, word_count

SEED = "mix-2024"
MAX_EPOCHS = 3
#: Knots (time, weight) for the first, second and third source in code point order, then again.
#: Their integrals are 1, 2 and 3.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 1.5), (0.5, 3.0), (1.0, 4.5)),
)


def integral(knots) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def demand_segments(knots) -> list[tuple[float, ...]]:
    """(t0, t1, w0, slope, y0, y1) of each piece; y is the normalised integral."""
    whole, done, out = integral(knots), 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        out.append((t0, t1, w0, (w1 - w0) / (t1 - t0), done / whole, (done + area) / whole))
        done += area
    return out


def training_time(share: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """The time at which a share of a source's demand has been met: the inverse of its integral."""
    result = F.lit(None).cast("double")
    for index, knots in enumerate(schedules):
        whole = integral(knots)
        inverse = F.lit(1.0)
        for t0, _, w0, slope, y0, y1 in reversed(demand_segments(knots)):
            area = (share - F.lit(y0)) * F.lit(whole)
            at = F.lit(t0) + (area / F.lit(w0) if slope == 0 else (F.sqrt(F.lit(w0 * w0) + F.lit(2 * slope) * area) - F.lit(w0)) / F.lit(slope))
            inverse = F.when(share < F.lit(y1), at).otherwise(inverse)
        result = F.when(kind == index, inverse).otherwise(result)
    return result


def source_targets(sources: DataFrame, total: int, max_epochs: int = MAX_EPOCHS, schedules=SCHEDULES) -> DataFrame:
    """Adds kind (schedule number), weight and target to rows (_source, source_size).

    The excess of capped sources is shared anew until no target is above its cap.  Each
    round is one aggregate of the table of sources; only three numbers reach the driver.
    """
    spark = sources.sparkSession
    weights = [integral(k) for k in schedules]
    # Null ("0...") sorts before every text ("1..."), but comes last.
    order = (F.col("_source") == "0").cast("int")
    listed = sources.withColumn("_order", order).sort("_order", "_source").drop("_order").rdd.zipWithIndex()
    ranked = listed.map(lambda pair: (pair[0][0], pair[0][1], pair[1] % len(weights)))
    table = materialise(spark.createDataFrame(ranked, "_source string, source_size long, kind int"), "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("kind") + 1)
    table = table.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * max_epochs)
    level, before = -1.0, -2.0
    while level != before:
        capped = F.col("weight") * F.lit(level) >= F.col("_cap") if level >= 0 else F.lit(False)
        spent, open_weight = table.agg(
            F.coalesce(F.sum(F.when(capped, F.col("_cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))
        ).first()
        before, level = level, (total - spent) / open_weight if open_weight else level
    return table.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("weight") * F.lit(max(level, 0.0)))).drop("_cap")


def mix_plan(
    docs: DataFrame,
    seed: str = SEED,
    max_epochs: int = MAX_EPOCHS,
    schedules=SCHEDULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, position, and the columns of ``keep``.

    ``taken`` are the words the mix takes, repeats counted; the document at a source's
    target is cut there, so a source's taken words equal its target to the word.  ``copies``
    is the same in whole documents (a pass counts when its middle is before the target).
    ``position`` is the training time of the first pass, null if the mix never takes it.
    Null texts have no words; a null source is the last source; an empty table, and a
    corpus without words, give zero targets; other columns are ignored.
    """
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            word_count(F.col(text_col)).alias("size"),
            group_key(F.col(source_col)).alias("_source"),
            seeded_unit(seed, F.col(id_col)).alias("_unit"),
            *keep,
        ),
        "mix-rows",
    )
    sources = rows.groupBy("_source").agg(F.sum("size").alias("source_size"))
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = source_targets(sources, total, max_epochs, schedules)
    placed = running_before(rows, ["_source"], ["_unit", "doc_id", "size", *keep], F.col("size"), "_start", n).join(targets, "_source")
    budget = F.floor(F.col("target")).cast("long")
    starts = [F.col("_start") + F.col("source_size") * j for j in range(max_epochs)]
    taken = sum((F.least(F.col("size"), F.greatest(F.lit(0), budget - s)) for s in starts), F.lit(0))
    copies = sum((((s + F.col("size") / 2) < F.col("target")) & (F.col("size") > 0)).cast("int") for s in starts)
    share = F.try_divide(F.col("_start").cast("double"), F.col("target"))
    return placed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        copies.alias("copies"),
        F.when(taken > 0, F.round(training_time(share, F.col("kind"), schedules), 9)).alias("position"),
        *keep,
    )


def curriculum(plan: DataFrame) -> DataFrame:
    """The plan range-sorted by training position; documents that are not taken come last.

    Of equal positions the smaller id is first, null ids before all; repeated rows stay; an
    empty plan stays empty; all columns are kept.
    """
    width = shuffle_width(plan.sparkSession)
    keys = [F.col("position").asc_nulls_last(), F.col("doc_id").asc()]
    return plan.repartitionByRange(width, *keys).sortWithinPartitions(*keys)


def mix_documents(docs: DataFrame, seed: str = SEED, text_col: str = "text", position_col: str | None = None) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, in training order.

    Whole documents: a document is repeated ``copies`` times, in consecutive passes over its
    source; documents the mix does not take are left out.  All columns are kept.  Every row has the copies of its own
    plan: rows are numbered in a copy in the shared folder, so rows alike in id or in everything are told apart; a null id
    goes by its text.  Documents without words are left out; an empty table gives an empty table.  ``position_col`` adds the
    training time of each copy, by which ``assign_shards`` can keep the order.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.md5(F.col(text_col))), F.lit("~"))
    numbered = materialise(docs.withColumns({"_mix_row": F.monotonically_increasing_id(), "_mix_key": key}), "mix-texts")
    plan = mix_plan(numbered, seed, id_col="_mix_key", text_col=text_col, keep=("_mix_row",))
    passes = plan.filter("copies > 0").select(
        "_mix_row", F.col("copies").alias("_copies"), F.col("position").alias("_position"), (F.col("source_size") / F.col("target")).alias("_pass")
    )
    # later passes come one pass length of the source's demand later
    placed = (
        numbered.join(passes.hint("merge"), "_mix_row")
        .withColumn("_n", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        .withColumn("_at", F.least(F.lit(1.0), F.col("_position") + F.col("_n") * F.col("_pass")))
    )
    order = ["_at", "_mix_key", "_mix_row"]
    placed = placed.repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order)
    return placed.select(*docs.columns, *([F.col("_at").alias(position_col)] if position_col else []))
