"""Problem 8: mixing sources to target weights by distributed pivotal rounding.

Each mixture wants ``corpus_fraction`` of the tokens of all documents, split over its sources by weight. A source that
can't fill its part even with ``max_repeats`` copies of every document is filled to that cap and what is missing goes
to the other sources in proportion to their weights, so the wanted size is met as long as any source has room. Every
document of a source then wants the same number of copies, an integer and a fraction. The fractions are rounded by the
pivotal method: two undecided documents of a source at a time exchange mass at random, each keeping its expectation,
until one of them is 0 or 1. Tasks do this over documents sorted by size (partners are of like size, so the tokens hardly
vary), at most one document of each source stays undecided in a task, and those residuals are combined up a
reduction tree of fewer and fewer tasks.

Defined results: documents without tokens (null, empty) are never drawn; a source unknown to ``documents`` has no
tokens and its part goes to the others; weights that are null, negative or zero count as 0; ``max_repeats`` null counts
as 1; a mixture whose sources hold nothing gives no document; repeated target rows of a source count once (the first by
weight, repeats); repeated ``doc_id`` rows count once; an empty table gives an empty mixture.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.encode import count_tokens, read_splits
from weftline.runtime import cut, parallelism, small_side

#: Residuals of this many tasks are combined by one task of the next level.
FAN_IN = 8
_EPS = 1e-12


def allot(weights: np.ndarray, room: np.ndarray, total: float) -> np.ndarray:
    """Split ``total`` by weight without going above any source's ``room``; what a full source leaves goes to the rest."""
    given = np.zeros(len(weights))
    open_ = (weights > 0) & (room > 0)
    left = float(total)
    while left > 1e-9 and open_.any():
        part = left * weights * open_ / weights[open_].sum()
        full = open_ & (given + part >= room - 1e-9)
        if not full.any():
            return given + part
        left -= float((room - given)[full].sum())
        given[full] = room[full]
        open_ &= ~full
    return given


def plan_mixture(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per mixture and source: tokens wanted and the copies each of its documents wants.

    ``counts`` has ``source`` and ``n_tokens`` of every document. Only sums by source travel; the plan of a mixture is
    made by one task from as many rows as it has sources.
    """
    have = counts.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count_if(F.col("n_tokens") > 0).alias("source_docs"))
    corpus = counts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("corpus_tokens"))
    first = Window.partitionBy("mixture_key", "source").orderBy(F.desc_nulls_last("target_weight"), F.desc_nulls_last("max_repeats"))
    want = (
        targets.select("mixture_key", "source", F.col("target_weight").cast("double"), F.col("max_repeats").cast("long"), F.col("corpus_fraction").cast("double"))
        .filter("mixture_key is not null and source is not null")
        .withColumn("_nth", F.row_number().over(first))
        .filter("_nth = 1")
        .drop("_nth")
    )
    rows = want.join(have, "source", "left").crossJoin(F.broadcast(corpus)).na.fill(0, ["source_tokens", "source_docs"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", ignore_index=True)
        weight = np.nan_to_num(pdf["target_weight"].to_numpy(float)).clip(0)
        cap = np.where(pdf["max_repeats"].isna(), 1, pdf["max_repeats"].fillna(1)).astype(float).clip(0)
        tokens = pdf["source_tokens"].to_numpy(float)
        size = float(np.nan_to_num(pdf["corpus_fraction"].to_numpy(float)).max()) * float(pdf["corpus_tokens"].iloc[0])
        given = allot(weight, tokens * cap, size)
        share = weight / weight.sum() if weight.sum() else weight
        return pd.DataFrame(
            {
                "mixture_key": pdf["mixture_key"], "source": pdf["source"], "target_share": share, "wanted_tokens": share * size, "planned_tokens": given,
                "source_tokens": pdf["source_tokens"].astype("int64"), "source_docs": pdf["source_docs"].astype("int64"), "max_repeats": cap.astype("int64"),
                "copies_wanted": np.divide(given, tokens, out=np.zeros(len(given)), where=tokens > 0),
            }
        )

    schema = "mixture_key string, source string, target_share double, wanted_tokens double, planned_tokens double, source_tokens bigint, source_docs bigint, max_repeats bigint, copies_wanted double"
    return rows.groupBy("mixture_key").applyInPandas(one, schema)


def pivot_pass(p: np.ndarray, luck: np.ndarray) -> np.ndarray:
    """The pivotal method over the documents of one group in their order: all but one of ``p`` become 0 or 1.

    ``luck`` holds a uniform number for each document. The sum of ``p`` and each document's expectation stay as they are.
    """
    out = p.tolist()
    keeper = -1
    for k, u in enumerate(luck.tolist()):
        b = out[k]
        if b <= _EPS or b >= 1 - _EPS:
            out[k] = 0.0 if b <= _EPS else 1.0
            continue
        if keeper < 0:
            keeper = k
            continue
        a = out[keeper]
        s = a + b
        if s < 1 - _EPS:
            if u * s < a:
                out[keeper], out[k] = s, 0.0
            else:
                out[keeper], out[k] = 0.0, s
                keeper = k
        elif s <= 1 + _EPS:
            if u < a:
                out[keeper], out[k] = 1.0, 0.0
            else:
                out[keeper], out[k] = 0.0, 1.0
            keeper = -1
        elif u * (2 - s) < 1 - b:
            out[keeper], out[k] = 1.0, s - 1
            keeper = k
        else:
            out[keeper], out[k] = s - 1, 1.0
    return np.array(out)


def _round_partitions(df: DataFrame, seed: int, last: bool) -> DataFrame:
    def run(frames):
        # a task's rows of one group may span Arrow batches: the undecided document of the last group is carried on
        carry: pd.DataFrame | None = None
        for pdf in frames:
            if carry is not None:
                pdf = pd.concat([carry, pdf], ignore_index=True)
                carry = None
            if not len(pdf):
                continue
            p = pdf["p"].to_numpy(float).copy()
            group = pdf["plan_no"].to_numpy()
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            ends = np.r_[starts[1:], len(pdf)]
            luck = pdf["luck"].to_numpy(float)
            for lo, hi in zip(starts, ends, strict=True):
                p[lo:hi] = pivot_pass(p[lo:hi], luck[lo:hi])
            pdf = pdf.assign(p=p)
            open_ = (p > _EPS) & (p < 1 - _EPS)
            tail = np.zeros(len(pdf), bool)
            tail[starts[-1] :] = True
            carry = pdf[open_ & tail]
            yield pdf[~(open_ & tail)]
        if carry is not None and len(carry):
            yield carry

    out = df.mapInPandas(run, df.schema)
    if last:  # one undecided document of a group is left at most: it is drawn with its own probability
        out = out.withColumn("p", F.when((F.col("p") > _EPS) & (F.col("p") < 1 - _EPS), (_luck(seed, -1) < F.col("p")).cast("double")).otherwise(F.col("p")))
    return out


def _luck(seed: int, level: int):
    """A uniform number of a document, mixture and level; the same in every run and attempt."""
    return (F.pmod(F.xxhash64(F.col("doc_id"), F.col("plan_no"), F.lit(seed), F.lit(level)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def pivotal_round(df: DataFrame, seed: int = 17) -> DataFrame:
    """Round ``p`` of rows (``plan_no``, ``doc_id``, ``n_tokens``, ``p``) to 0 or 1 within each ``plan_no``.

    Level 0 spreads the documents of every group over all tasks by their hash, so a group that holds most rows is no
    larger in any task than the others' share; later levels see one row per group and task of the level before.
    """
    width = max(parallelism(df.sparkSession), 1)
    pending = df.select("plan_no", "doc_id", "n_tokens", "p")
    decided: DataFrame | None = None
    level = 0
    while True:
        last = width == 1
        part = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(width)).cast("int")
        laid = pending.withColumn("luck", _luck(seed, level)).withColumn("_part", part).repartition(width, "_part").drop("_part")
        laid = laid.sortWithinPartitions("plan_no", "n_tokens", "luck", "doc_id")
        done = cut(_round_partitions(laid, seed, last).drop("luck"))
        settled = done if last else done.filter((F.col("p") <= _EPS) | (F.col("p") >= 1 - _EPS))
        decided = settled if decided is None else decided.unionByName(settled)
        if last:
            return decided
        pending = done.filter((F.col("p") > _EPS) & (F.col("p") < 1 - _EPS))
        width, level = max(1, width // FAN_IN), level + 1


def mix(documents: DataFrame, targets: DataFrame, seed: int = 17, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The drawn documents (``mixture_key``, ``source``, ``doc_id``, ``n_tokens``, ``copies``) and the plan of each mixture.

    ``documents`` has ``doc_id``, ``source`` and ``text``. Tokens are counted once and kept in the shared folder.
    """
    counted = count_tokens(read_splits(documents.select("doc_id", "source", "text")), path=path)
    counts = cut(counted.groupBy("doc_id").agg(F.min_by("source", F.struct("n_tokens", "source")).alias("source"), F.min("n_tokens").alias("n_tokens")))
    plan = cut(plan_mixture(counts, targets))
    numbered = plan.filter("copies_wanted > 0").withColumn("plan_no", F.xxhash64("mixture_key", "source"))
    wanted = counts.filter("n_tokens > 0").join(small_side(numbered.select("mixture_key", "source", "plan_no", "copies_wanted")), "source")
    wanted = wanted.withColumn("whole", F.floor(F.col("copies_wanted") + F.lit(1e-9))).withColumn("p", F.greatest(F.col("copies_wanted") - F.col("whole"), F.lit(0.0)))
    drawn = pivotal_round(wanted.select("plan_no", "doc_id", "n_tokens", "p"), seed).withColumnRenamed("p", "extra")
    names = small_side(numbered.select("plan_no", "mixture_key", "source", F.floor(F.col("copies_wanted") + F.lit(1e-9)).alias("whole")))
    rows = drawn.join(names, "plan_no").withColumn("copies", (F.col("whole") + F.round("extra")).cast("int")).filter("copies > 0")
    return rows.select("mixture_key", "source", "doc_id", "n_tokens", "copies"), plan


def shares(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The report: target, planned and actual share of every source of every mixture."""
    got = rows.groupBy("mixture_key", "source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.sum("copies").cast("long").alias("copies"), F.count(F.lit(1)).alias("docs"), F.max("copies").alias("most_copies")
    )
    whole = Window.partitionBy("mixture_key")
    return (
        plan.join(got, ["mixture_key", "source"], "left")
        .na.fill(0, ["actual_tokens", "copies", "docs", "most_copies"])
        .withColumn("actual_share", F.try_divide(F.col("actual_tokens"), F.sum("actual_tokens").over(whole)))
        .withColumn("capped", (F.col("wanted_tokens") > 0) & (F.col("planned_tokens") < F.col("wanted_tokens") - 0.5))
        .select(
            "mixture_key", "source", "target_share", F.coalesce("actual_share", F.lit(0.0)).alias("actual_share"), F.round("planned_tokens").cast("long").alias("planned_tokens"),
            F.col("actual_tokens").cast("long").alias("actual_tokens"), "source_tokens", "source_docs", "docs", "copies", "most_copies", "max_repeats", "capped",
        )
    )


def p8_mixture(spark, sf_dir: str) -> DataFrame:
    """The documents of every mixture with their number of copies."""
    docs, targets = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "mixture_targets"))
    return mix(docs, targets)[0]


def p8_shares(spark, sf_dir: str) -> DataFrame:
    """Target and actual share of every source of every mixture."""
    docs, targets = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "mixture_targets"))
    return shares(*mix(docs, targets))
