"""Ranking metrics and exact ROC areas, as joins, windows and counts; no list of scores is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .curate import running_total

#: The K of Recall@K in result tables.
RECALL_AT = (1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50)


def ranks(positives: DataFrame, negatives: DataFrame, keys: list[str], ties: str = "min") -> DataFrame:
    """The rank of each key's positive among its negatives. positives: keys, idx, sim; negatives: keys, sim.

    Only the first positive of a key (least idx) is ranked. ties='min' puts the positive behind equal negatives, 'max' before them. A missing
    score is below all others. Keys without negatives have no rank; an empty input gives no rows.
    """
    first = positives.groupBy(*keys).agg(F.min_by("sim", "idx").alias("pos"))
    low = float("-inf")
    score = lambda c: F.coalesce(F.col(c), F.lit(low))
    ahead = score("sim") >= score("pos") if ties == "min" else score("sim") > score("pos")
    return negatives.join(first, keys).groupBy(*keys).agg((F.lit(1) + F.count_if(ahead)).alias("rank"))


def reciprocal(rank: Column, k: int = 10) -> Column:
    """1/rank up to rank k, else 0."""
    return F.when(rank <= k, F.lit(1.0) / rank.cast("double")).otherwise(0.0)


def ranking_table(ranked: DataFrame, positives: DataFrame, by: list[str], at: tuple[int, ...] = RECALL_AT, k: int = 10) -> DataFrame:
    """by, recall_at_K..., mrr_at_k. Recall is over all positives, the mean reciprocal rank over the ranked keys."""
    total = positives.groupBy(*by).agg(F.count("*").alias("positives"))
    hits = ranked.groupBy(*by).agg(*(F.count_if(F.col("rank") <= n).alias(f"hits_{n}") for n in at), F.avg(reciprocal(F.col("rank"), k)).alias(f"mrr_at_{k}"))
    out = total.join(hits, by, "left") if by else total.crossJoin(F.broadcast(hits))
    return out.select(*by, *(F.coalesce(F.col(f"hits_{n}") / F.col("positives"), F.lit(0.0)).alias(f"recall_at_{n}") for n in at), f"mrr_at_{k}")


def auc(scored: DataFrame, by: list[str], score: str = "sim", label: str = "label") -> DataFrame:
    """by, positives, negatives, auc: the exact area, by ranks averaged over ties. Null where one class is missing. Rows without a score are left out.

    Scores are counted by value, and the negatives below each value come from a running total over range partitions, so no group is gathered in one task.
    """
    values = scored.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    run = running_total(values, "n", [*(F.col(c) for c in by), F.col(score)])
    # Within a group, what lies below is what lies before, less what lies before the whole group.
    sums = [F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum(F.col("p") * (F.col("before") + F.col("n") / 2.0)).alias("w"), F.min("before").alias("first")]
    out = run.groupBy(*by).agg(*sums)
    area = (F.col("w") - F.col("first") * F.col("positives")) / (F.col("positives") * F.col("negatives"))
    return out.select(*by, "positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), area).alias("auc"))


def binned_auc(scored: DataFrame, by: list[str], thresholds: int = 200, score: str = "sim", label: str = "label") -> DataFrame:
    """by, auc: the trapezoid over equally spaced thresholds of scores scaled to 0..1 in each group; an approximation of `auc`."""
    rows = scored.where(F.col(score).isNotNull())
    ends = rows.groupBy(*by).agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    rows = rows.join(ends, by) if by else rows.crossJoin(F.broadcast(ends))
    scaled = rows.withColumn("s", (F.col(score) - F.col("__low") + 1e-8) / (F.col("__high") - F.col("__low") + 1e-8))
    bins = scaled.groupBy(*by, F.floor(F.col("s") * (thresholds - 1)).alias("bin")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    below = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = bins.withColumn("wins", F.col("p") * (below + F.col("n") / 2.0)).groupBy(*by).agg(F.sum("wins").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).alias("auc"))


def target_ranks(scored: DataFrame, by: list[str], is_target: Column, order: list[Column]) -> DataFrame:
    """by, rank: the place of the true match in each group's list, best score first, missing scores last, ties by `order`. If several match, the
    best place counts. Counted against the best match by pre-aggregation; no list is sorted."""
    key = F.struct(F.coalesce(-F.col("sim"), F.lit(float("inf"))).alias("s"), *order)
    rows = scored.select(*by, key.alias("__k"), is_target.alias("__t"))
    best = rows.where("__t").groupBy(*by).agg(F.min("__k").alias("__b"))
    return rows.join(best, by).groupBy(*by).agg((F.lit(1) + F.count_if(F.col("__k") < F.col("__b"))).alias("rank"))


def rank_lists(ranked: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, ranks (`;` between, in the order of `order`), mrr_at_10."""
    return ranked.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "rank"))), lambda r: r["rank"].cast("string")), ";").alias("ranks"), F.avg(reciprocal(F.col("rank"))).alias("mrr_at_10"))


def triplet_accuracy(near: Column, far: Column) -> Column:
    """The share of triplets whose positive is nearer than the negative."""
    return F.avg(F.when(near > far, 1.0).otherwise(0.0))


def pair_loss(sim: Column, label: Column) -> Column:
    """Mean squared difference of a similarity and a label of +1 or -1."""
    return F.avg(F.pow(sim - label, 2))


def triplet_loss(near: Column, far: Column, margin: float) -> Column:
    """Mean of max(0, margin + distance to the positive - distance to the negative); scores are similarities."""
    return F.avg(F.greatest(F.lit(0.0), F.lit(margin) - near + far))


def best_by(scores: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """The name with the greatest value in each group."""
    return scores.groupBy(*by).agg(F.max_by(name, value).alias(name), F.max(value).alias(value))


def margin_pair_loss(distance: Column, label: Column, margin: float = 1.0) -> Column:
    """max(0, margin - label (1 - distance)) of pairs labelled +1 or -1."""
    return F.greatest(F.lit(0.0), F.lit(margin) - label * (1 - distance))


def hamming_pair_loss(agreement: Column, label: Column) -> Column:
    """A quarter of the squared difference of an agreement of signs and the label."""
    return F.pow(label - agreement, F.lit(2.0)) * 0.25


def hamming_triplet_loss(near: Column, far: Column) -> Column:
    """An eighth of the squared distances of the agreements from +1 and -1."""
    return (F.pow(near - 1, F.lit(2.0)) + F.pow(far + 1, F.lit(2.0))) * 0.125


def softmax_loss(scores: Column, label: Column) -> Column:
    """The cross-entropy of an array of class scores and the true class, from 0; safe for large scores."""
    top = F.array_max(scores)
    return F.log(F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top - F.get(scores, label)


def running_means(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """`df` with mean_c of each column over the rows so far in `order` (without ties), for each group; groups are runs of training, one row per step."""
    so_far = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({f"mean_{c}": F.avg(c).over(so_far) for c in columns})


def renamed_models(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under the names that tables show; names of columns that are not there do nothing."""
    return df.withColumnsRenamed(names)
