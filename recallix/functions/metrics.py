"""Evaluation metrics as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Shared over all distinct elements of two arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def path_overlap(expected: Column, actual: Column) -> Column:
    """Jaccard similarity of two paths; 0 if either is empty."""
    return F.when((F.size(expected) == 0) | (F.size(actual) == 0), 0.0).otherwise(jaccard(expected, actual))


def common_subsequence(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence of two arrays: a dynamic program folded over a, a row at a time.

    The row for an element x of a: r[j] is r[j-1] of the row before plus 1 where x = b[j], else the larger neighbour.
    """
    zero = F.transform(F.concat(b, F.array(F.lit(None))), lambda _: F.lit(0))

    def step(row: Column, x: Column) -> Column:
        start = F.array(F.lit(0))
        return F.aggregate(F.sequence(F.lit(1), F.size(b)), start, lambda new, j: F.concat(new, F.array(F.when(x == F.element_at(b, j), F.element_at(row, j) + 1).otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(new, -1))))))

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.element_at(F.aggregate(a, zero, step), -1))


def order_accuracy(expected: Column, actual: Column) -> Column:
    """Longest common subsequence over the longer length; 0 if either is empty."""
    longest = F.greatest(F.size(expected), F.size(actual))
    return F.when((F.size(expected) == 0) | (F.size(actual) == 0), 0.0).otherwise(common_subsequence(expected, actual) / longest)


def hop_accuracy(expected: Column, actual: Column) -> Column:
    """The smaller count over the larger; 1 if both are 0, 0 if one is."""
    return F.when((expected == 0) & (actual == 0), 1.0).when((expected == 0) | (actual == 0), 0.0).otherwise(F.least(expected, actual) / F.greatest(expected, actual))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def answer_score(answer: Column, expected: Column) -> Column:
    """The share of the expected texts that the answer contains; 1 if none is expected."""
    hit = F.size(F.filter(expected, lambda e: F.lower(answer).contains(F.lower(e))))
    return F.when(F.size(expected) == 0, 1.0).otherwise(hit / F.size(expected))


def composite(path: Column, order: Column, entity: Column, hops: Column) -> Column:
    """0.3 of overlap and order each, 0.2 of entities and hops each."""
    return 0.3 * path + 0.3 * order + 0.2 * entity + 0.2 * hops


def retrieval_scores(got: DataFrame, expected: DataFrame) -> DataFrame:
    """(qid, precision_score, recall_score, f1, mrr) of ranked texts (qid, rank, text) against expected words (qid, expected)."""
    rows = got.join(expected, "qid").withColumn("hit", F.filter("expected", lambda w: F.lower("text").contains(w)))
    found = F.array_distinct(F.flatten(F.collect_list("hit")))
    out = rows.groupBy("qid").agg(F.avg(F.when(F.size("hit") > 0, 1.0).otherwise(0.0)).alias("p"), (F.size(found) / F.first(F.size("expected"))).alias("r"), F.coalesce(F.max(F.when(F.size("hit") > 0, 1.0 / F.col("rank"))), F.lit(0.0)).alias("m"))
    return out.select("qid", F.round("p", 6).alias("precision_score"), F.round("r", 6).alias("recall_score"), F.round(f1(F.col("p"), F.col("r")), 6).alias("f1"), F.round("m", 6).alias("mrr"))
