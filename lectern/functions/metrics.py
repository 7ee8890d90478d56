"""Measures of retrieval and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import fixed
from lectern.functions.grounding import says_any


def reciprocal_rank(found: Column, relevant: Column) -> Column:
    """1 over the place of the first relevant item, 0 without one."""
    places = F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(1 / F.array_min(places), F.lit(0.0))


def recall_at(k: int, found: Column, relevant: Column) -> Column:
    wanted = F.array_distinct(relevant)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(F.slice(found, 1, k), wanted)), F.size(wanted)), F.lit(0.0))


def precision_at(k: int, found: Column, relevant: Column) -> Column:
    """Distinct relevant items over the number of items looked at, which may be below k."""
    top = F.slice(found, 1, k)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(top, relevant)), F.size(top)), F.lit(0.0))


def hit(found: Column, relevant: Column) -> Column:
    return F.when(F.size(F.array_intersect(found, relevant)) > 0, 1.0).otherwise(0.0)


RECALLS, PRECISIONS = (1, 3, 5, 10), (1, 3, 5)


def retrieval_row(found: Column, relevant: Column, scores: Column) -> list[Column]:
    """What retrieval_means() takes of one query."""
    return [
        reciprocal_rank(found, relevant).alias("rr"),
        *(recall_at(k, found, relevant).alias(f"recall_{k}") for k in RECALLS),
        *(precision_at(k, found, relevant).alias(f"precision_{k}") for k in PRECISIONS),
        hit(found, relevant).alias("hit"),
        F.aggregate(scores, F.lit(0.0), lambda a, x: a + x).alias("total_score"),
        F.size(scores).cast("long").alias("n_scores"),
        F.size(relevant).alias("n_relevant"),
    ]


def retrieval_means(strict: bool = True) -> list[Column]:
    """Aggregates of retrieval_row(). avg_score is over all scores.

    strict keeps queries without relevant items in every mean, with 0; otherwise they are left out.
    """
    stays = F.lit(True) if strict else F.col("n_relevant") > 0
    zero, of = (lambda c: F.coalesce(c, F.lit(0.0))), (lambda c: F.when(stays, F.col(c)))
    return [
        zero(F.avg(of("rr"))).alias("mrr"),
        *(zero(F.avg(of(f"recall_{k}"))).alias(f"recall_at_{k}") for k in RECALLS),
        *(zero(F.avg(of(f"precision_{k}"))).alias(f"precision_at_{k}") for k in PRECISIONS),
        zero(F.avg(of("hit"))).alias("hit_rate"),
        zero(F.try_divide(F.sum(of("total_score")), F.sum(of("n_scores")))).alias("avg_score"),
        F.count_if(stays).alias("num_queries"),
    ]


def retrieval_metrics(results: DataFrame, strict: bool = True) -> DataFrame:
    """One row of means over (retrieved_ids, relevant_ids, scores), as retrieval_means() has them."""
    return results.select(*retrieval_row(F.col("retrieved_ids"), F.col("relevant_ids"), F.col("scores"))).agg(*retrieval_means(strict))


def ranked_measures(hits: DataFrame, relevant: DataFrame, recalls: tuple[int, ...] = RECALLS, precisions: tuple[int, ...] = PRECISIONS) -> DataFrame:
    """query_id, rr, hit, recall_<k>, precision_<k>, total_score, n from hits (query_id, rank, score, is_relevant) and relevant (query_id, n_relevant).

    As the functions over arrays, but relevant items are counted, not gathered: a query may have any number of them. Queries of `relevant` without hits
    measure 0.
    """
    good, zero = F.col("is_relevant"), (lambda c: F.coalesce(c, F.lit(0.0)))
    upto = lambda k: F.count_if(good & (F.col("rank") <= k))
    looked = lambda k: F.count_if(F.col("rank") <= k)
    per = hits.groupBy("query_id").agg(
        F.max(F.when(good, 1 / F.col("rank"))).alias("rr"),
        F.max(F.when(good, 1.0)).alias("hit"),
        *(upto(k).alias(f"_good_{k}") for k in {*recalls, *precisions}),
        *(looked(k).alias(f"_seen_{k}") for k in precisions),
        F.sum("score").alias("total_score"),
        F.count("*").alias("n"),
    )
    rows = relevant.join(per, "query_id", "left")
    return rows.select(
        "query_id",
        zero(F.col("rr")).alias("rr"),
        zero(F.col("hit")).alias("hit"),
        *(zero(F.try_divide(F.col(f"_good_{k}"), F.col("n_relevant"))).alias(f"recall_{k}") for k in recalls),
        *(zero(F.try_divide(F.col(f"_good_{k}"), F.col(f"_seen_{k}"))).alias(f"precision_{k}") for k in precisions),
        zero(F.col("total_score")).alias("total_score"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def mean_measures(measured: DataFrame) -> DataFrame:
    """One row: the means of ranked_measures(), avg_score over all hits."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    names = {"rr": "mrr", "hit": "hit_rate"} | {c: c.replace("_", "_at_") for c in measured.columns if c.startswith(("recall_", "precision_"))}
    return measured.agg(*(zero(F.avg(c)).alias(n) for c, n in names.items()), zero(F.try_divide(F.sum("total_score"), F.sum("n"))).alias("avg_score"), F.count("*").alias("num_queries"))


def trap_handled(answer: Column, is_trap: Column) -> Column:
    return ~is_trap | says_any(answer, fixed.TRAP_PHRASES)


def trap_answered(answer: Column) -> Column:
    """As a run of questions judges answers to traps; its phrases differ a little."""
    return says_any(answer, fixed.RUN_TRAP_PHRASES)


def completeness(answer: Column, codes: Column) -> Column:
    """Share of the expected codes that the answer names, 1 if none is expected."""
    named = F.filter(codes, lambda c: F.contains(F.upper(answer), F.upper(c)))
    return F.when(F.size(codes) > 0, F.size(named) / F.size(codes)).otherwise(F.lit(1.0))


def answer_row(answer: Column, expected: Column) -> list[Column]:
    """What answer_means() takes of one answer, besides is_trap, is_grounded, grounding_score, n_citations and n_valid."""
    return [F.when(F.col("is_trap"), trap_handled(answer, F.lit(True)).cast("double")).alias("trap"), F.when(F.size(expected) > 0, completeness(answer, expected)).alias("full")]


def answer_means() -> list[Column]:
    zero, one = (lambda c: F.coalesce(c, F.lit(0.0))), (lambda c: F.coalesce(c, F.lit(1.0)))
    return [
        zero(F.avg(F.col("is_grounded").cast("double"))).alias("grounding_rate"),
        zero(F.avg("grounding_score")).alias("avg_grounding_score"),
        zero(F.try_divide(F.sum("n_valid"), F.sum("n_citations"))).alias("citation_accuracy"),
        one(F.avg("trap")).alias("trap_accuracy"),
        zero(1 - F.avg("trap")).alias("hallucination_rate"),
        one(F.avg("full")).alias("answer_completeness"),
        F.count("*").alias("num_answers"),
        F.count_if("is_trap").alias("num_trap_questions"),
    ]


def answer_metrics(checked: DataFrame) -> DataFrame:
    """One row of means over (answer, is_trap, expected_codes, is_grounded, grounding_score, n_citations, n_valid)."""
    return checked.select("*", *answer_row(F.col("answer"), F.col("expected_codes"))).agg(*answer_means())


def rounded(measures: DataFrame, digits: int = 4) -> DataFrame:
    """Measures as they are saved: fractions with `digits` digits, counts as they are."""
    return measures.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in measures.dtypes))


def summary(measures: DataFrame) -> DataFrame:
    """One row, summary: the main measures as lines."""
    line = lambda label, c: F.concat(F.lit(f"  {label}: "), F.format_number(c, 3))
    text = F.concat_ws(
        "\n",
        F.lit("Retrieval:"),
        line("MRR", "mrr"),
        line("Recall@5", "recall_at_5"),
        line("Hit rate", "hit_rate"),
        F.concat(F.lit("  Queries: "), F.col("num_queries").cast("string")),
        F.lit("Answers:"),
        line("Grounding rate", "grounding_rate"),
        line("Trap accuracy", "trap_accuracy"),
        line("Completeness", "answer_completeness"),
    )
    return measures.select(text.alias("summary"))
