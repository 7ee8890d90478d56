"""Context for answers: hits as text blocks, per query and per department, prompts, and an extractive answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

STANDARD_CHUNKS = 15

COMPARISON_SYSTEM = "You compare departments of a course catalog. Use the sources only, cite them as [id], take each department in turn and say where sources are missing."
QUANTITATIVE_SYSTEM = "You answer counting questions about a course catalog. Take numbers from the data, list what is counted and name the filters."
SYSTEM = "You answer questions about a course catalog. Use the sources only and cite them as [id]."
TRAP_NOTE = "The sources may not cover this question. If they do not, say that you could not find it."


def hit_block(with_score: bool = False):
    """One hit as lines: id, course, department, section and score where known, text."""
    lines = [
        F.concat(F.lit("["), F.col("chunk_id"), F.lit("]")),
        F.concat(F.lit("Course: "), F.col("course_code"), F.lit(" - "), F.col("course_title")),
        F.concat(F.lit("Department: "), F.upper("department")),
        F.when(F.coalesce("section_name", F.lit("")) != "", F.concat(F.lit("Section: "), F.col("section_name"))),
    ]
    if with_score:
        lines.append(F.concat(F.lit("Relevance: "), F.format_number("score", 3)))
    return F.concat_ws("\n", *lines, F.concat(F.lit("Content: "), F.col("text")))


def _numbered(with_score: bool):
    """Hits collected in the order of their ranks, as numbered sources."""
    blocks = F.array_sort(F.collect_list(F.struct("rank", hit_block(with_score).alias("t"))))
    return F.transform(blocks, lambda x, i: F.concat(F.lit("--- Source "), (i + 1).cast("string"), F.lit(" ---\n"), x["t"]))


def contexts(hits: DataFrame, most: int | None = STANDARD_CHUNKS, with_score: bool = False) -> DataFrame:
    """query_id, context: each query's hits by rank as numbered sources."""
    if most is not None:
        hits = hits.filter(F.col("rank") <= most)
    return hits.groupBy("query_id").agg(F.array_join(_numbered(with_score), "\n\n").alias("context"))


def department_contexts(hits: DataFrame, departments: list[str], with_score: bool = False) -> DataFrame:
    """query_id, department, context: the sources of every asked department, numbered anew in each, or a note where it has none."""
    asked = hits.select("query_id").distinct().select("query_id", F.explode(F.array(*map(F.lit, departments))).alias("department"))
    grouped = hits.groupBy("query_id", "department").agg(F.array_join(_numbered(with_score), "\n\n").alias("s"))
    text = F.coalesce("s", F.lit("No relevant sources found for this department."))
    return asked.join(grouped, ["query_id", "department"], "left").select("query_id", "department", F.concat(F.lit("=== "), F.upper("department"), F.lit(" ===\n"), text).alias("context"))


def prompts(questions: DataFrame, context: DataFrame, low_confidence: float = 0.3) -> DataFrame:
    """query_id, system, prompt; a note about missing sources where the best score is low or there are no hits."""
    doubtful = F.coalesce("top_score", F.lit(0.0)) < low_confidence
    joined = questions.join(context, "query_id", "left")
    body = F.concat_ws("\n\n", F.concat(F.lit("Sources:\n"), F.coalesce("context", F.lit("No relevant sources."))), F.concat(F.lit("Question: "), F.col("question")), F.when(doubtful, F.lit(TRAP_NOTE)))
    return joined.select("query_id", F.lit(SYSTEM).alias("system"), body.alias("prompt"), doubtful.alias("doubtful"))


def comparison_prompts(questions: DataFrame, by_department: DataFrame, departments: list[str]) -> DataFrame:
    """query_id, system, prompt from department_contexts(), departments in the order given."""
    place = F.array_position(F.array(*map(F.lit, departments)), F.col("department"))
    parts = by_department.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("k"), "context"))).alias("s"))
    body = F.concat(F.lit("Sources by department:\n"), F.coalesce(F.array_join("s.context", "\n\n"), F.lit("No relevant sources.")), F.lit("\n\nComparison question: "), F.col("question"))
    return questions.join(parts, "query_id", "left").select("query_id", F.lit(COMPARISON_SYSTEM).alias("system"), body.alias("prompt"))


def quantitative_prompts(questions: DataFrame, data: DataFrame) -> DataFrame:
    """query_id, system, prompt from (query_id, formatted): the data that a count or sum is read from."""
    body = F.concat(F.lit("Course data:\n"), F.coalesce("formatted", F.lit("")), F.lit("\n\nQuestion: "), F.col("question"))
    return questions.join(data.select("query_id", "formatted"), "query_id", "left").select("query_id", F.lit(QUANTITATIVE_SYSTEM).alias("system"), body.alias("prompt"))


def citation_rows(hits: DataFrame, snippet: int = 200) -> DataFrame:
    return hits.select("query_id", "chunk_id", "course_code", "course_title", "source_url", F.substring("text", 1, snippet).alias("text_snippet"))


def extractive_answers(hits: DataFrame, most: int = 3) -> DataFrame:
    """query_id, answer: the first sentence of each of the best hits with its citation. It stands in for a language model."""
    first = F.element_at(F.split("text", "(?<=[.!?])\\s+", 2), 1)
    rows = hits.filter(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(first, F.lit(" ["), F.col("chunk_id"), F.lit("]")).alias("t")))).alias("s"))
    return rows.select("query_id", F.array_join(F.transform("s", lambda x: x["t"]), " ").alias("answer"))


def similarity_range(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, max_similarity, min_similarity, retrieval_count; zeros without hits."""
    stats = hits.groupBy("query_id").agg(F.max("score").alias("a"), F.min("score").alias("b"), F.count("*").alias("n"))
    zero = F.lit(0.0)
    return questions.select("query_id").join(stats, "query_id", "left").select("query_id", F.coalesce("a", zero).alias("max_similarity"), F.coalesce("b", zero).alias("min_similarity"), F.coalesce("n", F.lit(0)).alias("retrieval_count"))


def first_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
