"""Catalog lookups and aggregations over courses (pos is the order in which rows count as first)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions import fixed


def first_per(df: DataFrame, *keys: str, order: str = "pos") -> DataFrame:
    """The first row of each key; a window, because dropDuplicates may keep any row."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def mandatory_courses(courses: DataFrame, semester: int, department: str) -> DataFrame:
    return courses.filter((F.col("department") == department) & (F.col("semester") == semester) & (F.col("course_type") == "mandatory")).orderBy("course_code", "pos")


def courses_with_prefix(courses: DataFrame, prefix: str) -> DataFrame:
    """Distinct codes that begin with the prefix as a string."""
    return first_per(courses.filter(F.col("course_code").startswith(prefix.upper())), "course_code").orderBy("course_code")


def courses_with_ects(courses: DataFrame, ects: float) -> DataFrame:
    return first_per(courses.filter(F.col("ects") == ects), "course_code").orderBy("course_code")


def department_counts(courses: DataFrame) -> DataFrame:
    return courses.groupBy("department").agg(F.count("*").alias("total"), F.count_if(F.col("course_type") == "mandatory").alias("mandatory"), F.count_if(F.col("course_type") == "elective").alias("elective"))


def count_courses(courses: DataFrame) -> DataFrame:
    return courses.agg(F.count("*").alias("value"))


def sum_ects(courses: DataFrame) -> DataFrame:
    return courses.agg(F.coalesce(F.sum("ects"), F.lit(0.0)).alias("value"))


def semester_breakdown(courses: DataFrame) -> DataFrame:
    """Courses by semester; no semester is 0, the sentinel -1 of the store stays."""
    return courses.groupBy(F.coalesce("semester", F.lit(0)).alias("semester")).agg(F.count("*").alias("n"))


def department_comparison(courses: DataFrame, listed: int = 5) -> DataFrame:
    """Courses by upper-case department (UNKNOWN if empty), with the first `listed` codes."""
    name = F.upper(F.when(F.coalesce("department", F.lit("")) == "", "unknown").otherwise(F.col("department")))
    w = Window.partitionBy("name").orderBy("pos")
    ranked = courses.select(name.alias("name"), "course_code", "pos").withColumn("n", F.row_number().over(w))
    firsts = F.array_sort(F.collect_list(F.when(F.col("n") <= listed, F.struct("n", "course_code"))))
    return ranked.groupBy("name").agg(F.count("*").alias("total"), F.array_join(F.transform(firsts, lambda x: x["course_code"]), ", ").alias("first_codes"))


def course_list(courses: DataFrame, listed: int = 20) -> DataFrame:
    """The first `listed` courses by position, as lines."""
    line = F.concat(F.lit("- "), F.col("course_code"), F.lit(": "), F.coalesce("course_title", F.lit("")))
    return courses.orderBy("pos").limit(listed).select("pos", line.alias("line"))


def store_stats(chunks: DataFrame) -> DataFrame:
    """Chunks and distinct courses by department, with a row for all (department null)."""
    return chunks.cube("department").agg(F.count("*").alias("chunks"), F.count_distinct("course_code").alias("courses"))


def question_stats(questions: DataFrame) -> DataFrame:
    """Counts by type, by difficulty, by department ("general" without one) and overall, as (facet, value, n, traps)."""
    rows = questions.withColumn("department", F.coalesce("target_department", F.lit("general")))
    sets = [[], [F.col("question_type")], [F.col("difficulty")], [F.col("department")]]
    grouped = rows.groupingSets(sets, "question_type", "difficulty", "department").agg(F.count("*").alias("n"), F.count_if("is_trap").alias("traps"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "difficulty").when(F.col("g") == 6, "department").otherwise("all")
    return grouped.select(facet.alias("facet"), F.coalesce("question_type", "difficulty", "department").alias("value"), "n", "traps")


def hit_courses(hits: DataFrame, *by: str) -> DataFrame:
    """course_code, place, ects, credits, course_type and the hits' own columns but text: codes named in hits (pos, text), each at its first place.

    Quantities are the first ones in the hit's text and the type is the first kind with a word in it ("" without one); all its
    codes share them. With `by`, such as a query's id, a code counts once for each.
    """
    from lectern.functions.grounding import course_codes

    low = F.lower("text")
    number = lambda p: F.nullif(F.regexp_extract("text", f"(?iU){p}", 1), F.lit("")).try_cast("double")
    kind = F.coalesce(*(F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), k) for k, words in fixed.COURSE_TYPE_WORDS.items()), F.lit(""))
    own = [c for c in hits.columns if c not in ("text", "ects", "credits", "course_type", "course_code", "place")]
    rows = hits.select(*own, number(fixed.ECTS).alias("ects"), number(fixed.CREDITS).alias("credits"), kind.alias("course_type"), F.posexplode(course_codes(F.col("text"))).alias("place", "course_code"))
    w = Window.partitionBy(*by, "course_code").orderBy("pos", "place")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def hit_metadata(chunks: DataFrame) -> DataFrame:
    """Metadata as the store keeps it: no semester is -1, no ects 0."""
    return chunks.withColumn("semester", F.coalesce(F.nullif("semester", F.lit(0)), F.lit(-1))).withColumn("ects", F.coalesce("ects", F.lit(0.0)))


def course_id(department: Column, code: Column, years: Column) -> Column:
    return F.concat_ws("_", department, F.lower(F.replace(code, F.lit(" "), F.lit("_"))), years)


def normal_course_id(department: Column, code: Column, years: Column) -> Column:
    """The stricter id: white space to one underscore, other signs dropped."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(code)), "\\s+", "_"), "[^a-z0-9_]", "")
    return F.concat_ws("_", F.lower(F.trim(department)), plain, F.trim(years))
