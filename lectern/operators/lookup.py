"""Answers from the catalog itself, without vectors: questions joined to courses, hits and contexts made from courses.

Each distinct thing asked for (a semester and department, a code prefix, ects, a department) is looked up once, however many
questions ask for it, and its result joins back to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions import fixed, questions as asked
from lectern.operators import catalog

LISTED = 20


def _some(value: Column) -> Column:
    """False for null, empty text and zero."""
    return F.coalesce(value.cast("string"), F.lit("")).isin("", "0", "0.0") == F.lit(False)


def course_hits(courses: DataFrame) -> DataFrame:
    """courses with chunk_id, text and score: courses as hits of a direct lookup.

    Columns objectives, prerequisites and year_range may be missing.
    """
    column = lambda name, kind="string": F.col(name).cast(kind) if name in courses.columns else F.lit(None).cast(kind)
    code, title = F.coalesce("course_code", F.lit("")), F.coalesce("course_title", F.lit(""))
    line = lambda label, value: F.when(_some(value), F.concat(F.lit(f"{label}: "), value.cast("string")))
    text = F.concat_ws(
        "\n",
        F.when((code != "") & (title != ""), F.concat(code, F.lit(" - "), title)),
        line("ECTS", F.col("ects")),
        line("Semester", F.col("semester")),
        line("Type", F.col("course_type")),
        line("Objectives", F.substring(column("objectives"), 1, 200)),
        line("Prerequisites", column("prerequisites")),
    )
    place = F.when(F.coalesce("department", F.lit("")) == "", "unknown").otherwise(F.col("department"))
    plain = F.when(code == "", "unknown").otherwise(F.lower(F.replace(code, F.lit(" "), F.lit("_"))))
    years = F.replace(F.coalesce(column("year_range"), F.lit("2020-2024")), F.lit("-"), F.lit("_"))
    return courses.withColumns({"chunk_id": F.concat_ws("_", place, plain, years, F.lit("course_info_0")), "text": text, "score": F.lit(1.0)})


def _asked(questions: DataFrame, lookup: Column) -> DataFrame:
    """id and the lookup's fields, of questions that have one. Made by inline(), so that the patterns are tried once and not copied into later steps."""
    # the patterns take far longer than reading: questions of one file would be one task's
    dealt = questions.select("id", "question").repartition(4 * questions.sparkSession.sparkContext.defaultParallelism, "id")
    return dealt.select("id", F.inline(F.array_compact(F.array(lookup))))


def _in_order(rows: DataFrame, keys: list[str], order: list[Column | str], line: Column, most: int | None = None) -> DataFrame:
    """keys, n, lines, hits: how many rows each key has, and the first `most` lines and hits (all if None) in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    hit = F.struct("chunk_id", "course_code", "text")
    numbered = rows.select(*keys, line.alias("_line"), hit.alias("_hit"), F.row_number().over(w).alias("_k"))
    held = F.struct("_k", "_line", "_hit")
    held = held if most is None else F.when(F.col("_k") <= most, held)
    return numbered.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(held)).alias("_s")).select(*keys, "n", F.col("_s._line").alias("lines"), F.col("_s._hit").alias("hits"))


#: What a lookup without courses gives as hits.
_NO_HITS = "array<struct<chunk_id: string, course_code: string, text: string>>"


def _hits() -> Column:
    return F.coalesce("hits", F.array().cast(_NO_HITS)).alias("hits")


def _whole() -> list[Column]:
    return [F.col("context"), F.col("hits")]


def mandatory_lookups(questions: DataFrame, courses: DataFrame, given: Callable[[], list[Column]] = _whole) -> DataFrame:
    """id, semester, department, n, context, hits: the mandatory courses of the semester that a question asks for, by course code.

    An answer's context and hits are as long as its courses are many, and each question that asks for it gets a copy: `given` makes other columns of them, such as a
    hash, once for each answer.
    """
    wanted = _asked(questions, asked.mandatory_lookup(F.col("question")))
    keys = ["semester", "department"]
    line = F.format_string(fixed.CATALOG_TEXTS["course_with_ects"], F.coalesce("course_code", F.lit("Unknown")), F.coalesce("course_title", F.lit("Unknown")), F.coalesce(F.col("ects").cast("string"), F.lit("N/A")))
    taken = course_hits(courses.filter(F.col("course_type") == "mandatory")).join(wanted.select(*keys).distinct(), keys, "left_semi")
    found = wanted.select(*keys).distinct().join(_in_order(taken, keys, ["course_code", "pos"], line), keys, "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    name = F.coalesce(*(F.when(F.col("department") == d, t.upper()) for d, t in fixed.DEPARTMENT_TITLES.items()), F.upper("department"))
    head = F.format_string(fixed.CATALOG_TEXTS["mandatory"], name, F.col("semester").cast("string"), n.cast("string"))
    context = F.array_join(F.concat(F.array(head), F.coalesce("lines", F.array().cast("array<string>"))), "\n")
    answers = found.select(*keys, n.alias("n"), context.alias("context"), _hits()).select(*keys, "n", *given())
    return wanted.join(answers, keys).select("id", *answers.columns)


def counting_lookups(questions: DataFrame, courses: DataFrame, given: Callable[[], list[Column]] = _whole) -> DataFrame:
    """id, kind, value, n, context, hits (or what `given` makes of the last two): courses counted by code prefix, by ects or by department, as a question asks.

    Prefixes and ects count distinct codes, each by its first course; departments count courses. hits are the first LISTED courses, those of
    a department in the catalog's own order.
    """
    courses = course_hits(courses)
    wanted = _asked(questions, asked.counting_lookup(F.col("question")))
    values = wanted.select("kind", "value").distinct()
    first = catalog.first_per(courses, "course_code")
    by_ects = catalog.first_per(courses.filter(F.col("ects").isNotNull()), "course_code", "ects")
    # codes are short: each beginning of a code is a row, so prefixes meet codes by an equi join
    begins = F.transform(F.sequence(F.lit(1), F.length("course_code")), lambda k: F.substring(F.col("course_code"), F.lit(1), k))
    columns = ["pos", "course_code", "course_title", "course_type", "chunk_id", "text"]
    offered = [
        first.filter("course_code <> ''").select(F.lit("count_by_prefix").alias("kind"), F.explode(begins).alias("value"), *columns),
        by_ects.select(F.lit("count_by_ects").alias("kind"), F.col("ects").cast("double").cast("string").alias("value"), *columns),
        courses.select(F.lit("count_by_department").alias("kind"), F.col("department").alias("value"), *columns),
    ]
    # ects are compared as numbers
    plain = F.when(F.col("kind") == "count_by_ects", F.col("value").try_cast("double").cast("string")).otherwise(F.col("value"))
    keyed = values.withColumn("_value", plain)
    matched = offered[0].unionByName(offered[1]).unionByName(offered[2]).withColumnRenamed("value", "_value").join(keyed, ["kind", "_value"])
    line = F.format_string(fixed.CATALOG_TEXTS["course"], F.col("course_code"), F.coalesce("course_title", F.lit("None")))
    by_code = F.when(F.col("kind") != "count_by_department", F.col("course_code"))
    counted = _in_order(matched, ["kind", "value"], [by_code, "pos"], line, LISTED)
    kinds = matched.groupBy("kind", "value").agg(F.count_if(F.col("course_type") == "mandatory").alias("mandatory"), F.count_if(F.col("course_type") == "elective").alias("elective"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    found = values.join(counted.join(kinds, ["kind", "value"]), ["kind", "value"], "left").withColumns({"n": zero("n"), "mandatory": zero("mandatory"), "elective": zero("elective")})
    text = lambda c: F.col(c).cast("string")
    said = lambda k, *values: F.format_string(fixed.CATALOG_TEXTS[k], *values)
    head = F.when(F.col("kind") == "count_by_prefix", said("by_prefix", F.col("value"))).otherwise(said("by_ects", F.col("value")))
    more = F.when(F.col("n") > LISTED, said("more", (F.col("n") - LISTED).cast("string")))
    listed = F.concat_ws("\n", head, said("unique", text("n")), F.when(F.col("n") > 0, F.lit("")), F.when(F.col("n") > 0, F.array_join("lines", "\n")), more)
    whole = said("by_department", text("n"), text("mandatory"), text("elective"))
    answers = found.select("kind", "value", "n", F.when(F.col("kind") == "count_by_department", whole).otherwise(listed).alias("context"), _hits()).select("kind", "value", "n", *given())
    return wanted.join(answers, ["kind", "value"]).select("id", *answers.columns)


def quantitative_results(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """id, kind, n_courses, total_ects, groups, formatted: counting questions answered from their hits.

    hits: query_id (a question's id), pos (their order), chunk_id, text, department, semester. Courses are the codes that a question's hits name, each
    once. Filters that the question names apply, but a comparison takes all courses. groups maps semesters ("0" without
    one) or departments to numbers of courses.
    """
    q = F.col("question")
    parts = F.struct(
        asked.question_kind(q).alias("kind"),
        asked.asked_department(q).alias("_department"),
        asked.asked_semester(q).alias("_semester"),
        asked.asked_year(q).alias("_year"),
        asked.asked_type(q).alias("_type"),
        asked.asked_prefix(q).alias("_prefix"),
    )
    wanted = questions.select(F.col("id").alias("query_id"), F.inline(F.array(parts)))
    courses = catalog.hit_courses(hits, "query_id")
    rows = wanted.join(courses, "query_id", "left")
    free = lambda name, test: F.col(name).isNull() | F.coalesce(test, F.lit(False))
    stays = (
        free("_department", F.lower("department") == F.col("_department"))
        & free("_semester", F.col("semester") == F.col("_semester"))
        & free("_year", F.ceil(F.col("semester") / 2) == F.col("_year"))
        & free("_type", F.col("course_type") == F.col("_type"))
        & free("_prefix", F.split_part("course_code", F.lit(" "), F.lit(1)) == F.col("_prefix"))
    )
    taken = F.col("course_code").isNotNull() & ((F.col("kind") == "compare") | stays) & (F.col("kind") != "none")
    # one course's line in each kind of text
    ects = F.when(_some(F.col("ects")), F.col("ects").cast("string"))
    bracket = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    full = F.concat_ws(" ", F.concat(F.lit("  - "), F.col("course_code")), F.concat(F.lit("("), ects, F.lit(" ECTS)")), F.when(_some(F.col("semester")), F.concat(F.lit("Sem "), F.col("semester").cast("string"))), F.when(F.col("course_type") != "", bracket(F.col("course_type"))), bracket(F.col("chunk_id")))
    summed = F.concat(F.lit("  - "), F.col("course_code"), F.lit(": "), F.coalesce(F.concat(ects, F.lit(" ECTS")), F.lit("ECTS unknown")), F.lit(" "), bracket(F.col("chunk_id")))
    brief = F.concat(F.lit("  - "), F.col("course_code"), F.when(F.col("kind") == "compare", F.lit("")).otherwise(F.concat(F.lit(" "), bracket(F.col("chunk_id")))))
    line = F.when(F.col("kind").isin("count", "list"), full).when(F.col("kind") == "sum_ects", summed).otherwise(brief)
    semester = F.coalesce(F.col("semester"), F.lit(0)).cast("int")
    named = F.upper(F.when(F.coalesce("department", F.lit("")) == "", "unknown").otherwise(F.col("department")))
    group = F.when(F.col("kind") == "compare", named).when(F.col("kind") == "breakdown", semester.cast("string")).otherwise(F.lit(""))
    order = F.when(F.col("kind") == "breakdown", semester)
    held = rows.filter(taken).select("query_id", "kind", group.alias("g"), order.alias("o"), "ects", "pos", "place", line.alias("line"))
    groups = held.groupBy("query_id", "kind", "g", "o").agg(F.count("*").alias("n"), F.sum("ects").alias("total"), F.array_sort(F.collect_list(F.struct("pos", "place", "line"))).alias("s"))
    groups = groups.withColumn("l", F.col("s.line"))
    first = F.array_join(F.slice("l", 1, 5), "\n")
    said = lambda k, *values: F.format_string(fixed.QUANTITY_TEXTS[k], *values)
    size = F.col("n").cast("string")
    compared = F.concat(said("department", F.col("g"), size), first, F.when(F.col("n") > 5, said("more", (F.col("n") - 5).cast("string"))).otherwise(""))
    label = F.when(F.col("o") > 0, F.concat(F.lit("Semester "), F.col("g"))).otherwise("Unknown semester")
    broken = F.concat(said("semester", label, size), F.array_join("l", "\n"))
    block = F.when(F.col("kind") == "compare", compared).when(F.col("kind") == "breakdown", broken).otherwise(F.array_join("l", "\n"))
    per = groups.groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.array_sort(F.collect_list(F.struct(F.coalesce("o", F.lit(0)).alias("o"), "g", "n", block.alias("b")))).alias("s"))
    n, total = F.coalesce("n", F.lit(0).cast("long")), F.coalesce("total", F.lit(0.0))
    head = (
        F.when(F.col("kind") == "count", said("count", n.cast("string")))
        .when(F.col("kind") == "list", said("list", n.cast("string")))
        .when(F.col("kind") == "sum_ects", said("sum_ects", F.when(total == 0, F.lit("0")).otherwise(total.cast("string")), n.cast("string")))
        .when(F.col("kind") == "breakdown", fixed.QUANTITY_TEXTS["breakdown"])
        .when(F.col("kind") == "compare", fixed.QUANTITY_TEXTS["compare"])
    )
    mapped = F.when(F.col("kind").isin("breakdown", "compare"), F.map_from_arrays(F.transform("s", lambda x: x["g"]), F.transform("s", lambda x: x["n"])))
    formatted = F.coalesce(F.array_join(F.concat(F.array(head), F.coalesce(F.col("s.b"), F.array().cast("array<string>"))), "\n"), F.lit(""))
    return wanted.join(per, "query_id", "left").select(F.col("query_id").alias("id"), "kind", n.alias("n_courses"), total.alias("total_ects"), mapped.alias("groups"), F.when(F.col("kind") == "none", "").otherwise(formatted).alias("formatted"))


def lookups(questions: DataFrame, courses: DataFrame, given: Callable[[], list[Column]] = _whole) -> DataFrame:
    """id, route, n, context, hits (or what `given` makes of the last two) of every question that the catalog answers directly: mandatory courses first, then counts."""
    mandatory = mandatory_lookups(questions, courses, given).drop("semester", "department").withColumn("route", F.lit("mandatory"))
    counting = counting_lookups(questions, courses, given).drop("kind", "value").withColumn("route", F.lit("counting"))
    mandatory, counting = (df.select("id", "route", *[c for c in df.columns if c not in ("id", "route")]) for df in (mandatory, counting))
    return mandatory.unionByName(counting.join(mandatory.select("id"), "id", "left_anti"))
