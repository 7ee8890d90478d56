"""A run over a set of questions as one flow: route, retrieve, answer, check, measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions import grounding, metrics, questions as asked
from lectern.operators import context, lookup, vectors
from lectern.session import stored


def wanted_departments(questions: DataFrame) -> Column:
    """The departments that a question is to be answered from, null for all: a comparison names several, any other question one at most.

    Columns question_type, target_department and target_departments may be missing.
    """
    column = lambda name, kind: F.col(name) if name in questions.columns else F.lit(None).cast(kind)
    several, one = column("target_departments", "array<string>"), column("target_department", "string")
    return F.when((column("question_type", "string") == "comparison") & (F.size(several) > 0), several).when(F.coalesce(one, F.lit("")) != "", F.array(one))


def _classes(chunks: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(one chunk for each department and vector, that of the least pos; first_pos and pos of the first k chunks of each).

    Chunks of one vector score alike and go by pos, so the k best chunks are among the first k of the k best vectors.
    """
    # vectors are known by 128 bits: as keys they would be brought to one form of zero and compared anew at every step of a sort
    alike = Window.partitionBy("_h1", "_h2", "department")
    keyed = chunks.select("pos", "department", "embedding", F.xxhash64("embedding").alias("_h1"), F.xxhash64(F.lit(1), "embedding").alias("_h2"))
    numbered = keyed.withColumn("_n", F.row_number().over(alike.orderBy("pos"))).filter(F.col("_n") <= k)
    copies = numbered.withColumn("first_pos", F.min("pos").over(alike))
    return copies.filter("_n = 1").select("pos", "department", "embedding"), copies.select("first_pos", "pos")


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = 10, threshold: float = 0.0, provider: str | None = None) -> DataFrame:
    """query_id, rank, score and the chunk's columns: the k best chunks of each question within its departments, those below the threshold left out.

    Each distinct text is searched for once, among the distinct vectors of each department: the search does not grow with repeats of either.
    """
    q = questions.select(F.col("id").cast("long").alias("query_id"), F.col("question").alias("text"), wanted_departments(questions).alias("departments"))
    texts = q.groupBy("text").agg(F.min("query_id").alias("asked_id"))
    vectored = vectors.embed(texts.withColumnRenamed("asked_id", "query_id"), provider)
    first, copies = _classes(chunks, k)
    by_vector = vectors.batch_top_k(first, vectored, k, key="pos", group="department").drop("rank").withColumnsRenamed({"pos": "first_pos", "query_id": "asked_id"})
    best = Window.partitionBy("asked_id", "department").orderBy(F.desc("score"), "pos")
    by_department = by_vector.join(copies, "first_pos").drop("first_pos").withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")
    same = texts.withColumnRenamed("text", "_text")
    asks = q.join(same, F.col("text").eqNullSafe(F.col("_text"))).select("query_id", "departments", "asked_id")
    meant = by_department.join(asks, "asked_id").drop("asked_id").filter(F.col("departments").isNull() | F.array_contains("departments", F.col("department")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    found = meant.withColumn("rank", F.row_number().over(best)).filter((F.col("rank") <= k) & (F.col("score") >= threshold))
    return found.drop("departments", "department").join(chunks.drop("embedding"), "pos")


def _routed(questions: DataFrame) -> DataFrame:
    """questions with _route (if not there), dealt to several tasks a core, where its patterns are tried once: inline() keeps Spark from copying them into later steps."""
    if "_route" in questions.columns:
        return questions
    dealt = questions.repartition(4 * questions.sparkSession.sparkContext.defaultParallelism, "id")
    return dealt.select("*", F.inline(F.array_compact(F.array(F.struct(asked.route(F.col("question")).alias("_route"))))))


def _of_answer() -> list[Column]:
    """What a run takes of a catalog's answer, made once for all questions that get it."""
    text = F.col("context")
    return [text, F.col("hits.course_code").alias("listed"), grounding.abstains(text).alias("says_none"), metrics.trap_handled(text, F.lit(True)).alias("says_trap")]


def run(questions: DataFrame, chunks: DataFrame, k: int = 10, low_confidence: float = 0.3, threshold: float = 0.0, courses: DataFrame | None = None, provider: str | None = None) -> DataFrame:
    """One row per question: route, retrieved codes (repeats keep their ranks), scores, answer, grounding, trap verdict.

    questions: id, question, expected_course_codes, is_trap, and what wanted_departments() reads. chunks: pos, chunk_id, text, course_code,
    department, embedding. Questions without hits get an answer that says so. With courses (pos, department, course_code, course_title, ects,
    course_type, semester), questions that the catalog answers directly get what it says: its courses are what was retrieved, each with score 1, and
    the answer counts as grounded, every course as a valid citation.
    """
    questions = _routed(questions)
    hits = retrieve(questions if courses is None else questions.filter("_route = 'semantic'"), chunks, k, threshold, provider)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "course_code", "score", "chunk_id", "text")))
    grouped = hits.groupBy("query_id").agg(ranked.alias("h"))
    answers = context.extractive_answers(hits)
    rows = questions.withColumn("query_id", F.col("id").cast("long")).join(grouped, "query_id", "left").join(answers, "query_id", "left")
    if courses is None:
        kinds = {"context": "string", "listed": "array<string>", "says_none": "boolean", "says_trap": "boolean"}
        rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items()})
    else:
        looked_up = lookup.lookups(questions, courses, _of_answer).select(F.col("id").cast("long").alias("query_id"), "context", "listed", "says_none", "says_trap")
        rows = rows.join(looked_up, "query_id", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    source = lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["text"].alias("text"))
    found = F.coalesce("answer", F.lit("I could not find this in the catalog."))
    rows = rows.select(
        "query_id",
        "question",
        "is_trap",
        F.coalesce("expected_course_codes", none("string")).alias("expected_codes"),
        F.col("_route").alias("route"),
        F.coalesce(F.col("listed"), F.col("h.course_code"), none("string")).alias("retrieved_ids"),
        F.coalesce(F.transform("listed", lambda _: F.lit(1.0)), F.col("h.score"), none("double")).alias("scores"),
        F.coalesce(F.transform("h", source), none("struct<chunk_id: string, text: string>")).alias("sources"),
        F.coalesce("context", found).alias("answer"),
        # the catalog's answers are grounded by definition: what is as long as they are is not checked against sources
        F.when(F.col("context").isNull(), found).otherwise("").alias("to_check"),
        F.size("listed").alias("n_listed"),
        "says_none",
        "says_trap",
    )
    rows = rows.withColumn("doubtful", F.coalesce(F.get("scores", F.lit(0)), F.lit(0.0)) < low_confidence)
    checked = grounding.check_answers(rows, "to_check")
    sure = {"n_citations": F.col("n_listed").cast("long"), "n_valid": F.col("n_listed").cast("long"), "n_claims": F.lit(1).cast("long"), "n_supported": F.lit(1).cast("long"), "grounding_score": F.lit(1.0), "is_grounded": F.lit(True), "abstention": F.col("says_none")}
    listed = F.coalesce(F.col("n_listed") >= 0, F.lit(False))
    checked = checked.withColumns({c: F.when(listed, v).otherwise(F.col(c)) for c, v in sure.items()})
    handled = ~F.col("is_trap") | F.coalesce("says_trap", metrics.trap_handled(F.col("to_check"), F.lit(True)))
    return checked.withColumn("trap_handled", handled).drop("sources", "invalid", "n_listed", "to_check", "says_none", "says_trap")


#: What an answer's row has for its measures besides those of metrics.retrieval_row() and answer_row().
_CHECKED = ("is_trap", "is_grounded", "grounding_score", "n_citations", "n_valid")


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """The columns, made where they stand: inline() keeps Spark from copying them into the steps before and after."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def _rows(results: DataFrame) -> DataFrame:
    retrieved = metrics.retrieval_row(F.col("retrieved_ids"), F.col("expected_codes"), F.col("scores"))
    return _once(results, *(F.col(c) for c in _CHECKED), *retrieved, *metrics.answer_row(F.col("answer"), F.col("expected_codes")))


def _means(rows: DataFrame, strict: bool) -> DataFrame:
    return rows.agg(*metrics.retrieval_means(strict), *metrics.answer_means()).withColumnRenamed("num_answers", "num_questions")


def measures(results: DataFrame, strict: bool = True) -> DataFrame:
    """One row: the measures of retrieval and of answers."""
    return _means(_rows(results), strict)


def _catalog_rows(asks: DataFrame, courses: DataFrame) -> DataFrame:
    """_rows() of what run() gives for asks (id, question, expected, is_trap, _key: what the catalog is asked for).

    An answer is as long as its courses are many. Each is made once, gives the first place of every code that it lists, and is read once for each distinct code
    that is expected of it: no question gets a copy.
    """
    spark = asks.sparkSession
    first = asks.groupBy("_key").agg(F.min(F.struct("id", "question")).alias("q")).select("_key", "q.*")
    text = F.col("context")
    made = lambda: [F.upper(text).alias("said"), F.col("hits.course_code").alias("listed"), metrics.trap_handled(text, F.lit(True)).alias("says_trap")]
    found = lookup.lookups(first.select("id", "question"), courses, made).select("id", "said", "listed", "says_trap")
    answers = stored(first.select("_key", "id").join(found, "id").drop("id"), "answers")
    codes = asks.select("_key", F.explode("expected").alias("code")).distinct()
    listed = answers.select("_key", F.posexplode("listed").alias("at", "code")).groupBy("_key", "code").agg((F.min("at") + 1).alias("place"))
    # an answer's codes are dealt to several tasks, each with a copy of the answer
    parts = 4 * spark.sparkContext.defaultParallelism
    part = F.pmod(F.xxhash64("code"), F.lit(8)).cast("int")
    dealt = codes.withColumn("_part", part).repartition(parts, "_key", "_part")
    texts = answers.select("_key", "said", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_part")).repartition(parts, "_key", "_part")
    named = dealt.join(texts, ["_key", "_part"]).select("_key", "code", F.contains("said", F.upper("code")).alias("named"))
    pair = named.join(listed.select(F.col("_key").alias("_k"), F.col("code").alias("_c"), "place"), (F.col("_key") == F.col("_k")) & F.col("code").eqNullSafe(F.col("_c")), "left").drop("_k", "_c")
    sets = asks.select("_key", "expected").distinct()
    each = sets.select("_key", "expected", F.explode_outer("expected").alias("_code"))
    p = pair.select(F.col("_key").alias("_k"), "code", "named", "place")
    met = each.join(p, (F.col("_key") == F.col("_k")) & F.col("_code").eqNullSafe(F.col("code")), "left")
    met = met.groupBy("_key", "expected").agg(F.collect_list(F.when(F.size("expected") > 0, F.struct(F.col("_code").alias("code"), "place", "named"))).alias("c"))
    sizes = answers.select("_key", F.size("listed").cast("long").alias("n_scores"), "says_trap")
    places = F.transform(F.array_distinct(F.transform("c", lambda x: F.struct(x["code"], x["place"]))), lambda x: F.struct(x["code"].isNotNull().alias("some"), x["place"].alias("place")))
    rows = asks.select("_key", "expected", "is_trap").join(met.withColumn("d", places), ["_key", "expected"]).join(sizes, "_key")
    zero, n_relevant = (lambda c: F.coalesce(c, F.lit(0.0))), F.size("expected")
    upto = lambda k: F.size(F.filter("d", lambda x: x["place"] <= k))
    wanted = F.size(F.array_distinct("expected"))
    best = F.array_min(F.transform(F.filter("d", lambda x: x["some"]), lambda x: x["place"]))
    return _once(
        rows,
        F.col("is_trap"),
        F.lit(True).alias("is_grounded"),
        F.lit(1.0).alias("grounding_score"),
        F.col("n_scores").alias("n_citations"),
        F.col("n_scores").alias("n_valid"),
        zero(1 / best).alias("rr"),
        *(zero(F.try_divide(upto(k), wanted)).alias(f"recall_{k}") for k in metrics.RECALLS),
        *(zero(F.try_divide(upto(k), F.least(F.lit(k).cast("long"), "n_scores"))).alias(f"precision_{k}") for k in metrics.PRECISIONS),
        F.when(F.exists("d", lambda x: x["place"].isNotNull()), 1.0).otherwise(0.0).alias("hit"),
        F.col("n_scores").cast("double").alias("total_score"),
        F.col("n_scores"),
        n_relevant.alias("n_relevant"),
        F.when(F.col("is_trap"), F.col("says_trap").cast("double")).alias("trap"),
        F.when(n_relevant > 0, F.size(F.filter("c", lambda x: x["named"])) / n_relevant).alias("full"),
    )


def run_measures(questions: DataFrame, chunks: DataFrame, k: int = 10, low_confidence: float = 0.3, threshold: float = 0.0, courses: DataFrame | None = None, provider: str | None = None, strict: bool = True) -> DataFrame:
    """measures() of run(), whose rows are as long as the catalog for questions that it answers: here those are measured without a copy of their answer."""
    if courses is None:
        return measures(run(questions, chunks, k, low_confidence, threshold, None, provider), strict)
    q = F.col("question")
    dealt = questions.repartition(4 * questions.sparkSession.sparkContext.defaultParallelism, "id")
    parsed = dealt.select("*", F.inline(F.array_compact(F.array(F.struct(asked.mandatory_lookup(q).alias("_mandatory"), asked.counting_lookup(q).alias("_counting"))))))
    # the two kinds of keys differ in their fields; several steps read them, and the patterns take longest
    keyed = parsed.withColumn("_key", F.coalesce(F.to_json("_mandatory"), F.to_json("_counting"))).drop("_mandatory", "_counting")
    keyed = stored(keyed, "questions")
    searched = _rows(run(keyed.filter("_key IS NULL").drop("_key").withColumn("_route", F.lit("semantic")), chunks, k, low_confidence, threshold, None, provider))
    expected = F.coalesce("expected_course_codes", F.array().cast("array<string>")).alias("expected")
    return _means(searched.unionByName(_catalog_rows(keyed.filter("_key IS NOT NULL").select("id", "question", expected, "is_trap", "_key"), courses)), strict)


def plain_questions(df: DataFrame) -> DataFrame:
    """Questions given as bare strings (id, question), with nothing expected."""
    return df.select("id", "question", F.array().cast("array<string>").alias("expected_course_codes"), F.lit(False).alias("is_trap"))
