from pyspark.sql import functions as F

from lectern.functions import grounding, metrics, questions


def test_metric_values(spark):
    rows = spark.createDataFrame(
        [(["d1", "d2", "d3"], ["d1"]), (["d1", "d2", "d3"], ["d2"]), (["d1", "d2", "d3"], ["d4"]), (["d1", "d2", "d3", "d4", "d5"], ["d1", "d3", "d6"]), ([], ["d1"]), (["d1"], [])],
        "f array<string>, r array<string>",
    )
    f, r = F.col("f"), F.col("r")
    got = rows.select(metrics.reciprocal_rank(f, r), metrics.recall_at(3, f, r), metrics.precision_at(3, f, r), metrics.hit(f, r)).collect()
    assert [x[0] for x in got] == [1.0, 0.5, 0.0, 1.0, 0.0, 0.0]
    assert [round(x[1], 6) for x in got] == [1.0, 1.0, 0.0, 0.666667, 0.0, 0.0]
    assert [round(x[2], 6) for x in got] == [0.333333, 0.333333, 0.0, 0.666667, 0.0, 0.0]
    assert [x[3] for x in got] == [1.0, 1.0, 0.0, 1.0, 0.0, 0.0]


def test_precision_counts_what_there_is(spark):
    row = spark.sql("SELECT array('d1', 'd2') AS f, array('d1') AS r").select(metrics.precision_at(5, F.col("f"), F.col("r"))).first()
    assert row[0] == 0.5


def test_strict_metrics(spark):
    rows = spark.createDataFrame([(["a"], ["a"], [0.5]), (["a"], [], [0.7])], "retrieved_ids array<string>, relevant_ids array<string>, scores array<double>")
    strict, loose = metrics.retrieval_metrics(rows).first(), metrics.retrieval_metrics(rows, strict=False).first()
    assert (strict.mrr, loose.mrr) == (0.5, 1.0)
    assert abs(strict.avg_score - 0.6) < 1e-12
    empty = metrics.retrieval_metrics(rows.limit(0)).first()
    assert (empty.mrr, empty.avg_score, empty.num_queries) == (0.0, 0.0, 0)


CHECKED = [
    ("The course SE 201 has 5 ECTS [c1].", 1.0, True),
    ("I could not find it.", 1.0, True),
    ("A plain sentence.", 0.4, False),
    ("SE 999 is a course [zz].", 0.0, False),
    ("SE 201 is good. MATH 900 too [c1].", 0.7, True),
]


def test_grounding(spark):
    rows = spark.createDataFrame([(i, a, [("c1", "SE 201 carries 5 ECTS")]) for i, (a, _, _) in enumerate(CHECKED)], "i int, answer string, sources array<struct<chunk_id: string, text: string>>")
    got = {r.i: (round(r.grounding_score, 6), r.is_grounded) for r in grounding.check_answers(rows).collect()}
    assert got == {i: (s, g) for i, (_, s, g) in enumerate(CHECKED)}


def test_codes(spark):
    row = spark.sql("SELECT 'Take SE 201, CE100 and EEE  301 but not X 12 or ABCDE 123' AS t").select(grounding.course_codes(F.col("t"))).first()
    assert row[0] == ["SE 201", "CE 100", "EEE 301"]
    parts = spark.sql("SELECT 'SEST 400' AS c").select(grounding.code_prefix(F.col("c")), grounding.code_number(F.col("c"))).first()
    assert tuple(parts) == ("SEST", 400)


def test_trap_and_answers(spark):
    rows = spark.createDataFrame(
        [("It was not found", True, [], True, 1.0, 0, 0), ("Of course", True, [], False, 0.4, 2, 1), ("SE 201", False, ["se 201", "CE 1"], True, 0.8, 0, 0)],
        "answer string, is_trap boolean, expected_codes array<string>, is_grounded boolean, grounding_score double, n_citations int, n_valid int",
    )
    m = metrics.answer_metrics(rows).first()
    assert (m.trap_accuracy, m.hallucination_rate, m.answer_completeness, m.citation_accuracy, round(m.grounding_rate, 6)) == (0.5, 0.5, 0.5, 0.5, 0.666667)
    empty = metrics.answer_metrics(rows.limit(0)).first()
    assert (empty.trap_accuracy, empty.hallucination_rate, empty.answer_completeness, empty.grounding_rate) == (1.0, 0.0, 1.0, 0.0)


ASKED = [
    ("What is in the first semester?", 1, "none", "semantic"),
    ("semester 9 courses and semester two", None, "none", "semantic"),
    ("the 4 semester plan", 4, "none", "semantic"),
    ("Mandatory courses in semester 3 for SE", 3, "none", "mandatory"),
    ("How many courses have 5 ECTS", None, "count", "counting"),
    ("How many SE courses are there?", None, "none", "semantic"),
    ("total ECTS of year 2", None, "sum_ects", "semantic"),
    ("How many courses are in the electrical and electronics engineering department", None, "count", "semantic"),
]


def test_questions(spark):
    rows = spark.createDataFrame([(i, q) for i, (q, *_) in enumerate(ASKED)], "i int, q string")
    q = F.col("q")
    got = {r.i: (r.s, r.k, r.r) for r in rows.select("i", questions.semester_asked(q).alias("s"), questions.question_kind(q).alias("k"), questions.route(q).alias("r")).collect()}
    assert got == {i: tuple(w) for i, (_, *w) in enumerate(ASKED)}


def test_quirks_have_a_switch(spark):
    row = spark.sql("SELECT 'How many courses in semester 2' AS q")
    q = F.col("q")
    got = row.select(questions.asked_prefix(q), questions.asked_prefix(q, strict=False), questions.asked_type(q), questions.asked_type(q, strict=False), questions.asked_semester(q)).first()
    assert tuple(got) == ("MANY", None, "technical", None, 2)


def test_counted_measures_equal_those_of_arrays(spark):
    import random

    rng = random.Random(2)
    rows = [(q, rng.sample("abcdefghijkl", rng.randint(0, 12)), rng.sample("abcdefghijklmn", rng.randint(1, 6))) for q in range(40)]
    df = spark.createDataFrame(rows, "query_id long, found array<string>, relevant array<string>")
    f, r = F.col("found"), F.col("relevant")
    values = {"rr": metrics.reciprocal_rank(f, r), "hit": metrics.hit(f, r)} | {f"recall_{k}": metrics.recall_at(k, f, r) for k in metrics.RECALLS} | {f"precision_{k}": metrics.precision_at(k, f, r) for k in metrics.PRECISIONS}
    want = {x.query_id: x.asDict() for x in df.select("query_id", *(c.alias(n) for n, c in values.items())).collect()}
    hits = df.select("query_id", "relevant", F.posexplode("found").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), (F.col("rank") / 10).alias("score"), F.array_contains("relevant", F.col("x")).alias("is_relevant"))
    measured = metrics.ranked_measures(hits, df.select("query_id", F.size("relevant").alias("n_relevant")))
    got = {x.query_id: x.asDict() for x in measured.collect()}
    assert all(abs(got[q][k] - v) < 1e-12 for q, w in want.items() for k, v in w.items()) and len(got) == 40
    whole = metrics.retrieval_metrics(df.select(f.alias("retrieved_ids"), r.alias("relevant_ids"), F.transform(f, lambda x, i: i / 10).alias("scores"))).first().asDict()
    mean = metrics.mean_measures(measured).first().asDict()
    assert all(abs(mean[k] - v) < 1e-12 for k, v in whole.items())
