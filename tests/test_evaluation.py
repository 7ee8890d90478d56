import json

from lectern import __main__ as cli
from lectern.operators import vectors
from lectern.plans import evaluation


def chunks(spark):
    rows = [(1, "c1", "SE 201 teaches data structures and trees.", "SE 201", "A", "se"), (2, "c2", "CE 100 is about circuits and current.", "CE 100", "B", "ce")]
    return vectors.hash_embedding(spark.createDataFrame(rows, "pos long, chunk_id string, text string, course_code string, course_title string, department string"))


def test_run(spark):
    questions = spark.createDataFrame(
        [(1, "data structures and trees", ["SE 201"], False), (2, "mandatory courses in semester 3 for se", [], False), (3, "", [], True)], "id long, question string, expected_course_codes array<string>, is_trap boolean"
    )
    got = {r.query_id: r for r in evaluation.run(questions, chunks(spark), threshold=0.1).collect()}
    assert got[1].retrieved_ids[0] == "SE 201" and "[c1]" in got[1].answer and got[1].is_grounded
    assert got[2].route == "mandatory"
    assert got[3].retrieved_ids == [] and got[3].trap_handled and got[3].doubtful
    m = evaluation.measures(evaluation.run(questions, chunks(spark), threshold=0.1), strict=False).first()
    assert (m.mrr, m.hit_rate, m.trap_accuracy, m.num_questions) == (1.0, 1.0, 1.0, 3)
    assert evaluation.plain_questions(questions.select("id", "question")).count() == 3


def test_catalog_questions_and_departments(spark):
    """Catalog courses are the retrieved codes with score 1, grounded by definition; other questions stay within their departments."""
    courses = spark.createDataFrame(
        [(1, "se", "SE 302", "B", 6.0, "mandatory", 5), (2, "se", "SE 301", "A", 5.0, "mandatory", 5), (3, "ce", "CE 301", "C", 5.0, "mandatory", 5), (4, "se", "SE 310", "D", 4.0, "technical_elective", 5)],
        "pos long, department string, course_code string, course_title string, ects double, course_type string, semester int",
    )
    questions = spark.createDataFrame(
        [
            (1, "mandatory courses in semester 5 for software engineering", ["SE 301", "SE 302"], False, "factual", None, None),
            (2, "mandatory courses in semester 7 for software engineering", [], False, "factual", None, None),
            (3, "circuits and current", ["SE 201"], False, "factual", "se", None),
            (4, "circuits and current", ["CE 100"], False, "comparison", "se", ["ce", "ie"]),
            (5, "circuits and current", ["CE 100"], False, "factual", None, ["se"]),
        ],
        "id long, question string, expected_course_codes array<string>, is_trap boolean, question_type string, target_department string, target_departments array<string>",
    )
    got = {r.query_id: r for r in evaluation.run(questions, chunks(spark), courses=courses).collect()}
    assert got[1].retrieved_ids == ["SE 301", "SE 302"] and got[1].scores == [1.0, 1.0] and "SE 301" in got[1].answer
    assert (got[1].is_grounded, got[1].grounding_score, got[1].n_citations, got[1].n_valid, got[1].doubtful) == (True, 1.0, 2, 2, False)
    assert got[2].retrieved_ids == [] and got[2].is_grounded and got[2].n_citations == 0
    assert got[3].retrieved_ids == ["SE 201"] and got[4].retrieved_ids == ["CE 100"] and sorted(got[5].retrieved_ids) == ["CE 100", "SE 201"]
    m = evaluation.measures(evaluation.run(questions, chunks(spark), courses=courses)).first()
    assert m.hit_rate == 0.8 and m.num_questions == 5


def test_evaluation_record(spark, tmp_path):
    """One JSON object of a run: metadata, config, measures in two groups, and every question."""
    from lectern.sources import readers

    questions = spark.createDataFrame([(2, "data structures and trees", ["SE 201"], False), (1, "", [], True)], "id long, question string, expected_course_codes array<string>, is_trap boolean")
    results = evaluation.run(questions, chunks(spark))
    readers.save_evaluation_record(results, evaluation.measures(results), str(tmp_path / "r"), 1.234, "2024-01-01T00:00:00", {"top_k": "10"})
    record = json.loads(spark.read.text(str(tmp_path / "r"), wholetext=True).first()[0])
    assert list(record) == ["metadata", "config", "metrics", "question_results"]
    assert record["metadata"] == {"timestamp": "2024-01-01T00:00:00", "num_questions": 2, "duration_seconds": 1.23} and record["config"] == {"top_k": "10"}
    assert record["metrics"]["retrieval"]["num_queries"] == 2 and record["metrics"]["answer"]["num_questions"] == 2
    first, second = record["question_results"]
    assert (first["question_id"], first["is_trap"], second["retrieved_course_codes"][0], second["error"]) == (1, True, "SE 201", None)


def test_command_line(spark, tmp_path, capsys):
    docs = spark.createDataFrame([(1, "Data structures and trees are taught here. " * 40), (2, "Circuits and current are measured in the lab. " * 40)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    cli.main(["index", str(tmp_path / "docs"), str(tmp_path / "index")])
    capsys.readouterr()
    cli.main(["ask", str(tmp_path / "index"), "structures and trees", "-k", "2"])
    found = json.loads(capsys.readouterr().out)
    assert "trees" in found[0]["text"]
    cli.main(["info", str(tmp_path / "index")])
    assert "all" in capsys.readouterr().out
    (tmp_path / "q.jsonl").write_text('{"id": "a", "question": "circuits and current", "expected_course_codes": [], "is_trap": false}\n')
    cli.main(["evaluate", str(tmp_path / "index"), str(tmp_path / "q.jsonl")])
    assert json.loads(capsys.readouterr().out)["num_questions"] == 1


def test_copies_are_searched_once(spark, monkeypatch):
    """Repeated questions and chunks find what they would find one by one, while the search gets each distinct text and vector once."""
    from pyspark.sql import functions as F

    base = chunks(spark)
    many = base.crossJoin(spark.range(30)).withColumn("pos", F.col("id") * 2 + F.col("pos")).withColumn("chunk_id", F.concat(F.lit("c"), F.col("pos"))).drop("id")
    rows = [(i, "structures and circuits" if i % 2 else "trees", "se" if i % 3 == 0 else None) for i in range(1, 13)] + [(13, None, None)]
    questions = spark.createDataFrame(rows, "id long, question string, target_department string")
    seen = []
    whole = vectors.batch_top_k
    monkeypatch.setattr(vectors, "batch_top_k", lambda v, q, *a, **kw: seen.append((v.count(), q.count())) or whole(v, q, *a, **kw))
    got = {(r.query_id, r["rank"]): (r.pos, r.score) for r in evaluation.retrieve(questions, many, 7).collect()}
    assert seen == [(2, 3)]
    one = vectors.embed(questions.select(F.col("id").alias("query_id"), F.col("question").alias("text"), "target_department"))
    scored = one.crossJoin(many.select("pos", "department", F.col("embedding").alias("v"))).filter("target_department IS NULL OR target_department = department")
    plain = {}
    for r in sorted(scored.select("query_id", "pos", F.round(vectors.cosine(F.col("embedding"), F.col("v")), 9).alias("s")).collect(), key=lambda r: (-r.s, r.pos)):
        plain.setdefault(r.query_id, []).append((r.pos, r.s))
    want = {(i, rank): hit for i, hits in plain.items() for rank, hit in enumerate([h for h in hits if h[1] >= 0][:7], 1)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want)


def test_measures_without_copies_of_answers(spark):
    """run_measures() gives the measures of run(): with repeated and missing codes, several expected ones or none, traps and empty answers."""
    courses = spark.createDataFrame(
        [(i, "se" if i % 2 else "ce", None if i % 7 == 0 else f"SE {300 + i % 5}", f"T {i} of se 30", 5.0 + i % 2, "mandatory", 5 + i % 3 // 2) for i in range(40)],
        "pos long, department string, course_code string, course_title string, ects double, course_type string, semester int",
    )
    asked = ["mandatory courses in semester 5 for software engineering", "mandatory courses in semester 7 for software engineering", "How many courses have exactly 6 ECTS?", "How many courses are offered in the software engineering department?", "circuits and current"]
    expected = [["SE 303"], ["SE 301", "SE 304", "SE 301", "XX 9"], [], None, ["SE 30", None], ["SE 201", "se 302"]]
    rows = [(i, asked[i % 5], expected[i % 6], i % 4 == 0) for i in range(60)]
    questions = spark.createDataFrame(rows, "id long, question string, expected_course_codes array<string>, is_trap boolean")
    want = evaluation.measures(evaluation.run(questions, chunks(spark), courses=courses)).first().asDict()
    got = evaluation.run_measures(questions, chunks(spark), courses=courses).first().asDict()
    assert list(got) == list(want) and {k: (got[k], want[k]) for k in want if abs(got[k] - want[k]) > 1e-12} == {}
    assert 0 < got["mrr"] < 1 and 0 < got["answer_completeness"] < 1


def test_all_questions_are_measured(spark, sf_dir):
    from lectern.plans import catalogue

    assert catalogue.queries()["evaluate_measures"](spark, sf_dir).first().num_questions == spark.read.parquet(f"{sf_dir}/part.parquet").count()
