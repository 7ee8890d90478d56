import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.functions import chunking, cleaning, grounding, metrics
from lectern.operators import context, lookup, store, vectors
from lectern.sources import html, pages, readers

COURSE = "course_id string, course_code string, course_title string, department string, semester int, ects double, objectives string, description string, weekly_topics array<string>, learning_outcomes array<string>"


def test_course_chunks(spark):
    """Every course has its course_info; sections get a heading and the course before them, lists become lines."""
    weeks = [f"topic {i} with some words" for i in range(8)]
    text = "First sentence here. " * 80
    rows = [("c1", "SE 201", "Data", "se", 3, 6.0, "short aims", text, weeks, ["to know"]), ("c2", "CE 1", "Nothing", "ce", None, None, None, None, None, None)]
    got = {}
    for r in chunking.course_chunks(spark.createDataFrame(rows, COURSE)).collect():
        got.setdefault((r.course_id, r.section_name), []).append(r)
        assert r.text_hash == hashlib.sha256(r.text.encode()).hexdigest() and r.chunk_id == f"{r.course_id}_{r.section_name}_{r.chunk_index}_{r.text_hash[:8]}"
    assert set(got) == {("c1", "course_info"), ("c1", "description"), ("c1", "weekly_topics"), ("c2", "course_info")}
    assert got["c2", "course_info"][0].text == "Course Code: CE 1\nCourse Title: Nothing\nDepartment: CE\nPrerequisites: None"
    assert got["c1", "course_info"][0].text.endswith("ECTS Credits: 6.0\nPrerequisites: None\nObjectives: short aims")
    head = "Course: SE 201 - Data\n\n"
    want = [x.strip() for x in chunking.chunks_of(f"{head}Course Description\n\n{text}", 1000, 200, 100)]
    assert [r.text for r in sorted(got["c1", "description"], key=lambda r: r.chunk_index)] == want and len(want) > 1
    assert got["c1", "weekly_topics"][0].text == head + "Weekly Topics\n\n" + "\n".join(f"Week {i + 1}: {w}" for i, w in enumerate(weeks))


def catalog_of(spark):
    rows = [(i, "se" if i % 2 else "ce", f"SE {100 + i % 30}", f"Title {i}", 5.0 + i % 2, "mandatory" if i % 3 else "elective", i % 8 + 1) for i in range(60)]
    return spark.createDataFrame(rows, "pos long, department string, course_code string, course_title string, ects double, course_type string, semester int")


def test_lookups(spark):
    asked = ["Mandatory courses in semester 2 for software engineering", "How many courses have a course code starting with SE", "How many courses have exactly 9 ECTS?", "How many courses are offered in the computer engineering department?", "Who teaches it?", "How many courses have a course code starting with SE"]
    got = {r.id: r for r in lookup.lookups(spark.createDataFrame(list(enumerate(asked)), "id int, question string"), catalog_of(spark)).collect()}
    assert set(got) == {0, 1, 2, 3, 5}
    assert got[0].route == "mandatory" and got[0].context.startswith("MANDATORY COURSES FOR SOFTWARE ENGINEERING - SEMESTER 2\nTotal: ") and got[0].context.count("\n- ") == got[0].n > 0
    assert got[1].n == 30 and got[1].context.endswith("- SE 119: Title 19\n... and 10 more") and got[5].context == got[1].context
    assert got[2].n == 0 and got[2].context == "COURSES WITH 9 ECTS CREDITS\nTotal unique courses: 0"
    assert got[3].context == "COURSES IN DEPARTMENT\nTotal: 30\nMandatory: 20\nElective: 10"


def test_course_hits(spark):
    rows = spark.createDataFrame([("se", "SE 1", "T", 6.0, 2, "mandatory", "x" * 300, "2021-2022"), (None, None, None, None, None, None, None, None)], "department string, course_code string, course_title string, ects double, semester int, course_type string, objectives string, year_range string")
    a, b = lookup.course_hits(rows).orderBy(F.desc("course_code")).collect()
    assert a.chunk_id == "se_se_1_2021_2022_course_info_0" and a.text == "SE 1 - T\nECTS: 6.0\nSemester: 2\nType: mandatory\nObjectives: " + "x" * 200
    assert b.chunk_id == "unknown_unknown_2020_2024_course_info_0" and b.text == ""


def test_quantitative_texts(spark):
    texts = [("SE 101 is mandatory, 6 ECTS", "se", 1), ("CE 202 and CE 203 are elective, 4 ECTS", "ce", 3), ("SE 101 again, EEE 5", "se", 2), ("IE 300 is required", "", None)]
    questions = ["How many classes?", "total ects of all", "breakdown of classes", "compare the number of courses total", "List all classes", "Hello"]
    hits = spark.createDataFrame([(q, p, f"k{p}", t, d, s) for q in range(6) for p, (t, d, s) in enumerate(texts)], "query_id int, pos int, chunk_id string, text string, department string, semester int")
    got = {r.id: r for r in lookup.quantitative_results(spark.createDataFrame(list(enumerate(questions)), "id int, question string"), hits).collect()}
    assert got[0].formatted == "Found 4 courses\n  - SE 101 (6.0 ECTS) Sem 1 [required] [k0]\n  - CE 202 (4.0 ECTS) Sem 3 [elective] [k1]\n  - CE 203 (4.0 ECTS) Sem 3 [elective] [k1]\n  - IE 300 [required] [k3]"
    assert got[1].formatted.startswith("Total ECTS: 14.0\nCourses included (4):\n  - SE 101: 6.0 ECTS [k0]") and got[1].formatted.endswith("  - IE 300: ECTS unknown [k3]")
    assert got[2].groups == {"0": 1, "1": 1, "3": 2} and got[2].formatted.startswith("Course breakdown by semester:\n\nUnknown semester (1 courses):\n  - IE 300 [k3]\n\nSemester 1 (1 courses):")
    assert got[3].groups == {"CE": 2, "SE": 1, "UNKNOWN": 1} and got[3].formatted.startswith("Course comparison by department:\n\nCE: 2 courses\n  - CE 202\n  - CE 203")
    assert got[4].formatted.startswith("Listing 4 courses") and (got[5].kind, got[5].n_courses, got[5].formatted) == ("none", 0, "")


def test_prompts(spark):
    questions = spark.createDataFrame([(1, "how?"), (2, "why?")], "query_id int, question string")
    parts = spark.createDataFrame([(1, "ce", "B"), (1, "se", "A")], "query_id int, department string, context string")
    got = {r.query_id: r.prompt for r in context.comparison_prompts(questions, parts, ["se", "ce"]).collect()}
    assert got[1] == "Sources by department:\nA\n\nB\n\nComparison question: how?" and "No relevant sources" in got[2]
    data = {r.query_id: r.prompt for r in context.quantitative_prompts(questions, spark.createDataFrame([(1, "Found 3")], "query_id int, formatted string")).collect()}
    assert data[1] == "Course data:\nFound 3\n\nQuestion: how?" and data[2].startswith("Course data:\n\n")


def test_record_cleaning(spark):
    rows = [(" se 101 ", "<b></b>", "SE ", "A&amp;B <i>ﬁne</i> text", " ", ["<b>one</b> &amp; all the rest", "x"]), (None, None, None, None, None, None)]
    got = cleaning.clean_courses(spark.createDataFrame(rows, "course_code string, course_title string, department string, objectives string, description string, weekly_topics array<string>")).collect()
    r = next(r for r in got if r.course_code)
    assert (r.course_code, r.course_title, r.department, r.objectives, r.description, r.weekly_topics) == ("SE 101", "<b></b>", "se", "A&B fine text", None, ["one & all the rest"])


def test_grounding_helpers(spark):
    rows = spark.createDataFrame([(1, "SE 101 has 6 ECTS [a].", [("a", "se  101 is 6 ECTS")]), (2, "Maybe.", [("a", "x")])], "id int, answer string, sources array<struct<chunk_id: string, text: string>>")
    got = {r.id: r for r in grounding.grounded_by_score(rows.withColumn("known", grounding.course_exists(F.lit("se 101"), F.col("sources")))).collect()}
    assert got[1].grounded and got[1].known and not got[2].grounded and not got[2].known
    text = {r.id: r.t for r in grounding.check_answers(rows).select("id", grounding.feedback().alias("t")).collect()}
    assert text[1].startswith("✓ Grounded (Score: 1.00)\nCitations: 1/1 valid") and text[2].startswith("✗ Not Grounded")


def test_embeddings_by_name(spark):
    rows = spark.createDataFrame([(1, "some words")], "id int, text string")
    assert len(vectors.embed(rows).first().embedding) == 64 == len(vectors.embed(rows, " HASH ").first().embedding)
    with pytest.raises(ValueError, match="unknown embedding provider"):
        vectors.provider("other")


def test_batch_search_in_blocks_and_slices(spark, monkeypatch):
    """The same rows for any size of blocks and slices; equal scores go by key."""
    rows = spark.createDataFrame([(i, i % 3, [float(i % 5 - 2), float(i % 7 - 3)]) for i in range(120)], "vec_id long, label int, embedding array<double>")
    asked = rows.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    found = lambda **k: sorted(map(tuple, vectors.batch_top_k(rows, asked, 4, **k).select("query_id", "vec_id", "rank").collect()))
    want = found(), found(group="label"), found(skip_self=True)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    monkeypatch.setattr(vectors, "SLICE", 17)
    assert (found(), found(group="label"), found(skip_self=True)) == want
    assert len(want[0]) == 48 and len(want[1]) == 144 and not any(q == v for q, v, _ in want[2])


def test_question_bank_and_results(spark, tmp_path):
    bank = spark.createDataFrame([("q1", "a?"), ("q2", "b?")], "id string, question string")
    assert readers.save_questions(bank, str(tmp_path / "bank")) == 2
    back = spark.read.json(str(tmp_path / "bank")).first()
    assert back["count"] == 2 and {q.id for q in back.questions} == {"q1", "q2"}
    assert {q.id for q in readers.read_questions(spark, str(tmp_path / "bank")).collect()} == {"q1", "q2"}
    more = readers.add_questions(bank, spark.createDataFrame([("q2", "c?"), ("q3", "d?")], "id string, question string"))
    # a question with a known id stands beside the first, and is the one that is found and removed
    assert sorted((r.id, r.question) for r in more.collect()) == [("q1", "a?"), ("q2", "b?"), ("q2", "c?"), ("q3", "d?")]
    assert readers.get_question(more, "q2").first().question == "c?"
    assert readers.get_question(readers.remove_questions(more, ["q2"]), "q2").first().question == "b?"
    assert readers.get_question(readers.add_questions(more, more.filter("id = 'q1'").selectExpr("id", "'e?' AS question")), "q1").first().question == "e?"
    assert readers.remove_questions(more, ["q1"]).count() == 3 and readers.get_question(more, "q3").first().question == "d?"
    results = spark.createDataFrame([(1, [0.123456] * 12, 0.98765)], "query_id long, scores array<double>, grounding_score double")
    measures = spark.createDataFrame([(0.123456, 7)], "mrr double, num_queries long")
    assert readers.save_evaluation(results, measures, str(tmp_path / "eval"), name="x") == 1
    r = spark.read.json(str(tmp_path / "eval/results")).first()
    assert r.scores == [0.1235] * 10 and r.grounding_score == 0.988 and spark.read.json(str(tmp_path / "eval/metrics")).first().mrr == 0.1235
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.jsonl").write_text('{"course_code": "A"}\nbroken\n')
    (tmp_path / "c/b.json").write_text('[{"course_code": "B"}, {"course_code": "C"}]')
    assert {x.course_code for x in readers.read_courses(spark, str(tmp_path / "c"), "course_code string").collect()} == {"A", "B", "C"}
    assert len(metrics.summary(spark.createDataFrame([(0.5, 0.5, 0.5, 3, 0.5, 0.5, 0.5)], "mrr double, recall_at_5 double, hit_rate double, num_queries long, grounding_rate double, trap_accuracy double, answer_completeness double")).first().summary.split("\n")) == 9


def test_files_go_and_have_hashes(spark, tmp_path):
    rows = spark.createDataFrame([("http://a.b/1", "x", 200), ("http://a.b/2", "y", 200), ("http://c.d/", "z", 500)], "url string, html string, status_code int")
    path = str(tmp_path / "cache")
    pages.write_cache(rows, path)
    assert pages.clear_cache(spark, path, "http://a.b/1") == 1 and spark.read.parquet(path).count() == 1
    assert pages.clear_cache(spark, path) == 1 and pages.clear_cache(spark, path) == 0
    (tmp_path / "f.txt").write_text("text")
    assert store.file_hashes(spark, str(tmp_path / "f.txt"), 16).first().hash == hashlib.sha256(b"text").hexdigest()[:16]
    store.save_manifest(spark, str(tmp_path / "m"), {"dataset_version": "v"})
    assert store.delete_manifest(spark, str(tmp_path / "m"), "v") and not store.delete_manifest(spark, str(tmp_path / "m"), "v")


def test_absolute_links(spark):
    from urllib.parse import urljoin

    links = ["/a", "b/c", "../up", "?q=1", "#top", "//h.org/x", "https://other/y", "./d", "b/c"]
    page = "".join(f'<a href="{x}">' for x in links)
    for base in ("http://x.org/p/q/r.html?z=1", "http://x.org"):
        got = spark.createDataFrame([(page, base)], "html string, url string").select(html.absolute_links(F.col("html"), F.col("url")).alias("l")).first().l
        want = list(dict.fromkeys(urljoin(base, x) for x in links))
        if base != "http://x.org":
            assert got == want
        assert len(got) == len(want)


def test_pages_are_read_through_the_cache(spark, tmp_path):
    urls = spark.createDataFrame([("http://a.b/1",), ("http://a.b/2",), ("http://bad/",)], "url string").coalesce(1)
    path = str(tmp_path / "pages")

    def get(url, timeout):
        if "bad" in url:
            raise OSError("no such host")
        return 200, f"page of {url}"

    first = {r.url: r for r in pages.read_through(urls, path, 3, gap=0.0, attempts=1, get=get).collect()}
    assert first["http://a.b/1"].html == "page of http://a.b/1" and first["http://bad/"].status_code == 0

    def broken(url, timeout):
        raise OSError("offline")

    again = {r.url: r for r in pages.read_through(urls, path, 3, gap=0.0, attempts=1, get=broken).collect()}
    assert again["http://a.b/2"].html == "page of http://a.b/2" and again["http://bad/"].error == "offline"


def test_answers_are_made_once_for_all_that_ask(spark):
    """Columns made of an answer are made before it joins its questions, where they are copies otherwise."""
    questions = spark.createDataFrame([(i, "Mandatory courses in semester 1 for software engineering" if i % 2 else "ie semester 2 mandatory") for i in range(6)], "id long, question string")
    courses = spark.createDataFrame([(1, "se", "SE 1", "a", 6.0, "mandatory", 1), (2, "se", "SE 2", "b", 5.0, "mandatory", 1)], "pos long, department string, course_code string, course_title string, ects double, course_type string, semester int")
    got = lookup.mandatory_lookups(questions, courses, lambda: [F.md5("context").alias("h")])
    whole = {r.id: (r.n, r.h) for r in lookup.mandatory_lookups(questions, courses).select("id", "n", F.md5("context").alias("h")).collect()}
    assert got.columns == ["id", "semester", "department", "n", "h"] and {r.id: (r.n, r.h) for r in got.collect()} == whole and len(whole) == 6
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("md5(")
