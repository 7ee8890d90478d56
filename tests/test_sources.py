import datetime
import json

from pyspark.sql import functions as F

from lectern.operators import context, sampling, store
from lectern.sources import html, pages, readers
from lectern.streaming import flows

CURRICULUM = """
<table class="curr"><tr><td class="title">2. Year Spring Semester</td></tr><tr class="head"><td>Code</td><td>P</td><td>Name</td><td>T</td><td>A</td><td>LC</td><td>ECTS</td></tr>
<tr><td><a href="/syl?course_code=SE+202">SE 202</a></td><td></td><td>Data &amp; Things</td><td>3</td><td>0</td><td>3</td><td>6</td>
<tr><td>ELEC 001</td><td>Elective</td><td>3</td><td>3</td><td>5</td></tr><tr><td>POOL 1</td><td>x</td><td>1</td><td>1</td><td>1</td></tr>
<tr><td>SE 202</td><td>again</td><td>3</td><td>3</td><td>5</td></tr><tr><td>Total</td><td></td><td></td><td>6</td><td>11</td></tr></table>
<table class="curr elective"><tr><td>SE 400</td><td>Opt</td><td>3</td><td>n/a</td><td>4.5</td></tr></table>
"""
DETAIL = """
<span id="course_name">Data &amp; Things</span><div id="pre_requisites">SE 101</div>
<table class="transpose"><tr><th>Theory</th><th>Local Credits</th><th>ECTS</th></tr><tr><td>3</td><td>3</td><td>7</td></tr></table>
<ul id="outcome"><li>to know<li>to do</ul><table id="weeks"><tr><td>1</td><td>Intro</td></tr><tr><td>x</td><td>y</td></tr></table>
<table id="evaluation_table1"><tr><td>Midterm</td><td>1</td><td>40</td></tr><tr><td>Quiz</td><td>-</td><td>-</td></tr><tr><td>Final</td><td>1</td><td>60</td></tr></table>
"""


def test_curriculum_and_details(spark):
    base = "http://x.org/cur"
    courses = html.parse_curricula(spark.createDataFrame([(base, CURRICULUM), ("http://x.org/bad", "<table><tr><td>"), ("http://x.org/none", None)], "url string, html string"))
    got = {r.course_code: r for r in courses.collect()}
    assert set(got) == {"SE 202", "ELEC 001", "SE 400"}
    a = got["SE 202"]
    assert (a.course_title, a.semester, a.course_type, a.local_credits, a.ects, a.href) == ("Data & Things", 4, "mandatory", 3.0, 6.0, "http://x.org/syl?course_code=SE+202")
    assert (got["ELEC 001"].course_type, got["ELEC 001"].semester) == ("technical_elective", None)
    assert (got["SE 400"].course_type, got["SE 400"].local_credits, got["SE 400"].ects) == ("technical_elective", None, 4.5)
    details = html.parse_details(spark.createDataFrame([(a.href, DETAIL)], "url string, html string"))
    d = details.first()
    assert (d.course_code, d.prerequisites, d.ects, d.learning_outcomes, d.weekly_topics, d.assessment) == ("SE 202", "SE 101", 7.0, ["to know", "to do"], ["Week 1: Intro"], "Midterm: 40%; Final: 60%")
    rich = {r.course_code: r for r in html.enrich(courses, details).collect()}
    assert (rich["SE 202"].ects, rich["SE 400"].ects, rich["SE 400"].prerequisites) == (7.0, 4.5, None)


def test_links_of_all_kinds(spark):
    """Either quote, any number of dot segments, as the standard library resolves them."""
    from urllib.parse import urljoin

    base = "http://x.org/a/b/c/d/e/f/page.html?q=1#top"
    links = ["../" * n + "z" for n in range(9)] + ["./y", ".", "..", "../", "a/./b/../c", "/r/../s?x=../y", "//h.org/../k", "https://o.org/a/../../b#c/../d", "?n=2", "#f", "plain", "mailto:a@b", "x/..", "deep/../../../../w/."]
    page = "".join(f"<a class='k' href={q}{x}{q}>t</a>" for i, x in enumerate(links) for q in ("'" if i % 2 else '"'))
    got = spark.createDataFrame([(page, base)], "html string, base string").select(html.absolute_links(F.col("html"), F.col("base")).alias("l")).first().l
    assert got == list(dict.fromkeys(urljoin(base, x) for x in links))


def test_curriculum_cases():
    """Defaults of headings, layouts by number of cells, electives by class, and rows that are no courses."""
    assert [html.semester_of(t) for t in ("3. Year Fall Semester", "3. Year Spring", "3. Year", "Spring", "2 year fall", "")] == [(3, 5), (3, 6), (3, 1), (1, 2), (2, 3), (1, 1)]
    cells = lambda *x: "<tr>" + "".join(f"<td>{c}</td>" for c in x) + "</tr>"
    page = (
        '<table class="curr"><tr><td class="title">3. Year</td></tr>'
        + cells("Kod", "", "Ders Adı", "", "", "", "")
        + cells("SE 1", "", "Course Name", "", "", "1", "2")
        + cells("SE 2", "", "", "3", "0", "3", "5")
        + cells("SE 3", "p", "Eight", "3", "0", "3", "5", "note")
        + cells("SE 4", "Six", "3", "0", "2", "4")
        + cells("SE 5", "Five", "3", "1.5", "x")
        + cells("TMD 1", "p", "Table", "3", "0", "3", "5")
        + cells("POOL 1", "p", "Pool", "3", "0", "3", "5")
        + cells('<a href="c?x=1">SE  6</a> (new)', "p", "Linked", "3", "0", "", "1.2.3")
        + '</table><table class="curr Electives">'
        + cells("TMD 2", "p", "Other", "3", "0", "3", "5")
        + cells("SE 4", "again", "3", "0", "2", "4")
        + "</table>"
    )
    assert html.curriculum_rows(page, "http://x.org/a/") == [
        (0, "SE 3", "Eight", 1, "mandatory", 3.0, 5.0, None),
        (1, "SE 4", "Six", 1, "mandatory", 2.0, 4.0, None),
        (2, "SE 5", "Five", 1, "mandatory", 1.5, None, None),
        (3, "TMD 1", "Table", None, "non_technical_elective", 3.0, 5.0, None),
        (4, "SE 6", "Linked", 1, "mandatory", None, None, "http://x.org/a/c?x=1"),
        (5, "TMD 2", "Other", None, "technical_elective", 3.0, 5.0, None),
    ]


def test_cache_and_fetch(spark, tmp_path):
    urls = spark.createDataFrame([("http://a.org/1",), ("http://a.org/2",), ("http://b.org/x",)], "url string")

    def get(url, timeout):
        if url.endswith("/2"):
            raise OSError("gone")
        return (404 if "b.org" in url else 200), "<p>page</p>"

    fetched = pages.fetch(urls, gap=0.0, attempts=2, get=get).cache()
    got = {r.url: (r.status_code, r.html, r.error) for r in fetched.collect()}
    assert got == {"http://a.org/1": (200, "<p>page</p>", None), "http://a.org/2": (0, "", "gone"), "http://b.org/x": (404, "<p>page</p>", None)}
    pages.write_cache(fetched, str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    assert [r.url for r in cache.collect()] == ["http://a.org/1"]
    assert {r.url for r in pages.to_fetch(urls, cache, 30).collect()} == {"http://a.org/2", "http://b.org/x"}
    assert pages.to_fetch(urls, cache, 0).count() == 3
    assert pages.fetch_stats(fetched).first().failed == 1


def test_gaps_hold_per_host(spark, tmp_path):
    """Two hosts over many partitions: each keeps its gap, and one does not wait for the other."""
    log = str(tmp_path / "asked")

    def get(url, timeout):
        import time

        with open(log, "a") as f:
            f.write(f"{url} {time.time()}\n")
        if url.endswith("bad"):
            raise OSError("no")
        return 200, "x"

    hosts = {"http://a.org": 5, "http://b.org": 4}
    urls = spark.createDataFrame([(f"{h}/{i}",) for h, n in hosts.items() for i in range(n)] + [("http://b.org/bad",)], "url string").repartition(7)
    got = pages.fetch(urls, gap=0.3, attempts=2, get=get).collect()
    assert len(got) == 10 and sorted(r.url for r in got if r.status_code == 0) == ["http://b.org/bad"]
    asked = [(x.split()[0], float(x.split()[1])) for x in open(log)]
    assert len(asked) == 11
    spans = []
    for h in hosts:
        times = sorted(t for u, t in asked if u.startswith(h))
        assert all(b - a > 0.28 for a, b in zip(times, times[1:], strict=False))
        spans.append((times[0], times[-1]))
    assert max(a for a, _ in spans) < min(b for _, b in spans)


def test_read_through_and_scrape_command(spark, tmp_path, capsys):
    """A small server is asked once for each page; a second run comes from the cache; the command tells its rates."""
    import http.server
    import threading

    from lectern import __main__ as cli

    asked = []

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append(self.path)
            self.send_response(200 if self.path != "/gone" else 404)
            self.end_headers()
            self.wfile.write(b"<p>page</p>")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    urls = spark.createDataFrame([(f"{base}/1",), (f"{base}/2",), (f"{base}/2",), (f"{base}/gone",)], "url string")
    cache = str(tmp_path / "cache")
    first = pages.read_through(urls, cache, 30, gap=0.0, attempts=1)
    assert {r.url[len(base) :]: r.status_code for r in first.collect()} == {"/1": 200, "/2": 200, "/gone": 0} and first.count() == 3
    assert sorted(asked) == ["/1", "/2", "/gone"]
    (tmp_path / "urls.txt").write_text(f"{base}/1\n\n{base}/3\n")
    cli.main(["scrape", str(tmp_path / "urls.txt"), cache, str(tmp_path / "out")])
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1]) == {"pages": 2, "succeeded": 2, "failed": 0, "success_rate": 1.0}
    assert asked[3:] == ["/3"]
    server.shutdown()


def test_json(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_jsonl(spark, str(path), "a int").collect()) == [1, 2]
    rows = spark.createDataFrame([(1,), (2,)], "a int")
    assert readers.write_jsonl(rows, str(tmp_path / "out")) == 2
    assert readers.write_jsonl(rows, str(tmp_path / "out"), append=True) == 2
    assert readers.read_jsonl(spark, str(tmp_path / "out"), "a int").count() == 4


def test_questions(spark, tmp_path):
    whole = tmp_path / "q.json"
    whole.write_text(json.dumps({"questions": [{"id": "x", "question": "Q?"}, {"question": "R?"}]}))
    got = {r.question: r.id for r in readers.read_questions(spark, str(whole)).collect()}
    assert got["Q?"] == "x" and got["R?"].startswith("q_") and len(got["R?"]) == 10
    listed = tmp_path / "l.json"
    listed.write_text(json.dumps([{"id": "a", "question": "S?"}]))
    assert [r.id for r in readers.read_questions(spark, str(listed)).collect()] == ["a"]
    yaml = tmp_path / "q.yaml"
    yaml.write_text("questions:\n- {id: A1, category: A, department_scope: [SE], mode: single, query: 'What?', expected_numeric_answer: 5}\n- {id: E1, category: E, department_scope: ['ALL'], mode: trap, query: 'Trap?'}\n")
    got = {r.id: r for r in readers.read_questions(spark, str(yaml)).collect()}
    assert (got["A1"].question_type, got["A1"].target_department, got["A1"].expected_answer, got["A1"].is_trap) == ("factual", "se", "5", False)
    assert (got["E1"].is_trap, got["E1"].target_department, got["E1"].target_departments) == (True, None, [])


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "s.yaml").write_text("top_k: 40\nthreshold: 0.15\n")
    monkeypatch.setenv("LECTERN_TOP_K", "7")
    s = readers.load_settings(str(tmp_path / "s.yaml"))
    assert (s.top_k, s.threshold, s.chunk_size) == (7, 0.15, 1000)


def test_store_and_manifest(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "c1", "se", "t1"), ("b", "c1", "ce", "t2")], "chunk_id string, course_id string, department string, text string")
    s = store.ChunkStore(spark, str(tmp_path / "index"))
    assert s.read() is None
    assert (s.add(chunks), s.add(chunks)) == (2, 0)
    assert s.delete(["a", "nope"]) == 2
    assert [r.chunk_id for r in s.read().collect()] == ["b"]
    assert s.lookup(["b"]).first().score == 1.0 and "text" not in s.metadata().columns
    s.clear()
    assert s.read() is None
    m = store.manifest_of(chunks, "hash", "h64", 64, "i", "c")
    store.save_manifest(spark, str(tmp_path / "manifests"), m)
    held = store.latest_manifest(store.load_manifests(spark, str(tmp_path / "manifests"))).first().asDict()
    assert held["total_chunks"] == 2 and held["departments"] == ["ce", "se"]
    version = store.dataset_version(chunks).first().version
    assert version == store.dataset_version(chunks.orderBy("text", ascending=False)).first().version != store.dataset_version(chunks.limit(1)).first().version
    assert store.dataset_version(chunks.limit(0)).first().version == "empty"
    assert store.rebuild_reason(held, True, version, "hash", "h64") is None
    assert store.rebuild_reason(held, True, "other", "hash", "h64") == "dataset_version changed"
    assert store.rebuild_reason(None, True, version, "hash", "h64") == "no manifest"


def test_sampling(spark):
    q = spark.range(100).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 5, "rare").otherwise("often").alias("question_type"))
    assert sampling.simple(q, 10).count() == 10
    filled = sampling.stratified(q, 20).groupBy("question_type").count().collect()
    assert {r.question_type: r["count"] for r in filled} == {"rare": 5, "often": 15}
    assert sampling.stratified(q, 20, refill=False).count() == 15


def test_context(spark):
    hits = spark.createDataFrame(
        [("q", 1, "c1", "SE 1", "A", "se", "objectives", 0.91234, "One. Two."), ("q", 2, "c2", "SE 2", "B", "se", None, 0.5, "Three.")],
        "query_id string, rank int, chunk_id string, course_code string, course_title string, department string, section_name string, score double, text string",
    )
    plain = context.contexts(hits).first().context
    assert plain == "--- Source 1 ---\n[c1]\nCourse: SE 1 - A\nDepartment: SE\nSection: objectives\nContent: One. Two.\n\n--- Source 2 ---\n[c2]\nCourse: SE 2 - B\nDepartment: SE\nContent: Three."
    text = context.contexts(hits, with_score=True).first().context
    assert text.startswith("--- Source 1 ---\n[c1]\nCourse: SE 1 - A\nDepartment: SE\nSection: objectives\nRelevance: 0.912\nContent: One. Two.\n\n--- Source 2 ---")
    assert context.contexts(hits, most=1).first().context.count("Source") == 1
    by = {r.department: r.context for r in context.department_contexts(hits, ["se", "ce"]).collect()}
    assert by["ce"] == "=== CE ===\nNo relevant sources found for this department."
    assert by["se"] == "=== SE ===\n" + plain
    assert context.extractive_answers(hits).first().answer == "One. [c1] Three. [c2]"
    asked = spark.createDataFrame([("q", "Why?", 0.9), ("z", "What?", None)], "query_id string, question string, top_score double")
    got = {r.query_id: r for r in context.prompts(asked, context.contexts(hits)).collect()}
    assert not got["q"].doubtful and got["z"].doubtful and "No relevant sources." in got["z"].prompt


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    folder = tmp_path / "events"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(folder))
    stream = flows.tumbling(flows.timed(flows.event_stream(spark, str(folder)), "3650 days"))
    stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    batch = flows.tumbling(flows.timed(events))
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(spark.table("tumbled")) == key(batch)


def test_page_stream(spark, tmp_path):
    folder = tmp_path / "pages"
    rows = [("http://a/1", "<p>Some text that is long enough</p>", "2024-01-01"), ("http://a/2", "<p>Some text that is long enough</p>", "2024-01-01"), ("http://a/3", "<p>Another text of some length</p>", "2024-01-01")]
    spark.createDataFrame(rows, "url string, html string, t string").withColumn("scraped_at", F.to_timestamp("t")).drop("t").write.parquet(str(folder))
    flows.run_to_end(flows.chunk_stream(flows.event_stream(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_host_spacing(spark, tmp_path):
    folder = tmp_path / "requests"
    spark.createDataFrame([("h", "u1", datetime.datetime(2024, 1, 1)), ("h", "u2", datetime.datetime(2024, 1, 1)), ("g", "u3", datetime.datetime(2024, 1, 1))], "host string, url string, ts timestamp").write.parquet(str(folder))
    flows.run_to_end(flows.host_spacing(flows.event_stream(spark, str(folder)), 2.0), str(tmp_path / "out"), str(tmp_path / "c"))
    due = {r.url: r.due.second for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert due == {"u1": 0, "u2": 2, "u3": 0}


def test_pages_are_parsed_in_many_tasks_and_rows_let_go(spark):
    """One file of pages is parsed in more than one task; a long page is held as its courses, not as a tree."""
    import tracemalloc

    pages = spark.createDataFrame([(f"http://x.org/?course_code=CE+{i}", "<p id='course_name'>n</p>") for i in range(50)], "url string, html string").coalesce(1)
    assert html.parse_details(pages).rdd.getNumPartitions() > 1 and html.parse_curricula(pages).rdd.getNumPartitions() > 1
    assert html.parse_details(pages).select("course_code").distinct().count() == 50
    rows = "".join(f"<tr><td><a href='/s?c={i}'>CE {i % 60}</a></td><td></td><td>n{i}</td><td>3</td><td>0</td><td>1</td><td>5</td></tr>" for i in range(3000))
    tracemalloc.start()
    found = html.curriculum_rows(f"<table class='curr'><tr><td class='title'>2. Year Fall</td></tr>{rows}</table>", "http://x.org/")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r[:4] for r in found] == [(i, f"CE {i}", f"n{i}", 3) for i in range(60)] and peak < 4_000_000
    nested = "<table class='curr'><td class='title'>Spring<tr><td>A 1</td><td></td><td>n</td><td>1</td><td>2</td></tr><tr><td><table class='curr'><tr><td>B 1</td><td>m</td><td></td><td>3</td><td>4</td></tr></table></td></tr></table>"
    assert [r[1] for r in html.curriculum_rows(nested)] == ["B 1 m 3 4", "B 1"]
