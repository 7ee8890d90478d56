"""Queries over course chunks, catalog answers, prompts and derived pages. The registry's module loads this one."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import chunking, cleaning, fixed, grounding, metrics, questions as asked
from lectern.operators import catalog, context, lookup
from lectern.plans.catalogue import _A, _DEPT, _KIND, _Q, _RE, _TYPE, _checked, _ranked_hits, query
from lectern.plans.views import ANSWERS, COURSES, HITS, QUESTIONS, view
from lectern.sources import html
from lectern.sources.readers import table

#: Courses with texts of the documents table.
COURSE_TEXTS = f"""
SELECT c.*, '2023-2024' AS year_range, concat(department, '_', lower(replace(course_code, ' ', '_')), '_', CAST(pos AS STRING)) AS course_id,
  concat('https://', department, '.example.org/', CAST(pos AS STRING)) AS source_url, CAST(pos % 4 AS DOUBLE) AS local_credits,
  d.text AS description, CASE pos % 4 WHEN 0 THEN NULL WHEN 1 THEN ' N/A ' WHEN 2 THEN ' CE 101 ' ELSE '' END AS prerequisites,
  CASE WHEN pos % 3 = 0 THEN NULL WHEN pos % 3 = 1 THEN 'Short aims' ELSE concat('Aims of ', course_code, ': ', coalesce(d.text, '')) END AS objectives
FROM ({COURSES}) AS c LEFT JOIN documents AS d ON d.doc_id = c.pos
"""

_NEEDS = "CASE WHEN lower(trim(coalesce(prerequisites, ''))) IN ('none', 'n/a', '-', '') THEN 'None' ELSE trim(prerequisites) END"


@query(
    f"WITH c AS ({COURSE_TEXTS}), t AS (SELECT course_id, concat('Course Code: ', course_code, chr(10), 'Course Title: ', course_title, chr(10), 'Department: ', upper(department), "
    "CASE WHEN coalesce(semester, 0) <> 0 THEN concat(chr(10), 'Semester: ', semester) ELSE '' END, CASE WHEN coalesce(ects, 0) <> 0 THEN concat(chr(10), 'ECTS Credits: ', ects) ELSE '' END, "
    f"CASE WHEN coalesce(local_credits, 0) <> 0 THEN concat(chr(10), 'Local Credits: ', local_credits) ELSE '' END, chr(10), 'Course Type: ', course_type, chr(10), 'Prerequisites: ', {_NEEDS}, "
    "CASE WHEN length(objectives) < 100 THEN concat(chr(10), 'Objectives: ', objectives) ELSE '' END) AS text FROM c) "
    "SELECT course_id, concat(course_id, '_course_info_0_', substr(sha256(text), 1, 8)) AS chunk_id, text FROM t"
)
def course_info_chunks(spark, d):
    return chunking.course_chunks(view(spark, d, COURSE_TEXTS)).filter("section_name = 'course_info'").select("course_id", "chunk_id", "text")


@query()
def course_chunks(spark, d):
    """All chunks of all courses; tests/test_lookup.py compares them with a plain version."""
    return chunking.course_chunks(view(spark, d, COURSE_TEXTS)).select("chunk_id", "course_code", "section_name", "chunk_index", "text_hash")


_ASKED_MANDATORY = (
    f"{_Q}, m AS (SELECT id, CAST(regexp_extract(t, 'semester\\s+(\\d+)', 1) AS INT) AS semester, CASE WHEN contains(t, 'software') THEN 'se' ELSE 'ie' END AS department FROM q "
    "WHERE regexp_matches(t, 'mandatory\\s+courses?\\s+in\\s+semester\\s+[1-8]\\s+for\\s+software') OR regexp_matches(t, '^ie\\s+semester\\s+[1-8]\\s+mandatory'))"
)


@query(
    f"{_ASKED_MANDATORY}, c AS ({COURSES}), g AS (SELECT m.id, m.semester, m.department, count(c.pos) AS n, string_agg(concat('- ', course_code, ': ', course_title, ' (', ects, ' ECTS)'), chr(10) ORDER BY course_code, pos) AS lines "
    "FROM m LEFT JOIN c ON c.department = m.department AND c.semester = m.semester AND c.course_type = 'mandatory' GROUP BY m.id, m.semester, m.department) "
    "SELECT id, semester, department, n, sha256(concat('MANDATORY COURSES FOR ', CASE department WHEN 'se' THEN 'SOFTWARE ENGINEERING' ELSE 'INDUSTRIAL ENGINEERING' END, ' - SEMESTER ', semester, chr(10), 'Total: ', n, ' courses', chr(10), "
    "CASE WHEN n > 0 THEN concat(chr(10), lines) ELSE '' END)) AS h FROM g"
)
def answer_curriculum(spark, d):
    return lookup.mandatory_lookups(view(spark, d, QUESTIONS), view(spark, d, COURSES), lambda: [F.sha2("context", 256).alias("h")])


_ASKED_COUNTS = (
    f"{_Q}, a AS (SELECT id, regexp_extract(t, 'exactly (\\d+) ects', 1) AS e, upper(regexp_extract(t, 'starting with (\\w+)', 1)) AS p, contains(t, 'offered in the industrial engineering department') AS i FROM q), "
    "k AS (SELECT id, CASE WHEN p <> '' THEN 'count_by_prefix' WHEN e <> '' THEN 'count_by_ects' ELSE 'count_by_department' END AS kind, CASE WHEN p <> '' THEN p WHEN e <> '' THEN e ELSE 'ie' END AS value FROM a WHERE p <> '' OR e <> '' OR i)"
)


@query(
    f"{_ASKED_COUNTS}, c AS ({COURSES}), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY course_code ORDER BY pos) = 1), g AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY course_code, ects ORDER BY pos) = 1), "
    "v AS (SELECT DISTINCT kind, value FROM k), o AS (SELECT v.*, f.* FROM v JOIN f ON v.kind = 'count_by_prefix' AND starts_with(f.course_code, v.value) UNION ALL "
    "SELECT v.*, g.* FROM v JOIN g ON v.kind = 'count_by_ects' AND g.ects = TRY_CAST(v.value AS DOUBLE) UNION ALL SELECT v.*, c.* FROM v JOIN c ON v.kind = 'count_by_department' AND c.department = v.value), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY kind, value ORDER BY course_code, pos) AS x FROM o), "
    "s AS (SELECT kind, value, count(*) AS n, count(*) FILTER (WHERE course_type = 'mandatory') AS mandatory, count(*) FILTER (WHERE course_type = 'elective') AS elective, "
    "string_agg(concat('- ', course_code, ': ', course_title), chr(10) ORDER BY x) FILTER (WHERE x <= 20) AS lines FROM r GROUP BY kind, value) "
    "SELECT id, kind, value, coalesce(n, 0) AS n, sha256(CASE WHEN kind = 'count_by_department' THEN concat('COURSES IN DEPARTMENT', chr(10), 'Total: ', coalesce(n, 0), chr(10), 'Mandatory: ', coalesce(mandatory, 0), chr(10), 'Elective: ', coalesce(elective, 0)) "
    "ELSE concat(CASE WHEN kind = 'count_by_prefix' THEN concat('COURSES WITH CODE STARTING WITH ''', value, '''') ELSE concat('COURSES WITH ', value, ' ECTS CREDITS') END, chr(10), 'Total unique courses: ', coalesce(n, 0), "
    "CASE WHEN n > 0 THEN concat(chr(10), chr(10), lines) ELSE '' END, CASE WHEN n > 20 THEN concat(chr(10), '... and ', n - 20, ' more') ELSE '' END) END) AS h FROM k LEFT JOIN s USING (kind, value)"
)
def answer_counting(spark, d):
    return lookup.counting_lookups(view(spark, d, QUESTIONS), view(spark, d, COURSES), lambda: [F.sha2("context", 256).alias("h")])


@query(
    f"{_ASKED_MANDATORY}, {_ASKED_COUNTS.removeprefix(f'{_Q}, ')}, c AS ({COURSES}), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY course_code ORDER BY pos) = 1), g AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY course_code, ects ORDER BY pos) = 1), "
    "z AS (SELECT m.id, 'mandatory' AS route, c.course_code, row_number() OVER (PARTITION BY m.id ORDER BY course_code, pos) AS x FROM m LEFT JOIN c ON c.department = m.department AND c.semester = m.semester AND c.course_type = 'mandatory'), "
    "y AS (SELECT k.id, f.course_code, f.course_code AS o, f.pos FROM k JOIN f ON k.kind = 'count_by_prefix' AND starts_with(f.course_code, k.value) UNION ALL SELECT k.id, g.course_code, g.course_code, g.pos FROM k JOIN g ON k.kind = 'count_by_ects' AND g.ects = TRY_CAST(k.value AS DOUBLE) "
    "UNION ALL SELECT k.id, c.course_code, '', c.pos FROM k JOIN c ON k.kind = 'count_by_department' AND c.department = k.value), "
    "u AS (SELECT * FROM z UNION ALL SELECT k.id, 'counting', y.course_code, y.x FROM k LEFT JOIN (SELECT id, course_code, row_number() OVER (PARTITION BY id ORDER BY o, pos) AS x FROM y QUALIFY x <= 20) AS y USING (id)) "
    "SELECT id, route, coalesce(string_agg(course_code, ',' ORDER BY x), '') AS codes, CAST(count(course_code) AS DOUBLE) AS total_score FROM u GROUP BY id, route"
)
def catalog_hits(spark, d):
    """What the catalog's own answers count as retrieved: every hit scores 1."""
    made = lambda: [F.array_join("hits.course_code", ",").alias("codes"), F.size("hits").cast("double").alias("total_score")]
    return lookup.lookups(view(spark, d, QUESTIONS), view(spark, d, COURSES), made).drop("n")


#: Each question has the hits of eight courses.
QUESTION_HITS = f"SELECT CAST(ceil(pos / 8) AS BIGINT) AS query_id, h.* FROM ({HITS}) AS h"

_SEASON = " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in ws)} THEN {n}" for n, ws in reversed(fixed.SEMESTER_WORDS.items()))
_HIT_TYPE = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{k}'" for k, ws in fixed.COURSE_TYPE_WORDS.items()) + " ELSE '' END"


@query(
    f"{_Q}, w AS (SELECT id, {_KIND} AS kind, {_DEPT} AS department, CASE WHEN regexp_matches(t, 'semester\\s*\\d') THEN TRY_CAST(regexp_extract(t, 'semester\\s*(\\d+)', 1) AS INT) ELSE CASE {_SEASON} END END AS semester, "
    f"TRY_CAST(regexp_extract(t, 'year\\s*(\\d+)', 1) AS INT) AS year, {_TYPE} AS course_type, upper(nullif(regexp_extract(question, '(?i)\\b([A-Z]{{2,4}})\\s+courses?\\b', 1), '')) AS prefix FROM q), "
    f"h AS ({QUESTION_HITS}), x AS (SELECT query_id, pos, department, semester, {_HIT_TYPE} AS course_type, TRY_CAST(regexp_extract(text, '(\\d+)\\s*ECTS', 1) AS DOUBLE) AS ects, unnest(regexp_extract_all(text, '\\b[A-Z]{{2,4}}\\s*\\d{{3}}\\b')) AS code, "
    "generate_subscripts(regexp_extract_all(text, '\\b[A-Z]{2,4}\\s*\\d{3}\\b'), 1) AS k FROM h), c AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query_id, code ORDER BY pos, k) = 1), "
    "j AS (SELECT w.id, w.kind, c.ects, upper(c.department) AS d, c.semester AS s FROM w JOIN c ON c.query_id = w.id AND w.kind <> 'none' AND (w.kind = 'compare' OR ((w.department IS NULL OR c.department = w.department) AND (w.semester IS NULL OR c.semester = w.semester) "
    "AND (w.year IS NULL OR ceil(c.semester / 2) = w.year) AND (w.course_type IS NULL OR c.course_type = w.course_type) AND (w.prefix IS NULL OR split_part(c.code, ' ', 1) = w.prefix)))), "
    "g AS (SELECT id, CASE WHEN kind = 'compare' THEN d WHEN kind = 'breakdown' THEN CAST(coalesce(s, 0) AS VARCHAR) END AS name, count(*) AS n, sum(ects) AS total FROM j GROUP BY ALL) "
    "SELECT w.id, w.kind, CAST(coalesce(sum(g.n), 0) AS BIGINT) AS n_courses, coalesce(sum(g.total), 0.0) AS total_ects, string_agg(CASE WHEN name IS NOT NULL THEN concat(name, '=', n) END, ',' ORDER BY name) AS groups FROM w LEFT JOIN g ON g.id = w.id GROUP BY w.id, w.kind"
)
def answer_quantitative(spark, d):
    rows = lookup.quantitative_results(view(spark, d, QUESTIONS), view(spark, d, QUESTION_HITS))
    entries = F.array_sort(F.transform(F.map_entries("groups"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return rows.select("id", "kind", "n_courses", "total_ects", F.nullif(F.array_join(entries, ","), F.lit("")).alias("groups"))


@query(
    f"WITH c AS ({COURSES}) SELECT pos, concat(department, '_', lower(replace(course_code, ' ', '_')), '_2020_2024_course_info_0') AS chunk_id, "
    "concat(course_code, ' - ', course_title, chr(10), 'ECTS: ', ects, CASE WHEN semester IS NOT NULL THEN concat(chr(10), 'Semester: ', semester) ELSE '' END, chr(10), 'Type: ', course_type) AS text, 1.0::DOUBLE AS score FROM c"
)
def course_hits(spark, d):
    return lookup.course_hits(view(spark, d, COURSES)).select("pos", "chunk_id", "text", "score")


_RANKED = f"h AS (SELECT *, pos % 20 AS query_id, (pos % 97) / 100 AS score FROM ({HITS})), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM h)"
_BLOCK = (
    "concat('[', chunk_id, ']', chr(10), 'Course: ', course_code, ' - ', course_title, chr(10), 'Department: ', upper(department), chr(10), 'Section: description', chr(10), 'Content: ', text)"
)
_BY_DEPARTMENT = (
    f"{_RANKED}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, department ORDER BY rank) AS i FROM r WHERE rank <= 20), "
    f"b AS (SELECT query_id, department, string_agg(concat('--- Source ', i, ' ---', chr(10), {_BLOCK}), chr(10) || chr(10) ORDER BY i) AS t FROM o GROUP BY ALL), "
    "n AS (SELECT DISTINCT query_id FROM r), dp AS (SELECT * FROM (VALUES (1, 'se'), (2, 'ce'), (3, 'eee'), (4, 'ie')) AS v(k, department)), "
    "dc AS (SELECT query_id, dp.k, dp.department, concat('=== ', upper(dp.department), ' ===', chr(10), coalesce(t, 'No relevant sources found for this department.')) AS context FROM n CROSS JOIN dp LEFT JOIN b USING (query_id, department))"
)


@query(f"WITH {_BY_DEPARTMENT} SELECT query_id, department, context FROM dc")
def department_context(spark, d):
    return context.department_contexts(_ranked_hits(spark, d), list(fixed.DEPARTMENTS))


@query(
    f"WITH {_BY_DEPARTMENT} SELECT query_id, sha256(concat('Sources by department:', chr(10), string_agg(context, chr(10) || chr(10) ORDER BY k), chr(10), chr(10), 'Comparison question: q', query_id)) AS h FROM dc GROUP BY query_id"
)
def comparison_prompt(spark, d):
    hits = _ranked_hits(spark, d)
    asked_ = hits.select("query_id").distinct().withColumn("question", F.concat(F.lit("q"), F.col("query_id").cast("string")))
    names = list(fixed.DEPARTMENTS)
    return context.comparison_prompts(asked_, context.department_contexts(hits, names), names).select("query_id", F.sha2("prompt", 256).alias("h"))


@query(
    f"WITH {_RANKED}, f AS (SELECT query_id, rank, concat(regexp_extract(text, '^(.*?[.!?])\\s', 1), ' [', chunk_id, ']') AS t FROM r WHERE rank <= 3) SELECT query_id, string_agg(t, ' ' ORDER BY rank) AS answer FROM f GROUP BY query_id"
)
def extractive_answers(spark, d):
    return context.extractive_answers(_ranked_hits(spark, d))


_CASES = "CASE WHEN pos % 7 = 0 THEN 1.0 WHEN pos % 5 = 0 THEN 0.4 WHEN pos % 3 = 0 THEN 0.6 * (1 / 2) + 0.2 * (1 / 2) + 0.2 ELSE 1.0 END"


@query(
    f"{_A} SELECT round(avg(CASE WHEN pos % 5 = 0 AND pos % 7 <> 0 THEN 0.0 ELSE 1.0 END), 9) AS grounding_rate, round(avg({_CASES}), 9) AS avg_grounding_score, "
    "round(sum(CASE WHEN pos % 7 = 0 OR pos % 5 = 0 THEN 0 ELSE 1 END) / sum(CASE WHEN pos % 7 = 0 OR pos % 5 = 0 THEN 0 WHEN pos % 3 = 0 THEN 2 ELSE 1 END), 9) AS citation_accuracy, "
    "avg(CASE WHEN is_trap THEN 1.0 END) AS trap_accuracy, 0.0::DOUBLE AS hallucination_rate, round(avg(CASE WHEN contains(upper(answer), course_code) THEN 1.0 ELSE 0.0 END), 9) AS answer_completeness, "
    "count(*) AS num_answers, count(*) FILTER (WHERE is_trap) AS num_trap_questions FROM a"
)
def answer_metrics(spark, d):
    m = metrics.answer_metrics(_checked(spark, d).withColumn("expected_codes", F.array("course_code")))
    return metrics.rounded(m, 9)


@query(
    f"{_Q}, m AS (SELECT id, t, regexp_matches(t, 'mandatory\\s+courses?\\s+in\\s+semester\\s+[1-8]\\s+for\\s+software') OR regexp_matches(t, '^ie\\s+semester\\s+[1-8]\\s+mandatory') AS mandatory, "
    "nullif(upper(regexp_extract(t, 'starting with (\\w+)', 1)), '') AS p, nullif(regexp_extract(t, 'exactly (\\d+) ects', 1), '') AS e, CASE WHEN contains(t, 'offered in the industrial engineering department') THEN 'ie' END AS i FROM q) "
    "SELECT id, CASE WHEN mandatory THEN 'mandatory' WHEN coalesce(p, e, i) IS NOT NULL THEN 'counting' ELSE 'semantic' END AS route, CASE WHEN mandatory THEN CAST(regexp_extract(t, 'semester\\s+(\\d+)', 1) AS INT) END AS semester, "
    "CASE WHEN mandatory THEN CASE WHEN contains(t, 'software') THEN 'se' ELSE 'ie' END END AS department, coalesce(p, e, i) AS value FROM m"
)
def query_route(spark, d):
    q = F.col("question")
    rows = view(spark, d, QUESTIONS).select("id", asked.route(q).alias("route"), asked.mandatory_lookup(q).alias("m"), asked.counting_lookup(q).alias("c"))
    return rows.select("id", "route", F.col("m.semester").alias("semester"), F.col("m.department").alias("department"), F.col("c.value").alias("value"))


@query(
    f"{_Q} SELECT id, {_DEPT} AS department, {_TYPE} AS course_type, TRY_CAST(regexp_extract(t, 'year\\s*(\\d+)', 1) AS INT) AS year, upper(nullif(regexp_extract(question, '(?i)\\b([A-Z]{{2,4}})\\s+courses?\\b', 1), '')) AS prefix, "
    f"CASE WHEN regexp_matches(t, 'semester\\s*\\d') THEN TRY_CAST(regexp_extract(t, 'semester\\s*(\\d+)', 1) AS INT) ELSE CASE {_SEASON} END END AS semester FROM q"
)
def query_filters(spark, d):
    q = F.col("question")
    parts = {"department": asked.asked_department, "course_type": asked.asked_type, "year": asked.asked_year, "prefix": asked.asked_prefix, "semester": asked.asked_semester}
    return view(spark, d, QUESTIONS).select("id", *(f(q).alias(n) for n, f in parts.items()))


#: Documents with what pages carry around their text.
FRAMED = "SELECT doc_id, concat('Print this page', chr(10), 'Last updated: ', CAST(doc_id AS STRING), chr(10), text, chr(10), 'Page 3 of ', CAST(doc_id AS STRING), ' Back to top', chr(10), '© 2024 Example. All rights reserved.', chr(10), 'cookie POLICY applies') AS body FROM documents"


def _framed_sql() -> str:
    out = "body"
    for p in fixed.BOILERPLATE:
        out = f"regexp_replace({out}, '(?im){_RE(p)}', '', 'g')"
    return out


@query(f"SELECT doc_id, sha256({_framed_sql()}) AS h FROM ({FRAMED})")
def clean_boilerplate(spark, d):
    return view(spark, d, FRAMED.replace("chr(10)", "'\\n'")).select("doc_id", F.sha2(cleaning.strip_patterns(F.col("body"), fixed.BOILERPLATE), 256).alias("h"))


@query("SELECT doc_id, sha256(CASE WHEN length(t) < 10 THEN '' ELSE t END) AS h FROM (SELECT doc_id, regexp_replace(text, '[^a-z]', '', 'g') AS t FROM documents)")
def min_length(spark, d):
    """The rule alone over whole texts, of letters only, so that no other step changes them."""
    letters = table(spark, d, "documents").withColumn("t", F.regexp_replace("text", "[^a-z]", ""))
    return letters.select("doc_id", F.sha2(cleaning.clean_text(F.col("t"), cleaning.CleaningOptions(entities=False, form=None)), 256).alias("h"))


#: Course pages, as a catalog's site has them.
COURSE_PAGES = f"""
SELECT pos, concat('https://catalog.example.org/syllabus?course_code=', replace(course_code, ' ', '+'), '&n=', CAST(pos AS STRING)) AS url,
  concat('<html><span id="course_name">', course_title, '</span><div id="pre_requisites">', CASE WHEN pos % 2 = 0 THEN 'CE 101' ELSE '' END, '</div>',
    '<table class="transpose"><tr><th>Theory</th><th>Local Credits</th><th>ECTS</th></tr><tr><td>3</td><td>', CAST(pos % 4 AS STRING), '</td><td>', CAST(CAST(ects AS INT) AS STRING), '</td></tr></table>',
    '<ul id="outcome"><li>to know ', course_title, '</li><li>to use it</li></ul><table id="weeks"><tr><td>1</td><td>Start</td></tr><tr><td>2</td><td>', course_code, '</td></tr></table>',
    '<table id="evaluation_table1"><tr><td>Midterm</td><td>1</td><td>', CAST(pos % 50 AS STRING), '</td></tr><tr><td>Quiz</td><td>-</td><td>-</td></tr></table></html>') AS html
FROM ({COURSES}) AS c
"""


@query(
    f"WITH c AS ({COURSES}) SELECT concat('https://catalog.example.org/syllabus?course_code=', replace(course_code, ' ', '+'), '&n=', pos) AS url, course_code, course_title, CASE WHEN pos % 2 = 0 THEN 'CE 101' END AS prerequisites, "
    "CAST(pos % 4 AS DOUBLE) AS local_credits, ects, concat('to know ', course_title, '|to use it') AS outcomes, concat('Week 1: Start|Week 2: ', course_code) AS weeks, concat('Midterm: ', pos % 50, '%') AS assessment FROM c"
)
def page_details(spark, d):
    rows = html.parse_details(view(spark, d, COURSE_PAGES))
    return rows.select("url", "course_code", "course_title", "prerequisites", "local_credits", "ects", F.array_join("learning_outcomes", "|").alias("outcomes"), F.array_join("weekly_topics", "|").alias("weeks"), "assessment")


#: A curriculum page for each department and semester.
CURRICULA = f"""
SELECT department, concat('https://', department, '.example.org/cur/', CAST(semester AS STRING)) AS url, semester,
  concat_ws('', concat('<table class="curr"><tr><td class="title">', CAST(CAST(ceil(semester / 2) AS INT) AS STRING), '. Year ', CASE WHEN semester % 2 = 0 THEN 'Spring' ELSE 'Fall' END, ' Semester</td></tr>'),
    rows, '<tr><td>Total</td><td></td><td></td><td>0</td><td>0</td></tr></table>') AS html
FROM (SELECT department, semester, {{rows}} AS rows FROM (SELECT * FROM ({COURSES}) AS c0 WHERE semester IS NOT NULL) AS c GROUP BY department, semester) AS g
"""
_ROW = "concat('<tr><td><a href=\"/s?c=', CAST(pos AS STRING), '\">', course_code, '</a></td><td></td><td>', course_title, '</td><td>3</td><td>0</td><td>', CAST(pos % 4 AS STRING), '</td><td>', CAST(CAST(ects AS INT) AS STRING), '</td></tr>')"


@query(
    f"WITH c AS (SELECT * FROM ({COURSES}) WHERE semester IS NOT NULL), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY department, semester, course_code ORDER BY pos) = 1) "
    "SELECT concat('https://', department, '.example.org/cur/', semester) AS url, course_code, course_title, semester, 'mandatory' AS course_type, CAST(pos % 4 AS DOUBLE) AS local_credits, ects, concat('https://', department, '.example.org/s?c=', pos) AS href FROM f"
)
def curriculum_rows(spark, d):
    rows = f"array_join(transform(array_sort(collect_list(struct(pos, {_ROW} AS r))), x -> x.r), '')"
    return html.parse_curricula(view(spark, d, CURRICULA.format(rows=rows))).select("url", "course_code", "course_title", "semester", "course_type", "local_credits", "ects", "href")


#: Curriculum pages with every kind of row: by pos % 6 seven, six, five and eight cells, no title, and a code of a free elective.
_CODE = "concat(CASE WHEN pos % 6 = 5 THEN 'TMD ' ELSE '' END, course_code)"
_CELLS = (
    "concat('<tr><td>', " + _CODE + ", '</td>', CASE WHEN pos % 6 IN (0, 3, 4, 5) THEN '<td>p</td>' ELSE '' END, '<td>', CASE WHEN pos % 6 = 4 THEN '' ELSE course_title END, '</td><td>3</td>', CASE WHEN pos % 6 = 2 THEN '' ELSE '<td>0</td>' END, "
    "'<td>', CAST(pos % 4 AS STRING), '</td><td>', CAST(CAST(ects AS INT) AS STRING), '</td>', CASE WHEN pos % 6 = 3 THEN '<td>9</td>' ELSE '' END, '</tr>')"
)
CASES = f"""
SELECT concat('https://', department, '.example.org/cases/', CAST(semester AS STRING)) AS url,
  concat('<table class="curr', CASE WHEN department = 'ie' THEN ' Electives' ELSE '' END, '"><tr><td class="title">', CAST(CAST(ceil(semester / 2) AS INT) AS STRING), '. Year',
    CASE WHEN department = 'ce' THEN '' WHEN semester % 2 = 0 THEN ' Spring' ELSE ' Fall' END, '</td></tr><tr><td>Kod</td><td></td><td>Ders Adı</td><td></td><td></td><td></td><td></td></tr>', rows, '</table>') AS html
FROM (SELECT department, semester, {{rows}} AS rows FROM (SELECT * FROM ({COURSES}) AS c0 WHERE semester IS NOT NULL) AS c GROUP BY department, semester) AS g
"""


@query(
    f"WITH c AS (SELECT *, {_CODE} AS code FROM ({COURSES}) WHERE semester IS NOT NULL AND pos % 6 <> 4), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY department, semester, code ORDER BY pos) = 1) "
    "SELECT concat('https://', department, '.example.org/cases/', semester) AS url, code AS course_code, course_title, CASE WHEN department = 'ie' OR pos % 6 = 5 THEN -1 WHEN department = 'ce' THEN 1 ELSE semester END AS semester, "
    "CASE WHEN department = 'ie' THEN 'technical_elective' WHEN pos % 6 = 5 THEN 'non_technical_elective' ELSE 'mandatory' END AS course_type, CAST(pos % 4 AS DOUBLE) AS local_credits, ects FROM f"
)
def curriculum_cases(spark, d):
    rows = f"array_join(transform(array_sort(collect_list(struct(pos, {_CELLS} AS r))), x -> x.r), '')"
    found = html.parse_curricula(view(spark, d, CASES.format(rows=rows)))
    return found.select("url", "course_code", "course_title", F.coalesce("semester", F.lit(-1)).alias("semester"), "course_type", "local_credits", "ects")


@query(f"WITH c AS ({COURSES}) SELECT pos, concat(department, '_', lower(replace(course_code, ' ', '_')), '_2023-2024') AS course_id FROM c")
def normal_course_ids(spark, d):
    code = F.concat(F.lit("  "), F.replace(F.col("course_code"), F.lit(" "), F.lit(" \t")), F.lit("! "))
    return view(spark, d, COURSES).select("pos", catalog.normal_course_id(F.upper("department"), code, F.lit(" 2023-2024 ")).alias("course_id"))


_LINKS = "list_distinct(list_transform(list_filter(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1), lambda x: x <> ''), lambda x: CASE WHEN starts_with(x, '/') THEN concat(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1), x) ELSE x END))"


@query(f"SELECT page_id, array_to_string(list_sort({_LINKS}), '|') AS links FROM pages")
def absolute_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(F.sort_array(html.absolute_links(F.col("html"), F.col("url"))), "|").alias("links"))


@query(f"{_A}, h AS ({HITS}) SELECT a.pos, contains(upper(h.text), split_part(a.course_code, ' ', 1)) AND contains(upper(h.text), split_part(a.course_code, ' ', 2)) AS known, {_CASES} >= 0.5 AS grounded FROM a JOIN h USING (pos)")
def grounding_quick(spark, d):
    answers, hits = view(spark, d, ANSWERS), view(spark, d, HITS).select("pos", F.array(F.struct("chunk_id", "text")).alias("sources"))
    rows = answers.join(hits, "pos").withColumn("known", grounding.course_exists(F.col("course_code"), F.col("sources")))
    return grounding.grounded_by_score(rows).select("pos", "known", "grounded")
