"""Course, question, hit and answer tables derived from the given tables, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

COURSES = """
SELECT p_partkey AS pos,
  CASE p_partkey % 4 WHEN 0 THEN 'se' WHEN 1 THEN 'ce' WHEN 2 THEN 'eee' ELSE 'ie' END AS department,
  concat(CASE (p_partkey * 7) % 6 WHEN 0 THEN 'SE' WHEN 1 THEN 'CE' WHEN 2 THEN 'EEE' WHEN 3 THEN 'IE' WHEN 4 THEN 'MATH' ELSE 'SEST' END, ' ',
    CAST(100 + (p_partkey * 37) % 400 AS STRING)) AS course_code,
  p_name AS course_title, CAST(p_size % 6 + 3 AS DOUBLE) AS ects,
  CASE WHEN p_size % 3 = 0 THEN 'technical_elective' WHEN p_size % 11 = 0 THEN 'elective' ELSE 'mandatory' END AS course_type,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_partkey % 8 + 1 AS INT) END AS semester
FROM part
"""

#: Passages that name courses and quantities, as a store would return them.
HITS = f"""
SELECT pos, concat('c', CAST(pos AS STRING)) AS chunk_id, course_code, course_title, department, semester, ects,
  concat(course_code, ' is a ', CASE WHEN course_type = 'mandatory' THEN 'mandatory' ELSE 'elective' END, ' course of ', CAST(CAST(ects AS INT) AS STRING),
    ' ECTS and ', CAST(1 + pos % 4 AS STRING), ' credits. It follows CE ', CAST(100 + pos % 50 AS STRING), '.') AS text
FROM ({COURSES}) AS c
"""

#: Answers with codes, quantities, citations that hold or not, hedging and abstention.
ANSWERS = f"""
SELECT pos, pos % 7 = 0 AS is_trap, course_code,
  CASE WHEN pos % 7 = 0 THEN 'I could not find this course in the catalog.'
    WHEN pos % 5 = 0 THEN concat('It might be hard to say. Perhaps ', course_title, ' is offered.')
    WHEN pos % 3 = 0 THEN concat(course_code, ' has ', CAST(CAST(ects AS INT) AS STRING), ' ECTS [c', CAST(pos AS STRING), ']. MATH ', CAST(600 + pos % 9 AS STRING), ' takes 3 hours [x', CAST(pos AS STRING), '].')
    ELSE concat('The course ', course_code, ' is worth ', CAST(CAST(ects AS INT) AS STRING), ' ECTS. Take it [c', CAST(pos AS STRING), '] early.') END AS answer
FROM ({COURSES}) AS c
"""

#: Questions of every kind about the courses.
QUESTIONS = f"""
SELECT pos AS id,
  CASE pos % 13
    WHEN 0 THEN concat('How many courses have exactly ', CAST(CAST(ects AS INT) AS STRING), ' ECTS?')
    WHEN 1 THEN concat('Mandatory courses in semester ', CAST(pos % 10 AS STRING), ' for software engineering')
    WHEN 2 THEN concat('How many courses have a course code starting with ', substr(course_code, 1, 2))
    WHEN 3 THEN concat('Which department has more ', course_title, '?')
    WHEN 4 THEN 'Give me a breakdown by semester of the elective courses'
    WHEN 5 THEN 'total ects in year 2 of computer engineering'
    WHEN 6 THEN concat('List all SE courses of semester ', CAST(1 + pos % 8 AS STRING))
    WHEN 7 THEN 'How many courses are offered in the industrial engineering department?'
    WHEN 8 THEN concat('What is taught in the third semester about ', course_title)
    WHEN 9 THEN concat('ie semester ', CAST(1 + pos % 8 AS STRING), ' mandatory')
    WHEN 10 THEN 'Show me the required courses of the 5th semester'
    WHEN 11 THEN concat('Does ', course_code, ' exist?')
    ELSE 'Compare the number of free courses in software and industrial engineering, 4 semester' END AS question,
  CASE pos % 5 WHEN 0 THEN 'factual' WHEN 1 THEN 'counting' WHEN 2 THEN 'comparison' WHEN 3 THEN 'listing' ELSE 'trap' END AS question_type,
  CASE pos % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
  CASE WHEN pos % 4 = 0 THEN NULL ELSE department END AS target_department, pos % 5 = 4 AS is_trap
FROM ({COURSES}) AS c
"""


TABLES = ("part", "supplier", "orders", "lineitem", "customer", "nation", "region", "events", "documents", "pages", "embeddings", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over given tables, which stand under their own names in the SQL. They are passed as arguments, so no view of the session is made or replaced."""
    names = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)).intersection(TABLES)
    marked = re.sub(r"\b(FROM|JOIN)\s+(\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in names else m[0], sql)
    return spark.sql(marked, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})
