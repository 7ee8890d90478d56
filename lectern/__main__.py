"""python -m lectern COMMAND: catalog pages to courses, courses to an index, questions to answers and measures.

  scrape URLS CACHE OUT    addresses (one a line) to pages, through a cache, and what was fetched, failed and how fast
  parse PAGES OUT          curriculum pages (Parquet with url, html) to courses
  index DOCUMENTS OUT      documents (Parquet with doc_id, text) to embedded chunks
  ask INDEX QUESTION       the best chunks of an index for one question
  evaluate INDEX QUESTIONS the measures of a question file over an index
  info INDEX               chunks and courses by department
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession, functions as F

from lectern.functions import chunking, cleaning, questions as asked
from lectern.operators import catalog, vectors
from lectern.plans import evaluation
from lectern.session import ship_package
from lectern.sources import html, pages, readers


def scrape(spark: SparkSession, urls: str, cache: str, out: str) -> list[str]:
    """Pages of the addresses as Parquet; tells progress and the run's rates as JSON lines."""
    s = readers.load_settings()
    asked_urls = spark.read.text(urls).select(F.trim("value").alias("url")).filter("url <> ''")
    pages.read_through(asked_urls, cache, s.cache_days, gap=s.request_gap, attempts=s.attempts).write.parquet(out)
    return pages.fetch_stats(spark.read.parquet(out)).toJSON().collect()


def parse(spark: SparkSession, pages: str, out: str) -> None:
    html.parse_curricula(spark.read.parquet(pages)).write.parquet(out)


def index(spark: SparkSession, documents: str, out: str, department: str = "all") -> None:
    s = readers.load_settings()
    docs = spark.read.parquet(documents)
    docs = docs.withColumn("text", cleaning.clean_text(F.col("text")))
    rows = chunking.chunk_rows(docs, "doc_id", size=s.chunk_size, overlap=s.chunk_overlap, least=s.chunk_least)
    rows = vectors.hash_embedding(rows.withColumnRenamed("chunk", "text"), dims=s.embedding_dimensions)
    for name, value in {"department": department, "course_code": "", "course_title": ""}.items():
        rows = rows.withColumn(name, docs[name] if name in docs.columns else F.lit(value))
    rows.withColumn("pos", F.xxhash64("chunk_id")).write.partitionBy("department").parquet(out)


def ask(spark: SparkSession, index: str, question: str, k: int) -> list[dict]:
    s = readers.load_settings()
    asked_rows = spark.createDataFrame([(0, question)], "id long, question string")
    semester = asked_rows.select(asked.semester_asked(F.col("question"))).first()[0]
    chunks = spark.read.parquet(index)
    if semester is not None and "semester" in chunks.columns:
        chunks = chunks.filter(F.col("semester") == semester)
    found = evaluation.retrieve(asked_rows, chunks, k, s.threshold)
    return [r.asDict() for r in found.select("rank", F.round("score", 3).alias("score"), "chunk_id", "text").orderBy("rank").collect()]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lectern", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["scrape", "parse", "index", "ask", "evaluate", "info"])
    parser.add_argument("paths", nargs="+")
    parser.add_argument("-k", type=int, default=5)
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    ship_package(spark)
    if given.command == "scrape":
        print("\n".join(scrape(spark, *given.paths)))
    elif given.command == "parse":
        parse(spark, *given.paths)
    elif given.command == "index":
        index(spark, *given.paths)
    elif given.command == "ask":
        print(json.dumps(ask(spark, *given.paths, given.k), indent=1, ensure_ascii=False))
    elif given.command == "evaluate":
        chunks, questions = spark.read.parquet(given.paths[0]), readers.read_questions(spark, given.paths[1])
        numbered = questions.withColumn("id", F.xxhash64("id"))
        print(evaluation.measures(evaluation.run(numbered, chunks, given.k)).toJSON().first())
    else:
        print("\n".join(catalog.store_stats(spark.read.parquet(given.paths[0])).toJSON().collect()))


if __name__ == "__main__":
    main()
