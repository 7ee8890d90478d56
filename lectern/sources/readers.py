"""Readers and writers: Parquet tables, JSON and JSON lines, question files, settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lectern.functions import fixed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def malformed_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The lines that read_jsonl leaves out."""
    whole = StructType([*schema.fields, *StructType.fromDDL("_corrupt_record string").fields])
    return spark.read.schema(whole).option("mode", "PERMISSIVE").json(path).cache().filter("_corrupt_record IS NOT NULL").select("_corrupt_record")


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON file that holds one object or a list of them."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_typed(spark: SparkSession, path: str, schema: StructType | str, lines: bool = True) -> DataFrame:
    """As above, but a row that does not fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", not lines).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> int:
    """Returns the number of rows, counted while they are written."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append" if append else "overwrite").json(path)
    return seen.get["n"]


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.delete(p, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, none if it is not there."""
    fs, p = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []


def write_json(df: DataFrame, path: str, field: str = "items", **extra) -> int:
    """One JSON object in one file: the rows under `field`, their number as "count", and `extra`. For small results: rows meet in one task."""
    n = df.count()
    rows = F.coalesce(F.collect_list(F.struct("*")), F.array())
    whole = df.agg(rows.alias(field)).select(*(F.lit(v).alias(k) for k, v in extra.items()), F.col(field), F.lit(n).alias("count"))
    whole.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return n


def read_courses(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Courses of all JSON-lines (.jsonl) and JSON files (a list, or one object) under a folder."""
    lines = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).json(path)
    whole = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(path)
    return lines.unionByName(whole)


def save_questions(questions: DataFrame, path: str, lines: bool = False) -> int:
    """A question bank as JSON lines, or as one object {questions, count}."""
    return write_jsonl(questions, path) if lines else write_json(questions, path, "questions")


def add_questions(bank: DataFrame, new: DataFrame) -> DataFrame:
    """The bank with new questions behind its own, and `added`, the turn in which each came (0 at first). A question with the id of another stands beside it."""
    turn = 0
    if "added" in bank.columns:
        turn = bank.agg(F.coalesce(F.max("added"), F.lit(0))).first()[0]
    else:
        bank = bank.withColumn("added", F.lit(0))
    return bank.unionByName(new.withColumn("added", F.lit(turn + 1)), allowMissingColumns=True)


def _latest(bank: DataFrame) -> DataFrame:
    """bank with _latest: whether a question is the last of its id."""
    if "added" not in bank.columns:
        return bank.withColumn("_latest", F.lit(True))
    last = bank.groupBy(F.col("id").alias("_id")).agg(F.max("added").alias("_last"))
    return bank.join(last, F.col("id").eqNullSafe(F.col("_id")), "left").withColumn("_latest", F.col("added") == F.col("_last")).drop("_id", "_last")


def remove_questions(bank: DataFrame, ids: list[str]) -> DataFrame:
    """The bank without the last question of each of these ids."""
    return _latest(bank).filter(~(F.coalesce(F.col("id").isin(ids), F.lit(False)) & F.col("_latest"))).drop("_latest")


def get_question(bank: DataFrame, id: str) -> DataFrame:  # noqa: A002
    """The last question with this id."""
    return _latest(bank.filter(F.col("id") == id)).filter("_latest").drop("_latest")


def evaluation_record(results: DataFrame, measures: DataFrame, seconds: float, timestamp: str, config: dict[str, str] | None = None) -> DataFrame:
    """One row, record: a run as one JSON object of metadata, config, metrics (retrieval, answer) and question_results.

    Results meet in one task: a set of questions is small beside a corpus. All questions run as one flow, so their durations are null and metadata have the
    run's. Columns question_type and error of the results may be missing.
    """
    from lectern.functions.metrics import rounded

    column = lambda name: F.col(name) if name in results.columns else F.lit(None).cast("string")
    none = F.lit(None).cast("double")
    question = F.struct(
        F.col("query_id").alias("question_id"),
        F.col("question").alias("question_text"),
        column("question_type").alias("question_type"),
        F.col("retrieved_ids").alias("retrieved_course_codes"),
        F.transform(F.slice("scores", 1, 10), lambda x: F.round(x, 4)).alias("retrieved_scores"),
        none.alias("retrieval_time_ms"),
        F.col("expected_codes").alias("expected_course_codes"),
        F.col("answer").alias("generated_answer"),
        none.alias("generation_time_ms"),
        F.round("grounding_score", 3).alias("grounding_score"),
        "is_grounded",
        "is_trap",
        F.col("trap_handled").alias("trap_handled_correctly"),
        column("error").alias("error"),
    )
    rows = results.agg(F.array_sort(F.collect_list(question)).alias("question_results"), F.count("*").alias("n"))
    fine = rounded(measures)
    answer = [c for c in ("grounding_rate", "avg_grounding_score", "citation_accuracy", "trap_accuracy", "hallucination_rate", "answer_completeness", "num_questions", "num_trap_questions") if c in fine.columns]
    grouped = fine.select(F.struct(F.struct(*(c for c in fine.columns if c not in answer)).alias("retrieval"), F.struct(*answer).alias("answer")).alias("metrics"))
    settings = F.create_map(*(F.lit(x) for kv in (config or {}).items() for x in kv)).cast("map<string,string>") if config else F.expr("CAST(map() AS map<string,string>)")
    metadata = F.struct(F.lit(timestamp).alias("timestamp"), F.col("n").alias("num_questions"), F.lit(round(seconds, 2)).alias("duration_seconds"))
    # two rows of one line each
    whole = rows.join(grouped, F.lit(True)).select(F.struct(metadata.alias("metadata"), settings.alias("config"), "metrics", "question_results").alias("r"))
    return whole.select(F.to_json("r", {"ignoreNullFields": "false"}).alias("record"))


def save_evaluation_record(results: DataFrame, measures: DataFrame, path: str, seconds: float, timestamp: str, config: dict[str, str] | None = None) -> None:
    evaluation_record(results, measures, seconds, timestamp, config).coalesce(1).write.mode("overwrite").text(path)


def save_evaluation(results: DataFrame, measures: DataFrame, path: str, **config: str) -> int:
    """results/ as JSON lines with scores (the 10 best) to 4 and grounding to 3 digits, metrics/ with fractions to 4 digits and config/ as one object each."""
    from lectern.functions.metrics import rounded

    kinds = dict(results.dtypes)
    steps = {"scores": F.transform(F.slice("scores", 1, 10), lambda x: F.round(x, 4)), "grounding_score": F.round("grounding_score", 3)}
    n = write_jsonl(results.withColumns({c: v for c, v in steps.items() if c in kinds}), f"{path}/results")
    write_jsonl(rounded(measures).coalesce(1), f"{path}/metrics")
    if config:
        write_jsonl(measures.limit(1).select(*(F.lit(v).alias(k) for k, v in config.items())).coalesce(1), f"{path}/config")
    return n


QUESTION = (
    "id string, question string, question_type string, difficulty string, expected_answer string, expected_course_codes array<string>, expected_chunks array<string>, "
    "is_trap boolean, trap_topic string, target_department string, target_departments array<string>, target_year int, tags array<string>, notes string"
)
RAW_QUESTION = (
    "id string, category string, department_scope array<string>, mode string, query string, question string, expected_course_codes array<string>, expected_answer string, "
    "expected_numeric_answer int, expected_negative boolean, expected_answer_type string, notes string"
)


def map_questions(raw: DataFrame) -> DataFrame:
    """Questions in their file's form to the common form: names, types by mode or category, scope, tags, traps."""
    lookup = lambda pairs, c: F.coalesce(*(F.when(F.col(c) == k, v) for k, v in pairs.items()))
    scope = F.transform(F.filter(F.coalesce("department_scope", F.array().cast("array<string>")), lambda d: F.upper(d) != "ALL"), lambda d: F.lower(d))
    kind = F.coalesce(lookup(fixed.MODE_TYPES, "mode"), lookup(fixed.CATEGORY_TYPES, "category"), F.lit("factual"))
    trap = F.coalesce("expected_negative", F.lit(False)) | (kind == "trap")
    return raw.select(
        "id",
        F.coalesce("query", "question", F.lit("")).alias("question"),
        kind.alias("question_type"),
        F.lit("medium").alias("difficulty"),
        F.coalesce(F.col("expected_numeric_answer").cast("string"), F.nullif("expected_answer", F.lit(""))).alias("expected_answer"),
        F.coalesce("expected_course_codes", F.array().cast("array<string>")).alias("expected_course_codes"),
        F.array().cast("array<string>").alias("expected_chunks"),
        trap.alias("is_trap"),
        F.lit(None).cast("string").alias("trap_topic"),
        F.when(F.size(scope) == 1, F.get(scope, F.lit(0))).alias("target_department"),
        F.when(F.size(scope) > 1, scope).otherwise(F.array().cast("array<string>")).alias("target_departments"),
        F.lit(None).cast("int").alias("target_year"),
        F.filter(F.array("category", "mode"), lambda t: t.isNotNull()).alias("tags"),
        "notes",
    )


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from .jsonl, from .json (a list, or an object with the list "questions") or from .yaml."""
    if path.endswith(".jsonl"):
        found = read_jsonl(spark, path, QUESTION)
    elif path.endswith((".yaml", ".yml")):
        import yaml

        text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one hand-written file
        items = (yaml.safe_load(text) or {}).get("questions", [])
        names = [f.name for f in StructType.fromDDL(RAW_QUESTION).fields]
        return map_questions(spark.createDataFrame([tuple(_as_text(n, x.get(n)) for n in names) for x in items], RAW_QUESTION))
    else:
        whole = spark.read.schema(f"questions array<struct<{_struct(QUESTION)}>>, {QUESTION}").option("multiLine", True).json(path)
        inner = whole.filter("questions IS NOT NULL").select(F.explode("questions").alias("q")).select("q.*")
        found = inner.unionByName(whole.filter("questions IS NULL").drop("questions"))
    return with_question_ids(found)


def _struct(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)


def _as_text(name: str, value):
    if name == "department_scope" and isinstance(value, str):
        return [value]
    return str(value) if name in ("expected_answer", "notes", "id") and value is not None else value


def with_question_ids(questions: DataFrame) -> DataFrame:
    """A missing id becomes one made from the question."""
    made = F.concat(F.lit("q_"), F.substring(F.md5("question"), 1, 8))
    return questions.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), made))


@dataclass(frozen=True)
class Settings:
    """Defaults, then a YAML file, then environment variables of the same names in capitals with LECTERN_ before them."""

    chunk_size: int = fixed.CHUNK_SIZE
    chunk_overlap: int = fixed.CHUNK_OVERLAP
    chunk_least: int = fixed.CHUNK_LEAST
    top_k: int = 10
    threshold: float = 0.3
    per_department: int = 10
    max_total: int = 40
    cache_days: int = 30
    request_gap: float = 1.0
    attempts: int = 3
    embedding_provider: str = "hash"
    embedding_dimensions: int = 64


def load_settings(path: str | None = None) -> Settings:
    given = {}
    if path is not None:
        import yaml

        with open(path, encoding="utf-8") as f:
            given = yaml.safe_load(f) or {}
    out = {}
    for f in fields(Settings):
        value = os.environ.get(f"LECTERN_{f.name.upper()}", given.get(f.name, f.default))
        out[f.name] = type(f.default)(value)
    return Settings(**out)
