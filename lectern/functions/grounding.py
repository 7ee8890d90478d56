"""Codes, citations and claims in answers, and how well sources support them. Sources are array<struct<chunk_id, text>>."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import fixed
from lectern.functions.cleaning import strip_ends


def course_codes(text: Column) -> Column:
    """All codes in a text, in order, as "XX 123"."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?U){fixed.CODE}"), F.lit(0)), lambda c: F.regexp_replace(c, "(?U)^([A-Z]+)\\s*", "$1 "))


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.CITATION), F.lit(1))


def quantities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?iU){fixed.QUANTITY}"), F.lit(1))


def code_prefix(code: Column) -> Column:
    return F.when(code.contains(" "), F.split_part(code, F.lit(" "), F.lit(1))).otherwise(F.regexp_extract(code, "^[A-Za-z]*", 0))


def code_number(code: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(code, "(\\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))


def claims(answer: Column) -> Column:
    """Sentences that name a code or a quantity, each with its codes, quantities and citations (not trimmed)."""
    parts = F.filter(F.transform(F.split(answer, "(?U)[.!?]\\s+", -1), lambda s: strip_ends(s)), lambda s: s != "")
    found = F.transform(parts, lambda s: F.struct(s.alias("text"), course_codes(s).alias("codes"), quantities(s).alias("numbers"), citations(s).alias("cited")))
    return F.filter(found, lambda c: (F.size(c["codes"]) > 0) | (F.size(c["numbers"]) > 0))


def says_any(text: Column, phrases: list[str]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(p) for p in phrases])


def hedges(text: Column) -> Column:
    return F.filter(F.array(*map(F.lit, fixed.HEDGING_PHRASES)), lambda p: F.contains(F.lower(text), p))


def abstains(text: Column) -> Column:
    return says_any(text, fixed.ABSTENTION_PHRASES)


def supported(claim: Column, sources: Column) -> Column:
    """Whether a cited source has a code's letters and digits or a number of the claim, or any source has a whole code."""

    def source_supports(s: Column) -> Column:
        low = F.lower(s["text"])
        code = F.exists(claim["codes"], lambda c: F.contains(low, F.lower(F.split_part(c, F.lit(" "), F.lit(1)))) & F.contains(low, F.split_part(c, F.lit(" "), F.lit(2))))
        return F.array_contains(claim["cited"], s["chunk_id"]) & (code | F.exists(claim["numbers"], lambda n: F.contains(s["text"], n)))

    everything = F.array_join(F.transform(sources, lambda s: F.lower(s["text"])), " ")
    return F.exists(sources, source_supports) | F.exists(claim["codes"], lambda c: F.contains(everything, F.lower(c)))


def check_answers(df: DataFrame, answer: str = "answer", sources: str = "sources", least: float = 0.5) -> DataFrame:
    """df with n_citations, n_valid, n_claims, n_supported, invalid, abstention, grounding_score, is_grounded."""
    df = df.withColumn("_cited", F.transform(citations(F.col(answer)), lambda c: strip_ends(c))).withColumn("_claims", claims(F.col(answer)))
    df = df.withColumn("_ids", F.transform(sources, lambda s: s["chunk_id"])).withColumn("abstention", abstains(F.col(answer)))
    df = df.withColumn("_valid", F.filter("_cited", lambda c: F.array_contains("_ids", c))).withColumn("_sure", F.filter("_claims", lambda c: supported(c, F.col(sources))))
    n = {k: F.size(f"_{k}") for k in ("cited", "valid", "claims", "sure")}
    by_claims = F.when(n["claims"] > 0, 0.6 * n["sure"] / n["claims"]).otherwise(F.lit(0.3))
    by_citations = F.when(n["cited"] > 0, 0.2 * n["valid"] / n["cited"]).otherwise(F.lit(0.1))
    bonus = F.when((n["sure"] > 0) | (n["valid"] > 0), F.lit(0.2)).otherwise(F.lit(0.0))
    score = F.when(F.col("abstention"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), by_claims + by_citations + bonus))
    df = df.select(
        *[c for c in df.columns if not c.startswith("_")],
        n["cited"].cast("long").alias("n_citations"),
        n["valid"].cast("long").alias("n_valid"),
        n["claims"].cast("long").alias("n_claims"),
        n["sure"].cast("long").alias("n_supported"),
        F.array_except("_cited", "_ids").alias("invalid"),
        score.alias("grounding_score"),
    )
    return df.withColumn("is_grounded", (F.col("grounding_score") >= least) & ((F.col("n_citations") > 0) | F.col("abstention")))


def grounded_by_score(df: DataFrame, answer: str = "answer", sources: str = "sources", least: float = 0.5) -> DataFrame:
    """df with grounded: the score alone decides, an answer without citations may pass."""
    checked = check_answers(df.withColumn("_sources", F.col(sources)), answer, sources)
    return checked.select(*[c for c in df.columns if not c.startswith("_")], (F.col("grounding_score") >= least).alias("grounded"))


def course_exists(code: Column, sources: Column) -> Column:
    """Whether one source has both parts of a code; a code that is not two words exists nowhere."""
    parts = F.split(strip_ends(F.upper(code)), "(?U)\\s+", -1)
    return (F.size(parts) == 2) & F.exists(sources, lambda s: F.contains(F.upper(s["text"]), F.get(parts, F.lit(0))) & F.contains(F.upper(s["text"]), F.get(parts, F.lit(1))))


def feedback() -> Column:
    """A checked answer's verdict, citations and claims as lines."""
    count = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("/"), F.col(b).cast("string"))
    return F.concat_ws(
        "\n",
        F.concat(F.when(F.col("is_grounded"), "✓ Grounded").otherwise("✗ Not Grounded"), F.lit(" (Score: "), F.format_number("grounding_score", 2), F.lit(")")),
        F.concat(F.lit("Citations: "), count("n_valid", "n_citations"), F.lit(" valid")),
        F.when(F.size("invalid") > 0, F.concat(F.lit("  Invalid: "), F.array_join("invalid", ", "))),
        F.concat(F.lit("Claims: "), count("n_supported", "n_claims"), F.lit(" verified")),
    )
