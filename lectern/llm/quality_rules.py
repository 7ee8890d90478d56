"""Quality rules with host verdicts, in DataFrame functions only.

Each document is measured (words are runs of characters other than 0x20 and 0x09-0x0D) and checked
against rules. Rule failures are then counted by host (the `source` column); each rule's failure
rate of a host is shrunk with a beta prior whose two parameters come from the mean and variance of
the rates of all hosts, each host counting by its documents. Verdicts join back to the documents:

* A host whose shrunk rate of a rule is above SUSPECT times the prior's mean is suspect by that rule, and its
  documents that fail the rule go, though symbols and repeated lines alone reject no document elsewhere.
* A host whose shrunk rate of any rule is above HOST_LIMIT is rejected with all its documents.

Null or empty text has no words and fails the base rules. Documents with a null host get no host
verdict. Repeated rows are separate documents, judged alike. Texts of any length are measured whole. A rate that
equals a limit (a tie) is not above it. Other columns pass through drop_failures() unread, whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.llm.common import packed, stored, table, unpacked

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PERCENT = 30
MAX_DUP_LINES_PERCENT = 30
HOST_LIMIT, SUSPECT = 0.5, 1.25
#: A host on its own, or hosts of equal rates, give no variance; the prior then counts as this many documents.
FLAT_PRIOR = 1e6
BROADCAST_HOSTS = 50_000

SPACES = " \t\n\x0b\x0c\r"
GAP = "[\\x20\\x09-\\x0D]+"
RULES = ("short", "repeated", "symbols", "dup_lines")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeat_words(pairs: Column) -> Column:
    """Words inside 3-word windows found twice or more. pairs: (window hash, place), sorted."""
    same = lambda p, k: F.get(pairs, k)["h"].eqNullSafe(p["h"])
    places = F.transform(F.filter(F.transform(pairs, lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"])), lambda i: i.isNotNull()), lambda i: i)
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"))
    return F.aggregate(F.sort_array(places), start, step)["n"].cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words appended under the prefix q_."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.withColumn("q_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP, -1))).withColumn("q_l", lines)
    word = lambda k: F.get(F.col("q_words"), k)
    windows = F.when(F.size("q_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("q_words") - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("q_windows", windows)
    out = out.withColumn("q_again", F.size("q_windows") > F.size(F.array_distinct("q_windows")))
    out = out.withColumn("q_pairs", F.when(F.col("q_again"), F.sort_array(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    return out.select(
        *docs.columns,
        F.size("q_words").cast("long").alias("q_n_words"),
        F.length(F.array_join("q_words", "")).cast("long").alias("q_word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("q_n_symbols"),
        F.size("q_l").cast("long").alias("q_n_lines"),
        (F.size("q_l") - F.size(F.array_distinct("q_l"))).cast("long").alias("q_n_dup_lines"),
        F.when(F.col("q_again"), _repeat_words(F.col("q_pairs"))).otherwise(F.lit(0).cast("long")).alias("q_n_repeat_words"),
    )


def rule_failures() -> dict[str, Column]:
    n = F.col("q_n_words")
    return {
        "short": n < MIN_WORDS,
        "repeated": 100 * F.col("q_n_repeat_words") > MAX_REPEAT_PERCENT * n,
        "symbols": 100 * F.col("q_n_symbols") > MAX_SYMBOLS_PERCENT * n,
        "dup_lines": 100 * F.col("q_n_dup_lines") > MAX_DUP_LINES_PERCENT * F.col("q_n_lines"),
    }


def base_failed() -> Column:
    rules = rule_failures()
    return rules["short"] | rules["repeated"]


def host_verdicts(measured: DataFrame) -> DataFrame:
    """host, n_docs, shrunk_<rule>, suspect_<rule>, host_rejected: one row per non-null host."""
    failed = rule_failures()
    hosts = measured.filter(F.col("source").isNotNull()).groupBy(F.col("source").cast("string").alias("host")).agg(F.count("*").alias("n_docs"), *(F.count_if(failed[r]).alias(f"f_{r}") for r in RULES))
    n, squares = F.sum("n_docs"), {r: F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n_docs")) for r in RULES}
    prior = hosts.agg(*(c for r in RULES for c in ((F.sum(f"f_{r}") / n).alias(f"m_{r}"), (squares[r] / n).alias(f"q_{r}")))).first()
    for r in RULES:
        m, q = prior[f"m_{r}"] or 0.0, prior[f"q_{r}"] or 0.0
        v = q - m * m
        weight = max(m * (1 - m) / v - 1, 0.0) if v > 1e-12 else FLAT_PRIOR
        hosts = hosts.withColumn(f"shrunk_{r}", (F.col(f"f_{r}") + F.lit(m * weight)) / (F.col("n_docs") + F.lit(float(weight))))
        hosts = hosts.withColumn(f"suspect_{r}", F.col(f"shrunk_{r}") > F.lit(SUSPECT * m))
    return hosts.select("host", "n_docs", *(f"{k}_{r}" for k in ("shrunk", "suspect") for r in RULES), (F.greatest(*(F.col(f"shrunk_{r}") for r in RULES)) > HOST_LIMIT).alias("host_rejected"))


def with_verdicts(measured: DataFrame) -> DataFrame:
    """Measured rows with base_failed and kept."""
    verdicts = ("host_rejected", *(f"suspect_{r}" for r in RULES))
    hosts = stored(host_verdicts(measured).select(F.col("host").alias("_host"), *verdicts), "hosts")
    few = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = measured.join(F.broadcast(hosts) if few else hosts, measured["source"].cast("string") == hosts["_host"], "left")
    failed = rule_failures()
    by_host = F.col("host_rejected")
    for r in RULES:
        by_host = by_host | (F.col(f"suspect_{r}") & failed[r])
    return joined.select(measured.columns + [base_failed().alias("base_failed"), (~base_failed() & ~F.coalesce(by_host, F.lit(False))).alias("kept")])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, source, the measures, base_failed and kept: one row per row of docs."""
    return with_verdicts(stored(measure(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")).drop("text"), "rules"))


def drop_failures(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all columns of docs."""
    inner = packed(docs, "text", "source")
    # written once with the measures; rows that fail the base rules count for their hosts, but need no text any more
    text, rest = (F.when(~base_failed(), F.col(c)).alias(c) for c in ("text", "rest_columns"))
    measured = stored(measure(inner).select(text, "source", rest, *(f"q_{c}" for c in MEASURES)), "rules")
    return unpacked(with_verdicts(measured).filter("kept").select(inner.columns), docs.columns, "text", "source")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *(F.col(f"q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def _oracle_rules(alias: str) -> dict[str, str]:
    return {
        "short": f"{alias}.n_words < {MIN_WORDS}",
        "repeated": f"100 * {alias}.n_repeat_words > {MAX_REPEAT_PERCENT} * {alias}.n_words",
        "symbols": f"100 * {alias}.n_symbols > {MAX_SYMBOLS_PERCENT} * {alias}.n_words",
        "dup_lines": f"100 * {alias}.n_dup_lines > {MAX_DUP_LINES_PERCENT} * {alias}.n_lines",
    }


_R = _oracle_rules("m")
ORACLE_BODY = f"""
d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM {{documents}}),
w AS (SELECT doc_id, list_filter(string_split_regex(t, '{GAP}'), lambda x: x <> '') AS ws FROM d),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g WHERE c IS NOT NULL),
p AS (SELECT doc_id, count(DISTINCT i + s) AS n FROM r, (VALUES (0), (1), (2)) AS v(s) WHERE k > 1 GROUP BY doc_id),
ls AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
m AS (
  SELECT d.doc_id, d.source, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(array_to_string(w.ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls.l) AS BIGINT) AS n_lines,
    CAST(len(ls.l) - len(list_distinct(ls.l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (doc_id) JOIN ls USING (doc_id) LEFT JOIN p USING (doc_id)
),
h AS (SELECT source, count(*) AS n_docs, {", ".join(f"count(*) FILTER (WHERE {_R[r]}) AS f_{r}" for r in RULES)} FROM m WHERE source IS NOT NULL GROUP BY source),
pr AS (SELECT {", ".join(f"sum(f_{r}) / sum(n_docs) AS m_{r}, sum(f_{r} * f_{r} / n_docs) / sum(n_docs) - (sum(f_{r}) / sum(n_docs)) * (sum(f_{r}) / sum(n_docs)) AS v_{r}" for r in RULES)} FROM h),
pw AS (SELECT *, {", ".join(f"CASE WHEN v_{r} > 1e-12 THEN greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 0) ELSE {FLAT_PRIOR} END AS w_{r}" for r in RULES)} FROM pr),
hs AS (SELECT source, {", ".join(f"(f_{r} + m_{r} * w_{r}) / (n_docs + w_{r}) AS s_{r}, m_{r}" for r in RULES)} FROM h, pw),
hv AS (SELECT source, greatest({", ".join(f"s_{r}" for r in RULES)}) > {HOST_LIMIT} AS rejected, {", ".join(f"s_{r} > {SUSPECT} * m_{r} AS suspect_{r}" for r in RULES)} FROM hs)
"""
ORACLE = f"""
WITH {ORACLE_BODY.format(documents="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_R["short"]} OR {_R["repeated"]}) AS base_failed,
  NOT ({_R["short"]} OR {_R["repeated"]}) AND NOT coalesce(rejected OR {" OR ".join(f"(suspect_{r} AND ({_R[r]}))" for r in RULES)}, false) AS kept
FROM m LEFT JOIN hv USING (source)
"""
