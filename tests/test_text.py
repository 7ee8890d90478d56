import html
import re
import unicodedata

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lectern.functions import chunking, cleaning, fixed
from lectern.operators import vectors


def plain_clean(text):
    """The cleaner's rules step by step on one string."""
    text = re.sub(fixed.COMMENT, "", text or "", flags=re.S)
    text = unicodedata.normalize("NFKC", re.sub(fixed.TAG, " ", html.unescape(text)))
    text = "".join(c for c in text if c in "\t\n\r" or unicodedata.category(c) != "Cc")
    text = re.sub(fixed.PHONE, "", re.sub(fixed.EMAIL, "", text))
    for p in fixed.BOILERPLATE:
        text = re.sub(p, "", text, flags=re.I | re.M)
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text))
    text = re.sub(r"^[ \t]+", "", re.sub(r"[ \t]+$", "", text, flags=re.M), flags=re.M).strip()
    return text if len(text) >= 10 else ""


CASES = [
    None,
    "",
    "short",
    "Hello &amp; World!   <b>bold</b> text",
    "<!-- a\nb -->A line of text\t\twith tabs\n\n\n\n  and more  \n",
    "&lt;b&gt;not a tag&lt;/b&gt; after all of it",
    "mail me at a.b@example.com or call 555-123-4567 today please",
    "ﬁne ½ text with ligatures and \x07 bells",
    "Intro text here\nLast updated: yesterday\nPage 3 of 9\nBack to top and the rest",
    "© 2024 Some School. All rights reserved. The text goes on.",
]


def test_clean_text(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string")
    got = {r.i: r.c for r in rows.select("i", cleaning.clean_text(F.col("t")).alias("c")).collect()}
    assert got == {i: plain_clean(t) for i, t in enumerate(CASES)}


def test_clean_pages_agree(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = pages.select("html", cleaning.clean_text(F.col("html")).alias("c")).collect()
    assert all(r.c == plain_clean(r.html) for r in got)


def test_clean_list(spark):
    row = spark.sql("SELECT array('  one topic here ', '', 'x') AS a, array('') AS b, CAST(NULL AS array<string>) AS c")
    got = row.select(cleaning.clean_list(F.col("a")).alias("a"), cleaning.clean_list(F.col("b")).alias("b"), cleaning.clean_list(F.col("c")).alias("c")).first()
    assert (got.a, got.b, got.c) == (["one topic here"], None, None)


def test_truncate(spark):
    row = spark.sql("SELECT 'abcdefghij' AS t").select(cleaning.truncate(F.col("t"), 8).alias("a"), cleaning.truncate(F.col("t"), 10).alias("b")).first()
    assert (row.a, row.b) == ("abcde...", "abcdefghij")


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab .!?\n"), max_size=400))
def test_chunks_keep_their_sizes(text):
    found = chunking.chunks_of(text, 50, 10, 5)
    if len(text) <= 50:
        assert found == ([text] if text else [])
    else:
        assert all(5 <= len(c.strip()) for c in found)
        words = re.findall("[ab]+", text)
        longest = max(map(len, re.findall(r"\S+", text)), default=0)
        assert all(len(c) <= max(50, longest) + 11 for c in found)
        assert all(w in words or longest > 50 or any(w in x for x in words) for c in found for w in re.findall("[ab]+", c))


def test_chunk_rules():
    assert list(chunking.join_while(["a" * 20, " ", "b" * 20, "c" * 20], 45, "\n\n")) == ["a" * 20 + "\n\n" + "b" * 20, "c" * 20]
    assert list(chunking.pack_words("aa bb cc dd", 6)) == ["aa bb", "cc dd"]
    assert chunking.tail_of("One. Two words here", 12) == "words here"
    assert chunking.tail_of("First part. Second", 10) == "Second"
    assert chunking.tail_of("abc", 10) == "abc"
    assert chunking.chunks_of(" " * 50, 20, 5, 3) == []


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(1, "word " * 400), (2, ""), (3, None), (4, "tiny")], "doc_id long, text string")
    rows = chunking.chunk_rows(docs, "doc_id").collect()
    assert {r.doc_id for r in rows} == {1, 4}
    assert len({r.chunk_id for r in rows}) == len(rows)


def test_hash_embedding(spark):
    rows = spark.createDataFrame([(1, "some words here"), (2, "some words here"), (3, ""), (4, None)], "id int, text string")
    got = {r.id: r.embedding for r in vectors.hash_embedding(rows).collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-6
    assert set(got[3]) == {0.0} and set(got[4]) == {0.0}


def test_entities_of_every_kind_equal_their_sql(spark, tmp_path):
    """Cut, numeric, unknown and overlapping entities, against the SQL of the query."""
    import duckdb

    from lectern.plans import catalogue

    texts = [None, "", "&", "&amp", "&am", "&ampx;", "&amp;amp;", "&notit;", "&#0;&#128;&#x9f&#xD800;&#11;&#99999999999999999999;", "&#x1F600;&#65b", "&x;é&eacute", "a\n&amp\n&copy2&zz&gt;="]
    spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = {tuple(r) for r in catalogue.queries()["decode_entities_nfkc"](spark, str(tmp_path)).select("page_id", "h").collect()}
    assert got == set(con.sql(catalogue.oracle_sql()["decode_entities_nfkc"]).fetchall()) and len(got) == len(texts)


def test_long_texts_of_several_slices(spark):
    """More long texts in a batch than are split at a time: each keeps its own chunks."""
    texts = [" ".join(f"w{i}x{j}." for j in range(300 + i)) for i in range(2 * chunking.ROWS_AT_ONCE + 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {r.id: r._c for r in chunking.split_text(df, out="_c", size=400, overlap=50, least=10).collect()}
    assert got == {i: chunking.chunks_of(t, 400, 50, 10) for i, t in enumerate(texts)}


def test_entities_in_two_passes_and_nfkc(spark, tmp_path):
    """Numbers that the first pass makes are decoded, too, and the text comes out in NFKC, in query and SQL alike."""
    import hashlib

    import duckdb

    from lectern.plans import catalogue

    texts = {
        "&amp;#65;&amp;#x42;&#38;amp;#67;": "AB&amp;#67;",
        "&amp;#38;#x44;": "D",
        "&#٦٥; &amp;#٦6;": "A B",
        "&amp;#0;e&amp;#769;": "\0é",
        "&amp;#x110000;&amp;#xD800;&amp;#99999999999999999999;": "���",
        "&amp;#128;&amp;#65": "\x80&#65",
        "a&nbsp;ﬁne&frac12;①Å": "a fine1⁄21Å",
        "e&#769; ｶﾞ �＇": "é ガ �'",
        "가 q̣̇ ẛ̣": "가 q̣̇ ṩ",
    }
    spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts.values())}
    assert {r.page_id: r.h for r in catalogue.queries()["decode_entities_nfkc"](spark, str(tmp_path)).collect()} == want
    assert dict(con.sql(catalogue.oracle_sql()["decode_entities_nfkc"]).fetchall()) == want
    row = spark.createDataFrame([("Text: &amp;#65;&amp;#x42; and more",)], "t string").select(cleaning.clean_text(F.col("t")).alias("t")).first()
    assert row.t == "Text: AB and more"
