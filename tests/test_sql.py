from lectern.functions import sql


def test_functions_in_sql(spark):
    names = sql.register(spark)
    assert "lectern_chunks" in names
    r = spark.sql("SELECT lectern_course_codes('SE  301 and CE 100, X 1') AS c, lectern_citations('a [x ] b [y]') AS i, lectern_reciprocal_rank(array('a', 'b'), array('b')) AS r, lectern_hit_rate(array('a'), array('b')) AS h, lectern_strip_markup('a<!-- x --><b>c') AS m, lectern_text_hash('') AS s").first()
    assert (r.c, r.i, r.r, r.h, r.m) == (["SE 301", "CE 100"], ["x", "y"], 0.5, 0.0, "a c") and r.s.startswith("e3b0c442")
    rows = spark.sql("SELECT d.id, c.* FROM VALUES (1, 'one two three four'), (2, '') AS d(id, t), LATERAL lectern_chunks(d.t, 9, 0, 1) AS c").collect()
    assert [(x.id, x.chunk_index, x.chunk) for x in rows] == [(1, 0, "one two"), (1, 1, "three"), (1, 2, "four")]
