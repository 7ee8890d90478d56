import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.llm import packing, quality_classifier, quality_rules, warc_archive
from lectern.llm.common import scratch


def measured(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_rules_equal_brute_force(docs, nothing):
    got = quality_rules.judge(docs).collect()
    want = Counter()
    for r in docs.collect():
        n, chars, symbols, dup, again = measured(r.text)
        want[r.doc_id, n, chars, symbols, dup, again, n < 50 or 100 * again > 50 * n] += 1
    assert Counter((r.doc_id, r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words, r.base_failed) for r in got) == want
    assert quality_rules.judge(nothing).count() == 0
    kept = quality_rules.drop_failures(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_host_verdicts(spark):
    fine = " ".join(f"w{i}" for i in range(60))
    noisy = fine + " " + "#" * 40
    rows = [(i, "bad", "x y") for i in range(50)] + [(50, "bad", fine)] + [(100 + i, "good", fine) for i in range(50)] + [(200, "one", "x y"), (201, None, fine), (202, None, noisy)] + [(300 + i, f"h{i}", fine) for i in range(8)]
    rows += [(400 + i, "loud", noisy if i < 20 else fine) for i in range(60)] + [(500, "good", noisy)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    kept = {k: r.kept for k, r in got.items()}
    assert not kept[50] and kept[100] and kept[201] and kept[300]  # a host that is rejected
    assert not kept[400] and kept[459] and kept[500] and kept[202]  # one that is suspect by its symbols only
    assert not got[400].base_failed


def test_host_verdicts_act_on_the_given_tables(spark):
    rows = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy().agg(F.count_if(~F.col("base_failed") & ~F.col("kept")).alias("by_host"), F.count_if("kept").alias("kept")).first()
    assert 0 < rows["by_host"] < 0.05 * rows["kept"]


def test_rules_stay_in_the_jvm(docs):
    plan = quality_rules.drop_failures(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_classifier_on_held_out_labels(spark, sf_dir):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train, test = labels.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 = 0")
    got = quality_classifier.judge(docs, train).join(test, "doc_id").select("kept", "quality", "p_quality").toPandas()
    assert (got["kept"].astype(int) == got["quality"]).mean() > 0.95
    assert got["p_quality"].between(0, 1).all()


def test_rounds_do_no_harm(spark):
    """On the given tables the exchange leaves accuracy on held-out labels at least as it was, in every split, and explains them better over all."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    features = quality_classifier.viewed(spark.read.parquet(f"{d}/documents.parquet")).cache()
    gain = 0.0
    for cut in range(3):
        test = labels.filter(f"doc_id % 3 = {cut}").join(features, "doc_id").toArrow().combine_chunks()
        y = test["quality"].to_numpy()
        x = [quality_classifier._matrix(test[c].combine_chunks(), n) for c, n in (("content", quality_classifier.CONTENT), ("meta", quality_classifier.META))]
        right, fit = {}, {}
        for rounds in (0, quality_classifier.ROUNDS):
            p = quality_classifier.fit(features, labels.filter(f"doc_id % 3 <> {cut}"), rounds).score(*x)[2]
            right[rounds], fit[rounds] = ((p >= quality_classifier.KEEP) == y).mean(), np.log(np.where(y == 1, p, 1 - p)).mean()
        assert right[quality_classifier.ROUNDS] >= right[0]
        gain += fit[quality_classifier.ROUNDS] - fit[0]
    assert gain > 0


def test_poor_teachers_do_not_teach():
    """A view that knows less than its student where it is sure gives it no labels; the better view teaches on."""
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 400) * 1.0
    good, poor = y * 4 + rng.normal(size=400), np.where(rng.random(400) < 0.85, y, 1 - y) * 6 + rng.normal(size=400)
    asked = []
    m = quality_classifier.CoTrained((good[:, None], poor[:, None]), y, lambda s, t: asked.append(t) or quality_classifier.confident_sums((good[:, None], poor[:, None]), s, t), 2)
    assert m.gives[0] == (True, True) and not all(m.gives[1])
    assert asked and all(t[1].gives == m.gives[1] for t in asked)


def test_query_equals_plain(spark, sf_dir):
    """Every score of the query against one model fitted and applied over whole arrays, without Spark's sums."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").toArrow().combine_chunks()
    column = lambda c: rows[c].combine_chunks()
    x = quality_classifier.content_features(column("text")), quality_classifier.metadata_features(column("lang"), column("source"), column("n_chars"))
    x = [v.astype("<f4").astype(np.float64) for v in x]
    ids = rows["doc_id"].to_numpy()
    order = {r[0]: i for i, r in enumerate(docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect())}
    quality = dict(zip(labels["doc_id"], labels["quality"], strict=True))
    known = np.array(sorted((i for i, d in enumerate(ids) if d in quality), key=lambda i: order[ids[i]]))
    free = np.setdiff1d(np.arange(len(ids)), known)
    y = np.array([float(quality[ids[i]]) for i in known])
    m = quality_classifier.CoTrained(tuple(v[known] for v in x), y, lambda s, t: quality_classifier.confident_sums(tuple(v[free] for v in x), s, t))
    want = dict(zip(ids, m.score(*x)[2], strict=True))
    got = quality_classifier.query(spark, sf_dir).collect()
    assert len(got) == len(ids) and max(abs(r.p_quality - want[r.doc_id]) for r in got) < 1e-6


def test_classifier_odd_rows(docs, nothing, labels, spark):
    got = quality_classifier.judge(docs, labels)
    assert got.count() == docs.count() and got.filter("p_quality IS NULL").count() == 0
    kept = quality_classifier.drop_rejected(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == got.filter("kept").count()
    assert quality_classifier.judge(nothing, labels).count() == 0
    one = quality_classifier.judge(docs, labels.filter("quality = 0"))
    assert one.filter("NOT kept").count() == 0
    assert quality_classifier.drop_rejected(docs, labels.limit(0)).count() == docs.count()


def test_views_teach_each_other():
    """On few labels and many documents without, rounds beat none; each view alone, too."""
    gains = []
    for seed in range(5):
        rng = np.random.default_rng(seed)
        y = rng.permutation(np.arange(24) % 2) * 1.0
        view = lambda y, d: np.column_stack([y * 1.2 + rng.normal(size=len(y)) for _ in range(d)] + [rng.normal(size=len(y)) for _ in range(12)])  # noqa: E731, B023
        pool_y, test_y = rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)
        labelled, pool, test = ((view(t, 6), view(t, 6)) for t in (y, pool_y, test_y))
        accuracy = {}
        for rounds in (0, quality_classifier.ROUNDS):
            m = quality_classifier.CoTrained(labelled, y, lambda s, t: quality_classifier.confident_sums(pool, s, t), rounds)  # noqa: B023
            accuracy[rounds] = [((v.logit(x) > 0) == test_y).mean() for v, x in zip(m.views, test, strict=True)]
        gains.append(np.subtract(accuracy[quality_classifier.ROUNDS], accuracy[0]))
    assert (np.mean(gains, 0) > 0.01).all()


def test_rounds_use_all_documents(spark, labels):
    """The sums that Spark adds up are those of all rows without a label at once."""
    docs = spark.createDataFrame([(i, f"word{i % 7} and {'loud !!!' if i % 2 else 'calm'} {i}", "en", f"s{i % 2}", i % 50) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    features = quality_classifier.viewed(docs.repartition(5))
    rows = features.toArrow().combine_chunks()
    x = quality_classifier._matrix(rows["content"], quality_classifier.CONTENT), quality_classifier._matrix(rows["meta"], quality_classifier.META)
    ids = rows["doc_id"].to_numpy()
    y = (ids % 2).astype(float)
    views = [quality_classifier.Logistic().fit(v[ids < 40], y[ids < 40]) for v in x]
    want = quality_classifier.confident_sums(tuple(v[ids >= 40] for v in x), views, views)
    got = quality_classifier.summed_over(features, np.arange(40), views, views)
    assert want[0] > 0 and np.allclose(got, want)


def test_warc_round_trip(spark):
    big = "é" * 800
    rows = [(1, "http://a/\r\nX: y", big), (2, "http://b", big), (2, "http://b", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS row")
    path = scratch(spark, "test-warc")
    warc_archive.write(pages, path)
    got = warc_archive.read(spark, path).collect()
    assert Counter((r.page_id, bytes(r.payload)) for r in got) == Counter((p, (h or "").encode()) for p, _, h in rows)
    assert all(r.payload_digest == hashlib.sha1(bytes(r.payload)).hexdigest() and r.payload_bytes == len(r.payload) for r in got)
    large = [(r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes >= 1000]
    assert Counter(large) == Counter([(2, "response", None), (2, "revisit", 2), (1, "revisit", 2), (None, "revisit", 2)])
    assert {r.record_type for r in got if r.payload_bytes < 1000} == {"response"}
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    whole = warc_archive.records(spark, path).select(warc_archive.original(F.col("header"), F.col("payload")).alias("b")).collect()
    assert all(bytes(r.b).startswith(b"WARC/1.1\r\n") and bytes(r.b).endswith(b"\r\n\r\n") for r in whole)
    assert not any(b"\nX: y" in bytes(r.b).split(b"\r\n\r\n")[0] for r in whole)
    heads = [bytes(r.b).split(b"\r\n\r\n")[0] for r in whole]
    assert all(re.search(rb"\r\nWARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n", h) for h in heads)
    assert len({re.search(rb"WARC-Record-ID: (<urn:uuid:[0-9a-f-]{36}>)", h)[1] for h in heads}) == len(rows)


def test_warc_damage_and_empty(spark):
    path = scratch(spark, "test-warc")
    warc_archive.write(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit("next").cast("binary")).write.parquet(f"{path}/new")
    spark.read.parquet(f"{path}/new").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc_archive.read(spark, path).collect()
    empty = scratch(spark, "test-warc")
    warc_archive.write(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc_archive.read(spark, empty).count() == 0


def check_packing(packed, sizes, lengths):
    assert packed.groupby("row" if "row" in packed else "doc_id")["n_tokens"].sum().sort_index().tolist() == sizes
    for _, b in packed.groupby(["shard", "bin"]):
        b = b.sort_values("offset")
        assert b["capacity"].nunique() == 1 and b["capacity"].iloc[0] in lengths
        assert b["offset"].iloc[0] == 0 and (b["offset"].to_numpy()[1:] == (b["offset"] + b["n_tokens"]).to_numpy()[:-1]).all()
        used = int(b["n_tokens"].sum())
        assert b["capacity"].iloc[0] == min(x for x in lengths if x >= used)


def test_packing(spark):
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(1, 900, 300)] + [5000, 4096, 1]
    rows = spark.createDataFrame(pd.DataFrame({"row": range(len(sizes)), "doc_id": range(len(sizes)), "n_tokens": sizes}))
    packed = packing.pack(rows, shard_pieces=100).toPandas()
    check_packing(packed, sizes, packing.LENGTHS)
    bins = packed.groupby(["shard", "bin"])["capacity"].first().sum()
    assert bins < 1.12 * sum(sizes)


def test_best_fit_takes_the_fullest_bin():
    bins, offsets, final, _ = packing.fill([60, 50, 40, 30, 10], (100,), 100)
    assert bins == [0, 1, 0, 1, 1] and offsets == [0, 0, 60, 50, 80] and final == [100, 100]
    _, _, final, _ = packing.fill([60, 10], (64, 100), 100)
    assert final == [100]
    _, _, final, _ = packing.fill([30], (32, 64, 100), 100)
    assert final == [32]


def test_packing_odd_rows(docs, nothing):
    got = packing.pack_documents(docs).toPandas()
    want = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) + 1 for r in docs.collect())
    assert int(got["n_tokens"].sum()) == want
    assert packing.pack_documents(nothing).count() == 0


def least_cost(sizes, lengths):
    """The least cost of any division of the pieces into bins."""
    best = {0: 0}
    n = len(sizes)
    for made in range(1 << n):
        if made not in best:
            continue
        left = [i for i in range(n) if not made >> i & 1]
        if not left:
            continue
        for pick in range(1 << (len(left) - 1)):
            group = [left[0]] + [left[1 + j] for j in range(len(left) - 1) if pick >> j & 1]
            used = sum(sizes[i] for i in group)
            if used <= lengths[-1]:
                then = made | sum(1 << i for i in group)
                price = best[made] + packing.cost(next(x for x in lengths if x >= used))
                best[then] = min(best.get(then, price), price)
    return best[(1 << n) - 1]


def test_packing_cost_is_near_the_least():
    """Against all divisions of small shards into bins: never below the least cost, and close to it."""
    rng = np.random.default_rng(7)
    ratios = []
    for _ in range(25):
        sizes = [int(x) for x in rng.integers(20, 700, 7)]
        placed = packing.pack_shard(pd.DataFrame({"row": range(7), "piece": 0, "n_tokens": sizes}), packing.LENGTHS)
        got = sum(map(packing.cost, placed.groupby("bin")["capacity"].first()))
        ratios.append(got / least_cost(sizes, packing.LENGTHS))
    assert min(ratios) >= 1 and np.mean(ratios) < 1.1 and max(ratios) < 1.5


def test_packing_ignores_partitions(docs):
    rows = [Counter(map(tuple, packing.pack_documents(docs.repartition(n)).collect())) for n in (1, 5)]
    assert rows[0] == rows[1]


def test_packed_sequences(spark):
    """Token ids of whole documents come out of the written bins again."""
    ids = {i: [i * 10_000 + k for k in range(n)] for i, n in enumerate([5, 700, 9000, 1, 4096, 300])}
    tokens = spark.createDataFrame(list(ids.items()), "doc_id long, ids array<int>")
    placed = packing.pack(tokens.selectExpr("doc_id AS row", "doc_id", "size(ids) AS n_tokens")).cache()
    bins = packing.sequences(placed, tokens).collect()
    assert all(r.n_tokens == len(r.ids) <= r.capacity for r in bins)
    held = {(r.shard, r.bin): r.ids for r in bins}
    back = {i: {} for i in ids}
    for r in placed.collect():
        back[r.doc_id][r.first_token] = held[r.shard, r.bin][r.offset : r.offset + r.n_tokens]
    assert {i: [x for k in sorted(p) for x in p[k]] for i, p in back.items()} == ids


@pytest.mark.parametrize("parts", [1, 3])
def test_packed_token_ids(spark, docs, nothing, parts):
    """The library's ids of every row, null and repeated ids too, stand in the written sequences where the result says."""
    import zlib

    from tokenizers import Tokenizer

    from lectern.llm.bpe import vocabulary_path

    library = Tokenizer.from_file(vocabulary_path())
    path = scratch(spark, "test-sequences")
    placed = packing.pack_tokens(docs.repartition(parts), vocabulary_path(), path).collect()
    held = {(r.shard, r.bin): r for r in packing.read_sequences(spark, path).collect()}
    bins = {k: np.frombuffer(r.ids, "<u2") for k, r in held.items()}
    assert all(len(x) <= held[k].capacity == min(n for n in packing.LENGTHS if n >= len(x)) for k, x in bins.items())
    assert sum(map(len, bins.values())) == sum(r.n_tokens for r in placed)
    assert all(r.sequence_tokens == len(bins[r.shard, r.bin]) and r.sequence_crc32 == zlib.crc32(held[r.shard, r.bin].ids) for r in placed)
    want, got = Counter(), Counter()
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), packing.LENGTHS[-1]):
            want[r.doc_id, k, tuple(ids[k : k + packing.LENGTHS[-1]])] += 1
    for r in placed:
        got[r.doc_id, r.first_token, tuple(bins[r.shard, r.bin][r.offset : r.offset + r.n_tokens].tolist())] += 1
    assert got == want
    assert packing.pack_tokens(nothing, vocabulary_path()).count() == 0
