import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import collocations

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows, least, most):
    """The definition, over (lang, text)."""
    total, counts, left, right = Counter(), {}, Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        c = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    g = tuple(w[i : i + k])
                    c[g] += 1
                    left[lang, g] += i > 0
                    right[lang, g] += i + k < len(w)
    out = []
    for lang, c in counts.items():
        wanted = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        gone = {h[i:j] for h, m in wanted.items() for i in range(len(h)) for j in range(i + 2, len(h) + 1) if j - i < len(h) and 100 * m >= 100 * c[h[i:j]]}
        found = []
        for g, a in wanted.items():
            if g not in gone:
                score, k = min((1000 * a * total[lang] // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]], left[lang, g], right[lang, g]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s, x, y) for i, (s, a, p, l, r, x, y) in enumerate(sorted(found)[:most])]
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    common = ["the", "of", "a", "b", "éa", "zé", "𝒳"]
    texts = []
    for i in range(120):
        words = rng.choice([*common, f"w{i}", "tail"], int(rng.integers(0, 60)))
        joints = rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\x0b", "! ", "\x0c", "\x1c "], len(words), p=[0.62, 0.1, 0.05, 0.05, 0.05, 0.05, 0.02, 0.02, 0.02, 0.02])
        texts.append((["en", "de", None, "", "und"][i % 5], "".join(a + b for a, b in zip(words, joints, strict=True))))
    texts += [("en", "New York City Hall of Fame")] * 12 + [("en", "NEW york city hall, of fame")] * 3 + [("fr", None), (None, None), ("fr", ""), ("de", "  \t ..;"), ("en", "a " * 400), ("en", "the of " * 200)]
    df = spark.createDataFrame(texts, "lang string, text string")
    return df.selectExpr("lang", "text", "1 AS shard", "2 AS words", "3 AS n", "4 AS gid", "5 AS p"), texts


@pytest.mark.parametrize(("least", "most", "size"), [(3, 2000, 8 << 20), (10, 7, 16), (2, 50, 300)])
def test_equals_plain(corpus, least, most, size):
    """Whatever the size of shards, steps and partitions."""
    df, texts = corpus
    assert rows(collocations.mine(df.repartition(4), least, most, shard_bytes=size)) == plain(texts, least, most)


def test_nothing(corpus):
    df, texts = corpus
    assert collocations.mine(df.limit(0)).collect() == []
    assert collocations.mine(df, 100_000).collect() == []
    assert collocations.mine(df.filter("text IS NULL"), 1).collect() == []


def test_one_text_over_many_shards(spark):
    text = "in a long text, of many pieces; " * 300 + "one piece without stops " * 200
    df = spark.createDataFrame([("en", text)], "lang string, text string")
    assert collocations.shards(df, 128).count() > 20
    assert rows(collocations.mine(df, 5, shard_bytes=128)) == plain([("en", text)], 5, 2000)


def test_packed_columns():
    rng = np.random.default_rng(1)
    columns = [rng.integers(-(2**62), 2**62, 999), np.arange(999), np.zeros(999, np.int64)]
    assert all((a == b).all() for a, b in zip(collocations.unpack(collocations.pack(*columns)), columns, strict=True))
    assert collocations.unpack(collocations.pack(np.zeros(0, np.int64))).shape == (1, 0)


def test_scores_beyond_64_bits(spark):
    grams = spark.createDataFrame([("en", ["a", "b", "c"], 10**13, 0, 0, [4 * 10**13, 2 * 10**13, 10**13], [3 * 10**13, 10**13 + 7, 10**13])], "lang string, words array<string>, n long, n_left long, n_right long, first array<long>, last array<long>")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    got = collocations.scored(grams, totals).first()
    cuts = [(1000 * 10**13 * 10**15 // (l * r), l, r) for l, r in ((4 * 10**13, 10**13 + 7), (2 * 10**13, 3 * 10**13))]
    assert (got.score, got.l, got.r) == min(cuts)


def test_index_counts_every_phrase():
    """Intervals in both directions against counting, through transforms that are sorted five words deep."""
    rng = np.random.default_rng(7)
    t = np.append(np.append(0, rng.choice([0, 1, 2, 3, 4, 5], 4000, p=[0.1, 0.1, 0.3, 0.2, 0.2, 0.1])), 0).astype(np.int32)
    ahead, back = collocations.FmIndex(collocations.transform(t)), collocations.FmIndex(collocations.transform(t[::-1]))
    size = np.bincount(t)
    first = (np.cumsum(size) - size)[2:]
    level = {(s,): x for s, *x in zip(range(2, 6), first, size[2:], first, strict=True)}
    for depth in range(2, 6):
        grams = list(level)
        lo, n, rlo = (np.array([level[g][i] for g in grams]) for i in range(3))
        right = depth % 2
        owner, symbol, new, count, other = back.extend(rlo, n, lo) if right else ahead.extend(lo, n, rlo)
        level = {}
        for o, s, a, c, b in zip(owner, symbol, new, count, other, strict=True):
            level[(*grams[o], int(s)) if right else (int(s), *grams[o])] = (b, c, a) if right else (a, c, b)
        want = Counter(g for i in range(len(t) - depth + 1) if min(g := tuple(map(int, t[i : i + depth]))) >= 2)
        assert {g: int(x[1]) for g, x in level.items()} == want
        lo, n, rlo = (np.array([level[g][i] for g in level]) for i in range(3))
        before = Counter(tuple(map(int, t[i : i + depth])) for i in range(1, len(t) - depth + 1) if t[i - 1])
        after = Counter(tuple(map(int, t[i : i + depth])) for i in range(len(t) - depth) if t[i + depth])
        assert ahead.followed(lo, n).tolist() == [before[g] for g in level] and back.followed(rlo, n).tolist() == [after[g] for g in level]


def test_index_is_not_shuffled_again(spark, corpus):
    """Levels read the bucketed index in place: only phrases go through an exchange."""
    name = "bucketed_index_test"
    spark.range(40).select(F.col("id").alias("shard"), *(F.lit(b"").alias(c) for c in ("bwt", "reversed", "gids"))).write.bucketBy(4, "shard").sortBy("shard").saveAsTable(name)
    held = spark.range(9).select(F.col("id").alias("of"), F.lit(2).alias("depth"), F.lit(b"").alias("data"))
    plan = collocations.longer(spark.table(name), held, 4, 2)._jdf.queryExecution().executedPlan().toString()
    spark.sql(f"DROP TABLE {name}")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
