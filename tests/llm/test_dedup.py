import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from lectern.llm import exact_dedup, line_dedup, near_dedup
from lectern.llm.components import components
from lectern.llm.weighted_minhash import Sampler
from lectern.llm.words import hash_shingles, hash_words
from tests.llm.conftest import prose


def fold(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def test_exact_equals_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[fold(r.text)].append(r.doc_id)
    got = exact_dedup.exact_groups(docs, capacity=2).collect()
    assert len(got) == len(rows)
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            want[i, max(known, default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(fold(r.text) for r in kept.collect()) == sorted(groups)


def test_exact_empty(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert exact_dedup.drop_copies(nothing).columns == nothing.columns


def test_directory_doubles_where_buckets_are_full():
    d = exact_dedup.Directory({0: 5, 1: 5, 8: 1}, 4, 4)
    assert d.depth == 4 and len(d.slots) == 16
    assert d.sizes.tolist() == [5, 5, 0, 0, 1]
    keys = (np.array([0, 1, 8, 15], np.uint64) << np.uint64(60) ^ np.uint64(1 << 63)).view(np.int64)
    assert d.bucket(keys).tolist() == [0, 1, 4, 4]
    assert exact_dedup.Directory({}, 4, 1).bucket(keys).tolist() == [0, 0, 0, 0]
    assert sorted(d.owners(3).tolist()) == d.owners(3).tolist()


def test_colliding_keys_chain(spark, docs):
    """With keys of two bits most texts share one: owner tasks tell them apart by their bytes, and results don't change."""
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = Counter(map(tuple, exact_dedup.exact_groups(docs).select(columns).collect()))
    got = exact_dedup.exact_groups(docs, key_bits=2).collect()
    assert Counter(tuple(r[c] for c in columns) for r in got) == want
    assert len({r.key for r in got}) <= 4 and max(r.chain for r in got) >= 5
    files = exact_dedup.index(docs, exact_dedup.Directory({}, 4, 1), 2).collect()
    assert len(files) == len({r.digest for r in files}) == len({r.text_sha256 for r in got})


def near_set(spark, n=60, length=120):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(length)]
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            t[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    for i in range(n, 2 * n):
        rows.append((i, " ".join(f"v{rng.randrange(300)}" for _ in range(rng.randrange(1, 200)))))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), dict(rows)


def brute_classes(texts, weights):
    ids = list(texts)
    _, _, sh, times, off = near_dedup._counted(pa.array([texts[i] for i in ids]))
    w = times * weights.relative(sh)
    sets = {i: (sh[a:b], w[a:b]) for i, a, b in zip(ids, off[:-1], off[1:], strict=True)}
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if len(a[0]) and len(b[0]) and near_dedup.similarity(a, b) >= 0.8:
                p, q = root(ids[x]), root(ids[y])
                label[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def test_near_equals_brute_force(spark, monkeypatch):
    docs, texts = near_set(spark)
    want = brute_classes(texts, near_dedup.shingle_weights(docs))
    for small in (64, 3):  # all by pairs, then most by clumps
        monkeypatch.setattr(near_dedup, "SMALL", small)
        monkeypatch.setattr(near_dedup, "BLOCK_NODES", 10)
        got = near_dedup.near_groups(docs).collect()
        assert {r.doc_id: r.class_id for r in got} == want
        assert Counter(r.class_id for r in got if r.kept) == Counter(set(want.values()))
        assert all(r.group_size == Counter(want.values())[r.class_id] for r in got)


def test_near_odd_rows(docs, nothing):
    got = near_dedup.near_groups(docs).collect()
    assert len(got) == docs.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.class_id)
    assert by[2] == by[3] == by[4] == {2}
    assert by[5] == by[6] == by[7] == {5}
    assert {r.class_id for r in got if r.doc_id is not None and 100 <= r.doc_id < 130} == {100}
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in got)
    assert near_dedup.near_groups(nothing).count() == 0


def test_weights_and_samples():
    s = Sampler(600)
    ids = np.arange(1, 401, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    w = np.where(np.arange(400) % 7 == 0, 3.0, 1.0)
    a, b = np.arange(0, 300), np.arange(60, 360)
    got = s.sample(np.concatenate([ids[a], ids[b]]), np.concatenate([w[a], w[b]]), np.array([0, 300, 600]))
    va, vb = np.zeros(400), np.zeros(400)
    va[a], vb[b] = w[a], w[b]
    assert abs((got[0] == got[1]).mean() - np.minimum(va, vb).sum() / np.maximum(va, vb).sum()) < 0.07
    many = s.sample(np.tile(ids, 400), np.ones(160_000), np.array([0, 160_000]))
    assert (many == s.sample(ids, np.ones(400), np.array([0, 400]))).all()


def test_words_and_shingles_are_whole():
    texts = ["Ab ab\tAB", None, "", "x" * 600_000 + " end", "a b c d e f"]
    h, off = hash_words(pa.array(texts))
    assert np.diff(off).tolist() == [3, 0, 0, 2, 6]
    assert h[0] == h[1] == h[2]
    again, _ = hash_words(pa.array(["end"]))
    assert h[off[3] + 1] == again[0]
    _, soff = hash_shingles(h, off)
    assert np.diff(soff).tolist() == [1, 0, 0, 1, 2]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows):
    lines = sorted((d, i, frozenset(x for x in line.replace("\t", " ").split(" ") if x)) for d, t in rows for i, line in enumerate((t or "").split("\n")))
    lines = [x for x in lines if x[2]]
    kept = defaultdict(list)
    for k, (d, i, s) in enumerate(lines):
        if not any(5 * len(s & t) >= 4 * len(s | t) for _, _, t in lines[:k]):
            kept[d].append(i)
    return kept


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    pool = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 30))] for _ in range(40)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randrange(0, 12)):
            line = list(rng.choice(pool))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = f"w{rng.randrange(60)}"
            lines.append(" ".join(line))
        rows.append((d, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_lines(rows)
    assert {r.doc_id: r.kept_lines for r in line_dedup.dedup_lines(docs).collect()} == {d: want.get(d, []) for d, _ in rows}


def test_lines_odd_rows(docs, nothing):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert (got[11].n_lines, got[11].kept_lines) == (4, [0, 1])
    assert (got[5].n_lines, got[5].kept_lines) == (0, [])
    assert got[101].kept_lines == [] and got[100].kept_lines == [0]
    cleaned = line_dedup.clean_texts(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    assert {r.doc_id: r.text for r in cleaned.collect()}[11] == "a b c a b c a b c\nline two\n"
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_lines_stay_in_the_jvm(docs, monkeypatch):
    """No plan of the whole operator, of the tables that it writes or of its result, runs Python."""
    plans = []
    plain = line_dedup.stored

    def noted(df, name):
        plans.append(df)
        return plain(df, name)

    monkeypatch.setattr(line_dedup, "stored", noted)
    plans += [line_dedup.dedup_lines(docs), line_dedup.clean_texts(docs)]
    assert len(plans) > 8
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_prefix_join_equals_brute_force(spark):
    """The filters of the join lose no pair that matches, with codes that collide too."""
    rng = random.Random(5)
    pool = [[rng.randrange(60) for _ in range(rng.randrange(1, 30))] for _ in range(40)]
    rows = []
    for k in range(160):
        s = list(rng.choice(pool))
        if rng.random() < 0.6:
            s[rng.randrange(len(s))] = rng.randrange(60)
        rows.append((k, sorted(set(s))))
    sets = spark.createDataFrame([(k, len(s), s) for k, s in rows], "id long, n int, codes array<int>")
    pairs = {(min(r.id_a, r.id_b), max(r.id_a, r.id_b)) for r in line_dedup.candidate_pairs(line_dedup.prefixes(sets, line_dedup.code_levels(sets))).collect()}
    want = {(a, b) for a, s in rows for b, t in rows if a < b and 5 * len(set(s) & set(t)) >= 4 * len(set(s) | set(t))}
    assert len(want) > 20 and want <= pairs


def test_lines_of_rows_that_share_a_doc_id(spark):
    """Rows without an id, or with the same one, are told apart; equal rows keep a line once."""
    base = [f"w{i}" for i in range(20)]
    other = [f"v{i}" for i in range(20)]
    near = [*base[:19], "x"]
    rows = [(None, " ".join(base)), (None, " ".join(other)), (None, " ".join(base)), (3, " ".join(other[:5])), (3, " ".join(near)), (4, " ".join(near)), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.n_links, tuple(r.kept_lines)) for r in line_dedup.dedup_lines(docs).collect())
    assert got == Counter({(None, 1, 0, 1, (0,)): 1, (None, 1, 0, 0, (0,)): 1, (None, 1, 1, 0, ()): 1, (3, 1, 0, 0, (0,)): 1, (3, 1, 1, 0, ()): 1, (4, 1, 1, 0, ()): 1, (None, 0, 0, 0, ()): 2})
    cleaned = Counter(r.text for r in line_dedup.clean_texts(docs).collect())
    assert cleaned == Counter([" ".join(base), " ".join(other), " ".join(other[:5]), "", "", "", None, None])


def test_links_of_large_groups_of_lines_make_no_pairs(spark, monkeypatch):
    """Links of lines that share common codes are counted in blocks: whole, and without a row for each of them."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(30)]
    rows = [(k, " ".join([*rng.sample(base, rng.randrange(26, 31)), f"x{k % 97}"])) for k in range(220)]
    rows += [(1000 + k, " ".join(rng.sample(base, rng.randrange(3, 7)))) for k in range(60)]
    sets = {}
    for d, text in rows:
        sets.setdefault(frozenset(text.split()), d)
    linked = {d: [e for t, e in sets.items() if e != d and 5 * len(s & t) >= 4 * len(s | t)] for s, d in sets.items()}
    want = {d: (1, len(linked[d])) if d in linked and all(d < e for e in linked[d]) else (0, 0) for d, _ in rows}
    assert sum(map(len, linked.values())) > 30_000  # 15,000 pairs
    monkeypatch.setattr(line_dedup, "LIGHT", 20)
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    sizes, plain = [], line_dedup.stored

    def noted(df, name):
        sizes.append((plain(df, name), name))
        return sizes[-1][0]

    monkeypatch.setattr(line_dedup, "stored", noted)
    got = {r.doc_id: (len(r.kept_lines), r.n_links) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want
    assert max(df.count() for df, _ in sizes) < 5_000


def test_near_link_counts(spark, monkeypatch):
    """n_links counts all linked texts, by pairs or by clumps; texts with equal words are one."""
    docs, texts = near_set(spark)
    weights = near_dedup.shingle_weights(docs)
    words = sorted(set(texts.values()))
    _, _, sh, times, off = near_dedup._counted(pa.array(words))
    w = times * weights.relative(sh)
    sets = [(sh[a:b], w[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    want = {t: sum(i != j and near_dedup.similarity(x, y) >= 0.8 for j, y in enumerate(sets)) for i, (t, x) in enumerate(zip(words, sets, strict=True))}
    assert max(want.values()) > 20
    for small in (64, 3):
        monkeypatch.setattr(near_dedup, "SMALL", small)
        monkeypatch.setattr(near_dedup, "BLOCK_NODES", 10)
        assert {r.doc_id: r.n_links for r in near_dedup.near_groups(docs).collect()} == {i: want[t] for i, t in texts.items()}


def test_near_many_rows_without_ids(spark):
    """Null and repeated ids: as many texts are fetched as there are different ones, and classes are those of unique ids."""
    rows = [(None if i % 3 else 7, prose(i // 2, 60 + i // 2) + (" tail" if i % 2 else "")) for i in range(240)] + [(None, prose(1, 61))] * 50 + [(7, prose(2, 62))] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    signed = near_dedup.signatures(docs, near_dedup.shingle_weights(docs))
    nodes = near_dedup.stored(near_dedup.node_table(signed), "nodes")
    texts = near_dedup.node_texts(docs, nodes.select("node", "doc_id", "text_hash", "again", "words_digest"))
    assert nodes.count() == len({t for _, t in rows}) == texts.count() == texts.select("node").distinct().count()
    joined = texts._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("xxhash64") >= 2 and "_hash" in joined
    numbered = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    sizes = lambda df: sorted(r.group_size for r in near_dedup.near_groups(df).filter("kept").collect())
    assert sizes(docs) == sizes(numbered)
    kept = near_dedup.drop_near_copies(docs)
    assert kept.count() == near_dedup.near_groups(docs).filter("kept").count()
