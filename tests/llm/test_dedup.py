"""Near-duplicates and near vectors against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchweave.llm import minhash, near_vectors
from matchweave.llm.textbuf import WordHash, string_buffers


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_marks_keep_the_bound_and_the_bands():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 48))
    x = near_vectors.unit(np.vstack([base, base + 0.04 * rng.standard_normal(base.shape), base + 0.25 * rng.standard_normal(base.shape)]))
    signs = near_vectors.band_bits(x, 7, 11)
    *known, values = near_vectors.read_marks(near_vectors.marks_of(x, signs), 48, 7, 11)
    assert (values == near_vectors.band_values(signs)).all()
    near, true = near_vectors.may_reach(*known, 0.95, 7.0), x @ x.T
    assert near[true >= 0.95].all() and near[true < 0.3].mean() < 0.01
    a, b = np.nonzero(np.triu(true >= 0.95, 1))
    met = (values[a] == values[b]) & (np.cumsum(values[a] == values[b], axis=1) == 1)
    assert all((near_vectors.first_shared(values, a, b, band) & (values[a, band] == values[b, band]) == met[:, band]).all() for band in range(11))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_defeat_polynomial_hashes(n):
    one, other = thue_morse(n)
    data, offsets = string_buffers(pa.array([f"{one} p q r", f"{other} p q r", f"p {one} q {other} r", "a" * 16 + " " + "a" * 17 + " a"]))
    _, at = minhash.shingle_sets(data, offsets, 3, WordHash(1))
    assert np.diff(at).tolist() == [2, 2, 3, 1]
    flat, at = minhash.shingle_sets(data, offsets, 1, WordHash(2))
    assert np.diff(at).tolist() == [4, 4, 5, 3] and len(np.intersect1d(flat[:4], flat[4:8])) == 3


def components(n, links):
    low = list(range(n))
    for _ in range(n):
        before = list(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if before == low:
            break
    return low


def shingles(text, width):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").encode().split()
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def texts(seed=3):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    out = []
    for words in base:
        for _ in range(6):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 50))
            out.append(rng.choice([" ", "  ", "\t"]).join(w))
    return [*out, None, "", "  \n", "One two", "one TWO", "one", "Éa b c", "éa b c", " ".join(["long"] * 30000), " ".join(["long"] * 29999)]


@pytest.mark.parametrize(("width", "part", "block"), [(3, 85, 1024), (5, 80, 4), (3, 85, 3)])
def test_minhash_equals_brute_force(spark, width, part, block):
    rows = [(i * 7, t, "x", "y") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, bands string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, width=width, part=part, whole=100, block=block).collect()}
    sets = [shingles(t, width) for t in texts()]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b])]
    low = components(len(sets), links)
    assert len(got) == len(rows)
    for i, s in enumerate(sets):
        assert (got[i * 7]["n_shingles"], got[i * 7]["component_id"], got[i * 7]["kept"]) == (len(s), low[i] * 7, low[i] == i)


def test_minhash_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(map(str, minhash.near_duplicates(docs).collect()))
    assert [("component_id=5" in x) for x in got].count(True) == 4
    assert minhash.near_duplicates(docs.where("false")).count() == 0
    kept = minhash.drop_near_duplicates(docs).collect()
    assert sorted(map(str, map(tuple, kept))) == ["(5, 'a b c d e f')", "(None, None)"]


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((20, 16))
    x = np.vstack([base, base[:8] + 0.07 * rng.standard_normal((8, 16)), base[:8] + 0.07 * rng.standard_normal((8, 16)), 3 * base[:3], base[5:6], base[5:6]])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(100, None), (101, []), (102, [0.0] * 16), (103, [1.0, None] + [0.0] * 14), (104, [float("nan")] * 16), (105, [float("inf")] * 16), (106, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "q", 1) for i, v in rows + odd], "vec_id long, embedding array<double>, n_links string, rep int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    low = components(len(x), list(zip(*np.nonzero(link), strict=True)))
    for block in (512, 3):
        got = {r["vec_id"]: r for r in near_vectors.near_duplicate_vectors(df, block=block, bucket=4).collect()}
        assert len(got) == len(rows) + len(odd)
        for i in range(len(x)):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[i].sum(), low[i], low[i] == i)
        for i in range(100, 107):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
        assert got[None]["n_links"] == 0
    assert near_vectors.near_duplicate_vectors(df.where("false")).count() == 0


def test_vector_estimates_bound_the_truth():
    rng = np.random.default_rng(2)
    x = near_vectors.unit(rng.standard_normal((400, 64)))
    turned = x @ near_vectors.rotations(64, 1)
    factor = np.abs(turned).sum(axis=1) / 8
    estimate = turned @ np.sign(turned).T / 8 / factor[None, :]
    true = x @ x.T
    assert abs(np.mean(estimate - true)) < 1e-3  # unbiased
    bound = 7 * np.sqrt(1 - factor**2) / factor / math.sqrt(63)
    assert (np.abs(estimate - true) <= bound[None, :] * np.sqrt(np.maximum(0, 1 - true**2)) + 1e-9).all()


@pytest.mark.parametrize("send", [10**6, 0])
def test_only_the_repeated_text_of_an_id_is_dropped(spark, send):
    one, other = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    docs = spark.createDataFrame([(1, one), (5, one), (5, other), (5, other), (5, None), (7, other), (None, "alone")], "doc_id long, text string")
    kept = minhash.drop_near_duplicates(docs, send=send).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(1, one), (5, other), (5, None), (None, "alone")]))


@pytest.mark.parametrize(("block", "sample"), [(6, 256), (6, 3), (25, 0)])
def test_families_that_share_too_little(spark, block, sample):
    """Texts around a boilerplate, most below the threshold, with linked pairs and chains among them."""
    rng = random.Random(12)
    word = lambda: "w" + str(rng.randrange(10**6))
    rows = []
    for family in range(2):
        shared = [word() for _ in range(60)]
        for _ in range(45):
            own = [word() for _ in range(18 + 4 * family)]
            rows.append(" ".join([*shared, *own]))
            if rng.random() < 0.3:
                own[rng.randrange(len(own))] = word()
                rows.append(" ".join([*shared, *own]))
    rng.shuffle(rows)
    sets = [shingles(t, 3) for t in rows]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    low = components(len(sets), links)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, width=3, part=85, block=block, sample=sample).collect()}
    assert got == dict(enumerate(low)) and 20 < len(links) < 400


def test_rare_shingles_of_linked_sets_meet():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    sets = [np.sort(rng.choice(pool, 120, replace=False)) for _ in range(4)]
    for base in list(sets):
        for _ in range(6):
            sets.append(np.sort(np.concatenate([base[rng.permutation(120)[: rng.integers(108, 120)]], rng.choice(np.setdiff1d(pool, base), 6, replace=False)])))
    rows = [(1, 0, 0, k, sets[k]) for k in (0, 5, 9)] + [(1, 0, 1, k, s) for k, s in enumerate(sets)]
    columns = [pa.array(c) for c in zip(*[(a, b, c, d, len(s), s.tobytes()) for a, b, c, d, s in rows], strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, names=["comp", "salt", "member", "rep", "n", "data"])
    out = pa.Table.from_batches(list(minhash.rare_shingles([batch.slice(0, 7), batch.slice(7)], 85, 100))).to_pylist()
    kept = [{r["shingle"] for r in out if r["rep"] == k} for k in range(len(sets))]
    assert all(len(kept[k]) == len(s) - math.ceil(0.85 * len(s) - 1e-9) + 1 for k, s in enumerate(sets))
    near = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
    assert near and all(kept[a] & kept[b] for a, b in near)


def test_only_tables_that_results_read_are_left(spark):
    from matchweave.sources import scratch

    scratch.clear_scratch(spark)
    docs = spark.createDataFrame([(k, f"a b c d e f {k // 2} h i j k l m n o p") for k in range(40)], "doc_id long, text string")
    vectors = spark.createDataFrame([(k, [1.0, 0.01 * k, 0.5]) for k in range(40)], "vec_id long, embedding array<double>")
    for make, left in ((lambda: minhash.near_duplicates(docs), {"signatures", "classes", "edges"}), (lambda: near_vectors.near_duplicate_vectors(vectors), {"vectors", "classes", "links", "edges"})):
        assert make().count() == 40
        found = {f.split("/")[-2] for f in scratch.files_below(spark, scratch.scratch_root(spark))}
        assert found <= left, found
        scratch.clear_scratch(spark)
        assert scratch.files_below(spark, scratch.scratch_root(spark)) == []


def test_small_graphs_are_written_in_few_files(spark):
    from matchweave.llm.common import connected_components
    from matchweave.sources.scratch import Scratch

    path = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(3)
    table, files = Scratch.table, []
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        Scratch.table = lambda self, df, name: files.append((name, len((found := table(self, df, name)).inputFiles()))) or found
        few = connected_components(path, "a", "b").collect()
        rounds = files[1:]
        many = connected_components(path, "a", "b", task_rows=4).collect()
    finally:
        Scratch.table = table
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, few)) == sorted(map(tuple, many)) == [(k, 0) for k in range(41)]
    assert rounds and all(n == 1 for _, n in rounds)
