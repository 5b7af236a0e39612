"""Product codes, line dedup and Merkle manifests against plain loops."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchweave.llm import lines, lloyd, merkle


def plain_codes(rows, parts, entries, rounds, scale=4096):
    """(codebooks, {row number: (code, error)}) with Python integers."""
    good = [(i, k, [math.floor(v * scale) if abs(v) < 2**52 else int(v) * scale for v in x]) for k, (i, x) in enumerate(rows)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, rows[r[1]][1]))
    size = len(good[0][2]) // parts
    cut = lambda x, p: x[p * size : (p + 1) * size]
    books = [[cut(x, p) for _, _, x in good[:entries]] for p in range(parts)]
    far = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))
    best = lambda x, p: min(range(len(books[p])), key=lambda e: (far(cut(x, p), books[p][e]), e))
    for _ in range(rounds):
        codes = {k: [best(x, p) for p in range(parts)] for _, k, x in good}
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(x, p) for _, k, x in good if codes[k][p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = {}
    for _, k, x in good:
        code = [best(x, p) for p in range(parts)]
        out[k] = ("".join(f"{c:02x}" for c in code), min(sum(far(cut(x, p), books[p][c]) for p, c in enumerate(code)), 2**63 - 1))
    return books, out


@pytest.mark.parametrize("top", [0.5, 1e3, 1e30])
def test_codes_equal_plain_rounds(spark, top):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(0, 0.3, 8).tolist()) for i in rng.permutation(60)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[4][1])] + [(100 + k, [top * (-1) ** k] * 8) for k in range(3)]
    labels = [None if k % 5 == 0 else k % 3 for k in range(len(rows))]
    bad = [(1, None), (2, [0.1] * 7 + [None]), (3, [0.1] * 7 + [float("nan")]), (4, [float("-inf")] * 8), (5, []), (6, [0.5] * 6), (8, [0.5] * 4)]
    df = spark.createDataFrame([(i, x, y, "c", 1) for (i, x), y in zip([*rows, *bad], [*labels, *[9] * len(bad)], strict=True)], "vec_id long, embedding array<double>, label int, code string, part int").repartition(5)
    coded, books = lloyd.product_codes(df, label_col="label", parts=4, entries=6, rounds=3)
    got = lloyd.with_label_error(coded, send=random.choice([0, 100]))
    want_books, want = plain_codes(rows, 4, 6, 3)
    assert books == want_books
    found = sorted(map(tuple, got.select("vec_id", "label", "code", "error").collect()), key=str)
    assert found == sorted([(rows[k][0], labels[k], *want[k]) for k in want], key=str)
    by_label = {x: min(sum(want[k][1] for k in want if labels[k] == x), 2**63 - 1) for x in set(labels)}
    assert {(r["label"], r["label_error"]) for r in got.collect()} == set(by_label.items())
    assert lloyd.codebooks_digest(books) == hashlib.sha256(",".join(str(v) for b in want_books for e in b for v in e).encode()).hexdigest()


def test_codes_of_few_or_no_vectors(spark):
    df = spark.createDataFrame([(2, [0.25] * 8), (1, [0.25] * 8)], "vec_id long, embedding array<float>")
    coded, books = lloyd.product_codes(df)
    assert [tuple(r)[2:] for r in coded.collect()] == [("00" * 8, 0)] * 2 and [len(b) for b in books] == [2] * 8 and books[0] == [[1024], [1024]]
    coded, books = lloyd.product_codes(df.where("vec_id > 9"))
    assert coded.count() == 0 and books == [] and lloyd.with_label_error(coded).count() == 0


def test_only_moved_parts_contribute():
    import pyarrow as pa

    data = lloyd.written(np.array([[0.0, 0.0], [1.0, 1.0], [0.9, 0.0]]), 4096)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 0, 0]), pa.array(data, pa.binary()), pa.array([bytes([0, 0]), bytes([1, 1]), bytes([0, 0])])], names=["vec_id", "label", "data", "code"])
    *_, last = lloyd.reassign([batch], [[[0], [4096]], [[0], [4096]]], 2, 4096)
    assert list(zip(*(c.to_pylist() for c in last.columns[4:]), strict=True)) == [(0, 0, -1, "-3686"), (0, 1, 1, "3686")]


def plain_lines(rows, least_chars, least_docs):
    key = lambda s: "".join(c.lower() if c.isascii() else c for c in s.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        split = (text or "").split("\n")
        gone = lambda s, i=i: len(h := holders.get(key(s), ())) >= least_docs and i != max(h, key=lambda x: (x is not None, x or 0))
        kept = [s for s in split if not gone(s)]
        out.append((i, "\n".join(kept), len(split), len(split) - len(kept)))
    return out


@pytest.mark.parametrize("send", [0, 1000])
def test_lines_equal_plain_loops(spark, send):
    rng = random.Random(4)
    pool = ["short", "", "  a line that repeats ", "A LINE that repeats", "a line that repeats\r", "\x0bÄ line that repeats", "another long line of text", "ä line that repeats", "x" * 5000]
    rows = [(i, "\n".join(rng.choice([*pool, f"only here {i} {k} and there"]) for k in range(rng.randrange(8)))) for i in range(60)]
    rows += [(5, None), (5, "a line that repeats"), (5, "a line that repeats"), (None, "a line that repeats\nmine"), (None, "a line that repeats\nmine"), (99, ""), (98, None), (97, "\n\n"), (4, "\n".join(pool * 400))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, pos int, h string").repartition(5)
    got = lines.drop_repeated_lines(df, least_chars=12, least_docs=3, send=send)
    assert got.columns == ["doc_id", "kept_text", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_lines(rows, 12, 3), key=str)
    assert lines.drop_repeated_lines(df.where("false")).count() == 0


def test_key_length_counts_code_points_and_ids_not_rows(spark):
    rows = [(k, "é" * 20) for k in (1, 1, 1, 2)] + [(k, "😀" * 20) for k in (1, 2, 3)] + [(k, "é" * 19) for k in (1, 2, 3)]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_dropped > 0")
    assert sorted(map(tuple, got.collect())) == [(1, "", 1, 1), (2, "", 1, 1)]


H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def plain_paths(nodes, fanout):
    """(root, [(left, right) of each level] for every node)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, k in zip(paths, at, strict=True):
            s = k - k % fanout
            path.append(("".join(nodes[s:k]), "".join(nodes[k + 1 : s + fanout])))
        nodes, at = [H(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)], [k // fanout for k in at]
    return nodes[0], paths


@pytest.mark.parametrize(("fanout", "levels"), [(3, 1), (2, 2), (3, 7)])
def test_manifest_equals_plain_trees(spark, fanout, levels):
    sizes = {None: 10, "": 1, "b": 1, "ä": 28, "a": 27, "Z": 9, "hot": 200}
    rows = [(s, k, H(str(s), str(k // 2))) for s, n in sizes.items() for k in range(n)] + [("Z", None, H("n")), ("a", 3, H("same")), ("a", 3, H("same"))]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "source string, doc_id long, leaf string, also int, tag string").repartition(6)
    got = merkle.manifest(df, also=("also",), fanout=fanout, levels=levels, send=random.choice([0, 100]))
    got = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("left"), F.col("right")))
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    groups = {s: sorted([r for r in rows if r[0] == s], key=order) for s in sizes}
    trees = {s: plain_paths([r[2] for r in own], fanout) for s, own in groups.items()}
    names = sorted(sizes, key=lambda s: (s is not None, (s or "").encode()))
    root, tops = plain_paths([trees[s][0] for s in names], fanout)
    want = [(r[1], r[2], 7, trees[s][0], root, [*path, *tops[names.index(s)]]) for s in sizes for r, path in zip(groups[s], trees[s][1], strict=True)]
    found = got.collect()
    assert sorted([(*tuple(r)[:5], list(zip(r["left"], r["right"], strict=True))) for r in found], key=str) == sorted(want, key=str)
    assert {r["folded"] for r in found} == {root}


def test_manifest_edges(spark):
    none = spark.createDataFrame([], "doc_id long, source string, leaf string")
    assert merkle.manifest(none).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, None, "ab")], none.schema)).first()
    assert (one["subroot"], one["root"], one["left"], one["right"]) == ("ab", "ab", [], [])
    with pytest.raises(ValueError, match="names"):
        merkle.manifest(none.withColumn("N", F.lit(1)), also=("N",))
    row = spark.createDataFrame([(12, None, "é\n")], "i long, s string, t string")
    assert row.select(merkle.leaf(F.col("i"), F.col("s"), F.col("t")).alias("h")).first()["h"] == H("2:12-3:é\n")
    same = [H("x")] * 50
    got = merkle.manifest(spark.createDataFrame([(1, "s", h) for h in same], none.schema).repartition(4), levels=1)
    assert got.select("root").distinct().collect()[0][0] == plain_paths(same, 3)[0] and got.count() == 50


def test_crc_of_decimal_ids(spark):
    got = spark.range(-3, 3).select("id", F.crc32(F.encode(F.col("id").cast("string"), "utf-8")).alias("c")).collect()
    assert all(r["c"] == zlib.crc32(str(r["id"]).encode()) for r in got)
