"""Packing, fingerprints, BPE, personal data, licenses, language ID on small inputs."""

import hashlib
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from matchweave.llm import bpe, langid, licenses, packing, pii, tokens, winnow
from matchweave.llm.textbuf import string_buffers, text_slices
from matchweave.llm.tokens import Memo, PieceEncoder, plain_tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "x", " ", "\n\n", "  a  b\n c\t d ", "it's  we'll\n\n\nyes 12 34", "<|endoftext|> hi", "日本 語\n日", "\x1c a \x1c b", "a×b", "Ǆ ß Σ́ ", "no" * 40000, "word " * 20000, "𝔘𝔫 😀"]


def fuzz(n=400, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(" \n\tab'sé1.,\x1c日S") for _ in range(rng.randint(0, 40))) for _ in range(n)]


def docs_of(spark, texts, schema="doc_id long, text string, ids string, length int"):
    return spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], schema)


def test_pieces_encode_as_the_library():
    texts = [t or "" for t in ODD] + fuzz() + ["".join(random.Random(k).choices("ab'sé1. \n,", k=20)) for k in range(300)]
    encoder, plain, got = PieceEncoder(BYTE, entries=50), plain_tokenizer(BYTE), []
    for lo, hi, data, offsets in text_slices(pa.array(texts), 300):
        ids, at = encoder.encode(data, offsets)
        got += [ids[at[k] : at[k + 1]].tolist() for k in range(hi - lo)]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_pieces_that_share_a_hash_or_defeat_polynomials():
    one, other = "a", "b"
    while len(one) < 4096:
        one, other = one + other, other + one
    texts = [one[:1024], other[:1024], one, other, f"x {one[:2048]} y", f"x {other[:2048]} y"]
    data, offsets = string_buffers(pa.array(texts))
    ids, at = PieceEncoder(BYTE).encode(data, offsets)
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [e.ids for e in plain_tokenizer(BYTE).encode_batch(texts, add_special_tokens=False)]
    memo = Memo(100)
    data, offsets = string_buffers(pa.array(["ab", "cd", "ab", "cd"]))
    mixed, tokens.mix = tokens.mix, lambda h: h * np.uint64(0)  # every piece has the same hash
    try:
        values, n = memo.look_up(data, offsets[:-1], offsets[1:], lambda piece: list(piece))
    finally:
        tokens.mix = mixed
    assert bytes(values.astype(np.uint8)) == b"abcdabcd" and n.tolist() == [2] * 4


def test_memo_is_bounded_in_bytes():
    memo = Memo(10**6, most_bytes=50_000)
    for k in range(60):
        texts = [f"{k}" + "é" * 700, "short"]
        data, offsets = string_buffers(pa.array(texts))
        values, n = memo.look_up(data, offsets[:-1], offsets[1:], lambda piece: list(piece))
        assert bytes(values.astype(np.uint8)) == "".join(texts).encode() and memo.held <= 60_000 and len(memo.named) < 12


def test_packing_places_every_id_once(spark):
    texts = ODD + fuzz(60) + ["some words here " * k for k in range(1, 300, 7)]
    plain = plain_tokenizer(BYTE)
    want = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    rows = packing.pack(docs_of(spark, texts), BYTE, sequence=256).toPandas()
    for i, own in rows.sort_values("start").groupby("doc_id"):
        at = 0
        for r in own.itertuples():
            piece = np.asarray(want[i][r.start : r.start + r.length], dtype="<u4").tobytes()
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(piece), len(want[i]))
            at += r.length
        assert at == len(want[i])
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 256
    assert rows.doc_id.nunique() == len(texts)
    assert packing.pack(docs_of(spark, texts).where("false"), BYTE).count() == 0


def test_shortest_pack_first():
    patterns = packing.shortest_pack_first({8: 3, 5: 2, 3: 1, 2: 4}, 8)
    assert sum(c * sum(p) for c, p in patterns) == 24 + 10 + 3 + 8
    assert all(sum(p) <= 8 for _, p in patterns)
    # 3 goes to a pack of 5 (the shortest), 2 to the other, and so on
    assert sorted((c, tuple(sorted(p))) for c, p in patterns) == [(1, (2, 2, 2)), (1, (2, 5)), (1, (3, 5)), (3, (8,))]


def test_null_ids_and_repeats_pack(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = packing.pack(docs, BYTE).collect()
    assert len(rows) == 3 and sorted(r["offset"] for r in rows) == [0, 3, 6]


def winnowed(text, k=16, w=16):
    if not text:
        return []
    p, base, grams, h = winnow.PRIME, winnow.BASE, [], 0
    for i, c in enumerate(text):  # one code point in, one out
        out = (ord(text[i - k]) + 1) * pow(base, k, p) if i >= k else 0
        h = (h * base + ord(c) + 1 - out) % p
        if i >= k - 1 or i == len(text) - 1:
            grams.append(h * winnow.SPREAD % p)
    out = []
    for i in range(max(1, len(grams) - w + 1)):
        window = grams[i : i + w]
        low = min(window)
        out.append((i + max(j for j, g in enumerate(window) if g == low), low))
    return list(dict.fromkeys(out))


def test_winnowing_equals_brute_force(spark):
    texts = [t[:3000] if t else t for t in ODD] + fuzz(40) + ["aaaa" * 30, "the same text twice over, " * 3, "the same text twice over, " * 3]
    ids = [None, *range(10, 10 + 3 * (len(texts) - 1), 3)]
    docs = spark.createDataFrame(list(zip(ids, texts, ids, strict=True)), "doc_id long, text string, bucket long")
    got = winnow.edited_fingerprints(docs).withColumn("p", winnow.positions_and_hashes(F.col("own_print"))).withColumn("e", winnow.positions_and_hashes(F.col("edited_print"))).collect()
    got = {r["doc_id"]: r for r in got}
    texts = [t or "" for t in texts]
    for k, t in enumerate(texts):
        after, q, r = texts[(k + 1) % len(texts)], len(t) // 4, got[ids[k]]
        edited = t[: len(t) - q] + after[:q]
        a, b, c = winnowed(t), winnowed(edited), winnowed(after)
        assert (r["text"], r["edited"]) == (t, edited)
        assert [tuple(x) for x in r["p"]] == a and [tuple(x) for x in r["e"]] == b
        for name, other in (("near_edited", b), ("near_next", c)):
            x, y = {h for _, h in a}, {h for _, h in other}
            assert r[name] == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
    assert winnow.edited_fingerprints(docs.where("false")).count() == 0
    one = winnow.edited_fingerprints(docs.where("doc_id = 16")).collect()
    assert len(one) == 1


def test_winnowing_of_long_texts(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("abc é日", k=n)) for n in (200_000, 60_000, 5)]
    rows = winnow.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").select(winnow.positions_and_hashes(F.col("own_print")).alias("p"), winnow.positions_and_hashes(F.col("edited_print")).alias("e"), "edited").collect()
    for t, r in zip(texts, rows, strict=True):
        assert [tuple(x) for x in r["p"]] == winnowed(t) and [tuple(x) for x in r["e"]] == winnowed(r["edited"])


def test_far_and_clustered_ids_spread_over_buckets(spark):
    near = spark.range(20_000).select("id", F.lit("t").alias("text"))
    far = spark.createDataFrame([((1 << 61) + k * (1 << 40), "t") for k in range(50)] + [(-(1 << 60), "t"), (None, "t"), (None, "u")], "id long, text string")
    rows = winnow.next_rows(near.unionByName(far), "id", "text", rows=1000).cache()
    sizes = [r["count"] for r in rows.groupBy("bucket").count().collect()]
    assert max(sizes) <= 1001 and len(sizes) > 60 and rows.where("own").count() == 20_053
    following = sorted((r["bucket"], r["id"]) for r in rows.where("not own").collect())
    own = {r["bucket"]: (r["a"], r["b"]) for r in rows.where("own").groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("b")).collect()}
    ids = [None, -(1 << 60), *range(20_000), *((1 << 61) + k * (1 << 40) for k in range(50))]
    after = dict(zip(ids, [*ids[1:], None], strict=True))
    assert [x for _, x in following] == [after[own[b][1]] for b, _ in following] and len(following) == len(own)


def test_buckets_are_bounded_by_rows_and_characters(spark):
    docs = spark.range(3000).select("id", F.repeat(F.lit("ab"), F.when((F.col("id") >= 1000) & (F.col("id") < 1040), 5000).otherwise(1)).alias("text"))
    rows = winnow.next_rows(docs, "id", "text").where("own").groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).collect()
    assert max(r["n"] for r in rows) <= 256 and len(rows) == 12
    rows = winnow.next_rows(docs, "id", "text", chars=50_000).where("own").groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).collect()
    assert max(r["c"] for r in rows) <= 50_000 and sum(r["n"] for r in rows) == 3000
    rows = winnow.next_rows(docs, "id", "text", chars=5_000).where("own").groupBy("bucket").count().collect()
    assert len(rows) == 3000  # a text longer than the bound is alone


def test_winnowing_keeps_its_guarantee(spark):
    rng = random.Random(5)
    shared = "".join(rng.choices("abcdefgh ", k=31))
    rows = [(i, "".join(rng.choices("xyz", k=50)) + shared + "".join(rng.choices("uvw", k=70))) for i in range(2)]
    a, b = (r["f"] for r in winnow.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), "text", "f").collect())
    assert {x["hash"] for x in a} & {x["hash"] for x in b}


def test_bpe_round_trip_equals_the_library(spark):
    texts = ODD + fuzz(200) + [("shared passage of many words, " * 9 + str(k)) for k in range(20)]
    rows = bpe.decode(bpe.encode(docs_of(spark, texts), WORD), WORD).collect()
    plain = plain_tokenizer(WORD)
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == np.asarray(ids, dtype="<u4").tobytes()
        assert r["decoded"] == plain.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs_of(spark, texts).where("false"), WORD).count() == 0


def test_bpe_joins_at_any_cut_and_reuse():
    texts = [t or "" for t in ODD] + fuzz(300, 1)
    plain = plain_tokenizer(WORD)
    want = [np.asarray(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    for bits, at_blanks in ((1, True), (2, True), (5, True), (3, False)):
        encoder, got = bpe.ChunkEncoder(WORD, words=20, chunks=20, bits=bits), []
        assert encoder.at_blanks
        encoder.at_blanks = at_blanks
        for _, _, data, offsets in text_slices(pa.array(texts), 500):
            got += encoder.encode(data, offsets)
        assert got == want
    encoder = bpe.ChunkEncoder(WORD)
    passage = " ".join(f"word{k}" for k in range(400))
    for _, _, data, offsets in text_slices(pa.array([f"{k} start {passage}" for k in range(10)])):
        encoder.encode(data, offsets)
    assert encoder.reused > encoder.encoded


def test_bpe_joints_agree_for_a_tokenizer_that_keeps_blanks(spark):
    texts = [t or "" for t in ODD if len(t or "") < 3000] + fuzz(400, 2) + ["some plain words, in   a row\n\n and 12 more " * 9]
    plain = plain_tokenizer(BYTE)
    want = [np.asarray(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    for bits in (1, 2, 4, 6):
        encoder, got = bpe.ChunkEncoder(BYTE, bits=bits), []
        assert not encoder.at_blanks
        for _, _, data, offsets in text_slices(pa.array(texts), 500):
            got += encoder.encode(data, offsets)
        assert got == want
    rows = bpe.decode(bpe.encode(docs_of(spark, texts[-20:]), BYTE), BYTE).collect()
    assert all(r["decoded"] == texts[-20:][r["doc_id"]] for r in rows)
    assert all(bytes(r["ids"]) == want[-20:][r["doc_id"]] for r in rows)


def test_bpe_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    rows = bpe.decode(bpe.encode(docs, WORD), WORD).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in rows) == [("1", "a</w> b</w>")] * 2 + [("2", ""), ("None", "a</w> b</w>")]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_equals_the_patterns(spark):
    rng = random.Random(1)
    parts = ["a", ".", "@", "-", "1", "2", "25", "+", "(", ") ", "4", "256", "0255", "b", "é", "%", "\n", " ", "4111 1111 1111 1111"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [None, "", "mail me: x@y.zz, +1 (363) 555-6578 from 10.0.0.1", "9" * 5000, "a@" * 3000, "1." * 3000]
    rows = pii.detect(docs_of(spark, texts), None).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == plain_spans(texts[r["doc_id"]] or "")
        assert not r["added"]


def personal_texts(seed, n):
    """(text, private spans, harmless spans) with words between."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=k))
    private = [
        lambda: f'token = "{word(40)}"', lambda: f"password: {word(rng.choice([12, 30, 200]))}", lambda: "AKIA" + "".join(rng.choices("ABCDEFGHIJ0123456789", k=16)),
        lambda: f"jane{digits(2)} [at] example [dot] com", lambda: f"{rng.randint(201, 899)}-{rng.randint(10, 99)}-{digits(3)}1", lambda: f"call ({rng.randint(201, 989)}) 555-{digits(4)}",
    ]
    harmless = [lambda: f"order {rng.randint(1, 9)}{digits(13)}7", lambda: f"serial 000-{digits(2)}-0000", lambda: f"placeholder token = {rng.choice('xyz') * 16}", lambda: f"version {rng.randint(256, 999)}.{digits(1)}.{digits(1)}.{rng.randint(300, 999)}"]
    out = []
    for _ in range(n):
        yes = rng.random() < 0.6
        span = rng.choice(private if yes else harmless)()
        out.append((f"{' '.join(word(5) for _ in range(6))} {span} {word(4)} text", span, yes))
    return out


def test_pii_precision_and_recall_on_other_texts(spark):
    taught, held = personal_texts(1, 1500), personal_texts(2, 600)
    base = [f"say hello, mail user{k}@host.com or {k} 10.1.2.{k % 250}" for k in range(60)]
    model = pii.fit(docs_of(spark, base + [t for t, *_ in taught]))
    rows = {r["doc_id"]: [(s["start"], s["end"]) for s in r["base"] + r["added"]] for r in pii.detect(docs_of(spark, [t for t, *_ in held]), model).collect()}
    hit = {True: 0, False: 0}
    for k, (text, span, yes) in enumerate(held):
        covered = set().union(*(range(a, b) for a, b in rows[k])) if rows[k] else set()
        value = re.split(r"[=:] |call ", span)[-1]
        start = text.index(value)
        hit[yes] += set(range(start, start + len(value.strip('"')))) <= covered if yes else bool(covered)
    private = sum(yes for *_, yes in held)
    recall, precision = hit[True] / private, hit[True] / (hit[True] + hit[False])
    print(f"added spans: precision {precision:.3f}, recall {recall:.3f} of {private}")
    assert recall >= 0.95 and precision >= 0.95


def test_pii_redacts_whole_runs_and_parts(spark):
    secrets = ["a1B2c3D4e5F6" * k for k in (1, 2, 11, 40, 417)]
    taught = [t for t, *_ in personal_texts(3, 600)]
    texts = [f'login with token = "{x}" today' for x in secrets] + ["Des +1 (826) 555-4081 190.137.223.4 8", "pay by card 4111 1111 1111 1111 980 now", None, "", "plain words only"]
    model = pii.fit(docs_of(spark, taught + texts))
    assert pii.fit(docs_of(spark, taught + texts)).weights.tolist() == model.weights.tolist()
    clean = [r["text"] for r in pii.redact(docs_of(spark, texts), model).orderBy("doc_id").collect()]
    assert clean[:5] == ["login with [SECRET] today"] * 5
    assert "4081" not in clean[5] and "1111" not in clean[6] and clean[7:] == [None, "", "plain words only"]
    spans = pii.spans_of("4111 1111 1111 1111 980", model, 0.0)
    assert (spans[0], [(pii.KINDS[k], a, b) for k, a, b in spans[1]]) == ([], [("card_part", 0, 19)])
    empty = pii.fit(docs_of(spark, texts).where("false"))
    assert not empty.weights.any() and pii.detect(docs_of(spark, texts).where("false"), empty).count() == 0


def test_pii_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "x@y.zz"), (1, "x@y.zz"), (1, "x@y.zz")], "doc_id long, text string")
    rows = pii.detect(docs, pii.fit(docs)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None"] and all(len(r["base"]) == 1 for r in rows)


def test_pii_long_runs_take_linear_time():
    for text in ("a." * 100_000 + " dot ", "at " * 50_000 + " dot ", "1 " * 100_000, "+1 " * 50_000, "token = " * 20_000, "1.1.1." * 30_000, "GB12" + "AAAA" * 50_000):
        good, bad = pii.base_spans(text)
        pii.loose_spans(text, good, bad)


def test_licenses(spark):
    texts = ["prose\nReleased under the MIT License. More prose follows here\nend", "All rights reserved.", None, "", "this license is unlike any other", "Licensed under CC BY-NC 4.0.\n" + "x " * 5000, "Licensed under the Apache License, Version 2.1.", "nothing here"]
    rows = licenses.scan(docs_of(spark, texts)).collect()
    found = {r["doc_id"]: (r["license"], r["confirmed"]) for r in rows}
    assert found[0] == ("MIT", True) and found[1] == ("proprietary", True) and found[5] == ("CC-BY-NC-4.0", True)
    assert not found[4][1] and found[6] == ("Apache-2.0", False)
    assert set(found) == {0, 1, 4, 5, 6}
    for r in rows:
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["block"]
    assert licenses.scan(docs_of(spark, texts).where("false")).count() == 0


def filled(wording, holder="Acme Inc."):
    """A template with something in its slots."""
    return re.sub(r"<(\d+)>", lambda m: {"1": "1.", "2": "the", "4": "the terms of the", "8": holder, "12": holder}[m[1]], wording)


def full(license_, k=-1, **how):
    return filled(licenses.TEMPLATES[license_][k], **how)


WRAPPED = {
    "MIT": "Copyright (c) 2020 A. Body\n\n" + "\n".join(textwrap.wrap(full("MIT"), 70)), "BSD-3-Clause": " * All rights reserved.\n *\n" + textwrap.indent("\n".join(textwrap.wrap(full("BSD-3-Clause"), 60)), " * "),
    "ISC": "\r\n".join(textwrap.wrap(full("ISC"), 72)) + "\nit stays",
    "GPL-3.0": "# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n",
    "proprietary": "Made by somebody. All rights\nreserved.\n", "Unlicense": "This is free and unencumbered software released into the public\ndomain.", "CC-BY-4.0": "Licensed\nunder\nCC\nBY\n4.0.",
}


def test_wrapped_licenses(spark):
    texts = [f"prose before\nand more of it\n{t}\nprose after" for t in WRAPPED.values()] + ["permission to\nuse it", "Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this program", "the licence\nsome\nthe copyright"]
    rows = licenses.scan(docs_of(spark, texts)).collect()
    assert {(r["doc_id"], r["license"]) for r in rows if r["confirmed"]} == {*enumerate(WRAPPED)}
    for r in rows:
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["block"] and "prose" not in r["block"]
    n = len(WRAPPED)
    assert [r["block"] for r in rows if r["doc_id"] == n] == ["permission to"]
    assert [r["confirmed"] for r in rows if r["doc_id"] == n + 1] == [False]
    assert sorted(r["block"] for r in rows if r["doc_id"] == n + 2) == ["the copyright", "the licence"]


SAME = {
    "LGPL-3.0": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 3 of the License, or (at your option) any later version.",
    "LGPL-2.0": "under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License", "LGPL-2.1": "GNU Lesser General Public License version 2.1 as published by the Free Software Foundation",
    "AGPL-3.0": "GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense", "GPL-2.0": "Licensed under the GPLv2 or later", "Apache-2.0": "licensed under Apache 2.0", "MIT-0": full("MIT-0"), "X11": full("X11"),
    "BSD-2-Clause": full("BSD-2-Clause"), "BSD-3-Clause": "Copyright 2020. All rights reserved.\n" + full("BSD-3-Clause"), "MIT": "Released under the MIT License.", "0BSD": full("0BSD"),
}
NONE = [
    "not released under the MIT License", "This was never licensed under the Apache License, Version 2.0.", full("MIT").replace("sublicense", "rent"), full("MIT").replace("subject to the following conditions", "for good"),
    full("BSD-2-Clause").replace("binary form must", "binary form may"), "either version 3 of the License, or (at your option) any later version", "Licensed under the Apache License, Version 2.1.", "the license of this work is unknown", "SPDX-License-Identifier: Odd-1.0",
]


def test_each_license_alone_and_none_where_words_differ():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    found = lambda t: [(j[0], j[2]) for a, b in scanner.blocks(t) for j in scanner.judge(t[a:b]) if j[4]]
    assert {name: found(f"prose\n{t}\nprose") for name, t in SAME.items()} == {name: [(name, 0)] for name in SAME}
    assert [found(t) for t in NONE] == [[]] * len(NONE)
    for name in licenses.TEMPLATES:
        if name != "proprietary":
            assert found(f"// SPDX-License-Identifier: {name}\nprose") == [(name, 0)]
    assert sorted(found("/* SPDX-License-Identifier: (MIT OR GPL-2.0-or-later) */")) == [("GPL-2.0", 0), ("MIT", 0)]
    changed = full("MIT").replace("sublicense", "rent").replace("copies of the", "copies the")
    assert [(j[0], j[2], j[3]) for j in scanner.judge(changed)] == [("MIT", 2, 7)]  # "sublicense" and "of" are missing; "rent" and six words of slots are more


def test_labelled_notices():
    """Every wording with other holders, line breaks and comment marks among prose, against the same with a word changed: precision and recall."""
    rng, scanner = random.Random(21), licenses.Scanner(licenses.TEMPLATES)
    right = wrong = missed = 0
    for name, wordings in licenses.TEMPLATES.items():
        for wording in wordings:
            for spoilt in (False, True):
                words = filled(wording, rng.choice(["Acme Inc.", "the copyright holder", "J. Doe and others"])).split()
                fixed = [k for k, w in enumerate(words) if w in wording.split()]
                if spoilt:
                    words[rng.choice(fixed)] = "altered"
                mark, width = rng.choice(["", "# ", " * ", "// "]), rng.randint(30, 90)
                text = "some prose here\n\n" + "\n".join(mark + line for line in textwrap.wrap(" ".join(words), width, break_on_hyphens=False, break_long_words=False)) + "\n\nmore prose of no kind"
                found = {j[0] for a, b in scanner.blocks(text) for j in scanner.judge(text[a:b]) if j[4]}
                want = set() if spoilt else {name}
                right, wrong, missed = right + len(found & want), wrong + len(found - want), missed + len(want - found)
    # A long text with a word changed may still hold another license's whole wording.
    assert right / (right + wrong) >= 0.97 and missed == 0, (right, wrong, missed)


def test_licenses_equal_brute_force(spark):
    """Every wording as a regular expression against every text; and of a block that confirms none, every license compressed."""
    import zstandard

    rng = random.Random(8)
    known = [(name, text) for name, texts in licenses.TEMPLATES.items() for text in texts]
    assert all(licenses.ANCHORS.search(text) for _, text in known)
    prose = lambda: " ".join(rng.choice(["the", "this", "software", "of", "either", "permission", "word", "license", "in", "all", "under", "not"]) for _ in range(rng.randint(0, 9)))
    texts = [None, ""]
    for _ in range(150):
        lines = [prose() for _ in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 3)):
            words = filled(rng.choice(known)[1]).split(" ")
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = "changed"
            width = rng.randint(3, 15)
            lines += [rng.choice(["", " * ", "# "]) + " ".join(words[k : k + width]) for k in range(0, len(words), width)] + [prose() for _ in range(rng.randint(0, 3))]
        texts.append("\n".join(lines))
    rows = licenses.scan(docs_of(spark, texts)).collect()
    pattern = lambda t: re.compile("(?= " + "".join(f"(?: \\S+){{0,{x}}}?" if k % 2 else "".join(f" {re.escape(w)}" for w in licenses._words(x)) for k, x in enumerate(re.split(r"<(\d+)>", t)))[1:] + " )")
    patterns = [(name, pattern(t)) for name, t in known]
    for r in rows:  # a block's confirmed licenses are all that stand in it, but those denied or covered by a longer one
        joined = " " + " ".join(licenses._words(r["block"])) + " "
        spans = []
        for name, p in patterns:
            for m in p.finditer(joined):
                end = re.compile(p.pattern[3:-1]).match(joined, m.start()).end()
                if not {"not", "never", "neither", "nor", "cannot", "isn", "aren", "wasn", "weren"} & set(joined[: m.start()].split()[-4:]):
                    spans.append((m.start(), end, name))
        own = {n for a, b, n in spans if not any(c <= a and b <= d and d - c > b - a for c, d, _ in spans)}
        own = own - {"proprietary"} or own
        assert (r["license"] in own) == r["confirmed"] and own <= {x["license"] for x in rows if (x["doc_id"], x["start"]) == (r["doc_id"], r["start"])}
    assert sum(r["confirmed"] for r in rows) > 120
    size = lambda data, **how: len(zstandard.ZstdCompressor(level=3, **how).compress(data))
    raw = {name: " ".join(re.sub(r"<\d+> ?", "", t) for t in texts).encode() for name, texts in licenses.TEMPLATES.items()}
    for r in [r for r in rows if not r["confirmed"]][:40]:
        data = r["block"].encode()
        saved = {name: 1 - size(data, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) / size(data) for name, d in raw.items()}
        assert r["reduction"] == pytest.approx(max(saved.values())) and r["license"] == max(saved, key=saved.get)


def test_licenses_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "All rights reserved."), (1, "All rights reserved."), (1, "All rights reserved.")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["license"]) for r in licenses.scan(docs).collect()) == [("1", "proprietary")] * 2 + [("None", "proprietary")]


def test_every_license_of_a_block(spark):
    two = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    texts = [two, two.replace(". L", ".\nL"), two + " All rights reserved. Licensed under CC BY 4.0.", "Released under the MIT License. Licensed under the Apache License, Version 2.1."]
    rows = licenses.scan(docs_of(spark, texts)).collect()
    assert len({(r["doc_id"], r["start"], r["end"]) for r in rows}) == len(texts) and all(r["confirmed"] and r["missing"] == 0 for r in rows)
    assert sorted((r["doc_id"], r["license"]) for r in rows) == [
        (0, "Apache-2.0"), (0, "MIT"), (1, "Apache-2.0"), (1, "MIT"), (2, "Apache-2.0"), (2, "CC-BY-4.0"), (2, "MIT"), (3, "MIT"),
    ]


def language_docs(spark, n=400):
    rng = random.Random(2)
    sound = {"aa": ["tha", "ing", "er ", "ou", " wh"], "bb": ["sch", "ung", "en ", "ß", " ge"], "cc": ["ción", "ue ", "ll", "ado", " la"]}
    rows = []
    for k in range(n):
        lang = rng.choice(list(sound))
        rows.append((k, "".join(rng.choices(sound[lang], k=rng.randint(5, 60))), lang, "score"))
    rows += [(n, None, "aa", "x"), (n + 1, "", "aa", "x"), (n + 2, "123 +-", "bb", "x"), (n + 3, "tha ing er ou wh " * 3000, None, "x"), (None, "schung geen", "bb", None), (1, rows[1][1], rows[1][2], "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_language_id_on_held_out_rows(spark):
    docs = language_docs(spark)
    got = langid.identify(docs, fit_rows=200).toPandas()
    assert len(got) == 406
    for doc_id, held in got[["doc_id", "held_out"]].dropna().itertuples(index=False):
        assert held == (zlib.crc32(str(int(doc_id)).encode()) % 4 == 2)
    truth = docs.where("doc_id < 400").select("doc_id", "lang").distinct().toPandas()
    both = got.merge(truth, on="doc_id")
    assert (both[both.held_out].lang_pred == both[both.held_out].lang).mean() > 0.98
    odd = got[got.doc_id.isin([400, 401, 402])]
    assert (odd.lang_pred == "und").all() and (odd.score == 0).all()
    assert got[got.doc_id == 403].lang_pred.iloc[0] == "aa" and got.score.between(0, 1).all()


def test_language_id_never_reads_what_it_must_not(spark):
    docs = language_docs(spark)
    first = langid.identify(docs, fit_rows=200)
    swapped = docs.withColumn("lang", F.when(langid.held_out(), F.lit("cc")).otherwise(F.col("lang")))
    second = langid.identify(swapped, fit_rows=200)
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert langid.identify(docs.where("false")).count() == 0


def plain_grams(text):
    """Bucket counts of a text's one- to three-letter runs, written out one by one."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    letters = [ord(c) if c != " " else 0 for c in " " + " ".join(letters.split()) + " "] if letters.split() else []
    seen = {}
    for i in range(len(letters)):
        h = 0
        for n, c in enumerate(letters[i : i + 3]):
            h = (c * 0x9E3779B1 + 1) & 0xFFFFFFFF if n == 0 else ((h ^ h >> (15, 13)[n - 1]) * (0x85EBCA77, 0xC2B2AE3D)[n - 1] + c) & 0xFFFFFFFF
            if n or c:
                bucket = ((h ^ h >> 16) * 0x27D4EB2F & 0xFFFFFFFF) >> 16
                seen[bucket] = seen.get(bucket, 0) + 1
    return seen


def test_grams_equal_brute_force():
    texts = [t for t in ODD if len(t or "") < 5000] + fuzz(60) + ["Σ́ İ ß A--B", "12 34", "x"]
    got = [{} for _ in texts]
    for lo, _, part in langid.slices(pa.array(texts), 300):
        for owner, bucket, count in zip(*langid.batch_grams(part), strict=True):
            got[lo + owner][int(bucket)] = int(count)
    assert got == [plain_grams(t) for t in texts]


def test_probabilities_and_ftrl_equal_plain_loops():
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6), int(rng.integers(3))) for _ in range(30)]
    weights, bias = langid.fit_ftrl(rows, 3, 2, 0.5, 1.0, 0.05, 0.1)
    z, n = {}, {}
    w = lambda i, k: 0.0 if abs(z.get((i, k), 0)) <= 0.05 else -(z[i, k] - math.copysign(0.05, z[i, k])) / ((1 + math.sqrt(n[i, k])) / 0.5 + 0.1)
    order = np.random.default_rng(5)
    for _ in range(2):
        for r in order.permutation(30).tolist():
            buckets, x, label = rows[r]
            own = [*zip(buckets.tolist(), x.tolist(), strict=True), (langid.SIZE, 1.0)]
            score = [math.exp(sum(v * w(i, k) for i, v in own)) for k in range(3)]
            for k in range(3):
                for i, v in own:
                    g, old = (score[k] / sum(score) - (k == label)) * v, n.get((i, k), 0.0)
                    now = w(i, k)
                    z[i, k] = z.get((i, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / 0.5 * now
                    n[i, k] = old + g * g
    assert all(weights[i, k] == pytest.approx(w(i, k), abs=1e-6) for i in range(40) for k in range(3)) and bias == pytest.approx([w(langid.SIZE, k) for k in range(3)])
    idf = rng.random(langid.SIZE)
    model = langid.Model(["a", "b", "c"], idf, rng.standard_normal((langid.SIZE, 3)), np.array([0.1, 0.2, 0.3]), 0.7)
    some, p = model.probabilities(["one two", "12", "drei und"])
    assert some.tolist() == [0, 2]
    for row, text in zip(p, ("one two", "drei und"), strict=True):
        x = {b: math.log1p(c) * idf[b] for b, c in plain_grams(text).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        e = [math.exp((sum(v * model.weights[b, k] for b, v in x.items()) / norm + model.bias[k]) / 0.7) for k in range(3)]
        assert row == pytest.approx([v / sum(e) for v in e])


def test_too_many_languages_and_one_id_in_many_rows(spark):
    many = spark.range(12).select(F.col("id").alias("doc_id"), F.lit("abc def").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="languages"):
        langid.fit(many, most_languages=11)
    one = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("abc"), F.when(F.col("id") % 2 == 0, "d").otherwise("e")).alias("text"), F.lit("x").alias("lang"))
    assert langid.fit(one, fit_rows=10).languages == ["x"]


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    logits = rng.standard_normal((4000, 3))
    p = langid.softmax(logits)
    classes = np.array([rng.choice(3, p=r) for r in p])
    assert langid.fit_temperature(logits * 5, classes) == pytest.approx(5, rel=0.15)


def test_digest_of_no_text():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
