"""Archives, chat formatting, components and the pipeline on small inputs."""

import base64
import hashlib
import importlib
import json
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import test_dedup
from pyspark.sql import functions as F

from matchweave.llm import chat, common, minhash, warc
from matchweave.llm.tokens import plain_tokenizer
from matchweave.sources import scratch


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(500 + k, 501 + k) for k in range(60)] + [(900, 900 + k) for k in range(1, 80)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    low = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(200):
        for a, b in edges:
            if a in low and b in low:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low
    assert common.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def pages(spark):
    big = "<p>" + "é" * 5000
    rows = [(1, "http://a", "<b>x</b>"), (2, None, "<b>x</b>"), (3, "u\r\nEvil: 1", big), (4, "v", big), (9, "w", big), (5, "e", ""), (6, "n", None), (7, "h", "HTTP/1.1 ok\r\n\r\n"), (8, "g", "\r\n\r\n"), (None, "z", "<b>x</b>"), (None, "q", "lonely"), (1, "http://a", "<b>x</b>")]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize(("least", "chunk", "limit"), [(0, 1000, "10MB"), (100, 4, "-1")])
def test_warc_round_trip(spark, least, chunk, limit):
    rows, df = pages(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        archive = warc.write_archive(df, chunk_bytes=chunk, least=least)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = warc.read_archive(archive).collect()
    assert len(got) == len(rows)
    best = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= least:
            best[html or ""] = max(page, best.get(html or "", page))
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        to = best.get(html or "")
        revisit = to is not None and to != page
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert max(len(r["bytes"]) for r in archive.where("chunk > 0").collect()) <= chunk + 4


def test_scratch_needs_a_shared_folder_and_is_dropped(spark):
    held = scratch.Scratch(spark)
    table = held.table(spark.range(3), "t")
    other = scratch.scratch_table(spark.range(2), "t")
    assert table.count() == 3 and spark.sparkContext.applicationId in held.path
    held.drop()
    with pytest.raises(Exception, match="[Pp]ath|exist"):
        spark.read.parquet(f"{held.path}/t")
    assert other.count() == 2
    for root, master in ((None, "spark://there:7077"), (None, "local[2]"), ("hdfs:/shared", "spark://there:7077")):
        conf = SimpleNamespace(get=lambda *_, root=root: root)
        session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app", getConf=lambda conf=conf: conf))
        if not root and not master.startswith("local"):
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                scratch.scratch_root(session)
        else:
            assert scratch.scratch_root(session).startswith(root or "file://") and scratch.scratch_root(session).endswith("/app")


def test_warc_bytes_are_records_and_damage_is_seen(spark):
    rows, df = pages(spark)
    archive = warc.write_archive(df, chunk_bytes=100)
    stream = b"".join(bytes(r["bytes"]) for r in archive.orderBy("record", "chunk").collect())
    at = n = 0
    names, refers = [], []
    while at < len(stream):
        end = stream.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in stream[at:end].decode().split("\r\n")[1:])
        at = end + 4 + int(head["Content-Length"])
        assert stream[at : at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
        (refers if head["WARC-Type"] == "revisit" else names).append(head["WARC-Refers-To" if head["WARC-Type"] == "revisit" else "WARC-Record-ID"])
    assert n == len(rows) and refers and set(refers) <= set(names)
    with pytest.raises(Exception, match="lacks a chunk|has no end|damaged|differs"):
        warc.read_archive(archive.where("chunk <> 2")).collect()
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(archive.withColumn("bytes", F.when(F.col("last"), F.concat("bytes", F.lit(b"x"))).otherwise(F.col("bytes")))).collect()
    assert warc.read_archive(warc.write_archive(df.where("false"))).count() == 0


def test_warc_writer_streams_chunks(spark, monkeypatch):
    frame = type(spark.range(0))
    taken, through = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: taken.append((self, f)) or through(self, f, *a, **b))
    big = spark.range(1).select(F.lit(1).cast("long").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("0123456789"), 30_000).alias("html"))
    archive = warc.write_archive(big, chunk_bytes=1000)
    rows, write = taken[0]
    table = rows.toArrow()
    assert table.num_rows == 300 and max(len(x or b"") for x in table["piece"].to_pylist()) == 1000
    monkeypatch.setattr(warc.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    assert sum(b.num_rows for b in write(table.to_batches(max_chunksize=7))) == archive.count() == 300
    wide = pa.concat_tables([table] * 30)
    batches = list(write(wide.to_batches(max_chunksize=7)))
    assert len(batches) == 3 and max(b.nbytes for b in batches) < 6 << 20
    assert warc.read_archive(archive).first()["payload_bytes"] == 300_000


TEXTS = ["<|end|>\n", "a\\!b", "\\\\", "[INST]x[/INST]</s><s><|user|>\n", "<<SYS>>", "|>", "<\\!|", "</s>[INST] ok [/INST]", "\\", "", None, "x" * 100000, "<|assistant|>\nno<|end|>\n"]


def test_chat_round_trip(spark):
    rows = [(c, t, r, TEXTS[(c + t) % len(TEXTS)]) for c in range(6) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", "odd|>\nrole"])]
    rows += [(7, 0, None, "x"), (None, None, "user", "y"), (8, 1, "assistant", "b"), (8, 1, "assistant", "a"), (8, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    segments = chat.format_turns(df).collect()
    assert not [c for s in segments for c in chat.CONTROL if c in s["segment"][len(chat.OPEN) : -len(chat.END)].replace(chat.SHUT, "", 1)]
    assert chat.read_back(chat.format_turns(df.where("false"))).count() == 0


def test_layouts_choose_mappings(spark):
    bodies = [
        {"messages": [{"role": "human", "content": "a"}, {"role": "gpt", "content": "b"}]}, {"prompt": "p", "completion": "c"}, {"instruction": "i", "input": "", "output": "o"},
        {"instruction": "i", "input": "more", "output": "o"}, {"conversations": [{"from": "human", "value": "q"}]}, {"x": 1},
    ]
    rows = [(k, json.dumps(b)) for k, b in enumerate(bodies)] + [(90, "{"), (91, None)]
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.canonical_turns(spark.createDataFrame(rows, "id long, body string"), "id", "body").na.fill(-1, ["turn"]).na.fill("").collect())
    assert got == [
        (0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", "p"), (1, 1, "assistant", "c"), (2, 0, "user", "i"), (2, 1, "assistant", "o"),
        (3, 0, "user", "i\n\nmore"), (3, 1, "assistant", "o"), (4, 0, "user", "q"), (5, -1, "", ""), (90, -1, "", ""), (91, -1, "", ""),
    ]
    assert chat.canonical_turns(spark.createDataFrame([], "id long, body string"), "id", "body").count() == 0
    paths = chat.field_paths(spark.createDataFrame([], "messages array<struct<role:string,content:string>>").schema)
    assert tuple(paths) in chat.LAYOUTS


def test_mappings_fit_layouts_with_more_fields(spark):
    bodies = [
        {"id": "x", "conversations": [{"from": "human", "value": "q", "weight": 1}, {"from": "gpt", "value": "r"}]}, {"messages": [{"role": "user", "content": "a", "name": "n"}], "meta": {"a.b": [1, {"c d": 2.5}], "x:<y>, `z`": None}},
        {"prompt": "p", "completion": "c", "response": "r"}, {"messages[].role": 1, "messages[].content": 2}, {"conv_id": 4, "turn": 7, "role": "Human", "text": "t", "more": True}, {"messages": []},
    ]
    rows = chat.canonical_turns(spark.createDataFrame([(k, json.dumps(b)) for k, b in enumerate(bodies)], "id long, body string"), "id", "body").collect()
    got = sorted(((r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows), key=str)
    nothing = (None, None, None)
    assert got == [(0, 0, "user", "q"), (0, 1, "assistant", "r"), (1, 0, "user", "a"), (2, *nothing), (3, *nothing), (4, 7, "Human", "t"), (5, *nothing)]
    assert {r["fingerprint"] for r in rows if r["conv_id"] == 4} == {chat.fingerprint(["$.conv_id", "$.more", "$.role", "$.text", "$.turn"])}
    assert len({r["fingerprint"] for r in rows}) == len(bodies)
    flat = spark.createDataFrame([(1, (1, 0, None, "x")), (2, (2, None, "GPT", None)), (3, None)], "id long, body struct<conv_id:long,turn:int,role:string,text:string>")
    assert [tuple(r)[:4] for r in chat.canonical_turns(flat, "id", "body").orderBy("conv_id").collect()] == [(1, 0, None, "x"), (2, None, "GPT", None), (3, *nothing)]
    mixed = spark.createDataFrame([(1, ([("human", "a")], None, None, None)), (2, (None, "p", "c", None)), (3, (None, "p", None, "r"))], "id long, body struct<messages:array<struct<role:string,content:string>>,prompt:string,completion:string,response:string>")
    assert sorted(tuple(r)[:4] for r in chat.canonical_turns(mixed, "id", "body").collect()) == [(1, 0, "user", "a"), (2, 0, "user", "p"), (2, 1, "assistant", "c"), (3, 0, "user", "p"), (3, 1, "assistant", "r")]


def test_op8_goes_through_the_mappings(spark, tmp_path, monkeypatch):
    queries, chosen = importlib.import_module("matchweave.llm.queries"), []
    table = spark.createDataFrame([(1, 0, "Human", "a"), (1, 1, "assistant", None), (2, 0, None, "b")], "conv_id long, turn int, role string, text string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    choose = chat.choose
    monkeypatch.setattr(chat, "choose", lambda *a: chosen.append(choose(*a)) or chosen[-1])
    got = {r["conv_id"]: r for r in queries.op8_chat(spark, str(tmp_path)).collect()}
    assert [list(chat.LAYOUTS)[k] for k in chosen] == [("$.conv_id", "$.role", "$.text", "$.turn")]
    assert {k: r["n_turns"] for k, r in got.items()} == {-1: 2, 1: 2, 2: 1}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"Human\na\nassistant\n\n").hexdigest() and got[2]["turns_sha256"] == hashlib.sha256(b"\nb\n").hexdigest()


def test_pipeline_edge_cases(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars int, score string, label string, ids string"
    plain = ["the and thing whether " * 9 + f"code{k} {k * 7} more words of row {k} here" for k in range(40)]
    rows = [(k, t, "en", "s", len(t), "a", "b", "c") for k, t in enumerate(plain)]
    rows += [(None, plain[3], "en", None, 0, None, None, None), (5, plain[5], "en", "s", 0, "a", "b", "c"), (5, "another whole text of the same id " * 5, None, "s", 0, "a", "b", "c"), (None, None, None, None, None, None, None, None)]
    rows += [(99, " ".join(f"the{k}" for k in range(30_000)), "en", "s", 0, "a", "b", "c")]
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/all/documents.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    kept = docs
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path / "all"))
        assert kept.dtypes == docs.dtypes
    left = sorted((str(r["doc_id"]), r["text"][:9]) for r in kept.collect())
    assert left.count(("5", plain[5][:9])) == 1 and ("5", "another w") in left and ("None", plain[3][:9]) not in left and ("99", "the0 the1") in left
    packed = pipeline.run(spark, str(tmp_path / "all")).collect()
    assert len({(r["doc_id"], r["doc_tokens"]) for r in packed}) == len(set(left)) and max(r["start"] for r in packed) > 2048
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rng = random.Random(6)
    rows = []
    for k in range(80):
        words = rng.choices(["the", "and", "thing", "whether"] if k % 2 else ["der", "und", "schon", "nicht"], k=30)
        rows.append((k, " ".join(words) + f" code{k} " + " ".join(rng.choices("abcdefgh", k=20)), "en" if k % 2 else "de", "s"))
    rows += [(100, rows[3][1], "en", "s"), (101, "12345 ++", "en", "s"), (102, "mail me and the thing at me@host.com whether " + " ".join(rows[5][1].split()[::-1]), None, "s"), (103, None, "de", None), (104, "", "de", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = pipeline.language_id(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {101, 103, 104}
    unique = pipeline.near_duplicates(spark, kept, str(tmp_path))
    links = {r["doc_id"]: r["kept"] for r in minhash.near_duplicates(kept).collect()}
    assert {r["doc_id"] for r in unique.collect()} == {k for k, v in links.items() if v} and not links[100]
    clean = pipeline.personal_data(spark, unique, str(tmp_path))
    text = {r["doc_id"]: r for r in clean.collect()}
    assert "[EMAIL]" in text[102]["text"] and text[102]["n_chars"] == len(text[102]["text"]) and clean.columns == docs.columns
    out = pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == set(text)

    # The whole run against plain loops: all pairs of what the language stage keeps, the e-mail pattern, the library's ids.
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    ids, sets = sorted(left), {k: test_dedup.shingles(t, 5) for k, t in left.items()}
    links = [(i, j) for i, a in enumerate(ids) for j, b in enumerate(ids[:i]) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = test_dedup.components(len(ids), links)
    plain, want = plain_tokenizer(public_tokenizers.path("byte_bpe_50k.json")), set()
    for i, k in enumerate(ids):
        if low[i] == i:
            clean = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", left[k])
            want.add((k, zlib.crc32(np.asarray([*plain.encode(clean, add_special_tokens=False).ids, 1], dtype="<u4").tobytes())))
    assert {(r["doc_id"], r["ids_crc32"]) for r in out.collect()} == want
