import random
import hashlib
import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from umbra.llm import licenses, registry, transport
from umbra.llm.chat import format_chats
from umbra.llm.mixing import mix_sources, rake


@pytest.mark.parametrize("size", [0, 1, 64, 170, 175, 176, 177, 184, 8185, 8192, 8193, 70_000])
def test_transport_round_trip(size):
    payload = transport._padded(os.urandom(size))
    stream = transport.mux(payload)
    d = transport.Demux(stream)
    assert d.payload == payload and len(stream) % 188 == 0 and all(stream[i] == 0x47 for i in range(0, len(stream), 188))
    assert (d.sync_errors, d.counter_errors, d.crc_errors, d.length_errors) == (0, 0, 0, 0)
    assert [t for t, _ in d.stamps] == [3600 * k for k in range(-(-len(payload) // 8192))]
    assert [e for _, e in d.stamps] == [k % 8 == 0 for k in range(len(d.stamps))]


def test_transport_damage():
    payload = transport._padded(os.urandom(40_000))
    stream = bytearray(transport.mux(payload))
    lost = bytes(stream[: 188 * 10] + stream[188 * 11 :])
    d = transport.Demux(lost)
    assert d.counter_errors == 1 and d.payload == payload[8192:]
    stream[188 + 20] ^= 1  # the program map
    assert transport.Demux(bytes(stream)).crc_errors == 1
    assert transport.Demux(b"").packets == 0 and transport.Demux(b"junk" * 100).sync_errors > 0


def test_transport_query(spark, make_docs, awkward):
    got = transport.read(transport.store(make_docs(awkward))).collect()
    assert len(got) == len(awkward)
    texts = sorted(hashlib.sha256((t or "").encode().ljust(max(64, -(-len((t or "").encode()) // 64) * 64), b"\0")).hexdigest() for _, t, *_ in awkward)
    assert sorted(r.payload_sha256 for r in got) == texts
    one = next(r for r in got if r.doc_id == 4)
    assert (one.n_bytes, one.payload_bytes, one.tail_crc32) == (7, 64, zlib.crc32(b"one two".ljust(64, b"\0")))
    assert registry.op7_transport_streams(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_licenses(make_docs, awkward):
    texts = {
        10: "some words\nReleased under the MIT License.\nmore words",
        11: "x\nThis work licensed under the GNU General Public License, version 3.",
        12: "This work is licensed under the GNU General Public License, version 2.",
        13: "Licensed under CC BY-NC 4.0.\n\n\n\n\n\n\nLicensed under CC BY-NC 4.0.",
        14: "Licensed under CC BY 4.0.",
        15: "my driving license was lost without permission",
        16: "\n".join(licenses.TEMPLATES["MIT"][1].replace(", ", ",\n").split("\n")) + "\nAll rights reserved.",
        17: "warranty void. " + licenses.TEMPLATES["Apache-2.0"][1],
    }
    got = licenses.scan_licenses(make_docs([*texts.items(), *((d, t) for d, t, *_ in awkward)])).collect()
    found = sorted((r.doc_id, r.license, r.n_missing + r.n_inserted) for r in got)
    assert found == [(10, "MIT", 0), (11, "GPL-3.0", 1), (12, "GPL-2.0", 0), (13, "CC-BY-NC-4.0", 0), (13, "CC-BY-NC-4.0", 0), (14, "CC-BY-4.0", 0), (16, "MIT", 0), (16, "Proprietary", 0), (17, "Apache-2.0", 0)]
    assert licenses.scan_licenses(make_docs([])).collect() == []


def test_license_lines_of_the_smallest_tables(spark):
    lines = {t: n for n, ts in licenses.TEMPLATES.items() for t in ts}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    want = {(r.doc_id, lines[x]) for r in docs for x in r.text.split("\n") if x in lines}
    assert want == {(r.doc_id, r.license) for r in registry.op1_license_scan(spark, "/root/testdata/sf0.01").collect()}


def brute_chats(rows):
    logs = {}
    for c, turn, role, text in rows:
        logs.setdefault(c, set()).add((turn is not None, turn or 0, hashlib.sha256(f"{role or ''}\x1f{text or ''}".encode()).hexdigest(), role or "", text or ""))
    logs = {c: [x[3:] for x in sorted(v)] for c, v in logs.items()}
    out = []
    for c, v in logs.items():
        if any(len(o) > len(v) and o[: len(v)] == v for o in logs.values()):
            continue
        if any(o == v and d is not None and (c is None or d < c) for d, o in logs.items()):
            continue
        out.append((c, len(v), "".join(f"<|{a}|>\n{b}<|end|>\n" for a, b in v)))
    return sorted(out, key=repr)


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 2, "user", "bye"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, "user", "hi"), (5, 1, "assistant", "no"), (6, 0, "assistant", "hi"), (7, 1, "user", "late"), (7, 0, None, None),
        (8, 0, "user", "hi"), (8, 0, "user", "hi"), (9, 0, "user", "tie b"), (9, 0, "user", "tie a"), (None, 0, "user", "lost"), (10, None, "user", "first"), (10, 0, "user", "then"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("x"))
    assert sorted((tuple(r) for r in format_chats(df).collect()), key=repr) == brute_chats(rows)
    assert format_chats(df.limit(0)).collect() == []


def test_raking_fits_all_margins(spark):
    cells = spark.createDataFrame([("a", "en", "x", 900), ("a", "de", "y", 50), ("b", "en", "y", 30), ("b", "de", "x", 20)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"x": 0.5, "y": 0.5}}
    got = rake(cells, targets, cycles=40).withColumn("t", F.col("tokens") * F.col("weight")).collect()
    total = sum(r.t for r in got)
    for margin, shares in targets.items():
        for value, share in shares.items():
            assert abs(sum(r.t for r in got if r[margin] == value) / total - share) < 1e-3


def test_mixing(spark, make_docs, awkward):
    docs = make_docs(awkward + [(100 + k, f"a b c {k}", "en" if k % 3 else "de", f"s{k % 4}") for k in range(400)])
    kept = mix_sources(docs, keep_share=0.5)
    rows = kept.collect()
    assert docs.columns == kept.columns[:-3] and kept.columns[-3:] == ["mix_topic_", "mix_tokens", "mix_probability"] and 0 < len(rows) < 411
    assert {r.mix_topic for r in rows} == {"x"}
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(docs, keep_share=0.5).collect()))
    assert all(0 <= r.mix_probability <= 1 for r in rows)
    assert mix_sources(make_docs([])).collect() == []
    assert mix_sources(make_docs([(1, None), (2, "")])).count() <= 2
    assert mix_sources(docs, keep_share=1.0).count() == docs.count()


def test_transport_random_damage_never_raises():
    r = random.Random(12)
    payload = bytes(r.randrange(256) for _ in range(40_000))
    whole = transport.mux(payload)
    units = {payload[i : i + transport.UNIT] for i in range(0, len(payload), transport.UNIT)}
    for _ in range(300):
        stream = bytearray(whole)
        for _ in range(r.choice([1, 3, 30, 300])):
            at = r.randrange(len(stream) // 188) * 188 + r.choice([1, 2, 3, 4, 5, 6, r.randrange(188)])
            stream[at] = r.randrange(256)
        if r.random() < 0.3:
            del stream[r.randrange(len(stream)) :]
        d = transport.Demux(bytes(stream))
        assert isinstance(d.feature(), str) and len(d.payload) <= len(payload) + 188
    for pointer in (200, 183, 255):  # a table packet whose pointer lies outside it
        stream = bytearray(whole)
        stream[4] = pointer
        assert transport.Demux(bytes(stream)).length_errors
    # one lost packet costs its own unit only
    lost = transport.Demux(whole[: 188 * 20] + whole[188 * 21 :])
    assert lost.counter_errors == 1 and all(lost.payload[i : i + 8192] in units for i in range(0, len(lost.payload), 8192))


def test_transport_repeated_packets_and_discontinuities():
    payload = bytes(range(256)) * 80
    packets = [transport.mux(payload)[i : i + 188] for i in range(0, len(transport.mux(payload)), 188)]
    twice = transport.Demux(b"".join(p + p if k % 3 == 0 else p for k, p in enumerate(packets)))
    assert twice.payload == payload and twice.counter_errors == 0
    thrice = transport.Demux(b"".join([*packets[:5], packets[5], packets[5], packets[5], *packets[6:]]))
    assert thrice.counter_errors
    # counters start anew at a signalled discontinuity, on the first packet of a unit
    second = bytearray(transport.mux(payload))
    second[188 * 2 + 5] |= 0x80
    assert second[188 * 2 + 4] >= 7
    both = transport.Demux(transport.mux(payload)[:-188] + transport.mux(payload)[-188:] + bytes(second[188 * 2 :]))
    assert both.payload == payload * 2 and both.counter_errors == 0


def test_transport_empty_table_and_batches(make_docs, monkeypatch):
    assert transport.read(transport.store(make_docs([]))).collect() == []
    monkeypatch.setattr(transport, "BATCH", 100)
    rows = transport.read(transport.store(make_docs([(i, "x" * (i * 37 % 200)) for i in range(40)]))).collect()
    assert sorted((r.doc_id, r.n_bytes) for r in rows) == [(i, i * 37 % 200) for i in range(40)]
    assert list(transport._parts([50, 60, 500, 1, 1])) == [(0, 1), (1, 2), (2, 3), (3, 5)]


def test_chats_without_id_and_of_many_turns(spark):
    rows = [(None, k % 3, "user", f"alone {k % 5}") for k in range(40)] + [(None, None, None, None), (None, 0, "user", "turn 0")]
    rows += [(1, k, "user", f"turn {k}") for k in range(20_000)] + [(2, k, "user", f"turn {k}") for k in range(19_999)]
    rows += [(3, 0, "user", "x" * 1_000_000), (3, 1, "user", "y")]
    got = {(r.conv_id, r.n_turns): r.chat for r in format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() if r.conv_id}
    assert set(got) == {(1, 20_000), (3, 2)}
    assert got[1, 20_000] == "".join(f"<|user|>\nturn {k}<|end|>\n" for k in range(20_000)) and len(got[3, 2]) > 1_000_000
    alone = format_chats(spark.createDataFrame(rows[:42], "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r.chat for r in alone) == sorted(["<||>\n<|end|>\n", "<|user|>\nturn 0<|end|>\n", *(f"<|user|>\nalone {k}<|end|>\n" for k in range(5))])
    assert all(r.conv_id is None and r.n_turns == 1 for r in alone)


def test_mixing_under_salts(spark, make_docs, monkeypatch):
    docs = make_docs([(k, f"a b c {k}" + " @" * (k % 3 == 0), "en" if k % 3 else "de", f"s{k % 40}") for k in range(500)] + [(None, "x", None, None)] * 3)
    want = sorted(map(str, mix_sources(docs, repeats=True).collect()))
    monkeypatch.setattr("umbra.llm.mixing.BROADCAST_CELLS", 10)
    assert sorted(map(str, mix_sources(docs, repeats=True).collect())) == want and len(want) > 100


def test_mixing_against_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(registry.oracle_sql()["op5_source_mixing"]).fetchall()
    got = registry.op5_source_mixing(spark, SF).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(got) > 100


def test_sampled_tokens_meet_the_targets(spark):
    rows = registry.op5_source_mixing(spark, "/root/testdata/sf0.1").collect()
    all_ = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("source", "lang", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("n")).collect()
    total = sum(r.n_tokens * r.copies for r in rows)
    assert abs(total / sum(r.n for r in all_) - 0.8) < 0.02
    for margin in ("source", "lang"):
        raised = {v: sum(r.n for r in all_ if r[margin] == v) ** 0.7 for v in {r[margin] for r in all_}}
        for v, share in raised.items():
            assert abs(sum(r.n_tokens * r.copies for r in rows if r[margin] == v) / total - share / sum(raised.values())) < 0.01
