import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater import functions as fn
from tidewater import options
from tidewater.operators import batch, files, log, namespace, telemetry
from tidewater.sources import crc, journal
from tidewater.streaming import dispatch, group_commit


@pytest.mark.parametrize(("data", "want"), [(b"", 0), (b"\0" * 32, 0x8A9136AA), (b"\xff" * 32, 0x62A8AB43), (bytes(range(32)), 0x46DD794E)])
def test_crc_known_answers(data, want):
    assert crc.crc32c(data) == want


def tail(data):
    frames, n = journal.decode_all(data), 0
    while True:
        try:
            next(frames)
            n += 1
        except StopIteration as stop:
            return n, *stop.value


def test_tail_states():
    good = journal.encode_frame(b"abc")
    assert tail(b"") == (0, 0, "CleanEnd")
    assert tail(journal.encode_frame(b"") * 2) == (2, 24, "CleanEnd")
    assert tail(good + good[:5]) == (1, 15, "TruncatedHeader")
    assert tail(good + good[:10]) == (1, 15, "TruncatedPayload")
    assert tail(good + good[:9] + b"X" + good[10:]) == (1, 15, "ChecksumMismatch")
    assert tail(good + b"junkjunkjunk") == (1, 15, "BadMagic")
    assert tail(good + b"FSY\x01" + b"\xff" * 8) == (1, 15, "LengthOverflow")
    assert tail(good + b"\0" * 100) == (1, 15, "CleanEnd")
    assert tail(good.ljust(512, b"\0") + good) == (2, 527, "CleanEnd")
    assert tail(good.ljust(100, b"\0") + good) == (1, 15, "TruncatedHeader")
    whole = good * 3
    for cut in range(len(whole)):
        assert tail(whole[:cut])[:2] == (cut // 15, cut // 15 * 15)


def test_crc_of_many(spark):
    rng = random.Random(1)
    rows = [b"", b"123456789", *(rng.randbytes(rng.choice([1, 63, 64, 65, 127, 128, 129, rng.randint(0, 5000)])) for _ in range(200))]

    def plain(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    got = crc.crc32c_many(np.frombuffer(b"xx" + b"".join(rows), np.uint8), np.cumsum([2, *map(len, rows)]))
    assert got.tolist() == [plain(r) for r in rows] and got[1] == 0xE3069283
    df = spark.createDataFrame([(k, r) for k, r in enumerate([*rows[:20], None])], "k int, p binary")
    sums = {r["k"]: r["c"] for r in df.select("k", journal.frame_crc("p").alias("c")).collect()}
    assert sums == {**{k: struct.unpack("<I", journal.encode_frame(r)[-4:])[0] for k, r in enumerate(rows[:20])}, 20: None}
    framed = df.where("p is not null").select("k", journal.frames("p").alias("f")).collect()
    assert all(bytes(r["f"]) == journal.encode_frame(rows[r["k"]]) for r in framed)


def whole_log(rng, records, gaps=True):
    """(bytes, [(lsn, payload)]) with zero gaps up to sector boundaries, and payloads that hold whole frames themselves."""
    out, want = b"", []
    for k in range(records):
        if gaps and rng.random() < 0.1:
            out = out.ljust(-(-len(out) // 512) * 512, b"\0")
        payload = rng.randbytes(rng.randint(0, 90)) if rng.random() < 0.8 else journal.encode_frame(b"inner %d" % k) * 3
        want.append((len(out), payload))
        out += journal.encode_frame(payload)
    return out, want


@pytest.mark.parametrize("width", [1 << 20, 700, 97])
def test_read_log(spark, tmp_path, width):
    rng = random.Random(4)
    data, want = whole_log(rng, 120)
    other, more = whole_log(rng, 40)
    cases = {"a": data + b"\0" * 7, "b": b"", "c": other + other[:5], "d": data[:-1], "e": other + b"junkjunkjunk" + other, "f": b"\0" * 600, "g": other + b"\0" * 2000}
    broken = bytearray(data)
    broken[want[60][0] + 9 if want[60][1] else want[61][0] + 9] ^= 1
    cases["h"] = bytes(broken)
    for name, raw in cases.items():
        (tmp_path / f"{name}.log").write_bytes(raw)
    (tmp_path / "a.log.corrupt-3").write_bytes(b"saved")
    got = {}
    for r in journal.read_log(spark, str(tmp_path), width=width).collect():
        got.setdefault(r["path"][-5], []).append((r["lsn"], bytes(r["payload"])))
        assert r["next_lsn"] == r["lsn"] + 12 + r["payload_len"]
    at = 60 if want[60][1] else 61
    assert {k: sorted(v) for k, v in got.items()} == {"a": want, "c": more, "d": want[:-1], "e": more, "g": more, "h": want[:at]}
    tails = {r["path"][-5]: (r["file_len"], r["clean_end"], r["records"], r["state"]) for r in journal.log_tails(spark, str(tmp_path), width).collect()}
    end, last = len(other), want[-1][0]
    assert tails == {
        "a": (len(data) + 7, len(data), 120, "CleanEnd"), "b": (0, 0, 0, "CleanEnd"), "c": (end + 5, end, 40, "TruncatedHeader"), "d": (
            len(data) - 1, tail(data[:-1])[1], 119, "TruncatedPayload"
        ),
        "e": (2 * end + 12, end, 40, "BadMagic"), "f": (600, 0, 0, "CleanEnd"), "g": (end + 2000, end, 40, "CleanEnd"), "h": (
            len(data), tail(bytes(broken))[1], at, "ChecksumMismatch"
        ),
    }
    assert last > 0 and tails["h"][1] <= want[at][0]
    some = journal.read_log(spark, str(tmp_path / "a.log"), want[50][0], width).collect()
    assert sorted((r["lsn"], bytes(r["payload"])) for r in some) == want[50:]
    for lsn, state in ((want[7][0], "Ok"), (want[7][0] + 1, "InvalidData"), (len(data) + 1, "UnexpectedEof"), (want[at][0], "Ok")):
        row = journal.read_at(spark, str(tmp_path / "a.log"), lsn).first()
        assert row["state"] == state and (row["payload"] is None) == (state != "Ok")


def test_repair(spark, tmp_path):
    good = b"".join(journal.encode_frame(b"r%d" % k) for k in range(30))
    cases = {"a.log": good, "b.log": good + b"torn", "c.log": good + b"\0" * 99, "d.log": b"", "e.log": good + b"other" + good}
    for name, raw in cases.items():
        (tmp_path / name).write_bytes(raw)
    n = len(good)
    (tmp_path / f"b.log.corrupt-{n}").write_bytes(b"else")  # the name is taken
    (tmp_path / f"e.log.corrupt-{n}").write_bytes(b"other" + good)  # saved before a crash
    got = {r["path"].rpartition("/")[2]: (r["clean_end"], r["tail"], r["sidecar"]) for r in journal.repair(spark, str(tmp_path), 128).collect()}
    assert got == {
        "a.log": (n, "Empty", None), "b.log": (n, "Preserved", f"b.log.corrupt-{n}.1"), "c.log": (n, "Zeros", None), "d.log": (0, "Empty", None),
        "e.log": (n, "Preserved", f"e.log.corrupt-{n}")
    }
    assert all((tmp_path / k).read_bytes() == (good if k != "d.log" else b"") for k in cases)
    assert (tmp_path / f"b.log.corrupt-{n}.1").read_bytes() == b"torn" and len(list(tmp_path.iterdir())) == 8
    assert {r["tail"] for r in journal.repair(spark, str(tmp_path)).collect()} == {"Empty"}
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(journal.sidecar_name(F.lit("b.log"), F.lit(n), F.lit(1))) == f"b.log.corrupt-{n}.1" and one(journal.sidecar_name(F.lit("b.log"), F.lit(n), F.lit(0))) == f"b.log.corrupt-{n}"


def test_append(spark, tmp_path):
    path = str(tmp_path / "log")
    assert journal.frontier(path) == 0
    df = spark.createDataFrame([(k, "r" * (k % 50)) for k in range(500)], "k long, p string").repartition(5)
    end = journal.append(df, ["k"], "p", path)
    assert end == sum(12 + k % 50 for k in range(500)) == journal.frontier(path)
    assert journal.append(df.where("k < 10"), ["k"], "p", path) == end + sum(12 + k for k in range(10))
    with pytest.raises(ValueError, match="cap"):
        journal.append(df, ["k"], "p", path, most=40)
    (tmp_path / "log" / f"{journal.frontier(path):020d}.log").write_bytes(journal.encode_frame(b"not committed"))
    rows = sorted((r["lsn"], r["next_lsn"], bytes(r["payload"])) for r in journal.read_segments(spark, path, 300).collect())
    assert [p for *_, p in rows] == [b"r" * (k % 50) for k in [*range(500), *range(10)]]
    assert rows[0][0] == 0 and all(a[1] == b[0] for a, b in zip(rows, rows[1:]))


def test_tail_stream(spark, tmp_path):
    from tidewater.streaming import tail as tailing

    logs = tmp_path / "logs"
    logs.mkdir()
    frame = [journal.encode_frame(b"record %d" % k) for k in range(40)]
    spark.dataSource.register(tailing.LogTail)

    def run():
        stream = spark.readStream.format("framed_log").option("path", str(logs)).option("range", 64).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.schema(tailing.SCHEMA).parquet(str(tmp_path / "out")).collect()
        return sorted((r["path"], r["lsn"], bytes(r["payload"])) for r in rows)

    want = lambda n: [("a.log", sum(map(len, frame[:k])), b"record %d" % k) for k in range(n)]
    (logs / "a.log").write_bytes(b"".join(frame[:10]) + frame[10][:9])
    assert run() == want(10)  # the torn frame is not there yet
    (logs / "a.log").write_bytes(b"".join(frame[:30]))
    assert run() == want(30)
    (logs / "a.log").write_bytes(b"".join(frame[:30]) + frame[30][:-1] + b"?")
    (logs / "b.log").write_bytes(frame[0])
    assert run() == [*want(30), ("b.log", 0, b"record 0")]  # a broken frame stops its log only
    (logs / "a.log").write_bytes(b"".join(frame))
    assert run() == [*want(40), ("b.log", 0, b"record 0")]


def test_paths(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(fn.normalize_path(F.lit("a//b\\c"))) == "a/b/c"
    assert one(fn.normalize_path(F.lit(""))) == ""
    assert one(fn.sanitize_segment(F.lit("  trail.  "))) == "trail"
    assert one(fn.escapes_root(F.lit("a/../../b"))) and not one(fn.escapes_root(F.lit("a/./../b")))
    assert one(fn.pci_parse(F.lit("1f:03.2"))["bus"]) == 31 and one(fn.pci_parse(F.lit("words"))) is None
    assert one(fn.cache_size(F.lit("32K"))) == 32768 and one(fn.cache_size(F.lit("x"))) is None


def test_globs(spark):
    assert namespace.expand_braces("{a,b}/{c,d}") == ["a/c", "a/d", "b/c", "b/d"]
    assert namespace.expand_braces("{a,{b,c}}") == ["a}", "b", "c}"] and namespace.expand_braces("a{b") == ["a{b"]
    assert len(namespace.expand_braces("{a,b}" * 12)) == 1024
    names = [
        ("", True), ("x.txt", False), ("a", True), ("a/x.txt", False), ("a/b", True), ("a/b/x.txt", False), ("a/b/y.md", False), ("!.txt", False),
        ("].txt", False), ("-.txt", False), ("a.b", True)
    ]
    paths = spark.createDataFrame(names, "path string, is_dir boolean")
    found = lambda p: sorted(r[0] for r in namespace.find(paths, p, F.col("is_dir")).collect())
    assert found("x*.txt") == ["x.txt"]
    assert found("**/x.txt") == ["a/b/x.txt", "a/x.txt", "x.txt"]
    assert found("a/*/{x.txt,y.md}") == ["a/b/x.txt", "a/b/y.md"]
    assert found("[!a-x].txt") == ["!.txt", "-.txt", "].txt"] and found("[]!].txt") == ["!.txt", "].txt"] and found("[x-].txt") == ["-.txt", "x.txt"] and found("[!!]*") == [
        "-.txt", "].txt", "a", "a.b", "x.txt"
    ]
    assert found("a/**") == ["a/b"] and found("**") == ["", "a", "a.b", "a/b"] and found("") == [""] and found("./a//b") == ["a/b"] and found("a?b") == ["a.b"]
    for bad in ("../x", "{..,x}/a.txt", "/x", "x..y"):
        with pytest.raises(ValueError, match="escapes"):
            found(bad)
    for bad in ("a**", "[a", "[]"):
        with pytest.raises(ValueError):
            found(bad)
    assert [r[0] for r in namespace.depth_first(paths.where("path like 'a%'")).collect()] == ["a", "a/b", "a/b/x.txt", "a/b/y.md", "a/x.txt", "a.b"]


def hot(spark):
    """One user holds nine tenths of all rows."""
    rng = random.Random(7)
    rows = [(0 if k % 10 else rng.randint(1, 5), k, rng.random() < 0.02, 10 * k, 10 * k + (10 if rng.random() < 0.9 else 9)) for k in range(2000)]
    return rows, spark.createDataFrame(rows, "user long, at long, flag boolean, lsn long, next_lsn long").repartition(7)


def test_plans_of_a_hot_key(spark):
    rows, df = hot(spark)
    by = {}
    for r in sorted(rows, key=lambda r: r[1]):
        by.setdefault(r[0], []).append(r)
    want = {r[1]: next((x[1] for x in own if x[1] >= r[1] and x[2]), None) for own in by.values() for r in own}
    assert {r["at"]: r["durable_at"] for r in log.durable_at(df, "user", "at", F.col("flag")).collect()} == want
    first = {u: next((r[1] for r in own if r[2]), 1 << 60) for u, own in by.items()}
    got = log.contiguous_frontier(df, "user", "at", ~F.col("flag"), F.lit(1))
    assert {r["user"]: (r["frontier"], r["finished"]) for r in got.collect()} == {u: (n, n) for u, own in by.items() for n in [sum(r[1] < first[u] for r in own)]}
    sticky = log.poisoned(df, "user", "at", F.col("flag"))
    assert {r["user"]: (r["accepted"], r["rejected"]) for r in sticky.collect()} == {
        u: (sum(r[1] <= first[u] for r in own), sum(r[1] > first[u] for r in own)) for u, own in by.items()
    }
    holes = {(b[0], b[1], a[4]) for own in by.values() for a, b in zip(own, own[1:]) if a[4] != b[3]}
    assert {(r["user"], r["at"], r["previous_end"]) for r in log.gaps(df, "at", "user").collect()} == holes
    done = batch.outcomes(df, "user", [F.col("at")], F.col("flag"), F.concat(F.lit("E"), "at"))
    assert {r["user"]: (r["ops"], r["failed_at"], r["error_code"]) for r in done.collect()} == {
        u: (len(own), *((sum(r[1] < first[u] for r in own), f"E{first[u]}") if first[u] < 1 << 60 else (None, None))) for u, own in by.items()
    }
    for out in (got, sticky, done):
        assert "Window" not in out._jdf.queryExecution().toString()
    value = telemetry.nearest_rank(df, "user", "at", {"p50": 0.5})
    assert {r["user"]: (r["n"], r["p50"]) for r in value.collect()} == {u: (len(own), sorted(r[1] for r in own)[int((len(own) - 1) * 0.5 + 0.5)]) for u, own in by.items()}


def test_sync_events(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 1, 30), (1, 2, 20), (4, 0, 40)], "leader_id long, followers_before long, next_lsn long")
    assert {tuple(r) for r in telemetry.sync_events(df, "next_lsn").collect()} == {(1, 2, 30), (4, 0, 40)}


def test_group_commit(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    data = [(1, i, start + dt.timedelta(seconds=s)) for i, s in enumerate([0, 10, 59, 60, 61, 62, 63, 64, 200])]
    df = spark.createDataFrame(data, "user_id long, event_id long, ts timestamp")
    want = {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 6, 8: 8}
    assert {r["event_id"]: r["leader_id"] for r in group_commit.commits(df, 60, 2).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = group_commit.stream_commits(
        spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 60, 2
    ).writeStream.format("memory").queryName("commits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["event_id"]: r["leader_id"] for r in spark.table("commits").collect()} == want


def test_syncs_of_a_stream(spark, tmp_path):
    """Commits close by count, by the next request and, without one, by the watermark."""
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    portions = [[(1, 0, 0), (1, 1, 10), (2, 2, 5)], [(1, 3, 70), (2, 4, 6), (2, 5, 7)], [(3, 6, 1000)], [(3, 7, 5000)]]
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(portions):
        spark.createDataFrame(
            [(u, e, start + dt.timedelta(seconds=s)) for u, e, s in rows], "user_id long, event_id long, ts timestamp"
        ).coalesce(1).write.parquet(str(tmp_path / "raw" / str(k)))
        next((tmp_path / "raw" / str(k)).glob("part*")).rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (k + 1, k + 1))
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
    q = group_commit.stream_syncs(stream, 60, 2).writeStream.format("memory").queryName("syncs").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "c")
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("syncs").collect()} == {(1, 0, 1), (2, 2, 2), (1, 3, 0), (3, 6, 0)}


def test_drain(spark, tmp_path):
    ops = [(b, k, "write" if k < 2 else "copy", f"p{k}", "p0" if b % 2 else "none", "d") for b in range(6) for k in range(3)]
    schema = "batch long, at long, kind string, path string, src string, data string"
    for k in range(3):
        spark.createDataFrame([r for r in ops if r[0] // 2 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second time nothing is queued
        dispatch.drain(stream, "batch", "at", str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        done = {r["batch"]: (r["ops"], r["failed_at"]) for r in spark.read.parquet(str(tmp_path / "out" / "outcomes")).collect()}
        assert done == {b: (3, None if b % 2 else 2) for b in range(6)}
    files_ = spark.read.parquet(str(tmp_path / "out" / "files"))
    assert files_.count() == 3 * 3 + 3 * 2 and files_.select("portion").distinct().count() == 3


def test_options(spark):
    o = options.Options(root="/data/", commit_window_us=10**9, commit_most=0, shards=100)
    assert (o.commit_window_us, o.commit_most, o.shards) == (100_000, 1, 64)
    for bad in ({"method": "journal"}, {"method": "spdk"}, {"mode": "x"}):
        with pytest.raises(ValueError):
            options.Options(**bad)
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(o.resolve(F.lit(p))) for p in ("a/./b", "a/../..", "", "/etc")] == ["/data/a/b", None, "/data", None]
    assert one(options.Options().resolve(F.lit("a//b"))) == "a/b"


@pytest.mark.parametrize(("window", "most", "block"), [(60, 2, 4), (60, 8, 16), (0.5, 3, 4), (1e6, 8, 16), (60, 0, 4)])
def test_group_commit_of_a_hot_user(spark, monkeypatch, window, most, block):
    import datetime as dt
    import random

    rng, start = random.Random(3), dt.datetime(2024, 1, 1)
    data = [(1 if k % 3 else rng.randint(2, 6), k, start + dt.timedelta(seconds=rng.randint(0, 20000) / 2)) for k in range(900)]
    df = spark.createDataFrame(data, "user_id long, event_id long, ts timestamp").repartition(3)
    want, open_ = set(), {}
    for user, event, ts in sorted(data, key=lambda x: (x[0], x[2], x[1])):
        lead, at, n = open_.get(user, (None, None, 0))
        new = lead is None or ts >= at + dt.timedelta(seconds=window) or n >= most
        open_[user] = (event, ts, 0) if new else (lead, at, n + 1)
        want.add((user, event, open_[user][0], open_[user][2]))
    monkeypatch.setattr(group_commit, "BLOCK", block, raising=False)
    out = group_commit.commits(df, window, most)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(data) and set(got) == want
    assert "InPandas" not in out._jdf.queryExecution().toString()  # no user is gathered in one frame
    assert group_commit.commits(df.limit(0), window, most).count() == 0


def test_words_and_sizes(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(fn.confine(F.lit("a/./b/../c"))) == "a/c" and one(fn.confine(F.lit("a/../.."))) is None and one(fn.confine(F.lit("/a"))) is None and one(fn.confine(F.lit("."))) == ""
    assert one(fn.mode_of(F.lit(" Debug "))) == "dev" and one(fn.mode_of(F.lit("RELEASE"))) == "prod" and one(fn.mode_of(F.lit("x"))) is None
    assert one(fn.kib(F.lit(" 12 kB"))) == 12288 and one(fn.kib(F.lit("x"))) == 0
    assert one(fn.field_of(F.lit("MemTotal:   77 kB"), "MemTotal")) == 77 and one(fn.field_of(F.lit("Other: 1"), "MemTotal")) is None
    assert one(fn.atomic_write_unit(F.lit(7), F.lit(512))) == 4096 and one(fn.atomic_write_unit(F.lit(2**31), F.lit(4096))) is None
    assert one(fn.escape_quoted(F.lit('a\\b"c\n\x01'))) == 'a\\\\b\\"c\\n'
    assert [one(fn.drive_kind(F.lit(d), F.lit(r))) for d, r in (("nvme0n1", 0), ("sda", 0), ("sda", 1), ("sda", 7))] == ["nvme", "ssd", "hdd", "unknown"]
    assert [one(fn.auto_method(F.lit("ssd"), F.lit(True), s)) for s in ("linux", "macos", "windows", "other")] == ["data", "sync", "direct", "sync"]
    assert len(fn.ERROR_CODES) == 23 and one(fn.error_name(F.lit("FS-00009"))) == "ShutdownInProgress" and one(fn.error_name(F.lit("?"))) is None


def test_apply_ops(spark):
    """A chain of copies, a copy after a delete, an empty batch's neighbour, and a source that is written again."""
    rows = [(1, 0, "write", "p0", None, "A")] + [(1, k, "copy", f"p{k}", f"p{k - 1}", None) for k in range(1, 20)] + [(1, 20, "write", "p0", None, "B")]
    rows += [(2, 0, "write", "a", None, "X"), (2, 1, "copy", "b", "a", None), (2, 2, "delete", "a", None, None), (2, 3, "copy", "c", "a", None), (2, 4, "write", "b", None, "late")]
    rows += [(3, 5, "copy", "a", "a", None), (4, 1, "write", "a", None, "1"), (4, 2, "copy", "a", "a", None), (4, 3, "delete", "z", None, None)]
    tree, done = batch.apply_ops(spark.createDataFrame(rows, "batch long, at long, kind string, path string, src string, data string"), "batch", "at")
    assert {(r["batch"], r["path"]): r["data"] for r in tree.collect()} == {**{(1, f"p{k}"): "A" for k in range(1, 20)}, (1, "p0"): "B", (2, "b"): "X", (4, "a"): "1"}
    assert {r["batch"]: (r["ops"], r["failed_at"], r["completed"]) for r in done.collect()} == {1: (21, None, 21), 2: (5, 3, 3), 3: (1, 0, 0), 4: (3, None, 3)}


def test_appends_and_trees(spark):
    old = spark.createDataFrame([("a", b"1"), ("b", b"2")], "path string, data binary")
    more = spark.createDataFrame([("a", 2, b"y"), ("a", 1, b"x"), ("c", 1, b"z")], "path string, k int, data binary")
    assert {r["path"]: bytes(r["data"]) for r in files.append_all(old, more, "path", "k", "data").collect()} == {"a": b"1xy", "b": b"2", "c": b"z"}
    tree = spark.createDataFrame([("a", False), ("a/b", False), ("a/f", True), ("e", False), ("ab", True)], "path string, is_file boolean")
    gone = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    left = lambda df: sorted(r["path"] for r in df.collect())
    assert left(namespace.remove_trees(tree, gone("a", "x"))) == ["ab", "e"]
    assert left(namespace.remove_empty(tree, gone("a", "a/b", "e", "ab", "x"), F.col("is_file"))) == ["a", "a/f", "ab"]
