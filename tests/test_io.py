"""Adapters, the stage cache and the streaming forms."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoset.plans import stages
from chronoset.sources import adapters as A
from chronoset.streaming import events as E

NOTES = [(0.0, 1.0, 60), (1.5, 0.5, 61), (3.0, 2.0, 67), (8.0, 0.25, 72)]


def test_musicxml_round_trip(spark, tmp_path):
    (tmp_path / "a.musicxml").write_text(A.write_musicxml(NOTES, title="a < b"))
    rows = A.read_scores(spark, str(tmp_path)).collect()
    got = sorted((r.position, r.duration, r.pitch, r.tie_stop) for r in rows)
    assert got == [(0.0, 1.0, 60, False), (1.5, 0.5, 61, False), (3.0, 1.0, 67, False), (4.0, 1.0, 67, True), (8.0, 0.25, 72, False)]


def test_midi_round_trip(spark, tmp_path):
    (tmp_path / "a.mid").write_bytes(A.write_midi([(o, d, p, 90) for o, d, p in NOTES]))
    got = [(round(r.onset, 3), round(r.duration, 3), r.pitch) for r in A.read_midi(spark, str(tmp_path)).orderBy("onset").collect()]
    assert got == NOTES
    for broken in (b"not midi", b"", b"RIFF\x00\x00\x00\x00RMIDdata", A.write_midi([(0.0, 1.0, 60, 90)])[:24]):
        with pytest.raises(ValueError):
            A.parse_midi(broken)
    tempo = b"\x00\xff\x51\x03" + (1_000_000).to_bytes(3, "big") + b"\x00\x90\x3c\x40\x83\x60\x80\x3c\x00\x00\xff\x2f\x00"
    data = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 480) + b"MTrk" + struct.pack(">I", len(tempo)) + tempo
    assert [(n["onset"], n["duration"]) for n in A.parse_midi(data)] == [(0.0, 1.0)]


def test_wav(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setparams((2, 2, 8000, 0, "NONE", ""))
        w.writeframes((np.ones((2500, 2)) * 16384).astype("<i2").tobytes())
    got = A.read_wav(spark, str(tmp_path)).collect()
    assert [(r.window, r.rms, r.peak) for r in got] == [(0, 0.5, 0.5), (1, 0.5, 0.5)]


def test_pcm_at_another_rate():
    x = np.arange(1000) - 500
    got, rate = A.read_pcm(A.write_pcm(x, 8000), 2000)
    assert rate == 2000 and np.allclose(got, x.reshape(-1, 4).mean(axis=1) / 32768) and np.allclose(A.read_pcm(A.write_pcm(x, 8000))[0] * 32768, x)


SCORE = """<museScore><Score><Part/><Staff id="1"><Measure><voice>
<TimeSig><sigN>3</sigN><sigD>4</sigD></TimeSig>
<Chord><durationType>quarter</durationType><dots>1</dots><Note><pitch>60</pitch></Note><Note><pitch>64</pitch></Note></Chord>
<Chord><acciaccatura/><durationType>eighth</durationType><Note><pitch>71</pitch></Note></Chord>
<Rest><durationType>eighth</durationType></Rest>
<Chord><durationType>quarter</durationType><Note><pitch>67</pitch><Spanner type="Tie"><next/></Spanner></Note></Chord></voice></Measure>
<Measure><voice><Chord><durationType>quarter</durationType><Note><Spanner type="Tie"><prev/></Spanner><pitch>67</pitch></Note></Chord>
<Tuplet><normalNotes>2</normalNotes><actualNotes>3</actualNotes></Tuplet>
<Chord><durationType>eighth</durationType><Note><pitch>62</pitch></Note></Chord><Chord><durationType>eighth</durationType><Note><pitch>63</pitch></Note></Chord>
<Rest><durationType>eighth</durationType></Rest><endTuplet/></voice></Measure></Staff></Score></museScore>"""


def test_musescore(spark, tmp_path):
    import zipfile

    (tmp_path / "a.mscx").write_text(SCORE)
    with zipfile.ZipFile(tmp_path / "b.mscz", "w") as z:
        z.writestr("a.mscx", SCORE)
    rows = A.read_musescore(spark, str(tmp_path))
    want = [(0.0, 1.5, 60, False, False), (0.0, 1.5, 64, False, False), (1.5, 0.0, 71, False, True), (2.0, 1.0, 67, False, False), (3.0, 1.0, 67, True, False), (4.0, 0.333, 62, False, False), (4.333, 0.333, 63, False, False)]
    for name in ("a.mscx", "b.mscz"):
        got = sorted((round(r.position, 3), round(r.duration, 3), r.pitch, r.tie_stop, r.grace) for r in rows.where(F.col("path").endswith(name)).collect())
        assert got == want
    line = sorted((round(r.position, 3), round(r.duration, 3), r.pitch) for r in A.melody(rows.where(F.col("path").endswith(".mscx"))).collect())
    assert line == [(0.0, 1.5, 64), (2.0, 2.0, 67), (4.0, 0.333, 62), (4.333, 0.333, 63)]
    assert A.parse_musescore(b"<museScore/>") == []


def test_settings_and_inventory(spark, tmp_path):
    (tmp_path / "new.json").write_text('{"salt": "s",\n "dev": ["a", "b"]}')
    (tmp_path / "old.json").write_text('{"salt": "t", "test_share": 0.2}')
    kind = "salt string, test_share double, dev array<string>"
    assert [tuple(r) for r in A.read_json(spark, str(tmp_path / "new.json"), kind).collect()] == [("s", None, ["a", "b"])]
    assert [tuple(r) for r in A.read_json(spark, str(tmp_path / "new.json"), kind, str(tmp_path / "old.json")).collect()] == [("s", 0.2, ["a", "b"])]
    for folder, size in (("x", 10), ("x/y", 5), ("z", 7)):
        (tmp_path / "f" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / folder / "a.bin").write_bytes(b"0" * size)
    assert sorted(tuple(r) for r in A.inventory(spark, str(tmp_path / "f")).collect()) == [("x", 2, 15), ("z", 1, 7)]


def test_stage_cache(spark, tmp_path):
    ran = []

    def add(df, n):
        ran.append(n)
        return df.withColumn("x", F.col("x") + n)

    source = spark.range(10).select(F.col("id").alias("x"))
    todo = [("a", add, {"n": 1}), ("b", add, {"n": 2})]
    out, log = stages.run(spark, source, todo, str(tmp_path))
    assert sorted(r.x for r in out.collect()) == list(range(3, 13)) and [hit for *_, hit in log] == [False, False]
    out, log = stages.run(spark, source.repartition(5), todo, str(tmp_path))
    assert ran == [1, 2] and [hit for *_, hit in log] == [True, True] and out.count() == 10
    _, log = stages.run(spark, source, [todo[0], ("b", add, {"n": 5})], str(tmp_path))
    assert [hit for *_, hit in log] == [True, False] and ran == [1, 2, 5]
    assert stages.stage_key("k", "s", {"b": 1, "a": 2}) == stages.stage_key("k", "s", {"a": 2, "b": 1})


def _stream(spark, tmp_path, make, mode):
    rows = [(i % 3, float(i), i) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, v double, s long").select("k", "v", F.timestamp_seconds(F.lit(1704067200) + F.col("s") * F.when(F.col("k") == 2, 7).otherwise(3)).alias("ts"))
    df.coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    q = make(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("out").outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df, spark.sql("select * from out").collect()


def test_tumbling_stream_equals_batch(spark, tmp_path):
    df, got = _stream(spark, tmp_path, lambda s: E.tumbling(s, "ts", ["k"], "v", "30 seconds", "10 seconds"), "complete")
    want = df.groupBy(F.window("ts", "30 seconds"), "k").agg(F.count("*").alias("n"), F.avg("v").alias("mean")).select("k", "window.start", "n", "mean").collect()
    assert sorted((r.k, r.start, r.n, r.mean) for r in got) == sorted((r.k, r.start, r.n, r.mean) for r in want)


def test_anchored_stream(spark, tmp_path):
    df, got = _stream(spark, tmp_path, lambda s: E.anchored(s, "ts", "k", 20.0, "5 seconds"), "append")
    by = {}
    for r in df.orderBy("ts").collect():
        c = by.setdefault(r.k, [])
        if not c or (r.ts - c[-1][0]).total_seconds() > 20:
            c.append([r.ts, 0])
        c[-1][1] += 1
    for k, clusters in by.items():
        own = sorted((r["first"], r.n) for r in got if r.k == k)
        assert own and all(tuple(c) in {(a, n) for a, n in clusters} for c in own)


def test_sessions_stream_equals_batch(spark, tmp_path):
    df, got = _stream(spark, tmp_path, lambda s: E.sessions(s, "ts", ["k"], "10 seconds", "5 seconds"), "append")
    want = df.groupBy(F.session_window("ts", "10 seconds"), "k").count().select("k", "session_window.start", "session_window.end", "count").collect()
    assert got and {tuple(r) for r in got} <= {tuple(r) for r in want}


def test_anchored_stream_of_rows_out_of_order(spark, tmp_path):
    """Files whose rows overlap in time by less than the watermark's delay give the clusters of the sorted rows."""
    import random

    r = random.Random(4)
    times = sorted(r.randrange(0, 600) for _ in range(150))
    rows = [(i % 2, t) for i, t in enumerate(times)]
    kind = "k long, s long"
    for f in range(6):
        part = [x for x in rows if 100 * f <= x[1] + r.randrange(-20, 20) < 100 * (f + 1) or (f == 0 and x[1] < 20) or (f == 5 and x[1] >= 580)]
        (tmp_path / "in").mkdir(exist_ok=True)
        rows = [x for x in rows if x not in part] if f < 5 else rows
        r.shuffle(part)
        spark.createDataFrame(part, kind).select("k", F.timestamp_seconds(F.lit(1704067200) + F.col("s")).alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{f}"))
    every = spark.read.parquet(str(tmp_path / "in" / "f*"))
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = E.anchored(stream, "ts", "k", 15.0, "120 seconds").writeStream.format("memory").queryName("ordered").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [tuple(x) for x in spark.sql("select * from ordered").collect()]
    want = set()
    for k in (0, 1):
        first, n = None, 0
        for t in sorted(x.ts for x in every.where(f"k = {k}").collect()):
            if first is None or (t - first).total_seconds() > 15:
                if first is not None:
                    want.add((k, first, n))
                first, n = t, 0
            n += 1
    assert len(got) == len(set(got)) > 20 and set(got) <= want


def midi(*tracks, division=480, declared=None):
    chunks = b"".join(tag + struct.pack(">I", len(body)) + body for tag, body in tracks)
    return b"MThd" + struct.pack(">IHHH", 6, 1, declared or sum(tag == b"MTrk" for tag, _ in tracks), division) + chunks


def spans(content, **how):
    return [(round(n["onset"], 6), round(n["duration"], 6), n["pitch"]) for n in A.parse_midi(content, **how)]


END = b"\x00\xff\x2f\x00"


def test_midi_notes_that_are_not_ended():
    """They end with their own track, at its end mark or where its bytes stop."""
    body = b"\x00\x90\x3c\x50\x83\x60\x3e\x50"  # a second note at tick 480, by running status
    assert spans(midi((b"MTrk", body + b"\x83\x60\xff\x2f\x00"))) == [(0.0, 1.0, 60), (0.5, 0.5, 62)]
    assert spans(midi((b"MTrk", body))) == [(0.0, 0.5, 60), (0.5, 0.0, 62)]
    longer = b"\x00\x91\x40\x50\x8f\x00\x81\x40\x00" + END
    assert spans(midi((b"MTrk", body + END), (b"MTrk", longer))) == [(0.0, 0.5, 60), (0.0, 2.0, 64), (0.5, 0.0, 62)]


def test_midi_wrapped_and_with_other_chunks():
    track = b"\x00\x90\x3c\x50\x83\x60\x80\x3c\x00" + END
    plain = midi((b"MTrk", track))
    assert spans(b"RIFF" + struct.pack("<I", len(plain) + 12) + b"RMIDdata" + struct.pack("<I", len(plain)) + plain) == [(0.0, 0.5, 60)]
    assert spans(midi((b"XFIH", b"anything"), (b"MTrk", track), (b"junk", b""), (b"MTrk", track), declared=2)) == [(0.0, 0.5, 60)] * 2


def test_midi_frames_a_second():
    track = b"\x00\xff\x51\x03\x0f\x42\x40\x00\x90\x3c\x50\x83\x60\x80\x3c\x00" + END  # the tempo says nothing here
    assert spans(midi((b"MTrk", track), division=((256 - 25) << 8) | 40)) == [(0.0, 0.48, 60)]


def test_midi_tempo_status_and_drums():
    tempo = b"\x83\x60\xff\x51\x03\x0f\x42\x40" + END  # from tick 480 on, a second a quarter
    track = b"\x00\x90\x3c\x50\x00\xff\x01\x01x\x83\x60\x3c\x00\x00\xf0\x01\xf7\x00\x90\x3c\x50\x00\xc0\x05\x83\x60\x90\x3c\x00\x00\x99\x24\x50\x10\x89\x24\x00" + END
    assert spans(midi((b"MTrk", tempo), (b"MTrk", track))) == [(0.0, 0.5, 60), (0.5, 1.0, 60)]
    assert len(spans(midi((b"MTrk", tempo), (b"MTrk", track)), drums=True)) == 3
    twice = b"\x00\x90\x3c\x50\x83\x60\x90\x3c\x50\x83\x60\x80\x3c\x00\x83\x60\x80\x3c\x00" + END  # struck again before it ends
    assert spans(midi((b"MTrk", twice))) == [(0.0, 1.0, 60), (0.5, 1.0, 60)]
    with pytest.raises(ValueError):
        A.parse_midi(midi((b"MTrk", b"\x00\x3c\x50" + END)))


def test_shortest_notes_keep_a_tick():
    assert spans(A.write_midi([(1.0, 0.0, 60, 90)])) == [(1.0, round(1 / 960, 6), 60)]
    (n,) = A.parse_musicxml(A.write_musicxml([(1.0, 0.0, 60)]).encode())
    assert n["position"] == 1.0 and n["duration"] == 1 / 480
