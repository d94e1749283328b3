"""Aligned reading, versioned folders, batches that are written once, and the joint writer, on files and with failures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_jobs import files, pairs, parts

from weft.sources import aligned, bitext, tables


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("ab é") for _ in range(r.choice([0, 1, 5, 60]))) for _ in range(n)]


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_aligned_as_bitext(spark, tmp_path, block):
    n = 60 if block == 7 else 400
    root = files(tmp_path, {
        "en-hi/train.en": "\n".join(texts(1, n)) + "\n", "en-hi/train.hi": "\n".join(texts(2, n - 1) + ["no feed at the end"]),
        "en-ta/train.en": "", "en-ta/train.ta": "", "en-en/train.en": "x\n", "en-xx/train.en": "lone\n", "en-te/train.en": b"\xffa\r\n\n", "en-te/train.te": "y\nz",
    })
    got = aligned.read_aligned(spark, root, domain="d", block=block)
    want = bitext.read_bitext(spark, root, domain="d").filter("src_lang <> tgt_lang")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == n + 2
    if block == 64:
        assert got.rdd.getNumPartitions() > 20 and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_aligned_sides_of_different_lengths(spark, tmp_path):
    root = files(tmp_path, {"en-hi/train.en": "a\nb\nc\n", "en-hi/train.hi": "x\ny\n"})
    with pytest.raises(ValueError, match="differ in length: en-hi 3 2"):
        aligned.read_aligned(spark, root)
    assert aligned.read_aligned(spark, f"{root}/none").collect() == []


def test_places_of_lines():
    r = random.Random(3)
    for _ in range(60):
        data = b"".join(r.choice([b"\n", b"a", b"bc\n"]) for _ in range(r.randrange(30)))
        block = r.randrange(1, 9)
        cut = [data[i : i + block] for i in range(0, len(data), block)]
        places = aligned.Places([(k, x.count(b"\n"), x.endswith(b"\n")) for k, x in enumerate(cut)], block)
        lines = data.split(b"\n")[: None if data and not data.endswith(b"\n") else -1]
        assert places.lines == len(lines)
        seen = []
        for k in range(len(cut)):
            first, stop = places.begun(k)
            at, skip = places.find(first) if stop > first else (0, 0)
            seen += data[at:].split(b"\n")[skip : skip + stop - first] if stop > first else []
        assert seen == lines


@pytest.mark.parametrize("kept", [True, False])
def test_stream_of_growing_files(spark, tmp_path, kept):
    """Lines wait for their other side, and a stream that is started again goes on where it was."""
    root = files(tmp_path, {"in/en-hi/train.en": "a\nb\nhalf", "in/en-hi/train.hi": "x\n"})
    progress = f"{tmp_path}/progress" if kept else None
    schema = ", ".join(c for c in aligned.SCHEMA.split(", "))

    def run():
        stream = aligned.follow_aligned(spark, f"{root}/in", most=4, progress=progress)
        query = stream.writeStream.foreachBatch(tables.once(f"{root}/out")).option("checkpointLocation", f"{root}/check").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r["line_no"], r["src_text"], r["tgt_text"]) for r in tables.read_batches(spark, f"{root}/out", schema).collect())

    assert run() == [(0, "a", "x")]
    with open(tmp_path / "in/en-hi/train.en", "a") as f:
        f.write(" line\nmuch longer than a batch\n")
    with open(tmp_path / "in/en-hi/train.hi", "a") as f:
        f.write("y\nz\nw\nv\n")
    want = [(0, "a", "x"), (1, "b", "y"), (2, "half line", "z"), (3, "much longer than a batch", "w")]
    assert run() == want and run() == want


def test_replaced_tables(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, path)
    tables.write_table(spark.range(5), path)
    tables.write_table(tables.read_table(spark, path).filter("id > 1"), path)  # read and replaced in one job
    assert sorted(r[0] for r in tables.read_table(spark, path).collect()) == [2, 3, 4]
    held = tables.read_table(spark, path)
    bad = held.select(F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        tables.write_table(bad, path)
    assert sorted(r[0] for r in tables.read_table(spark, path).collect()) == [2, 3, 4] and len(list((tmp_path / "table").glob("v-*"))) == 2
    tables.write_table(spark.range(1), path)
    assert tables.read_table(spark, path).count() == 1 and held.count() == 3  # who is reading the version before may go on
    tables.write_table(spark.range(2), path)
    assert len(list((tmp_path / "table").glob("v-*"))) == 2


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    tables.write_table(spark.range(1), path)

    def slow(folder):
        spark.range(7).write.parquet(folder)
        tables.write_table(spark.range(3), path)  # another writer is faster

    with pytest.raises(tables.Conflict):
        tables.replace(spark, path, slow)
    assert tables.read_table(spark, path).count() == 3


def test_replaced_text(spark, tmp_path):
    own = pairs(spark, [(0, "en", "hi", "a", "x"), (1, "en", "hi", "b", "y")])
    at = tables.replace(spark, f"file://{tmp_path}/side", lambda folder: bitext.export_lines(own, folder, "src_text"))
    assert tables.current(spark, f"file://{tmp_path}/side") == at and parts(tmp_path / "side" / at.rsplit("/", 1)[1]) == ["a", "b"]


@pytest.mark.parametrize("fails", ["before", "after"])
def test_batches_once(spark, tmp_path, fails):
    """The job ends once before a batch is marked, or after that and before Spark has noted it; the batch is replayed."""
    spark.range(4).withColumn("k", F.col("id") % 2).write.partitionBy("k").parquet(f"{tmp_path}/in")
    path, state = f"file://{tmp_path}/out", {"fail": True}
    write = tables.once(path)

    def sink(batch, number):
        if number == 1 and state["fail"]:
            if fails == "before":
                batch.write.parquet(f"{path}/batch={number}")
            else:
                write(batch, number)
            raise RuntimeError("lost")
        write(batch, number)

    def run():
        asked = spark.readStream.schema("id long, k int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/k=*")
        query = asked.select("id").writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(90)

    with pytest.raises(Exception, match="lost"):
        run()
    assert tables.read_batches(spark, path, "id long").count() < 4 or fails == "after"
    state["fail"] = False
    run()
    got = tables.read_batches(spark, path, "id long").collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2, 3] and len({r["batch"] for r in got}) > 1


def test_joint_text_by_placement(spark, tmp_path):
    """The text of one global sort, from one shuffle of the rows."""
    rows = [(n, s, t, f"{s} {n}", None if n == 4 else f"{t} {n}") for s, t in (("hi", "en"), ("en", "ta"), ("en", "hi")) for n in random.Random(5).sample(range(100), 50)]
    own = pairs(spark, rows).repartition(5)
    bitext.write_joint(own, f"file://{tmp_path}/joint", block=16)
    bitext.write_joint(own, f"file://{tmp_path}/joint", block=16)  # over what is there
    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    for side, col in (("SRC", 3), ("TGT", 4)):
        assert parts(tmp_path / f"joint/train.{side}") == [r[col] or "" for r in order]
        sizes = [len(p.read_text().split("\n")) - 1 for p in sorted((tmp_path / f"joint/train.{side}").glob("part-*"))]
        assert len(sizes) > 12 and [int(p.name[5:25]) for p in sorted((tmp_path / f"joint/train.{side}").glob("part-*"))] == [sum(sizes[:i]) for i in range(len(sizes))]
    assert parts(tmp_path / "joint/train.metadata") == ["en\thi\t50", "en\tta\t50", "hi\ten\t50"] and not (tmp_path / "joint/train.parts").exists()
