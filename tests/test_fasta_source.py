"""FASTA as a data source: any split size, both dialects, and what commit and abort leave."""

import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.sources import fasta, fasta_source


@pytest.fixture
def source(spark):
    spark.dataSource.register(fasta_source.FastaSource)
    return spark


def rows_of(df):
    return sorted((r["header"], r["bases"]) for r in df.collect())


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_any_split_gives_the_same_rows(source, tmp_path, monkeypatch, split):
    monkeypatch.setattr(fasta_source, "CHUNK", 16)
    r = random.Random(1)
    want = [(f"r{i} LN:i:{i} a>b", "".join(r.choices("ACGT", k=r.randrange(0, 90))) or None) for i in range(12)]
    text = "\n\r\n" + "".join(f">{h}\r\n" + (f"{b}\n" if b else "") + "\n" * r.randrange(3) for h, b in want)
    path = tmp_path / "a.fasta"
    path.write_bytes(text.encode())
    with open(path, "rb") as stream:
        size = len(text.encode())
        got = [fasta_source._split(x) for at in range(0, size, split) for x in fasta_source._records(stream, at, min(at + split, size))]
    assert got == want
    if split >= 64:
        assert rows_of(source.read.format("fasta").option("split", split).load(str(path))) == sorted(want, key=lambda x: (x[0], x[1] or ""))
        assert rows_of(fasta.read_records(source, str(path))) == sorted(want, key=lambda x: (x[0], x[1] or ""))


def test_long_records_odd_lines_and_empty_files(source, tmp_path):
    (tmp_path / "long.fasta").write_text(">long\nACGT\n" + "G" * 3_000_000 + "\n>last\n" + "T" * 5)
    (tmp_path / "empty.fasta").write_text("")
    (tmp_path / "_hidden").write_text(">x\nA\n")
    found = source.read.format("fasta").option("split", 100_000).load(f"file:{tmp_path}")
    assert rows_of(found) == [("last", "TTTTT"), ("long", "G" * 3_000_000)]
    assert found.select("file").first()["file"].endswith("long.fasta")
    (tmp_path / "bad.fasta").write_text("text\n>x\nA\n")
    with pytest.raises(Exception, match="before the first record"):
        source.read.format("fasta").load(str(tmp_path / "bad.fasta")).collect()
    assert source.read.format("fasta").load(str(tmp_path / "empty.fasta")).count() == 0


def test_dialects_are_those_of_the_columns(source, tmp_path):
    path = tmp_path / "g.fasta"
    for dialect, extra in (("bcalm", " KC:i:1 km:f:1.0"), ("ggcat", "")):
        path.write_text(f">0 LN:i:9{extra} L:+:1:+ L:-:2:-\nACGTACGTA\n>1 LN:i:5{extra}\nACGTA\n")
        want = fasta.parse(fasta.read_records(source, str(path)), 5, dialect).select("unitig", "length", "links", "bases").collect()
        got = source.read.format("fasta").option("dialect", dialect).option("k", 5).load(str(path)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got[0]["links"] == ["L:+:1:+", "L:-:2:-"]
    for options in ({"dialect": "other", "k": "5"}, {"dialect": "bcalm"}, {"split": "0"}):
        with pytest.raises(Exception, match="dialect|split"):
            source.read.format("fasta").options(**options).load(str(path)).collect()


def test_parts_appear_when_all_are_whole(source, tmp_path):
    path = str(tmp_path / "out")
    df = source.range(0, 100, 1, 4).select(F.concat(F.lit("s"), "id").alias("header"), F.when(F.col("id") != 7, "ACGT").alias("bases"), F.lit(1).alias("more"))
    df.write.format("fasta").mode("append").save(path)
    read = source.read.format("fasta").load(path)
    assert read.count() == 100 and read.where("bases is null").select("header").collect() == [("s7",)]
    before = sorted(os.listdir(path))
    assert len(before) == 5 and "_SUCCESS" in before
    broken = df.withColumn("header", F.when(F.col("header") != "s60", F.col("header")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="not a header"):
            broken.write.format("fasta").mode(mode).save(path)
        assert sorted(os.listdir(path)) == before
    df.limit(3).write.format("fasta").mode("append").save(path)
    assert source.read.format("fasta").load(path).count() == 103
    df.limit(3).write.format("fasta").mode("overwrite").save(path)
    assert source.read.format("fasta").load(path).count() == 3
    with pytest.raises(Exception, match="no such columns"):
        df.drop("bases").write.format("fasta").mode("append").save(path)
