"""FASTQ files in splits of any size."""

import gzip
import random

import pytest

from cladespark.sources import files


def text_of(seed, n, broken=None):
    rng, out, want = random.Random(seed), [], []
    for k in range(n):
        size = rng.choice([0, 1, 5, 40, 200])
        seq = "".join(rng.choice("ACGTN") for _ in range(size))
        quality = "".join(rng.choice("@@+!I~") for _ in range(size - (k == broken)))
        end = rng.choice(["\n", "\r\n"])
        out.append(end.join([f"@r{k} some words", seq, rng.choice(["+", f"+r{k}"]), quality]) + end)
        if broken is None or k < broken:
            want.append((f"r{k}", seq))
    return "".join(out), want


@pytest.mark.parametrize("size", [100, 700, 1 << 20])
def test_fastq_in_splits(spark, tmp_path, size):
    """Equal records for every size of split, also where lines of qualities begin with @ or +, and after a broken record none of its file."""
    texts = {"a": text_of(1, 25), "b": text_of(2, 20), "c": text_of(3, 20, broken=13), "d": ("", [])}
    (tmp_path / "in").mkdir()
    for name, (text, _) in texts.items():
        (tmp_path / "in" / f"{name}.fq").write_bytes(text.encode())
    zipped = text_of(4, 30)
    (tmp_path / "in" / "e.fq.gz").write_bytes(gzip.compress(zipped[0].encode()))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = files.read_fastq(spark, str(tmp_path / "in")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = {}
    for r in sorted(rows, key=lambda r: (r.path, r.ord)):
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.name, r.seq))
    assert got == {"a.fq": texts["a"][1], "b.fq": texts["b"][1], "c.fq": texts["c"][1], "e.fq.gz": zipped[1]}
    assert len({(r.path, r.ord) for r in rows}) == len(rows)


def test_fastq_of_several_lines(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@q1 x\nAC\nGT\n+\n@I\nII\n@q2\nAC\n+\nII\n")
    assert [(r.name, r.seq) for r in files.read_fastq(spark, str(tmp_path), several_lines=True).orderBy("ord").collect()] == [("q1", "ACGT"), ("q2", "AC")]
