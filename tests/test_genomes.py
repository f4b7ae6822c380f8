"""Chunked genomes, splittable scans: equal to plain Python whatever the borders."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import fragments as fr
from helixframe.operators.ordering import prefix_sums
from helixframe.sources import ranges, readers


def plain_windows(seq, window, stride, skip):
    out = []
    for s in range(0, len(seq) - window + 1, stride):
        w = seq[s : s + window]
        if set(w) - set("ACGT"):
            assert skip
            continue
        out.append((len(out), s, s + window, w))
    return out


def dna(r, n, odd=0.0):
    return "".join(r.choice("NRé") if r.random() < odd else r.choice("ACGT") for _ in range(n))


@pytest.mark.parametrize("window,stride,cell", [(1, 1, 7), (5, 3, 4), (16, 8, 50), (40, 64, 64), (33, 32, 32)])
@pytest.mark.parametrize("skip", [False, True])
def test_windows_equal_plain(spark, window, stride, cell, skip):
    r = random.Random(window * 100 + stride)
    genomes = {name: dna(r, n, 0.01 if skip else 0) for name, n in (("a", 500), ("b", window), ("c", window - 1), ("d", 0), (None, 333), ("e", cell * 4), ("f", cell * 4 + window - 1))}
    df = spark.createDataFrame(list(genomes.items()), "genome string, sequence string")
    whole = fr.fragment(df, window, stride, skip_ambiguous=skip, cell=cell)
    chunks = []
    for name, seq in genomes.items():
        at = 0
        while at < len(seq):
            n = r.choice([1, 2, 3, 10, 60])
            chunks.append((name, at, seq[at : at + n].lower()))
            at += n
    r.shuffle(chunks)
    parts = fr.fragment_chunks(spark.createDataFrame(chunks, "genome string, offset bigint, sequence string").repartition(5), window, stride, skip_ambiguous=skip, cell=cell)
    even = fr.fragment_chunks(fr.chunked(df, 9), window, stride, skip_ambiguous=skip, cell=cell)
    want = sorted((str(name), *w) for name, seq in genomes.items() for w in plain_windows(seq, window, stride, skip))
    for got in (whole, parts, even):
        assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want, (window, stride, cell)
    assert whole.schema == parts.schema


def test_windows_raise_and_check(spark):
    bad = spark.createDataFrame([("a", "ACGTACGTN")], "genome string, sequence string")
    for f in (lambda **k: fr.fragment(bad, 4, 4, **k), lambda **k: fr.fragment_chunks(fr.chunked(bad, 2), 4, 4, **k)):
        for cell in (4, 100):
            with pytest.raises(Exception, match="unsupported"):
                f(cell=cell).collect()
            assert f(cell=cell, skip_ambiguous=True).count() == 2
    short = spark.createDataFrame([("a", "ACN")], "genome string, sequence string")
    assert fr.fragment(short, 4, 4).count() == 0 and fr.fragment_chunks(fr.chunked(short, 2), 4, 4).count() == 0
    with pytest.raises(ValueError):
        fr.fragment(bad, 0, 1)


def test_a_text_is_cleaned_once(spark):
    """A whole genome is cleaned in one place of the plan and never shuffled; of chunks only counts move besides the cells, and once."""
    df = spark.createDataFrame([("a", "ACGTN" * 100)], "genome string, sequence string").repartition(2)
    plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
    whole = plan(fr.fragment(df, 16, 8, skip_ambiguous=True, cell=50))
    assert whole.count("[^ACGTN]") == 1 and whole.count("Exchange") == 1 and "Join" not in whole
    assert plan(fr.fragment(df, 16, 8)).count("[^ACGTN]") == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = plan(fr.fragment_chunks(fr.chunked(df, 9), 16, 8, skip_ambiguous=True, cell=50))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin [g#" in parts  # by the keys of the cells as they are
    assert "substring" not in fr.fragment(df, 16, 8).select("start", "end")._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[0]


def test_no_task_holds_a_genome(spark):
    """Of a genome of 3,000,000 bases in chunks no shuffled group, and so no task, has more than a cell and its halo."""
    chunks = spark.range(300).select(F.lit("g").alias("genome"), (F.col("id") * 10_000).alias("offset"), F.repeat(F.lit("ACGTTGCAAC"), F.lit(1000)).alias("sequence"))
    out = fr.fragment_chunks(chunks, 128, 32, cell=20_000)
    assert out.count() == (3_000_000 - 128) // 32 + 1
    assert out.filter(F.substring(F.repeat(F.lit("ACGTTGCAAC"), F.lit(20)), (F.col("start") % 10 + 1).cast("int"), F.lit(128)) != F.col("sequence")).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "cell" in plan.split("hashpartitioning(")[1].split(")")[0]


def test_prefix_sums(spark):
    r = random.Random(3)
    rows = [(g, i, r.randint(0, 9)) for g in ("a", None) for i in range(50)]
    got = prefix_sums(spark.createDataFrame(rows, "g string, i bigint, v bigint"), ["g"], "i", "v", "s", F.expr("i div 7"))
    have = {(x["g"], x["i"]): x["s"] for x in got.collect()}
    assert have == {(g, i): sum(v for h, j, v in rows if h == g and j < i) for g, i, _ in rows}


def plain_pairs(text):
    t = text.split()
    return [(a, b) for a, b in zip(t[0::2], t[1::2])]


@pytest.fixture
def here(monkeypatch):
    """Scans in this process, so that small reads and chunks hold: a list of rows in place of a DataFrame."""
    monkeypatch.setattr(ranges, "READ_BYTES", 8)
    monkeypatch.setattr(ranges, "CHUNK_BASES", 10)
    monkeypatch.setattr(ranges, "_counted", lambda s, kind, parts: [ranges._COUNT[kind](r) for r in parts])
    monkeypatch.setattr(ranges, "_load", lambda s, kind, parts, count: [row for r in parts for b in ranges._ROWS[kind](r) for row in zip(*b.to_pydict().values())])


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10**6])
def test_pair_scan_over_borders(here, tmp_path, size):
    for seed in range(25):
        r = random.Random(seed)
        texts = ["".join(dna(r, r.choice([1, 2, 5, 30])) + r.choice([" ", "\n", "\t", "  \r\n", "\n\n"]) for _ in range(n)) for n in (r.randint(0, 15), 0, 1, 4)]
        texts += ["\n \n", "AC", dna(r, 20) + " " + dna(r, 3)]
        folder = tmp_path / str(seed)
        folder.mkdir()
        (folder / "_SUCCESS").write_text("no data")
        for i, t in enumerate(texts):
            (folder / f"part-{i}").write_bytes(t.encode())
        want = [p for t in texts for p in plain_pairs(t)]
        assert sorted(ranges.scan_pairs(None, str(folder), range_bytes=size)) == [(i, a, b) for i, (a, b) in enumerate(want)]
        lines = [ln.split() for t in texts for ln in (t[:-1] if t.endswith("\n") else t).split("\n") if t]
        assert sorted(ranges.scan_pairs(None, str(folder), by_line=True, range_bytes=size)) == [(i, (p or [""])[0], p[1] if len(p) > 1 else None) for i, p in enumerate(lines)]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17, 10**6])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_fasta_scan_over_borders(here, tmp_path, size, end):
    for seed in range(25):
        r = random.Random(seed)
        lines, want = [], []
        for i in range(4):
            name, seq = f"genome {i} é", dna(r, r.choice([0, 5, 60]), 0.05).lower()
            lines += [" >" + name + " ", *[" " + seq[j : j + 13] + r.choice(["", "\t"]) for j in range(0, len(seq), 13)], ""]
            want.append((name, "".join("N" if c == "é" else c.upper() for c in seq)))
        p = tmp_path / "g.fa"
        p.write_bytes(end.join(lines).encode())
        got = {}
        for record, genome, offset, text in sorted(ranges.scan_fasta(None, str(p), single=False, range_bytes=size), key=lambda x: (x[0], x[2], len(x[3]))):
            assert len(text) <= 10 and offset == len(got.setdefault((record, genome), ""))
            got[record, genome] += text
        assert [(n, s) for (_, n), s in got.items()] == want and [k for k, _ in got] == list(range(4))


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_single_fasta_rules(here, tmp_path, size):
    p = tmp_path / "g.fa"
    for text in (">a\nAC\n>b\nGT\n", "AC\n>a\nGT\n", ">\nAC\n", ">a\n", "", "\n\n", ">a\nAC\n>\nGT", ">a\nAC\n>\n"):
        p.write_text(text)
        with pytest.raises(ValueError, match="FASTA"):
            ranges.scan_fasta(None, str(p), range_bytes=size)
    for text in (">a\nAC\nGT\n", "\n  >a \nACGT", ">\n>a\nAC\nGT"):
        p.write_text(text)
        got = sorted(x for x in ranges.scan_fasta(None, str(p), range_bytes=size) if x[3])
        assert "".join(x[3] for x in got) == "ACGT" and {x[1] for x in got} == {"a"}


def test_scans_in_many_tasks(spark, tmp_path):
    r = random.Random(1)
    p = tmp_path / "p.txt"
    p.write_text("".join(dna(r, 40) + r.choice(" \n") for _ in range(2001)))
    df = readers.scan_pairs(spark, str(p), range_bytes=5000)
    assert df.rdd.getNumPartitions() == 17 and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(x)[1:] for x in df.orderBy("pair_id").collect()] == plain_pairs(p.read_text())
    g = dna(r, 50_000)
    (tmp_path / "g.fa").write_text(">one line\n" + g)
    chunks = readers.scan_fasta(spark, str(tmp_path / "g.fa"), range_bytes=7000)
    assert chunks.rdd.getNumPartitions() == 8
    got = fr.fragment_chunks(chunks, 128, 32, cell=999).orderBy("fragment_id").collect()
    assert [tuple(x)[1:] for x in got] == plain_windows(g, 128, 32, False)
    with pytest.raises(FileNotFoundError):
        readers.read_pairs(spark, str(tmp_path / "none"))
