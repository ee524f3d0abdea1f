"""Suffix dedup against every window of every text."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hazardspark.llm import induced_sort, suffix_dedup

SCHEMA = "doc_id long, text string, start string, key int"


def plain(texts, size):
    data = [(t or "").encode() for t in texts]
    many = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if many[d[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans, i = [], 0
        while i < len(d):
            if gone[i]:
                j = i
                while j < len(d) and gone[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        out.append((len(d), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def corpus(seed, size):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, line = text(size), text(size // 8 + 1)
    out = [None, "", "é", "a" * (size - 1), "a" * size, "a" * (size + 1), "ab" * size, text(30)]
    out += [text(rnd.randint(1, 40)) + shared[rnd.randint(0, 9) :] + text(rnd.randint(1, 40)) for _ in range(12)]
    out += [text(10) + line + text(10) + line for _ in range(30)]
    out += [out[-1], out[-1], shared, shared[: size // 2] + "é" + shared[size // 2 :], text(2000) + shared]
    return out


@pytest.mark.parametrize("size", [8, 21, 60])
@pytest.mark.parametrize("small", [False, True])
def test_every_window(spark, size, small, monkeypatch):
    if small:  # many flushes; hot anchors are parted; queues go to disk
        monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 3)
    texts = corpus(size, size)
    rows = [(i if i % 11 else None, t, "x", 1) for i, t in enumerate(texts)]
    rows[20] = (rows[21][0], rows[20][1], "x", 1)  # an id that is there twice
    rows += [rows[9]]  # a row that is there twice
    want = Counter((r[0], n, tuple(spans), kept) for r, (n, spans, kept) in zip(rows, plain([r[1] for r in rows], size), strict=True))
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), size).collect()
    assert Counter((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in got) == want


def test_empty_table(spark):
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_scratch_is_gone(tmp_path, monkeypatch):
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    with induced_sort.scratch() as path:
        assert path.startswith(str(tmp_path))
    assert not list(tmp_path.iterdir())


def test_digest(spark):
    got = suffix_dedup.digest(suffix_dedup.suffix_dedup(spark.createDataFrame([(1, "x" * 300, "", 0), (2, "y", "", 0)], SCHEMA))).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got] == [(300, 300, 1), (1, 0, 0)]
    assert got[0]["kept_sha256"] == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
