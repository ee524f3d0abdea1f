"""Collocations against counting every phrase."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hazardspark.llm import collocations as col

SCHEMA = "doc_id long, text string, lang string, key string, phrase int"


def plain(rows, least, longest, top):
    f = defaultdict(Counter)
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = set()
    for lang, own in f.items():
        n = sum(v for p, v in own.items() if len(p) == 1)
        cand = {p: v for p, v in own.items() if len(p) > 1 and v >= least}
        inside = {q[i:j] for q, v in cand.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and cand[q[i:j]] <= v}
        found = []
        for p, a in cand.items():
            if p not in inside:
                score, _, left, right = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out |= {(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)}
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = ["A", "b", "Cé", "d", "éE", "f", "\x0cg"]
    line = "one Two three four five six"
    out = [None, "", " \t ", ".,;", "Z", "a b" * 400]
    for _ in range(60):
        own = rnd.choices(words, weights=[9, 7, 5, 3, 2, 1, 1], k=rnd.randint(0, 60))
        text = "".join(w + rnd.choice([" ", " ", " ", "\t ", ", ", ".", "\n"]) for w in own)
        out.append(text + rnd.choice(["", line, line + " " + line]))
    rows = [(i, t, rnd.choice(["en", "en", "fr", None])) for i, t in enumerate(out)]
    return [*rows, rows[-1], rows[-1], (None, line, "en"), (None, line, "en")]


@pytest.mark.parametrize(("least", "longest", "shards", "small"), [(5, 5, 4, False), (9, 3, 2, True), (20, 5, 1, False), (2, 4, 3, False)])
def test_every_phrase(spark, least, longest, shards, small, monkeypatch):
    rows = corpus(least)
    top = 15
    if small:  # lists in several parts, many flushes
        monkeypatch.setattr(col, "LIST", 40)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    if small:
        monkeypatch.setattr(col, "FLUSH", 50)
    got = col.collocations(df, least, longest, top, shards).collect()
    assert {tuple(r) for r in got} == plain(rows, least, longest, top)
    assert len(got) == len({tuple(r) for r in got})


def test_empty_table_and_no_candidate(spark):
    assert col.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert col.collocations(spark.createDataFrame([(1, "a b", "en", "", 0)], SCHEMA)).collect() == []


def test_types(spark):
    df = spark.createDataFrame([(i, "a b c", "en", "", 0) for i in range(5)], SCHEMA)
    got = col.collocations(df, least=2, shards=2)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((x, "bigint") for x in ("a", "l", "r", "n", "score"))]
    assert [tuple(r) for r in got.orderBy(F.col("rank")).collect()] == [("en", 1, "a b c", 5, 5, 5, 15, 3000)]
