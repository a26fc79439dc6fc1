import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.functions.paths import base_name
from tallyforge.llm import neardup as N

SCHEMA = "finding_id bigint, summary string, file string, ingested_at int, id string, content string, text string, n int"


def found(spark, rows, t=0.6):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash", 1) for r in rows], SCHEMA)
    out = N.near_duplicates(df, "finding_id", F.col("summary"), base_name(F.col("file")), F.col("ingested_at"), t)
    got = [(r.id_a, r.id_b) for r in out.collect()]
    assert len(got) == len(set(got))
    return sorted(got)


def brute(rows, t=0.6):
    last = {}
    for i, s, f, at in rows:
        if i not in last or at > last[i][0]:
            last[i] = (at, s, f)
    recs = [(i, re.split(r"[/\\]", f)[-1], set(re.findall("[a-z0-9]+", s.lower()))) for i, (_, s, f) in last.items() if s is not None and f is not None]
    return sorted((min(a, b), max(a, b)) for k, (a, fa, wa) in enumerate(recs) for b, fb, wb in recs[:k] if fa == fb and wa and wb and len(wa & wb) >= t * len(wa | wb) - 1e-9)


def test_words_match_regex():
    texts = ["", "a", "Über 3x_y-z", "İstanbul KELVIN Kelvin", "x" * 5000 + " y", "a" * 3 + "\x00b", None, "same same", "end"]
    rec, h = N.word_hashes(pa.array(texts, pa.string()))
    counts = [len(re.findall("[a-z0-9]+", (t or "").lower())) for t in texts]
    assert np.bincount(rec, minlength=len(texts)).tolist() == counts
    by = {}
    for i, t in enumerate(texts):
        for w, x in zip(re.findall("[a-z0-9]+", (t or "").lower()), h[rec == i], strict=True):
            assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


@pytest.mark.parametrize(("seed", "vocabulary"), [(0, 12), (1, 40), (2, 400)])
def test_random_against_brute_force(spark, seed, vocabulary, monkeypatch):
    # small thresholds bring the longer keys into play
    monkeypatch.setattr(N, "COMMON", 4)
    monkeypatch.setattr(N, "VERY_COMMON", 12)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for i in range(220):
        if rows and rng.random() < 0.5:
            base = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(base) + 1)
                base[k : k + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            rng.shuffle(base)
        else:
            base = rng.choices(words, k=rng.randint(1, 14))
        rows.append((i, " ".join(base), f"{rng.choice(['a', 'b/c', 'd\\e'])}/{rng.choice(['index.ts', 'x.py'])}", 0))
    want = brute(rows)
    assert len(want) > 50
    assert found(spark, rows) == want


def test_prefixes_lose_nothing(monkeypatch):
    """Any two sets that are similar enough share a key, whatever the counts say."""
    monkeypatch.setattr(N, "COMMON", 3)
    monkeypatch.setattr(N, "VERY_COMMON", 6)
    rng = np.random.default_rng(3)
    for _ in range(300):
        both = rng.choice(1000, rng.integers(1, 12), replace=False)
        only = 1000 + rng.choice(1000, rng.integers(0, 9), replace=False)
        cut = rng.integers(0, len(only) + 1)
        a, b = np.r_[both, only[:cut]], np.r_[both, only[cut:]]
        if len(both) < 0.6 * (len(both) + len(only)):
            continue
        rec = np.r_[np.zeros(len(a), np.int64), np.ones(len(b), np.int64)]
        code = np.r_[a, b].astype(np.uint32)
        count = (code.astype(np.int64) * 2654435761 >> 7) % 10
        r, key = N._keys(rec, code, count, np.array([len(a), len(b)]), 0.6)
        assert set(key[r == 0]) & set(key[r == 1])


def test_edge_rows(spark):
    rows = [
        (1, "Alpha beta gamma delta", "src/x.ts", 0),
        (1, "Alpha beta gamma delta", "src/x.ts", 0),  # repeated row
        (2, "delta, ALPHA; beta gamma!", "y\\x.ts", 0),  # reordered
        (3, None, "x.ts", 0),
        (4, "alpha beta gamma delta", None, 0),
        (5, "", "x.ts", 0),
        (6, "--- ...", "x.ts", 0),
        (7, "--- ...", "x.ts", 0),
        (8, "alpha beta gamma delta", "z.ts", 0),  # another file
        (9, "alpha beta gamma delta", "x.ts", 0),
        (9, "something else entirely now", "x.ts", 5),  # loaded again with other content
        (10, "one", "w.ts", 0),
        (11, "ONE one", "w.ts", 0),
    ]
    assert found(spark, rows) == brute(rows) == [(1, 2), (10, 11)]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_long_and_equal_texts(spark):
    long = " ".join(f"t{i}" for i in range(20_000))
    rows = [(i, long + f" extra{i}", "a.ts", 0) for i in range(3)] + [(10 + i, "the same short text", "b.ts", 0) for i in range(60)]
    assert found(spark, rows) == sorted([(0, 1), (0, 2), (1, 2)] + [(10 + i, 10 + j) for j in range(60) for i in range(j)])


def mixed(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(15)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(3, 8))), "a/x.ts", 0) for i in range(n)]
    return rows + [(n + i, rows[0][1], "b/x.ts", 0) for i in range(40)] + [(3, "loaded again with other words", "a/x.ts", 1)]


@pytest.mark.parametrize("bound", [3, 20])
def test_long_lists_in_chunks(spark, bound, monkeypatch):
    monkeypatch.setattr(N, "LONG_LIST", bound)
    assert found(spark, mixed(5)) == brute(mixed(5))


def test_classes_have_all_pairs(spark):
    rows = mixed(6)
    df = spark.createDataFrame([(*r, "clash", "clash", "clash", 1) for r in rows], SCHEMA)
    got = N.classes(df, "finding_id", F.col("summary"), base_name(F.col("file")), F.col("ingested_at"), 0.6).collect()
    pairs = brute(rows)
    text = {i: s for i, s, _, at in sorted(rows, key=lambda r: r[3])}
    assert sorted(r.id for r in got) == sorted({r[0] for r in rows})
    for r in got:
        own = [i for i in text if text[i] == text[r.id]]
        assert (r.class_id, r.copies) == (min(own), len(own))
        others = {text[b if a == r.id else a] for a, b in pairs if r.id in (a, b)} - {text[r.id]}
        assert r.links == len(others)
