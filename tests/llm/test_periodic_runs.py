"""Lyndon arrays and runs against plain versions, and the query against the words themselves."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from scoreweave.llm.periodic_runs import find_runs, lyndon_array, op11_periodic_runs, periodic_runs, with_planted_periods
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def plain_lyndon(s):
    """By definition: the longest factor at each place that is smaller than all its proper suffixes."""
    out = []
    for i in range(len(s)):
        best = 1
        for j in range(i + 2, len(s) + 1):
            w = s[i:j]
            if all(w < w[k:] for k in range(1, len(w))):
                best = j - i
        out.append(best)
    return out


def plain_runs(w, min_length, min_exponent):
    """For every period, the maximal stretches in which words p apart are equal; smallest periods first."""
    out = []
    n = len(w)
    for p in range(1, n // min_exponent + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i + p - start
            if length >= max(min_length, min_exponent * p):
                # A multiple of a smaller period of the same stretch is not its smallest.
                if not any(p % q == 0 and s <= start and start + length <= s + m for s, m, q in out):
                    out.append((start, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_strings(r, count):
    for _ in range(count):
        letters = "ab" if r.random() < 0.5 else "abcd"
        w = [r.choice(letters) for _ in range(r.randrange(1, 14))]
        for _ in range(r.randrange(4)):
            w = w * r.randrange(1, 4) + [r.choice(letters) for _ in range(r.randrange(4))] if len(w) < 60 else w
        yield w[:160]


def test_lyndon_array():
    r = random.Random(1)
    for w in [["a"], list("aaaa"), list("abab"), list("baa"), *some_strings(r, 300)]:
        w = w[:40]
        ranks = np.unique(w, return_inverse=True)[1]
        assert lyndon_array(ranks.tolist()) == plain_lyndon(ranks.tolist())
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    runs = find_runs(np.array(b), 4, 2)
    assert runs and all(b[s : s + n - p] == b[s + p : s + n] for s, n, p in runs)


@pytest.mark.parametrize(("length", "exponent"), [(2, 2), (6, 2), (3, 3), (24, 3)])
def test_find_runs(length, exponent):
    r = random.Random(length)
    for w in some_strings(r, 250):
        assert find_runs(np.unique(w, return_inverse=True)[1], length, exponent) == plain_runs(w, length, exponent)


def collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_texts(spark):
    r = random.Random(5)
    texts = [None, "", "  ", "a", "é " * 30, "x y\tz\n" * 9, "q " * 23, "q " * 24]
    for w in some_strings(r, 150):
        texts.append(r.choice([" ", "\n", " \x0b"]).join([*w, *w, *w[: r.randrange(len(w) + 1)], *"mnopq"]))
    texts += ["one two three four five six seven " * 6000 + "end", " ".join(str(i) for i in range(20_000))]
    rows = [(i if i != 9 else None, t) for i, t in enumerate(texts)] + [(4, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS n_words", "3 AS _key", "4 AS collapsed").repartition(3)
    for length, exponent in ((24, 3), (5, 2)):
        want = []
        for i, t in rows:
            w = brute.BLANK_WORDS.findall(t or "")
            found = plain_runs(w, length, exponent) if len(w) < 1000 else [(0, 42_000, 7)] * (w[-1] == "end")
            want.append((i, len(w), found, collapsed(w, found)))
        got = [(x["doc_id"], x["n_words"], [tuple(y) for y in x["runs"]], x["collapsed"]) for x in periodic_runs(df, length, exponent).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic_runs(df.limit(0)).count() == 0


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op11_periodic_runs(spark, SMALL).collect()}
    assert set(got) == set(docs)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    planted = 0
    for d, text in docs.items():
        w = brute.BLANK_WORDS.findall(text or "")
        h, n = zlib.crc32(str(d).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        found = plain_runs(w, 24, 3)
        best = None
        for s, m, p in found:
            if best is None or m * best[2] > best[1] * p:
                best = (s, m, p)
        r = got[d]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *(best or (None,) * 3))
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == sha("".join(f"{s},{m},{p}\n" for s, m, p in found))
        assert r["collapsed_sha256"] == sha(collapsed(w, found))
    assert planted and any(r["n_runs"] for r in got.values())
    odd = spark.createDataFrame([(None, "a b"), (14, None), (14, "")], "doc_id long, text string")
    assert sorted(map(str, (r["text"] for r in with_planted_periods(odd).collect()))) == ["", "None", "a b"]
    assert re.fullmatch(r"[0-9a-f]{64}", next(iter(got.values()))["runs_sha256"])
