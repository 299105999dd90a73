"""The noisy-or model against plain versions: its slope, its scores, what it learns and where it points."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa

from scoreweave.llm.toxicity import SENTENCE_WORDS, Model, fit, noisy_or, op12_toxicity, score, sentences

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def plain_sentences(text):
    """(first character, end, words) of every sentence."""
    out, last = [], None
    for m in WORDS.finditer(text):
        if last is None or len(out[-1]) == SENTENCE_WORDS or re.search(r"[.!?\n]", text[last : m.start()]):
            out.append([])
        out[-1].append(m)
        last = m.end()
    return [(s[0].start(), s[-1].end(), [m.group() for m in s]) for s in out]


def test_sentences():
    r = random.Random(2)
    texts = ["", None, "...", "One two. Three! é4\nfive", "x " * 150, "tail.\n\n.a"]
    texts += ["".join(r.choice("abé .!?\n,") for _ in range(r.randrange(60))) for _ in range(200)]
    s = sentences(pa.array(texts))
    for i, text in enumerate(texts):
        want = plain_sentences(text or "")
        own = range(s.first[i], s.first[i + 1])
        size = lambda n, text=text: len((text or "")[:n].encode())
        assert [(s.starts[k], s.ends[k]) for k in own] == [(size(a), size(b)) for a, b, _ in want]
        assert [np.count_nonzero(s.of == k) for k in own] == [
            sum(1 + sum(len(w.encode()) >= n for n in (4, 5, 6)) for w in words) for _, _, words in want
        ]


def test_slope_follows_the_likelihood():
    z, d = np.array([-3.0, 0.5, -6.0]), 1e-6
    p, total = 1 / (1 + np.exp(-z)), np.logaddexp(0, z).sum()
    for label, slope in ((1, p / np.expm1(total)), (0, -p)):
        for k in range(3):
            moved = z.copy()
            moved[k] += d
            gain = [np.log(noisy_or(v) if label else 1 - noisy_or(v)) for v in (z, moved)]
            assert abs((gain[1] - gain[0]) / d - slope[k]) < 1e-4
    # One document, three sentences: the model takes the step that its slope says.
    model = Model.empty(4)
    model.learn(np.array([1, 2]), np.array([0, 0, 1]), np.array([0, 1, 1]), 1.0)
    each = 1 / (1 + np.exp(-model.prior)) / np.expm1(2 * np.logaddexp(0, model.prior))
    assert np.allclose(-model.z[[1, 2, 16]], [2 * each, each, 2 * each])


def test_learns_from_document_labels_and_locates(spark):
    r = random.Random(7)
    common = ["river", "stone", "cloud", "letter", "window", "garden", "market", "song"]
    rows, labels, truth = [], [], {}
    for i in range(900):
        lines = [" ".join(r.choice(common) for _ in range(r.randrange(3, 9))) + "." for _ in range(r.randrange(1, 12))]
        if i % 3 == 0:
            at = r.randrange(len(lines))
            lines[at] = lines[at][:-1] + " " + r.choice(["vilex", "vileton"]) + "."
            truth[i] = at
        rows.append((i, " ".join(lines)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(2000, None), (2001, ""), (2002, ".. !"), (None, rows[0][1]), rows[0], (2003, "river stone. " * 20_000), (2004, "a vilex b. " + "river. " * 9000)]
    labels += [(None, 1), (5, None), (2001, 0), labels[0], (77777, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS Score", "2 AS at", "3 AS label", "4 AS _text2").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit(docs, known)
    got = {}
    for x in score(docs, model).collect():
        if x["doc_id"] in got:
            assert got[x["doc_id"]]["score"] == x["score"]
        got[x["doc_id"]] = x
    texts = dict(rows)
    for i in range(900):
        assert (got[i]["score"] >= 0.5) == (i in truth)
        spans = [texts[i].encode()[s["start"] : s["end"]].decode() for s in got[i]["offending"]]
        assert spans == [x.strip() for x in texts[i].split(".") if "vile" in x]
    alone = 1 / (1 + np.exp(-(model.weights()[-1] + model.prior)))
    assert all(abs(got[i]["score"] - alone) < 1e-12 and not got[i]["offending"] for i in (2000, 2001, 2002))
    assert got[2004]["score"] >= 0.5 and got[2004]["offending"][0]["start"] == 0
    # The score is the noisy-or over all sentences, from the weights.
    w = model.weights()
    for i in (0, 1, 2, 2003):
        s = sentences(pa.array([texts[i]]))
        odds = [w[s.slots[s.of == k]].sum() + w[-1] + model.prior for k in range(len(s.starts))]
        assert abs(1 - np.prod(1 / (1 + np.exp(np.array(odds)))) - got[i]["score"]) < 1e-9


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = fit(docs, labels), fit(docs, turned)
    assert np.array_equal(a.z, b.z) and a.z.any()
    none = fit(docs, labels.limit(0))
    assert not none.weights().any() and score(docs.limit(0), none).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in op12_toxicity(spark, folder).collect()}
    known = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    test = [(rows[i]["predicted"], y) for i, y in known.items() if rows[i]["held_out"]]
    assert np.mean([p == y for p, y in test]) >= 0.96
    caught = [p for p, y in test if y]
    assert np.mean(caught) >= 0.8
