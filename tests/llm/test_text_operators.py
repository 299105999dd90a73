"""Operators on texts against their plain versions, with nulls, empty and long texts, ties, repeats and clashing names."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from scoreweave.llm.components import components
from scoreweave.llm.decontaminate import decontaminate, op8_decontamination
from scoreweave.llm.jaccard_join import jaccard_components, op6_jaccard_join
from scoreweave.llm.packing import op9_packing, pack_sequences, place
from scoreweave.llm.substring import op2_substring_dedup, substring_dedup
from scoreweave.llm.token_counts import op5_token_counts, token_counts
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def documents(spark, folder=SMALL):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows, key="doc_id"):
    return spark.createDataFrame(rows, f"{key} long, text string").repartition(4)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (5, None)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("m", [5, 10, 50])
def test_substring(spark, m):
    r = random.Random(m)
    words = [chr(97 + i) * (1 + i % 3) for i in range(8)] + ["é", "Ab"]
    base = [r.choice(words) for _ in range(300)]
    rows = []
    for d in range(60):
        s, n = r.randrange(200), r.randrange(100)
        w = [r.choice(words) for _ in range(r.randrange(20))] + base[s : s + n] + base[s : s + n // 2]
        rows.append((d if d % 7 else d // 2, r.choice([" ", "\n\t", " \x0b"]).join(w)))
    rows += [(5, None), (6, ""), (None, rows[3][1]), rows[10], rows[10], (99, rows[3][1]), (98, "   "), (97, "a " * 3000), (96, "a " * 3000)]
    assert brute.rows(substring_dedup(frame(spark, rows), m, with_text=False)) == brute.substring(rows, m)


def test_substring_query_and_empty(spark):
    assert brute.rows(op2_substring_dedup(spark, SMALL)) == brute.substring(documents(spark), 50)
    assert substring_dedup(frame(spark, [])).count() == 0
    named = frame(spark, [(1, "a b c d e f"), (2, "x a b c d e f")]).selectExpr("doc_id", "text", "1 AS spans", "2 AS seeds", "3 AS kept")
    assert {r["doc_id"]: r["kept"] for r in substring_dedup(named, 5).collect()} == {1: "a b c d e f", 2: "x"}


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    r = random.Random(3)
    pool = [chr(i) for i in range(32, 127)] * 3 + [chr(r.randrange(0x80, 0x3000)) for _ in range(200)] + list("'''srtvemld  ̧́\x1c\x85​")
    texts = ["", None, "'s", "it's they're we'll I'd 'stop ''s !'s", "<|endoftext|>x<|startoftext|>", "ΣΑΣ İstanbul ﬃ", "x̸<|endoftext|≯", "ab" * 30_000]
    texts += ["".join(r.choice(pool) for _ in range(r.randrange(150))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "9 AS n_tokens", "1 AS _id").repartition(3)
    got = {x["doc_id"]: x for x in token_counts(df, PATH).collect()}
    for i, text in enumerate(texts):
        want = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (want, len((text or "").encode()), want > 2048)
    assert op5_token_counts(spark, SMALL).count() == len(documents(spark))
    assert token_counts(frame(spark, []), PATH).count() == 0


def test_token_counts_of_a_long_word_keep_few_states():
    from tokenizers import Tokenizer

    from scoreweave.llm.token_counts import SHORT, Counter

    library, r = Tokenizer.from_file(PATH), random.Random(8)
    texts = ["".join(r.choice("acgt") for _ in range(20_000)), "=" * 5000, "x" * SHORT, "y" * (SHORT + 1), "ab" * 100]
    counter = Counter(PATH)
    assert counter(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert sum(map(len, counter.machine.moves)) < 100_000


def similar_texts():
    r = random.Random(4)
    base = [[r.choice("abcdefghij") for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(120):
        w = list(r.choice(base))
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = r.choice("ABCxyz")
        if r.random() < 0.3:
            w += r.choice(base)[: r.randrange(15)]
        rows.append((i, " ".join(w)))
    return rows + [(200, None), (201, ""), (202, "a b"), (203, "A  B"), (204, " "), (205, "z " * 5000)]


@pytest.mark.parametrize(("bucket", "hot"), [(200_000, 100_000), (200, 8)])
def test_jaccard(spark, bucket, hot):
    rows = similar_texts()
    df = frame(spark, rows).selectExpr("*", "1 AS n", "2 AS token", "3 AS component")
    assert brute.rows(jaccard_components(df, bucket=bucket, hot=hot)) == sorted(brute.jaccard(rows), key=str)


def test_jaccard_postings_are_narrow():
    """Ids of any size come back from their halves, a posting takes 28 bytes, and n-grams taken for one lose no pair."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from scoreweave.llm import jaccard_join as j

    ids = [-(2**62) - 5, -1, 3, 2**31 + 1, 2**40 + 7]
    near = (9 << 32) + 1  # the same upper half as the n-gram after it
    tokens = [[near, 5 << 32], [near, 7 << 32], [5 << 32, near + 1], [near + 1, 8 << 32], [8 << 32, 6 << 32]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array([8] * 5), pa.array(tokens, pa.list_(pa.int64()))], ["_doc", "n", "prefix"]
    )
    (made,) = j._postings(SimpleNamespace(value=np.ones(1 << j.SKETCH_BITS, np.int64)), 1, 100)(iter([batch]))
    lists = [c.flatten() for c in made.columns[1:]]
    assert {len(v) for v in lists} == {10} and sum(v.nbytes for v in lists) == 28 * 10
    found = j._bucket_join(10)(pa.Table.from_batches([made])).to_pylist()
    pairs = {(r["a"], r["b"]) for r in found if r["kind"] == "pair"}
    together = [set(r["members"]) for r in found if r["kind"] == "group"]
    for a, b in ((0, 1), (0, 2), (2, 3), (3, 4)):
        assert (ids[a], ids[b]) in pairs or any({ids[a], ids[b]} <= g for g in together)


def test_jaccard_query_and_edges(spark):
    assert brute.rows(op6_jaccard_join(spark, SMALL)) == sorted(brute.jaccard(documents(spark)), key=str)
    assert jaccard_components(frame(spark, [])).count() == 0
    twice = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g")]
    assert brute.rows(jaccard_components(frame(spark, twice))) == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (None, 3, None)], key=str)


def test_decontamination(spark):
    r = random.Random(2)
    words = list("abcdefé")
    items = [(i, r.choice(" ,-").join(r.choice(words) for _ in range(r.randrange(14)))) for i in range(30)]
    items += [(None, "a b"), (77, None), (78, ""), (79, "A"), items[3]]
    docs = [(i, " ".join(r.choice([*words, "B"]) for _ in range(r.randrange(40)))) for i in range(80)]
    docs += [(5, None), (6, ""), (None, "a b c a b c"), docs[9], (300, "a b " * 4000)]
    df = frame(spark, docs).selectExpr("*", "1 AS n_hit", "2 AS hits", "3 AS w")
    got = decontaminate(df, frame(spark, items, "item_id"), 4).drop("text", "hits", "w")
    assert brute.rows(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == brute.contained(docs, items, 4)
    assert {r["n_hit"] for r in decontaminate(frame(spark, docs), frame(spark, [], "item_id")).collect()} == {0}
    assert decontaminate(frame(spark, []), frame(spark, items, "item_id")).count() == 0


def test_decontamination_query(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.contained(documents(spark), items, 10)
    assert brute.rows(op8_decontamination(spark, SMALL)) == want
    assert any(x[5] for x in want)


def check_packing(rows, texts, capacity=4096):
    """Every id in one piece, sequences without gaps, checksums right; returns the padding."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    ids = {d: np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for d, t in texts}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    for d, own in ids.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
        assert at == len(own)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing(spark):
    texts = documents(spark) + [(900, None), (901, ""), (902, "word " * 9000), (903, "x<|endoftext|>y")]
    df = frame(spark, texts).selectExpr("*", "1 AS n", "2 AS start", "3 AS rest")
    assert check_packing(pack_sequences(df, PATH, group_docs=64).collect(), texts) == 0
    assert check_packing(op9_packing(spark, SMALL).collect(), documents(spark)) == 0
    assert pack_sequences(frame(spark, []), PATH).count() == 0


def test_place_balances_cost():
    lengths = np.array([1000] * 8 + [100] * 80)
    cost = defaultdict(float)
    for _, _, size, sequence, _ in place(lengths, 4000):
        cost[sequence] += size * (1 + size / 4000)
    assert len(cost) == 4 and max(cost.values()) < 1.1 * min(cost.values())
