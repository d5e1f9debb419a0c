"""Resampling, the conversation trie and byte-pair encoding against brute force, and their defined edge cases."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from harborline.llm import bpe, pii, resampling, trie

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def runs(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(g.encode()) % 10_000 for g in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def resampled(docs, targets):
    """(id, features, weight, score, rank or 0) by plain counting."""
    own = [runs(text) for _, text in docs]
    s, t = Counter(b for _, found in own for b in found), Counter(b for text in targets for b in runs(text)[1])
    s_all, t_all = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    rows = []
    for (key, _), (words, found) in zip(docs, own):
        gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in found]
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain) // len(gain) if gain else 0
        rows.append([key, words, len(gain), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: 25 * len(fit) // 100])}
    return sorted(((r[0], *r[2:], rank.get(id(r), 0)) for r in rows), key=str)


def plain(frame):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"] or 0) for r in frame.collect()), key=str)


def test_resampling_equals_counting(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = resampled([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert plain(resampling.resample(docs, target)) == want


def test_resampling_edges(spark):
    many = "One two é ÉÉ 3x! " * 30
    rows = [(1, many), (2, None), (3, ""), (4, "!!! ..."), (5, "ABC abc " * 20), (5, "ABC abc " * 20), (None, many),
            (6, "w" * 200_000 + " " + "x " * 50_000), *[(k, many + str(k)) for k in range(10, 30)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("weight", F.lit("x")).withColumn("id", F.lit(1))
    target = spark.createDataFrame([("one two",), (None,), ("abc",)], "text string")
    assert plain(resampling.resample(docs, target)) == resampled(rows, ["one two", None, "abc"])
    empty = spark.createDataFrame([], "text string")
    assert plain(resampling.resample(docs, empty)) == resampled(rows, [])
    assert resampling.resample(docs.limit(0), target).count() == 0


def test_interning():
    data = np.frombuffer(random.Random(1).randbytes(5_000) + b" " * 8, np.uint8).copy()
    rng = np.random.default_rng(1)
    start, size = rng.integers(0, 4_900, 3_000), rng.integers(0, 60, 3_000)
    assert resampling.hashes(data, start, size).tolist() == [xxhash.xxh64_intdigest(data[a : a + n].tobytes()) for a, n in zip(start, size)]
    texts = [None, "", "a b a b a", "B. a", "é", "x" * 100]
    grams = resampling.Grams(pa.array(texts))
    assert grams.words.tolist() == [0, 0, 5, 2, 1, 1]
    assert len(grams.taken) == len({"a", "b", "a b", "b a", "é", "x" * 100})
    assert sorted(grams.count[grams.taken].tolist()) == [1, 1, 2, 3, 3, 4]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(resampling, "hashes", lambda data, start, size: np.full(len(start), 3, np.uint64))
    grams = resampling.Grams(pa.array(["a b c d a b", "abcdefghij abcdefghik"]))
    assert len(grams.taken) == 4 + 4 + 3


def trie_rows(rows):
    """Nodes of the trie by plain grouping of all prefixes."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, role, mark, text))
    turns = {c: [(r, x) for _, _, r, _, x in sorted(found)] for c, found in turns.items()}
    members, children = defaultdict(list), defaultdict(list)
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 9
        path = turns.get(conv - conv % 5, [])[:h] + own[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((conv, len(path) == d))
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        ends = ",".join(str(c) for c, last in sorted(members[node]) if last)
        out.append((min(members[node])[0], len(node), min(members[node[:-1]])[0] if node else None, len(members[node]),
                    len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def tried(frame):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def some_turns(seed, texts, convs=300):
    rng = random.Random(seed)
    return [(c, rng.choice([t, t, None, 1]), rng.choice(["user", "a", None]), rng.choice(texts))
            for c in rng.sample(range(-50, 3 * convs), convs) for t in range(rng.choice([1, 2, 3, 9, 20]))]


def test_trie_equals_grouping(spark):
    rows = some_turns(2, ["a", "b", None, "", "éé"]) + [(None, 1, "user", "a")] * 3
    frame = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("x")).withColumn("d1", F.lit(None))
    assert tried(trie.conversation_trie(frame)) == trie_rows(rows)


def test_trie_in_parts_under_a_full_sketch(spark, monkeypatch):
    for name, value in (("PART", 7), ("LEAST_CELLS", 64), ("MOST_CELLS", 64), ("CELLS_PER_BLOCK", 32)):
        monkeypatch.setattr(trie, name, value)
    rows = some_turns(3, ["a", "b"]) + [(10**6 + k // 60, k % 60, "user", str(k % 3)) for k in range(480)]
    assert tried(trie.conversation_trie(spark.createDataFrame(rows, TURNS))) == trie_rows(rows)


def test_trie_edges(spark):
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    alone = [(1, 0, "user", "x")]
    assert tried(trie.conversation_trie(spark.createDataFrame(alone, TURNS))) == trie_rows(alone)
    copies = [(c, t, "user", f"same {t} " * 2_000) for c in range(0, 300, 5) for t in range(3)]
    assert tried(trie.conversation_trie(spark.createDataFrame(copies, TURNS))) == trie_rows(copies)


def test_sketch_proves_only_singletons(spark):
    """Of 20,000 prefixes with 2,000 shared ones, no shared one is called alone, and most others are."""
    rows = [(k, k * 2654435761 % 2**40, k * 40503 % 2**40) for k in range(18_000)]
    frame = spark.createDataFrame(rows + rows[:2_000], "k long, d1 long, d2 long").select(
        "*", F.lit(1).cast("long").alias("depth"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"))
    got = trie.screened(frame).select("k", "alone").toPandas()
    assert not got.alone[got.k < 2_000].any()
    assert got.alone[got.k >= 2_000].mean() > 0.95


@pytest.fixture(scope="module")
def whole():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def digests(text):
        ids = encoding.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    return digests


def encoded(frame):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in frame.collect()), key=str)


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (101, 33)])
def test_stitched_chunks_equal_the_whole(spark, whole, chunk, overlap):
    rng = random.Random(chunk)
    pieces = ["a", "b", "re", " ", "  ", "\n", "'", "s", "'ll", "1", "23", ".", "!", "é", "中", "文", "。", "\U00032b50",
              "\U00012475", " ", "\x1c", "​", "𝟘", "<|endoftext|>"]
    texts = ["".join(rng.choices(pieces, [rng.choice([1, 1, 8]) for _ in pieces], k=rng.randint(0, 400))) for _ in range(600)]
    texts += ["a" * 5_000, " " * 5_000 + "x", "a" * 1_000 + " " + "b" * 1_000, "x1" * 700, "'" * 500 + "s" * 500, "word " * 900]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = encoded(bpe.encode_documents(frame, chunk=chunk, overlap=overlap))
    assert got == sorted(((k, *whole(t)) for k, t in enumerate(texts)), key=str)


def test_encoding_of_documents_and_edges(spark, sf_dir, whole):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x y " * 30_000), (-3, "x y " * 30_000), (None, "no id")], docs.schema)
    every = docs.unionByName(odd).withColumn("id", F.lit("clash")).withColumn("chunk", F.lit(0))
    assert encoded(bpe.encode_documents(every)) == sorted(((r.doc_id, *whole(r.text)) for r in every.collect()), key=str)
    assert bpe.encode_documents(every.limit(0)).count() == 0


def test_unbroken_text_of_a_million(spark):
    texts = [" " * 1_000_000 + "x", "a" * 1_000_000, "!" * 1_000_000]
    start = time.time()
    got = encoded(bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [row[3] for row in got] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert time.time() - start < 60


def test_pseudonyms_of_unbroken_text(spark):
    """Texts that once ended the job or were read again from every character; addresses beside them are still found."""
    start = time.time()
    texts = ["x@" + "a." * 6_000 + "1", "a" * 300_000, "a." * 150_000, "1 1 " * 500, "a" * 300_000 + " jo@example.com"]
    rows = pii.pseudonymise_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in rows}
    assert [got[k].text == texts[k] for k in (0, 1, 2)] == [True] * 3 and len(got[3].text) == len(texts[3])
    assert "jo@example.com" not in got[4].text and got[4].n_values == 1
    assert time.time() - start < 60
