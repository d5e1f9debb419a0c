"""The corpus operators against brute force, round trips and held-out accuracy, and their defined edge cases."""

import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from harborline.llm import (components, embeddings, fingerprints, html, langid, mixing, packing, pii, sharding, simhash,
                            toxicity)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in every column, empty and very long texts, repeated rows, and an extra column with a clashing name."""
    rows = [(1, "One two three. " * 30, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0),
            (4, "word " * 60_000, "en", "b", 1), (5, "Ein zwei drei. " * 40, "de", "b", 1),
            (5, "Ein zwei drei. " * 40, "de", "b", 1), (None, "no id here", "en", None, 1), (7, "   ", "fr", "c", 3)]
    return spark.createDataFrame(rows, DOCS).withColumn("id", F.lit("clash")).withColumn("fp", F.lit(0))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def roots(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(500, 560)]
    edges += [(600, k) for k in range(601, 900)] + [(7, 7)]
    frame = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(frame).collect()}
    used = {x for a, b in edges if a != b for x in (a, b)}
    want = roots([e for e in edges if e[0] != e[1]], used)
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 mixing


def test_mixing_meets_limit_and_budget(spark):
    rows = [(i, "w " * (1 + i % 7), None, s, 0) for i, s in enumerate(["hot"] * 900 + ["mid"] * 200 + ["low"] * 60 + [None] * 9)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mixture(docs).toPandas()
    assert set(got.doc_id) == set(range(len(rows)))
    assert got.groupby(got.source.fillna("-")).repeats.first().max() == pytest.approx(2.0, abs=1e-6)
    tokens = {s: sum(1 + i % 7 for i, r in enumerate(rows) if r[3] == s) for s in ("hot", "mid", "low", None)}
    for source, part in got.groupby(got.source.fillna("-")):
        repeats, total = part.repeats.iloc[0], tokens[None if source == "-" else source]
        largest = 7
        assert repeats * total - largest <= part.tokens.sum() <= repeats * total + 1e-6
        # Whole passes hold every row once, the partial one rows of least hash.
        assert all(len(e) == e.doc_id.nunique() for _, e in part.groupby("epoch"))
    weights = got.groupby(got.source.fillna("-")).weight.first()
    assert weights.sum() == pytest.approx(1)
    assert weights["hot"] > weights["mid"] > weights["low"]


def test_mixing_entropy(spark):
    rows = [(i, "w", None, s, 0) for i, s in enumerate(["a"] * 800 + ["b"] * 150 + ["c"] * 50)]
    light = spark.createDataFrame(rows, DOCS).select("source", F.lit(1).alias("tokens"))
    plan = mixing.source_plan(light, mixing.Target(max_repeats=None, entropy=0.9)).toPandas()
    w = plan.weight.to_numpy()
    assert -(w * np.log(w)).sum() == pytest.approx(0.9 * np.log(3), abs=1e-6)
    shares = np.array([800, 150, 50]) / 1000
    by = plan.set_index("source").weight[["a", "b", "c"]].to_numpy()
    alpha = plan.alpha.iloc[0]
    assert by == pytest.approx(shares**alpha / (shares**alpha).sum(), abs=1e-9)


def test_mixing_edges(odd, none):
    assert mixing.mixture(none).count() == 0
    got = mixing.mixed_documents(odd)
    assert got.columns == odd.columns
    assert got.count() >= odd.count()


# 2 page text


def test_page_layout():
    page = ("<title>no</title><p>One <b>two<p>three<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul><table><tr><th>Name<th>Qty"
            "<tr><td>apple<td>12<tr><td colspan=2>wide</table><pre>a\n  b</pre><div style='display:none'>no</div>"
            "<p hidden>no</p>x<br>y &amp; z<script>var a='</p>'</script> end<!-- no")
    assert html.visible_text(page).split("\n") == [
        "One two", "", "three", "", "- a", "- b", "  3. x", "  4. y", "", "Name   Qty", "apple  12", "wide", "", "a", "  b", "",
        "x", "y & z end"]


def test_page_edges(spark):
    rows = [(1, None), (2, ""), (3, "<" * 5000), (4, "<div>" * 3000 + "deep"), (5, "<p>a</p></p></div></table>b"), (5, "&#x41;<"),
            (None, "<table><td>loose<li>item"), (8, "<a href=\"x>y\">link</a>"), (9, "<style>never closed")]
    frame = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(1))
    got = {(r.page_id, r.text) for r in html.extract_pages(frame).collect()}
    assert {(1, None), (2, ""), (4, "deep"), (8, "link"), (9, "")} <= got
    assert html.extract_pages(frame.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["<", "<a ", "<a", '<a "', '<a =">"', "<!--", "</script ", "<script>", "a", "&", "<td colspan=999 rowspan=999>"])
def test_broken_pages_take_linear_time(part):
    for tail in ("", "='", ">"):
        start = time.process_time()
        html.visible_text(part * (1_000_000 // len(part)) + tail)
        assert time.process_time() - start < 12


def test_page_forms_and_visibility():
    page = ("<table><tr>loose<td>a<td>b</table><textarea>\nhi &amp; <b></textarea><p><select><option>one<option selected>two</select>"
            "<select multiple><option>p<option>q</select><div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>"
            "<details><summary>short</summary>long</details><details open><summary>s</summary>body</details>"
            "<a href=it's>quote</a> <a title='>'>value</a> <a title=\"never closed>text</a>")
    got = html.visible_text(page).split()
    assert got == "loose a b hi & <b> two p q yes short s body quote value text".split()


def test_wide_cells_do_not_pad_every_row():
    page = "<table><tr><td>" + "w" * 50_000 + "<td>x" + "<tr><td>a<td>b" * 1_000
    got = html.visible_text(page)
    assert len(got) < 100_000 and got.split("\n")[1:] == ["a  b"] * 1_000


def test_pages_keep_visible_words(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = html.extract_pages(pages).join(pages, "page_id").collect()
    for r in got:
        assert "track(" not in r.text and "margin:0" not in r.text and "<" not in r.text
        assert (r.text or "").count("\n\n\n") == 0


# 3 fingerprints


def slow_gear(data):
    out, h = [], 0
    for b in data:
        h = (h * 2 + int(fingerprints.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_gear_hash_and_chunks():
    data = np.random.default_rng(1).integers(0, 256, 4000, dtype=np.uint8).tobytes()
    assert fingerprints.rolling_hash(data).tolist() == slow_gear(data)
    ends = fingerprints.chunk_ends(data)
    lengths = np.diff([0, *ends])
    assert ends[-1] == len(data) and lengths.max() <= fingerprints.MOST and lengths[:-1].min() >= fingerprints.LEAST
    for k in (3, 10, 20):
        assert fingerprints.chunk_ends(data, ends[k]) == ends[k + 1:]
    moved = set(fingerprints.fingerprint("x" + "abc def ghi " * 9 + "tail").tolist())
    assert moved


def test_fingerprints_against_brute_force(docs, odd, none):
    got = fingerprints.fingerprint_documents(docs).toPandas().set_index("doc_id")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        a, b, c = (fingerprints.fingerprint(x) for x in (text, edited, following))
        r = got.loc[key]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), fingerprints.as_text(a), fingerprints.as_text(b))
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))
    assert got.near_edited.mean() > 0.6 > got.near_next.mean()
    assert fingerprints.fingerprint_documents(none).count() == 0
    edge = fingerprints.fingerprint_documents(odd).toPandas()
    assert len(edge) == 8 and edge[edge.doc_id == 2].fingerprint.item() == "" and edge.near_next.isna().sum() == 1
    assert edge[edge.doc_id == 5].fingerprint.nunique() == 1


# 4 sharding


def check_shards(rows, got):
    got = got.sort_values(["shard", "slot"])
    assert len(got) == len(rows)
    assert ((got.groupby("shard").cumcount() == got.slot)).all()
    assert got["shard"].between(0, sharding.SHARDS - 1).all()


def test_sharding(spark, docs, odd, none):
    got = sharding.shard_documents(docs).toPandas()
    want = {r.doc_id: ((r.text or "").encode()) for r in docs.collect()}
    check_shards(want, got)
    assert all(s == len(want[k]) + 16 and c == zlib.crc32(want[k]) for k, s, c in zip(got.doc_id, got["size"], got.text_crc32))
    rows = [(i, "hot " * 40, None, "s", 0) for i in range(3000)] + [(9000 + i, f"text {i} " * (1 + i % 50), None, "s", 0) for i in range(6000)]
    big = sharding.shard_documents(spark.createDataFrame(rows, DOCS)).toPandas()
    check_shards(rows, big)
    size = big.groupby("shard")["size"].sum()
    assert size.max() / size.min() < 1.01
    cold = big[big.doc_id >= 9000]
    assert (cold.groupby("text_crc32")["shard"].nunique() == 1).all()
    copies = [(20_000 + i, f"copies {i % 12} " * 30, None, "s", 0) for i in range(12 * 150)]
    mixed = sharding.shard_documents(spark.createDataFrame(rows + copies, DOCS)).toPandas()
    size = mixed.groupby("shard")["size"].sum()
    assert size.max() / size.min() < 1.01
    assert (mixed[mixed.doc_id >= 9000].groupby("text_crc32")["shard"].nunique() == 1).all()
    check_shards(range(8), sharding.shard_documents(odd).toPandas())
    assert sharding.shard_documents(none).count() == 0


def test_place_takes_highest_product():
    room = np.array([[1.0, 1.0], [2.0, 0.5], [0.2, 3.0]])
    assert sharding.place(np.array([[1.0, 0.1]]), room.copy()).tolist() == [1]
    assert sharding.place(np.array([[0.1, 1.0]]), room.copy()).tolist() == [2]


# 5 language


def slow_total(word, p, vocabulary):
    known = langid.pieces(vocabulary)
    total = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            k = known.get(word[i:j])
            if k is None and j == i + 1:
                k = len(known)
            if k is not None:
                total[j] += total[i] * p[k]
    return np.log(total[-1])


def test_forward_sums_all_segmentations():
    known = langid.pieces(langid.VOCABULARY)
    p = np.random.default_rng(0).dirichlet(np.ones(len(known) + 1))[:, None]
    words = [*langid.words_of("The thing größe 漢字 x" + " " + "q" * 70), "a"]
    lattice = langid.Lattice(words, langid.VOCABULARY)
    assert lattice.log_total(p)[:, 0] == pytest.approx([slow_total(w, p[:, 0], langid.VOCABULARY) for w in words])
    uses = lattice.expected(p, np.ones((len(words), 1)))
    assert (uses >= 0).all() and uses.sum() <= sum(map(len, words)) + 1e-9


def test_language_accuracy_and_edges(docs, odd, none):
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got.held_out]
    assert (out.lang == out.lang_pred).mean() > 0.95
    assert all(h == (zlib.crc32(str(k).encode()) % 3 == 1) for k, h in zip(got.doc_id, got.held_out))
    assert langid.identify(none).count() == 0
    edge = langid.identify(odd).toPandas()
    assert len(edge) == 8 and set(edge[edge.doc_id.isin([2, 3, 7])].lang_pred) == {"und"} and edge.score.between(0, 1).all()


# 6 embeddings


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(900, 24))
    near = base[:120] + rng.normal(size=(120, 24)) * 0.08
    ball = base[500] + rng.normal(size=(150, 24)) * 0.1
    x = np.concatenate([base, near, ball, base[:40], base[:20] * 3])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] + [1.0] * 23), (5003, [None] + [1.0] * 23), (5004, [1.0, 2.0]),
           (5005, [1.0, 2.0]), (5006, [])]
    frame = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    got = embeddings.near_duplicates(frame).toPandas().set_index("vec_id")
    u = embeddings.unit_rows(list(x))
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    found, real = got.n_links.loc[list(range(len(x)))].to_numpy(), close.sum(axis=1)
    assert (found <= real).all() and found.sum() >= 0.95 * real.sum()
    want = roots(zip(*map(list, np.nonzero(close))), range(len(x)))
    assert np.mean([got.component_id[i] == want[i] for i in range(len(x))]) > 0.95
    assert (got.n_links[[5000, 5001, 5002, 5003, 5006]] == 0).all() and (got.n_links[[5004, 5005]] == 1).all()
    assert (got.kept == (got.index == got.component_id)).all()
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


# 7 toxicity


def test_toxicity(docs, labels, odd, none):
    got = toxicity.grade_documents(docs, labels).join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").toPandas()
    assert (got.toxic == (got.y == 1)).mean() > 0.97
    assert got.severity.between(0, 2).all()
    assert toxicity.grade_documents(odd, labels).count() == 8
    assert toxicity.grade_documents(none, labels).count() == 0
    kept = toxicity.without_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == 8


def test_ordinal_fit_shares_weights():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(3000)]
    w = np.array([3.0, 2.0, 0, 0, 0, -1.0])
    score = np.array([w[r].sum() for r in rows]) + rng.logistic(size=3000)
    grades = (score > 2).astype(int) + (score > 4)
    weights, cuts = toxicity.fit_ordinal(rows, grades, 6, 2)
    assert weights == pytest.approx(w, abs=0.35) and cuts == pytest.approx([2, 4], abs=0.4)


def test_no_labels(docs, labels):
    assert not toxicity.grade_documents(docs, labels.limit(0)).where("toxic").count()


# 8 packing


def test_encoder_is_exact(docs):
    encode = packing.WordEncoder(packing.VOCABULARY)
    texts = [r.text or "" for r in docs.limit(60).collect()]
    texts += ["", "x", "  two  spaces", "a\n b", "end ", " lead", "tab\t y", "a.\nB c,", "x..\ny", "x.\n\ny", "p\n", "É.\né 12.\n3, ab1.",
              "<|endoftext|> z", "don't won't. it's,\nI'm"]
    rng = np.random.default_rng(4)
    parts = np.array(["a", "Bc", " ", "  ", "\n", "\n\n", "\t", "'", "s", "'ll", "1", "23", ".", ",", "-", "é", "à", "中", "\u3000", "\xa0",
                      "\u2003", "\x85", "\x1c", "€", "’", "<|endoftext|>", "word", " word", "\n "])
    texts += ["".join(rng.choice(parts, rng.integers(60))) for _ in range(3_000)] + ["a" * 50_000, " " * 50_000, "a. " * 20_000]
    want = [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [ids.tolist() for ids in encode(pa.array(texts))] == want
    assert [len(ids) for ids in encode(pa.array([None, ""], pa.string()))] == [0, 0]


def test_encoder_forgets_and_learns_again(docs, monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 400)
    texts = pa.array([r.text or "" for r in docs.limit(60).collect()])
    encode = packing.WordEncoder(packing.VOCABULARY)
    first = [ids.tolist() for k in range(60) for ids in encode(texts.slice(k, 1))]
    assert first == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
    assert len(encode.young) <= 200 + max(len(set((t or "").split())) for t in texts.to_pylist()) * 3


def check_packing(docs, got, tokenizer):
    got = got.sort_values(["sequence_id", "offset"])
    group = got.groupby("sequence_id")
    assert (got.offset == group.length.cumsum() - got.length).all() and group.length.sum().max() <= packing.CAPACITY
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        head = len(ids) % packing.CAPACITY
        starts = ([0] if head else []) + list(range(head, len(ids), packing.CAPACITY))
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    rows = [tuple(None if x != x else int(x) for x in r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(rows, key=key) == sorted(want, key=key)
    counts = np.bincount(got.length, minlength=packing.CAPACITY + 1)
    assert packing.lower_bound(counts) <= got.sequence_id.nunique() <= sum(n for _, n in packing.best_fit(counts))


def test_packing(docs, odd, none):
    tokenizer = packing.WordEncoder(packing.VOCABULARY).tokenizer
    for frame in (docs, odd):
        check_packing(frame, packing.pack_documents(frame).toPandas(), tokenizer)
    assert packing.pack_documents(none).count() == 0


def test_bin_completion_is_optimal_on_small_inputs():
    def optimum(sizes, capacity):
        # Fewest bins by dynamic programming over subsets: (bins, fill of the last one).
        table = {0: (1, 0)}
        for mask in range(1 << len(sizes)):
            if mask not in table:
                continue
            bins, fill = table[mask]
            for i, s in enumerate(sizes):
                if not mask >> i & 1:
                    state = (bins, fill + s) if fill + s <= capacity else (bins + 1, s)
                    if state < table.get(mask | 1 << i, (99, 0)):
                        table[mask | 1 << i] = state
        return table[(1 << len(sizes)) - 1][0]

    rng = np.random.default_rng(9)
    for _ in range(25):
        sizes = rng.integers(1, 21, 9).tolist()
        found = packing.bin_completion(np.bincount(sizes, minlength=21))
        assert sum(n for _, n in found) == optimum(sizes, 20)
        placed = np.zeros(21, int)
        for kind, n in found:
            assert sum(s * k for s, k in kind) <= 20
            for s, k in kind:
                placed[s] += k * n
        assert placed.tolist() == np.bincount(sizes, minlength=21).tolist()


def test_bin_completion_branches_on_triples():
    sizes = [11, 10, 8, 8, 5, 5, 4, 3, 3, 3]
    for copies in (1, 2, 5):
        found = packing.bin_completion(np.bincount(sizes, minlength=21) * copies)
        assert sum(n for _, n in found) == 3 * copies
    beside = np.bincount(sizes[1:], minlength=21)
    assert (3, 3, 3) in list(packing.fillings(beside, 9)) and (5, 4) in list(packing.fillings(beside, 9))


# 9 pseudonyms


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    values = ["4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005", "+1 (212) 555-0199", "212-555-0199", "9.255.0.17",
              "1984-02-29", "123-45-6789", "jane.doe42@mail.example.com", "b@x.org"]
    keep = ["4111 1111 1111 1112", "1.2.3.999", "2023-02-30", "666-12-1234", "12", "2024", "version 3.0"]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate([*values, *keep, *values])], "doc_id long, text string")
    frame = frame.withColumn("text", F.concat(F.lit("see "), "text", F.lit(", and "), "text", F.lit("."))).withColumn("n_values", F.lit("x"))
    got = [r.text for r in pii.pseudonymise_documents(frame).orderBy("doc_id").collect()]
    new = []
    for old, text in zip([*values, *keep, *values], got):
        first, second = text[4:-1].split(", and ")
        assert first == second
        new.append(first)
        shape = lambda s: "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in s)
        if "." not in old or "@" in old:
            assert shape(first) == shape(old)
    assert new[: len(values)] == new[-len(values):] and new[len(values): len(values) + len(keep)] == keep
    assert all(a != b for a, b in zip(values, new)) and all(luhn(x) for x in new[:3])


def test_no_phone_survives(spark, docs):
    forms = ["+1 (017) 555-7713", "+1 (132) 155-1352", "(212) 5550199", "2125550199", "+12125550199", "+44 20 7946 0958",
             "+49 (0)89/123456", "0033 1 23 45 67 89"]
    rows = [(i, f"call {v}, or {v}.", None, None, 0) for i, v in enumerate([*forms, "3.1415926535", "abc2125550199"])]
    got = [r.text for r in pii.pseudonymise_documents(spark.createDataFrame(rows, DOCS)).orderBy("doc_id").collect()]
    for v, text in zip(forms, got):
        first, second = text[5:-1].split(", or ")
        assert first == second != v and re.sub(r"\d", "9", first) == re.sub(r"\d", "9", v)
    assert [g == r[1] for g, r in zip(got, rows)] == [False] * len(forms) + [True] * 2
    assert len({re.sub(r"\D", "", g.split(",")[0])[-10:] for g in got[2:5]}) == 1
    phone = re.compile(r"\+\d \(\d{3}\) \d{3}-\d{4}")
    old = {r.doc_id: phone.findall(r.text or "") for r in docs.collect()}
    new = {r.doc_id: (phone.findall(r.text or ""), r.n_values) for r in pii.pseudonymise_documents(docs).collect()}
    assert any(p[4] in "01" for found in old.values() for p in found)
    for k, found in old.items():
        assert len(new[k][0]) == len(found) <= new[k][1] and not set(found) & set(new[k][0])


def test_cards_beside_other_digits(spark):
    card = "4111 1111 1111 1111"
    cases = {f"{card} 05/27": [card], "4111111111111111 123": ["4111111111111111"], f"12 {card}": [card], f"-{card}-": [card],
             f"{card} {card} 3782 822463 10005 9": [card, card, "3782 822463 10005"], "7 411111 1111111111 7 7": ["411111 1111111111"],
             f"05 212-555-0199 {card}": ["212-555-0199", card], "1 " * 3000 + card: [card], "41111111 11111112": []}
    frame = spark.createDataFrame([(i, v, None, None, 0) for i, v in enumerate(cases)], DOCS)
    alone = spark.createDataFrame([(v,) for found in cases.values() for v in found], "v string").distinct()
    new = {r.v: r.new for r in alone.select("v", pii.pseudonymise(F.col("v")).alias("new")).collect()}
    assert all(luhn(x) for v, x in new.items() if v != "212-555-0199")
    got = pii.pseudonymise_documents(frame).orderBy("doc_id").collect()
    for (text, found), row in zip(cases.items(), got):
        if text.startswith("1 1 "):
            assert row.text.endswith(new[card])
            continue
        for v in found:
            text = text.replace(v, new[v])
        assert (row.text, row.n_values) == (text, max(1, len(found)))


def test_feistel_is_a_permutation(spark):
    frame = spark.range(12 * 35).select(F.floor(F.col("id") / 35).alias("a"), (F.col("id") % 35).alias("b"))
    got = frame.select(pii.feistel("k", "t", F.col("a"), F.col("b"), 12, 35).alias("x")).collect()
    assert {(r.x.a, r.x.b) for r in got} == {(a, b) for a in range(12) for b in range(35)}


def test_pseudonym_edges(odd, none):
    got = pii.with_pseudonyms(odd)
    assert got.columns == odd.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, odd.collect()))
    assert pii.pseudonymise_documents(none).count() == 0


# 10 SimHash


def slow_simhash(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_and_spark_hash_agree(spark):
    for text in (None, "", "One", "A b", "É A b c d e", "a a a a a", "x\ty\nz\x0bq w v"):
        assert simhash.simhash(text) == slow_simhash(text)
    shingle = "one two three"
    assert spark.range(1).select(F.xxhash64(F.lit(shingle))).first()[0] % 2**64 == xxhash.xxh64_intdigest(shingle, 42)


def test_anchors_meet():
    """Any two halves one bit apart: the home of either is an anchor of the other."""
    rng = np.random.default_rng(4)
    halves = rng.integers(0, 1 << 32, 300)
    home, reach = simhash.anchors(halves)
    assert (reach[:, 0] == home).all()
    for k in range(32):
        other, _ = simhash.anchors(halves ^ (1 << k))
        assert (reach == other[:, None]).any(axis=1).all()
    words = rng.integers(0, 1 << 23, 500)
    code = simhash.nearest_codeword(words)
    assert len(np.unique(simhash.nearest_codeword(np.arange(1 << 12) << 11))) <= 1 << 12 and code.max() < 1 << 12


def test_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False)) for b in base[:200]]
    ball = [int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(30) for j in range(i)]
    values = np.unique(np.array([*map(int, base), *flips, *ball], dtype=np.uint64))
    frame = spark.createDataFrame([(int(v), i) for i, v in enumerate(values.view(np.int64))], "fp long, id long")
    found = components.connected_components(simhash.fingerprint_links(frame))
    got = {r.node: r.component for r in found.collect()}
    edges = [(i, int(j)) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3) if j > i]
    want = roots(edges, range(len(values)))
    assert {i: got.get(i, i) for i in range(len(values))} == want


def test_simhash_edges(odd, none):
    got = simhash.near_duplicates(odd).toPandas()
    assert len(got) == 8 and set(got[got.doc_id.isin([2, 3, 7])].component_id) == {2}
    assert got[got.doc_id.isin([2, 3, 7])].fp.eq(0).all()
    assert simhash.near_duplicates(none).count() == 0


def test_training_rows_are_shared_by_language(spark, monkeypatch):
    assert langid.row_shares({"a": 3, "b": 1000, "c": 50}, 103) == {"a": 3, "b": 50, "c": 50}
    assert langid.row_shares({"a": 3}, 100) == {"a": 3} and langid.row_shares({}, 5) == {}
    monkeypatch.setattr(langid, "TRAINING_ROWS", 60)
    rows = [(i, f"the house and the garden number {i}", "en") for i in range(3000)]
    rows += [(i, f"das Haus und der Garten Nummer {i}", "de") for i in range(3000, 3012)]
    model = langid.train(spark.createDataFrame(rows, "id long, text string, lang string"), rounds=2)
    assert model.languages == ["de", "en"]


def test_labelled_rows_stay_bounded_under_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, None), (2, "other"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (4, 1)], "doc_id long, toxic int")
    got = [(r["text"], r["toxic"]) for r in toxicity.labelled_sample(docs, labels, "doc_id", "text").collect()]
    assert len(got) == 3 and ("other", 0) in got and (None, 1) in got
    assert [t for x, t in got if x and x.startswith("text")] == [1]


def test_audit_sees_lost_pairs_beside_a_crowd_and_blocks_find_them(spark, monkeypatch):
    rng = np.random.default_rng(8)
    crowd = np.eye(24)[0] + rng.normal(0, 0.02, (150, 24))
    pairs = np.repeat(rng.normal(0, 1, (20, 24)), 2, axis=0) + rng.normal(0, 0.01, (40, 24))
    x = np.concatenate([crowd, pairs])
    nodes = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, vector array<double>, n long")
    u = embeddings.unit_rows(list(x))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found = spark.createDataFrame([(i, i, int(near[i].sum())) for i in range(150)], "a long, b long, weight long")
    assert embeddings._audit(nodes, found, 0.9) == 0.0
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 40)
    exact = embeddings._compare_all(nodes, 0.9)
    assert embeddings._audit(nodes, exact, 0.9) == 1.0
    got = {r["a"]: r["w"] for r in exact.groupBy("a").agg(F.sum("weight").alias("w")).collect()}
    assert all(got.get(i, 0) == near[i].sum() for i in range(len(x)))
