"""Tokenizer alignment, exact top-k search and whitening against plain Python and numpy."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchline.llm import alignment, queries, topk, whitening

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")

# --- alignment -------------------------------------------------------------------------------

TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces  \n\n and\tlines \n"), (5, "plain words, plain words; don't"), (6, "a▁b is not given back"), (7, "<|endoftext|> and <s> are text"),
    (8, "voilà quatre à l'Å b c　d\u0085 e"), (9, "漢字 🙂 Россия х Р ß\x00\x1f x"), (10, "no" * 1_500), (11, " ".join(f"w{i % 977}x{i % 89}" for i in range(20_000))),
    (12, "plain words, plain words; don't"), (12, "plain words, plain words; don't"), (None, "no id"), (None, None), (13, "᠎ x  y"), (14, "ends in space "), (15, "ends in two  "), (17, "la" * 40_000), (16, "▁"),
]
DOCS = "doc_id long, text string, row string, block string, found string, n_a string, `Text 2` string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "r", "b", "f", "n", None) for i, t in TEXTS], DOCS)


@cache
def byte_level(entry):
    """A byte-level entry's bytes, by the rule that bytes without a printable character stand shifted, in order, from U+0100."""
    shifted = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
    return bytes(shifted[ord(c) - 0x100] if ord(c) >= 0x100 else ord(c) for c in entry)


def aligned(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups digest) by whole texts and every two tokens near each other."""
    a = Tokenizer.from_file(queries.BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    entry = {i: e for e, i in a.get_vocab().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    made, total = [], Counter()
    for doc_id, text in rows:
        spans = []
        for ids, of in ((a.encode(" " + (text or ""), add_special_tokens=False).ids, lambda i: byte_level(entry[i])), (b.encode(text or ""), piece)):
            at, out = 0, []
            for i in ids:
                out.append((i, at, at := at + len(of(i))))
            spans.append(out if b"".join(map(of, ids)) == (" " + (text or "")).encode() else None)
        if not text or None in spans:
            made.append((doc_id, [], [], [], []))
            continue
        x, y = spans
        ends = sorted({s[2] for s in x} & {s[2] for s in y})
        group_of = lambda s: bisect_left(ends, s[2])
        groups = [([], []) for _ in ends]
        for side, tokens in enumerate(spans):
            for s in tokens:
                groups[group_of(s)][side].append(s)
        links = [(s[0], t[0]) for g in groups for s in g[0] for t in g[1] if s[1] < t[2] and t[1] < s[2]]
        total.update(links)
        made.append((doc_id, x, y, ["|".join(",".join(str(s[0]) for s in side) for side in g) for g in groups], links))
    most = Counter()
    for (_, t), n in total.items():
        most[t] = max(most[t], n)
    return [(i, len(x), len(y), len(g), len(k), sum(total[p] == most[p[1]] for p in k), sum(total[p] for p in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, x, y, g, k in made]


def by_text(rows):
    return sorted(tuple((v is None, v) for v in r) for r in rows)


NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@pytest.mark.parametrize("small", [False, True])
def test_alignment(docs, monkeypatch, small):
    if small:  # a block for each text, three levels of the tree
        monkeypatch.setattr(alignment, "BLOCK_BYTES", 1)
        monkeypatch.setattr(alignment, "FAN", 3)
    got = alignment.align(docs, queries.BYTE_LEVEL, queries.MODEL)
    assert got.columns == [*docs.columns, "aligned"]
    rows = [(r["doc_id"], *(r["aligned"][n] for n in NUMBERS), hashlib.sha256(r["aligned"]["groups"].encode()).hexdigest() if r["aligned"]["groups"] else "") for r in got.collect()]
    assert by_text(rows) == by_text(aligned(TEXTS))


def test_alignment_query_on_the_small_table(spark):
    got = queries.op11_alignment(spark, SF)
    rows = [tuple(r) for r in got.select("doc_id", *NUMBERS, "groups_sha256").collect()]
    assert by_text(rows) == by_text(aligned([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]))


def test_alignment_of_nothing(docs):
    assert alignment.align(docs.limit(0), queries.BYTE_LEVEL, queries.MODEL).count() == 0
    only_null = alignment.align(docs.where("text is null"), queries.BYTE_LEVEL, queries.MODEL, "out")
    assert [r["out"]["n_links"] for r in only_null.collect()] == [0, 0]
    with pytest.raises(ValueError, match="Block"):
        alignment.align(docs, queries.BYTE_LEVEL, queries.MODEL, "Block")


def test_pair_counts(spark):
    few = spark.createDataFrame([("x y x y",), ("x y",), (None,)], "text string")
    counts = {(r["a"], r["b"]): r["n"] for r in alignment.pair_counts(alignment.count(few, queries.BYTE_LEVEL, queries.MODEL)).collect()}
    assert sorted(counts.values()) == [3, 3]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 60_000])
def test_perfect_hash(n):
    keys = np.array(random.Random(n).sample(range(1 << 40), n), np.int64)
    made = alignment.PerfectHash.build(keys)
    assert sorted(made.numbers(keys)) == list(range(n))
    others = np.arange(1 << 41, (1 << 41) + 100)
    assert ((made.numbers(others) >= -1) & (made.numbers(others) < max(n, 1))).all()


def test_unknown_pair_is_an_error():
    keys = np.array([5, 9, 11], np.int64)
    made = alignment.PerfectHash.build(keys)
    order = np.empty(3, np.int64)
    order[made.numbers(keys)] = keys
    cell = {"words": made.words.tobytes(), "sizes": made.sizes, "keys": order}
    assert order[alignment._look_up(cell, keys)].tolist() == [5, 9, 11]
    with pytest.raises(KeyError):
        alignment._look_up(cell, np.array([5, 10]))


# --- exact top-k -----------------------------------------------------------------------------


def nearest(rows, k, step):
    """Plain Python: distinct rows, exact integers."""
    rows = {(i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, v in rows:
        if i % step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if len(w) == len(v) and (j, w) != (i, v))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, cid string, `Score` string")


@pytest.fixture(scope="module")
def awkward():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(1, 120)]
    hot = rng.normal(size=6).tolist()
    rows += [(i, hot) for i in range(200, 290)]  # equal vectors, queries among them
    rows += [(300, [0.0] * 6), (301, [-x for x in hot]), (310, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (320, [NAN] * 6), (330, [INF, 0.0, 0.0, 0.0, 0.0, 0.0]), (340, None), (None, hot), (350, []), (351, [])]
    rows += [(20, hot), (30, rows[28][1]), (30, rows[28][1]), (360, [1.0, 2.0]), (370, [2.0, 1.0])]  # one id with two vectors, a repeated row, another length
    return rows


@pytest.mark.parametrize("lists", [1, 2, 4, 9])
@pytest.mark.parametrize("small", [False, True])
def test_topk(spark, awkward, monkeypatch, lists, small):
    if small:  # many blocks, short heads
        for name, value in (("BLOCK_ROWS", 20), ("QUERY_ROWS", 7), ("DEPTH", 1), ("_STEP", 2)):
            monkeypatch.setattr(topk, name, value)
    got = topk.search(vectors(spark, awkward), F.col("vec_id") % 10 == 0, 5, lists=lists)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == nearest(awkward, 5, 10)


def test_topk_fewer_than_k_and_nothing(spark):
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    got = topk.search(vectors(spark, few), F.col("vec_id") == 0)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 1, 1024 * 512), (0, 2, 2, -1024 * 1024)]
    assert topk.search(vectors(spark, few).limit(0), F.col("vec_id") == 0).count() == 0
    assert topk.search(vectors(spark, few), F.lit(False)).count() == 0
    assert topk.search(vectors(spark, few[:1]), F.col("vec_id") == 0).count() == 0


def test_topk_beyond_doubles(spark):
    """Scores above 2 ** 53 are exact; beyond a long they are refused."""
    rows = [(0, [1.0e5, 1.0]), (1, [1.0e5, 1.0]), (2, [1.0e5, 1.5]), (3, [1.0e5, 1.25])]
    got = topk.search(vectors(spark, rows), F.col("vec_id") == 0, 3)
    assert sorted(tuple(r) for r in got.collect()) == nearest(rows, 3, 100)
    with pytest.raises(ValueError, match="long"):
        topk.search(vectors(spark, [(0, [1.0e8, 1.0])]), F.col("vec_id") == 0)


def test_topk_query_on_the_small_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op12_exact_topk(spark, SF).collect()) == nearest(rows, 10, 100)


# --- whitening -------------------------------------------------------------------------------


def whitened(vectors_, components=8):
    """(n, deviations, projections, explained) by numpy's eigenvectors."""
    x = np.floor(1024 * np.array(vectors_, np.float32).astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    values, turned = np.linalg.eigh(np.cov(x.T, bias=True))
    by_size = np.argsort(-values)[:components]
    deviations = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return n, deviations, (x - sums / n) @ turned[:, by_size] / np.sqrt(values[by_size]), values[by_size] / values.sum()


def check_whitening(got, ids, rows):
    n, deviations, projections, explained = whitened(rows)
    table = got.toPandas().set_index(["vec_id", "component"]).sort_index()
    assert len(table) == len(ids) * len(explained)
    assert set(table.n) == {n} and table.identity_error.nunique() == 1 and table.identity_error.iloc[0] < 1e-9
    for c in range(len(explained)):
        own = table.xs(c + 1, level="component").loc[ids]
        assert [int(d) for d in own.deviation] == deviations
        np.testing.assert_allclose(own.explained, explained[c], rtol=1e-9)
        sign = np.sign(own.whitened.to_numpy() @ projections[:, c])
        np.testing.assert_allclose(own.whitened.to_numpy() * sign, projections[:, c], atol=1e-8)


def test_whitening_query_on_the_small_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    check_whitening(queries.op13_whitening(spark, SF), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, (rng.normal(size=5) * [5, 3, 1, 0.5, 0.1]).tolist()) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [NAN] * 5), (104, [INF, 1.0, 1.0, 1.0, 1.0])]
    check_whitening(whitening.whiten(vectors(spark, good + bad).repartition(7)), range(60), [v for _, v in good])
    # Repeated rows and rows without id count each time; another length is fitted apart.
    more = good + [good[0], (None, good[1][1]), (200, [1.0, 0.0]), (201, [0.0, 3.0]), (202, [0.0, 0.0])]
    got = whitening.whiten(vectors(spark, more))
    assert {(r["n"], r["rows"]) for r in got.groupBy("n").agg(F.count("*").alias("rows")).collect()} == {(62, 62 * 5), (3, 3 * 2)}
    assert got.where("vec_id is null").count() == 5


def test_whitening_without_variance(spark):
    line = [(i, [float(i), 2.0 * i, 0.5]) for i in range(20)]
    got = whitening.whiten(vectors(spark, line)).collect()  # rank 1
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)
    for rows in (line[:1], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], []):
        assert whitening.whiten(vectors(spark, rows)).count() == 0


def test_exact_deviation_beyond_a_long():
    x = np.array([[3_000_000_000, 1], [5, 7]], np.int64)
    n, sums = 4_000_000_000, [17, 23]
    assert whitening._deviations(x, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]


@pytest.mark.parametrize("rank", [1, 3, 7, 8])
def test_factor_and_rotations(rank):
    rng = np.random.default_rng(rank)
    a = rng.normal(size=(8, rank)) * 10.0 ** -np.arange(rank)
    scatter = a @ a.T
    factor, order = whitening.pivoted_cholesky(scatter)
    assert np.allclose(factor, np.tril(factor)) and np.all(np.diff(factor.diagonal()[: factor.shape[1]]) <= 0)
    np.testing.assert_allclose((factor @ factor.T), scatter[np.ix_(order, order)], atol=1e-12 * scatter.max())
    turned = whitening.one_sided_jacobi(factor)
    gram = turned.T @ turned
    assert np.abs(gram / np.sqrt(np.outer(gram.diagonal(), gram.diagonal())) - np.eye(len(gram))).max() < 1e-13
    values, vectors_ = whitening.eigen(scatter, 2)
    np.testing.assert_allclose(values, (np.linalg.svd(a, compute_uv=False) ** 2 / 2)[: len(values)], rtol=1e-2)  # the least are as exact as the scatter
    np.testing.assert_allclose(vectors_ @ vectors_.T, np.eye(len(values)), atol=1e-12)
