"""Every operator against plain Python on a table of awkward rows and on the small test tables."""

import gzip
import hashlib
import math
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from touchline.llm import decontaminate, jaccard, kneser_ney, licenses, line_templates, permutation_index, queries, sentencepiece_bpe, substrings, urls, warc
from touchline.plans.materialize import shuffles_freed

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"word{i}" for i in range(60))
LONG = " ".join(f"w{i % 977}x{i % 89}" for i in range(40_000))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Under The MIT  license, under the mit license"), (5, PASSAGE), (6, f"Before it. {PASSAGE} after it"),
    (7, PASSAGE), (8, PASSAGE), (9, LONG), (10, LONG + " one more"), (11, "a b"), (12, "A  b"), (13, "ÉÀ ß 漢字 🙂 cc-by-nc apache license, version 2"),
    (None, "no id " + PASSAGE), (None, None), (14, PASSAGE + "\n" + PASSAGE), (8, PASSAGE), (15, " ".join(["same"] * 70)), (16, "\x00 zero\x00 K İ"),
    (17, "Avant. Un deux trois voilà quatre cinq six sept huit neuf dix. Après"), (18, "да Россия будет хорошо жить в мире и труде всегда и везде вместе"),
    (19, "Åse gick\u00a0hem 漢字\u0085はさ る"),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, block string, found string, k_text string, t_text string"


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en" if k % 3 else None, "s", len(t) if t else None, "x", "y", "z", "k", "l") for k, (i, t) in enumerate(TEXTS)], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def plain(df):
    return [r.asDict() for r in df.collect()]


def same(df, columns, expected):
    def key(row):
        return tuple((x is None, x) for x in row)

    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == sorted(expected, key=key)


def stored(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


ITEMS = [(1, " ".join(f"word{i}" for i in range(5, 30))), (2, "license under"), (3, None), (4, "!!"), (None, PASSAGE), (5, "license, UNDER"), (5, "license, UNDER"), (10, "漢字 🙂"),
         (11, "un deux trois voilà quatre cinq six sept huit neuf dix"), (12, "Россия будет хорошо жить в мире и труде всегда и"), (13, "Åse gick\u00a0hem"), (14, "漢字\u0085はさ")]


@pytest.mark.parametrize("small", [False, True])
def test_decontamination(spark, docs, none, monkeypatch, small):
    if small:
        monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 500)  # several automata
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.find(docs.select("doc_id", "text"), items)
    digest = F.sha2(F.array_join(F.array_sort(F.transform("found.items", lambda i: i.cast("string"))), ","), 256)
    hit = F.aggregate("found.hits", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    got = got.select("doc_id", "found.n_words", hit.alias("n_hit"), F.size("found.items").alias("n_items"), digest.alias("d"), (hit > 0).alias("c"))
    same(got, got.columns, brute.decontamination(plain(docs), plain(items)))
    assert decontaminate.drop_contaminated(none, items).count() == 0
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert Counter(r[0] for r in kept.select("doc_id").collect()) == Counter(d["doc_id"] for d, b in zip(plain(docs), brute.decontamination(plain(docs), plain(items)), strict=True) if not b[-1])
    assert decontaminate.find(docs, items.limit(0), into="hits_").where("size(hits_.items) > 0").count() == 0


def test_decontamination_keeps_columns_of_any_case(spark):
    docs = spark.createDataFrame([(1, "quick brown", "mine"), (2, "other", "yours")], "doc_id long, text string, Found string")
    items = spark.createDataFrame([(7, "quick brown")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.drop_contaminated(docs, items).collect()] == [(2, "other", "yours")]


def test_encoding_refuses_a_taken_name(spark):
    docs = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, Pieces string")
    with pytest.raises(ValueError, match="pieces"):
        sentencepiece_bpe.encode(docs, queries.MODEL)
    assert sentencepiece_bpe.encode(docs, queries.MODEL, "own").columns == ["doc_id", "text", "Pieces", "own"]


def test_decontamination_offsets(spark):
    docs = spark.createDataFrame([(1, "Ünd — the QUICK, brown 🙂 fox.")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "quick brown")], "item_id long, text string")
    found = decontaminate.find(docs, items).first()
    assert [found["text"][a:b] for a, b in found["found"]["chars"]] == ["QUICK, brown"]


def test_licenses(docs, none):
    columns = "doc_id n_words n_base first_word last_word base_labels".split()
    same(licenses.scan(docs), columns, brute.licenses(plain(docs), licenses.PHRASES))
    assert licenses.scan(none).count() == 0
    assert licenses.scan(docs, {}, {}).where("n_base > 0 or labels <> ''").count() == 0


def test_licenses_with_many_places(spark):
    """Places are folded to their count, first and last, whatever their number."""
    rows = [(1, "x " + "cc by nc " * 20_000 + "under the MIT license"), (2, "cc by nc"), (3, "cc by")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates={})
    same(got, ["doc_id", "n_base", "first_word", "last_word", "base_labels"], [(1, 20_001, 1, 60_001, "cc-by-nc,mit"), (2, 1, 0, 0, "cc-by-nc"), (3, 0, None, None, "")])


def test_license_blocks_are_all_found(spark):
    wording = "released under the mit license by example people and their friends today".split()
    lines = [" ".join(wording[:n]) for n in range(1, 13)] + ["x " + " ".join(reversed(wording)), "", "the mit"]
    docs = spark.createDataFrame([(i, "first line\n" + t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"] for r in licenses.scan(docs, {}, {" ".join(wording): "w"}, 0.8).where("labels = 'w'").collect()}
    assert got == {i for i, t in enumerate(lines) if len(set(t.split()) & set(wording)) >= math.ceil(0.8 * len(wording))}


def test_licenses_across_lines_and_far_apart(spark):
    """Notices wrapped over lines are found; words that lie far apart are none."""
    wrapped = {1: ("Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that", "bsd"),
               2: ("This work is licensed under the GNU\r\n# General Public License,\n# version 3.", "gpl-3"),
               3: ("Licensed under the Mozilla\nPublic License, version 2.0", "mpl-2"), 4: ("Licensed under\nCC BY-SA\n4.0", "cc-by-sa")}
    rows = [(10 * i + k, "own words " * k + text) for i, (text, _) in wrapped.items() for k in range(8)]
    rows += [(900 + i, (" filler" * 200 + " ").join(t.split())) for i, t in enumerate(licenses.TEMPLATES)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["labels"] for r in found}
    assert len(found) == len(rows)
    assert {i: {got[10 * i + k] for k in range(8)} for i in wrapped} == {i: {label} for i, (_, label) in wrapped.items()}
    assert all(got[900 + i] == "" for i in range(len(licenses.TEMPLATES)))


def test_line_templates(spark, docs, none):
    rows = [(i, f"Own line number {i} of {'abcdefghijklmnopqrstuvwxyz'[i % 26] * (i + 3)} kind\nSeen {i} times by reader{i} of this page\nplain text {i}") for i in range(30)]
    rows += [(100 + i, "A copied document of some words\nand its second line here") for i in range(40)] + [(200, None), (201, ""), (202, "Seen 7 times by reader7 of this page")]
    out = {r["doc_id"]: r for r in line_templates.mark(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Seen" not in out[i]["t_text"] and "Own line" in out[i]["t_text"] for i in range(30))
    assert all(out[100 + i]["t_dropped"] == 0 for i in range(40))  # recurs only as its document is copied
    assert out[200]["t_text"] is None and out[201]["t_text"] == "" and out[202]["t_text"] == ""
    assert line_templates.drop_lines(docs).columns == docs.columns
    assert line_templates.drop_lines(docs).count() == len(TEXTS)
    assert line_templates.drop_lines(none).count() == 0


def _own(i, k):
    """Lines that no other document has."""
    return [" ".join(hashlib.md5(f"{i} {j} {w}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop")) for w in range(5)) for j in range(k)]


def test_line_templates_among_copies_and_together(spark):
    """Neither hot copies nor lines that stand together, blank ones included, keep a template; copies and near copies do."""
    note, shared = "All of these words stand everywhere", "Another of those lines stands there"
    rows = [(i, "\n".join([note, "", *_own(i, 3), shared])) for i in range(60)]
    rows += [(1000 + i, "\n".join([note, *_own(-1, 4)])) for i in range(200)]
    near = [f"{x} of near copies that stays" for x in _own(-2, 12)]
    rows += [(2000 + i, "\n".join([*near[: i % 12], f"{near[i % 12]} {_own(i, 1)[0][:32]}", *near[i % 12 + 1 :]])) for i in range(60)]
    out = {r["doc_id"]: r for r in line_templates.mark(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i]["t_dropped"] == 2 and note not in out[i]["t_text"] and shared not in out[i]["t_text"] for i in range(60))
    assert all(out[1000 + i]["t_text"].split("\n") == _own(-1, 4) for i in range(200))
    assert all(out[2000 + i]["t_dropped"] == 0 for i in range(60))


@pytest.mark.parametrize("line", ["Posted by {a}", "Posted by {a} on {b}", "one two three {a} {c} six seven eight nine ten", "Seen at {a} in the town of {b} by {c} of us"])
def test_line_templates_with_fields(spark, line):
    """Fields of any number and place; some words of a field are frequent themselves."""
    names, days = [x.split()[0] for x in _own(-3, 9)], "Monday Tuesday Wednesday Thursday Friday".split()
    rows = [(i, "\n".join([line.format(a=names[i * i % 9], b=days[i % 5], c=_own(i, 1)[0].split()[1]), *_own(i, 3)])) for i in range(120)]
    out = line_templates.mark(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["t_text"].split("\n") == _own(r["doc_id"], 3) for r in out)


def test_substrings(docs, none, spark):
    got = substrings.drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("d"), "spans")
    same(got, ["doc_id", "n_words", "n_removed", "d"], brute.substrings(plain(docs)))
    assert got.where("n_removed <> aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)").count() == 0
    assert substrings.drop_repeats(none).count() == 0
    same(queries.op5_substring_dedup(spark, SF), ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.substrings(plain(stored(spark, "documents"))))


@pytest.mark.parametrize("blocks", [(512, 2048), (2, 3)])
def test_jaccard(docs, none, spark, monkeypatch, blocks):
    monkeypatch.setattr(jaccard, "OUTLIERS", blocks[0])
    monkeypatch.setattr(jaccard, "NODES", blocks[1])
    near = [(1000 + i, " ".join(f"t{j if j % 60 != i % 60 else f'e{i}'}" for j in range(60 + i % 7))) for i in range(40)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    for size, percent in ((4, 85), (5, 80)):
        same(jaccard.link(table, size, percent), ["doc_id", "n_shingles", "component_id"], brute.jaccard(plain(table), size, percent))
    assert jaccard.link(none).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and jaccard.keep_one(none).count() == 0
    expected = brute.jaccard(plain(docs), 5, 80)
    groups = {c for (_, n, c) in expected if n}
    assert kept.count() == len(groups) + sum(1 for _, n, _ in expected if not n)


URLS = [None, "", "no scheme", "http://", "http://Net", "https://x.NET/", "http://example.net/en/a?b#c", "http://example.net/en", "http://a.example.com/de/x", "ftp://org/fr/?q",
        "http://notexample.com/de/", "http://a..net/x", "http://net?x/y", "http://h.example.net#/en/", "http://ü.example.com/de/", "x://y://net/", "http://net/" + "p" * 5000]


def test_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block"), ("h.example.net", "", "allow")]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)] + [(None, "http://net/", "", ""), (3, "http://net/", "", "")], "page_id long, url string, host string, verdict string")
    table = spark.createDataFrame(rules + [(None, "/", "block")], "host string, path string, verdict string")
    same(urls.judge(pages, table), ["page_id", "host", "path", "rule", "verdict"], brute.url_verdicts(plain(pages), rules))
    assert urls.judge(pages.limit(0), table).count() == 0
    assert urls.judge(pages, table.limit(0)).where("verdict <> 'allow' or rule is not null").count() == 0


def test_sentencepiece(spark, docs, none):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    table = docs.select("doc_id", "text").union(stored(spark, "documents").select("doc_id", "text"))
    rows = sentencepiece_bpe.encode(table, queries.MODEL, check=True).collect()
    assert len(rows) == table.count() and all(r["pieces"]["agrees"] for r in rows)
    for r in rows:
        assert r["pieces"]["ids"] == library.encode(r["text"] or "") and r["pieces"]["decoded"] == library.decode(r["pieces"]["ids"])
    assert sentencepiece_bpe.encode(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    codec = sentencepiece_bpe.Codec(open(queries.MODEL, "rb").read())
    random = np.random.default_rng(5)
    for ids in ([int(x) for x in random.choice([*range(3, 300), 28705], size=6)] for _ in range(2000)):
        assert codec.decode(ids) == library.decode(ids)
    part = "x" * 200 + "ing" * 40
    assert codec.encode(part) == library.encode(part)


def test_sentencepiece_merges_the_parts_of_many_texts_together():
    """Words, marks and characters outside the vocabulary in every order, short and long parts, in one call."""
    library = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    codec = sentencepiece_bpe.Codec(open(queries.MODEL, "rb").read())
    assert codec.cut.findall("▁▁a.b▁(word),\n▁") == ["▁▁a", ".", "b", "▁(", "word", "),\n", "▁"]
    random = np.random.default_rng(7)
    signs = [*"abcdest", "the", "ing", " ", "  ", *".,!?()'\"/\n\r\t\0=-", "’", "²", "…", "“", "é", "ß", "語", "🙂", "▁", "7", "2024", "x" * 50, "e" * 47]
    texts = [None, "", " ", "\0", "a\0"] + ["".join(random.choice(signs, size=n)) for n in random.integers(1, 60, 3000)]
    want = [library.encode(t or "") for t in texts]
    assert [np.frombuffer(x, "<i4").tolist() for x in codec.encode_all(texts)] == want
    assert [codec.encode(t) for t in texts[:300]] == want[:300]  # from the table of known parts, text by text


def test_sentencepiece_query_and_pipeline_check_with_the_library(spark, docs, tmp_path):
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    whole = queries.op8_sentencepiece(spark, folder).collect()
    assert whole and all(r["agrees"] is True for r in whole)
    last = corpus_pipeline.encoding(spark, queries.table(spark, folder, "documents"), folder).collect()
    assert Counter(last) == Counter(whole)


def brute_perplexity(trusted, texts, order):
    """Interpolated modified Kneser-Ney by dictionaries."""
    def signs(text):
        lower = "".join(c.lower() if c.isascii() else c for c in text)
        words = [w for w in re.split(r"[ \t-\r]+", lower) if w]
        return [0] * (order - 1) + words + [1] if words else []

    counts = Counter()
    for t in trusted:
        s = signs(t)
        counts.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    stats = {}
    for k, c in levels.items():
        n = [sum(1 for v in c.values() if v == i) for i in range(5)]
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.01), i) for i in (1, 2, 3)]
        else:
            d = [0.5, 1.0, 1.5]
        total, left = defaultdict(float), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            left[g[:-1]] += d[min(v, 3) - 1]
        stats[k] = d, total, left

    def p(g):
        if not g:
            return 1 / (len(levels[1]) + 1)
        d, total, left = stats[len(g)]
        h = g[:-1]
        if not total[h]:
            return p(g[1:])
        v = levels[len(g)][g]
        return ((v - d[min(v, 3) - 1]) if v else 0) / total[h] + left[h] / total[h] * p(g[1:])

    out = []
    for t in texts:
        s = signs(t or "")
        logs = [math.log(p(tuple(s[i : i + order]))) for i in range(len(s) - order + 1)]
        out.append(math.exp(-sum(logs) / len(logs)) if logs else None)
    return out


@pytest.mark.parametrize("order", [2, 4])
def test_kneser_ney(spark, docs, none, order):
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (6, 1, None), (13, 1, 0), (11, 0, 0), (4, 1, 1), (9, 1, 0), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    texts = [t for _, t in TEXTS if t != LONG and t != LONG + " one more"]
    held = {r["key"] for r in kneser_ney.trusted_texts(docs, labels).where("held").collect()}
    trusted = [t for i, t in TEXTS if i in (5, 6, 13) and hashlib.md5(t.encode()).hexdigest() not in held]
    assert trusted
    got = kneser_ney.judge(docs, labels, order=order).collect()
    have = [r["perplexity"] for r in got if r["doc_id"] not in (9, 10)]
    want = brute_perplexity(trusted, texts, order)
    assert sorted((x for x in have if x), key=float) == pytest.approx(sorted((x for x in want if x), key=float), rel=1e-4)
    assert all(r["keep"] for r in got if r["perplexity"] is None or r["doc_id"] in (5, 6))
    kept = kneser_ney.drop_poor(docs, labels, order=order)
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in got)
    assert kneser_ney.judge(none, labels, order=order).count() == 0
    assert kneser_ney.judge(docs, labels.limit(0), order=order).where("keep").count() == len(TEXTS)


def test_kneser_ney_moves_texts_and_answers_compressed():
    """Both come back whole, and take less than half of what they did plain."""
    values = ["", "ü" * 3, "one\0two"] + [f"word{i} and others, " * 40 for i in range(50)]
    rows = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(values))] * 2), pa.array(values * 2)], ["key", "text"])
    moved = pa.Table.from_batches(kneser_ney._once([rows]))
    assert kneser_ney._texts(moved).to_pylist() == values
    assert moved.column("text").nbytes < sum(map(len, values)) / 2
    random = np.random.default_rng(3)
    n = random.choice([0, 0, 0, 1, 2, 254, 255, 256, 70_000], 10_001).astype("<f4")
    history = random.random(10_001) < 0.1
    total, left = np.where(history, n + 3, 0).astype("<f4"), np.where(history, n * 0.7, 0).astype("<f4")
    for sums in ((n, total, left), (n[:0], total[:0], left[:0]), (n * 0, total, left * 0)):
        assert (kneser_ney._unpacked(kneser_ney._packed(*sums)) == np.stack(sums)).all()
    assert len(kneser_ney._packed(np.minimum(n, 3), total, left)) < (n.nbytes + total.nbytes + left.nbytes) / 4


def test_kneser_ney_rounds_give_the_same_and_move_less_at_once(spark, docs, monkeypatch):
    """Slices of the texts one after the other: the same scores, no question left out, and no write that moves all texts."""
    rng = np.random.default_rng(5)
    made = [(1000 + i, " ".join(f"w{w}" for w in rng.zipf(1.3, 300) % 5000), "en") for i in range(240)]
    docs = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(made + made[:40], "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(1000 + i, int(i % 2 == 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")

    def judged():
        return sorted(kneser_ney.judge(docs, labels).collect(), key=lambda r: (str(r["doc_id"]), str(r["lang"]), r["perplexity"] or 0))

    asked, questions = [], kneser_ney.blocks.sizes(docs, "text")[0]
    deal = kneser_ney._dealt

    def dealt(rows, n_blocks, rounds):
        parts = deal(rows, n_blocks, rounds)
        asked.append([p.select("key").distinct().count() for p in parts])
        assert n_blocks * rounds >= questions
        return parts

    monkeypatch.setattr(kneser_ney, "_dealt", dealt)
    whole = judged()
    monkeypatch.setattr(kneser_ney, "ROUND_BYTES", 1)
    sliced = judged()
    assert [len(a) for a in asked] == [1, kneser_ney.ROUNDS]
    assert sum(asked[1]) == asked[0][0] and max(asked[1]) < asked[0][0] / 2
    assert [r["doc_id"] for r in sliced] == [r["doc_id"] for r in whole]
    assert [r["keep"] for r in sliced] == [r["keep"] for r in whole]
    assert [r["perplexity"] or 0 for r in sliced] == pytest.approx([r["perplexity"] or 0 for r in whole], rel=1e-9)


def test_shuffle_files_go_with_their_action(spark, tmp_path):
    """Two writes within ``shuffles_freed`` leave no map outputs behind; the setting is as before afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with shuffles_freed(spark):
        assert spark.conf.get(name) == "true"
        for i in range(2):
            spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count().write.parquet(f"{tmp_path}/{i}")
    assert spark.conf.get(name, None) == before
    assert spark.read.parquet(f"{tmp_path}/0", f"{tmp_path}/1").count() == 20


def test_kneser_ney_limits_with_a_hot_text(spark):
    """Copies of held-out texts change no limit."""
    docs, labels = stored(spark, "documents").select("doc_id", "text", "lang"), stored(spark, "labels")
    held = kneser_ney.trusted_texts(docs, labels).where("held").orderBy("key").limit(2).collect()
    hot = docs.where(F.md5("text").isin([r["key"] for r in held])).crossJoin(spark.range(1, 400)).select((F.col("id") * 100_000 + F.col("doc_id")).alias("doc_id"), "text", "lang")

    def limits(table):
        return {r["lang"]: r["limit"] for r in kneser_ney.judge(table, labels).select("lang", "limit").distinct().collect()}

    assert limits(docs.union(hot)) == pytest.approx(limits(docs))


def test_kneser_ney_on_held_out_labels(spark):
    """Trained on even ids, judged on odd ones: good documents stay, poor ones mostly go."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    out = kneser_ney.judge(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1 and toxic = 0"), "doc_id")
    share = {r["quality"]: r["k"] for r in out.groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("k")).collect()}
    assert share[1] > 0.97 and share[0] < 0.5


@pytest.mark.parametrize("version", ["1", "2"])
def test_archives(spark, version):
    big, other = "<p>" + "ü" * 900, "y" * 1000
    rows = [(1, "http://a/ b\n", big), (2, None, big), (9, "", big), (9, "again", big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"),
            (7, "u", "WARC/1.1\r\n\r\n" * 200), (None, "u", other), (8, "u", other), (None, "u", "z" * 2000), (None, "v", "z" * 2000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, value string")
    got = warc.archive(pages, version)
    same(got, "page_id payload_bytes payload_digest record_type refers_to".split(), brute.archives(plain(pages)))
    assert warc.archive(pages.limit(0), version).count() == 0
    with pytest.raises(ValueError, match="version"):
        list(warc.read_arc(warc.arc_file("n", [], "1").replace(b"\n1 0", b"\n9 0")))
    with pytest.raises(ValueError, match="shorter"):
        list(warc.read_arc(warc.arc_file("n", [(1, "u", "body")], version)[:-4]))
    twice = warc.archive(pages.union(pages), version).select("record_id", "record_type", "refers_to").toPandas()
    assert twice["record_id"].nunique() == len(twice) == 2 * len(rows)


@pytest.mark.parametrize("version", ["1", "2"])
def test_foreign_archives(spark, tmp_path, monkeypatch, version):
    """Bytes that are no text, spaces in urls and types, urls of other encodings, files bounded by bytes."""
    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    more = b"" if version == "1" else b" 200 - - 0 n"
    bodies = [b"caf\xe9\r\n\r\n", b"\x00\xff" * 700, b"\x00\xff" * 700, b"", bytes(range(256)) * 30]
    raw = warc.arc_file("n", [], version)
    for i, body in enumerate(bodies):
        raw += b"http://h/a b/caf\xe9 %d 20011231235959 text/html; charset=latin-1%s %d\n" % (i, more, len(body)) + body + b"\n"
    assert [r[1:5] for r in warc.read_arc(raw)] == [("http://h/a%20b/caf%E9", str(i), "20011231235959", "text/html; charset=latin-1") for i in range(5)]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame([("x.arc", raw), ("y.arc", raw)], "name string, arc binary"), path)
    got = warc.read_warc(spark, path).toPandas()
    assert len(got) == got["record_id"].nunique() == 10
    for r in got.itertuples():
        body = bodies[int(r.page_id)]
        assert (r.payload_bytes, r.payload_digest, r.date) == (len(body), hashlib.sha1(body).hexdigest(), "2001-12-31T23:59:59Z")
        assert r.record_type == ("revisit" if r.page_id == 1 else "response")
        assert r.record_type == "revisit" or bytes(r.payload) == body
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "w").glob("*.gz")]
    assert max(sizes) < 5000 + len(bodies[-1]) + 1000


def test_permutation_index(spark, monkeypatch):
    for name, value in (("LEAST", 7), ("PIVOTS", 128), ("LENGTH", 64), ("SHARD_ROWS", 1024), ("QUERY_ROWS", 64)):
        monkeypatch.setattr(permutation_index, name, value)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", F.lit(1).alias("v"), F.lit(1).alias("dim"))
    odd = [(100_000, None), (100_020, []), (100_040, [0.0] * 64), (100_060, [float("nan")] * 64), (100_080, [1.0, None] * 32), (None, [1.0] * 64), (100_100, [float("inf")] * 64)]
    hot = [(200_000 + i, [0.125] * 64) for i in range(60)]
    more = spark.createDataFrame([(*r, 0, 0) for r in odd + hot], "vec_id long, embedding array<float>, v int, dim int")
    out = permutation_index.search(table.union(more), F.col("vec_id") % 20 == 0).toPandas()
    frame = table.toPandas()
    ids = np.concatenate([frame["vec_id"].to_numpy(), [i for i, _ in hot]])
    vectors = np.concatenate([np.array(frame["embedding"].tolist(), np.float64), np.array([v for _, v in hot], np.float64)])
    place = {int(i): k for k, i in enumerate(ids)}
    asked = {i for i in place if i % 20 == 0}
    assert set(out["query_id"]) == asked
    found = 0
    for q, part in out.groupby("query_id"):
        part = part.sort_values("rank")
        scores = vectors @ vectors[place[q]]
        order = [int(ids[k]) for k in np.lexsort((ids, -scores)) if ids[k] != q][:20]
        assert list(part["rank"]) == list(range(1, 21)) and q not in set(part["vec_id"])
        assert np.allclose(part["score"], scores[[place[i] for i in part["vec_id"]]], atol=1e-9)
        found += len(set(order) & set(part["vec_id"]))
        if q >= 200_000:  # a common vector: the smallest ids of its copies
            assert list(part["vec_id"]) == [i for i, _ in hot if i != q][:20]
    assert found / (20 * len(asked)) >= 0.9
    # With the parameters of the query the index is in use, and enough is found, at every size.
    monkeypatch.undo()
    for scale in ("0.01", "0.1"):
        table = spark.read.parquet(f"/root/testdata/sf{scale}/embeddings.parquet")
        frame = table.orderBy("vec_id").toPandas()
        ids, vectors = frame["vec_id"].to_numpy(), np.array(frame["embedding"].tolist(), np.float64)
        kept = next(permutation_index._candidates(vectors, vectors[:1], vectors[:400], 20))
        assert len(kept) == max(200, np.ceil(0.15 * len(ids))) < len(ids)
        got = permutation_index.search(table, F.col("vec_id") % 20 == 0).groupBy("query_id").agg(F.collect_list("vec_id").alias("near")).toPandas()
        found = 0
        for q, near in zip(got["query_id"], got["near"], strict=True):
            scores = vectors @ vectors[ids == q][0]
            found += len(set(near) & set([int(i) for i in ids[np.lexsort((ids, -scores))] if i != q][:20]))
        assert len(got) == (ids % 20 == 0).sum() and found / (20 * len(got)) >= 0.9
    few = permutation_index.search(table.where("vec_id < 5"), F.col("vec_id") % 20 == 0)
    assert few.count() == 4
    assert permutation_index.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_footrule_order():
    """The rows kept for a query are those of the least footrule distance, summed plainly over all pivots."""
    rng = np.random.default_rng(1)
    vectors, pivots = rng.normal(size=(300, 16)), rng.normal(size=(40, 16))
    length = 40
    places = np.argsort(np.argsort(-vectors @ pivots.T, axis=1), axis=1)
    for i, kept in enumerate(permutation_index._candidates(vectors, vectors[:5], pivots, 3)):
        footrule = np.abs(np.minimum(places, length) - np.minimum(places[i], length)).sum(1)
        assert len(set(kept.tolist())) == 45 and i in kept
        assert footrule[kept].max() <= np.delete(footrule, kept).min()
