"""Corpus operators on small tables: brute force, round trips, and odd rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from texlith.llm import ann_search, exact_search, html_text, language_id, language_model, line_dedup, packing, sentencepiece_codec, shingle_join, token_counts
from texlith.llm.bpe import loaded

BPE = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = [" ", "  ", "\n", "\t", "'s", "'re", "'", "a", "é", "日本", "1", "²", "!", "...", "<|endoftext|>", " ", "\x1c", "\x85", "😀", "aaaaaaa", "don't", "we've "]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, repeated and long texts, a null id, and columns that clash with internal names."""
    same = " ".join(f"w{i}" for i in range(60))
    near = same.replace("w30 ", "x30 ")
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t", None), (4, same, "en"), (5, same, "fr"), (6, near, "en"), (None, "solo text here", None), (8, "short one", "en"), (8, "short one", "en"), (9, "x " * 30000, "de"), (10, "123 !!", "en")]
    return spark.createDataFrame([(*r, "s", 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, key int, n int, score int")


def test_bpe_equals_the_library():
    random.seed(1)
    texts = ["".join(random.choice(SIGNS) for _ in range(random.randint(0, 14))) for _ in range(3000)]
    want = [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in loaded(BPE).ids(texts)] == want
    assert loaded(BPE).counts(texts).tolist() == [len(x) for x in want]


def test_token_counts(odd):
    rows = token_counts.count_tokens(odd, BPE).collect()
    assert len(rows) == 11 and all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (1, 2))
    assert token_counts.count_tokens(odd.limit(0), BPE).count() == 0


def test_packing(odd):
    rows = packing.pack(odd, BPE).collect()
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) == -(-sum(r["length"] for r in rows) // 2048)
    assert next(r["ids_crc32"] for r in rows if r["doc_id"] == 1) == zlib.crc32(b"\0\0\0\0")
    assert packing.pack(odd.limit(0), BPE).count() == 0


def test_fullest_bin_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(30):
        counts = np.zeros(41, np.int64)
        np.add.at(counts, rng.integers(3, 30, 8), 1)
        seed = int(np.flatnonzero(counts)[-1])
        chosen = packing.fullest(counts, seed, 40)
        items = np.repeat(np.arange(41), counts).tolist()
        items.remove(seed)
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= 40 - seed}
        assert sum(k * m for k, m in chosen.items()) == seed + max(sums) and all(counts[k] >= m for k, m in chosen.items())


def test_language_id(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", language_id.held_out().alias("h"))
    rows = language_id.predict(docs, language_id.fit(docs.where("not h"))).where("h").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert {r["lang_pred"] for r in language_id.predict(odd, language_id.fit(odd)).where("doc_id in (1, 2, 3, 10)").collect()} == {"und"}
    assert language_id.keep_identified(odd).count() == 7 and language_id.predict(odd, language_id.fit(odd.limit(0))).count() == 11


def test_html():
    page = '<div id="main"><nav>x</nav><div class="sidebar">x</div><p>a&amp;b <b>c<br>d</p><ul><li>e<li>f</ul><!-- x --><script>"</p>"</script><div class="comments"><p>no</p></div></div>'
    assert html_text.extract(page) == "a&b c d\ne\nf" and html_text.extract("") == ""


def test_template_goes(spark):
    pages = [(i, "http://h.org/%d" % i, f"<body><section><p>Same words on all pages.</p></section><div><p>Own text {i}.</p></div></body>") for i in range(9)]
    pages += [(99, None, None), (98, "::", "<p>x"), (98, "::", "<p>x")]
    got = html_text.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == 12 and {r["text"] for r in got if r["page_id"] < 9} == {f"Own text {i}." for i in range(9)}


def test_shingle_join(spark, odd):
    got = {r["doc_id"]: r for r in shingle_join.link_components(odd).collect()}
    assert got[4]["component_id"] == got[5]["component_id"] == 4 and got[6]["component_id"] in (4, 6)
    assert got[1]["n_shingles"] == 0 and got[1]["component_id"] == 1 and got[8]["n_shingles"] == 1
    assert shingle_join.link_components(odd.limit(0)).count() == 0


def test_signatures_meet():
    """Any two sets at the threshold share a signature in their roles, with any classes."""
    rng = np.random.default_rng(5)
    for n in (1, 3, 5, 20, 60, 400, 3000):
        classes = np.where(rng.random(1 << 12) < rng.random(), 3, 0).astype(np.uint8)
        for _ in range(8):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            lost = int(rng.integers(0, n // 9 + 1))
            y = np.unique(np.concatenate((x[lost:], rng.integers(0, 2**63, int(lost), dtype=np.uint64))))
            common = len(np.intersect1d(x, y))
            if 100 * common < 80 * (len(x) + len(y) - common):
                continue
            big, small = (x, y) if len(x) >= len(y) else (y, x)
            a, ra, _ = shingle_join.signatures(big, classes)
            b, rb, _ = shingle_join.signatures(small, classes)
            assert np.intersect1d(a[ra & 1 > 0], b[rb & 2 > 0]).size
            assert shingle_join.apart_at_least(shingle_join.parity(x), shingle_join.parity(y)) <= len(x) + len(y) - 2 * common


def test_language_model(spark, odd, monkeypatch):
    docs = odd.selectExpr("doc_id", "false as held_out", "cast(text as binary) as text")
    direct = {r["doc_id"]: (r["n_tokens"], r["base_score"], r["score"]) for r in language_model.score(docs, language_model.train(docs.select("text"))).collect()}
    assert direct[1][0] == 1 and direct[4][0] == 61
    first = language_model.Store.__init__
    monkeypatch.setattr(language_model.Store, "__init__", lambda self, s: first(self, s, mapped=False))
    sent = {r["doc_id"]: (r["n_tokens"], r["base_score"], r["score"]) for r in language_model.score(docs, language_model.train(docs.select("text"))).collect()}
    assert sent == direct
    assert language_model.score(docs, language_model.train(docs.select("text").limit(0))).count() == 11


def test_kneser_ney_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "cast(text as binary) as text").withColumn("held_out", language_model.held_out())
    got = {r["doc_id"]: r for r in language_model.score(docs, language_model.train(docs.where("not held_out").select("text"), order=2)).collect()}
    words = {r["doc_id"]: [*bytes(r["text"]).lower().split(), b"</s>"] for r in docs.collect()}
    single, pair = Counter(), Counter()
    for d, t in words.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            single.update(t)
            pair.update(zip([b"<s>", *t], t))
    after = Counter(w for _, w in pair)
    total, kinds = Counter(), defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), k in pair.items():
        total[a] += k
        kinds[a][min(k, 3)] += 1

    def discounts(counts):
        t = Counter(counts)
        y = t[1] / (t[1] + 2 * t[2])
        return [0, *(k - (k + 1) * y * t[k + 1] / t[k] for k in (1, 2, 3))]

    d2, d1, n, v, mass = discounts(pair.values()), discounts(after.values()), single.total(), len(single), after.total()
    base = sum(d1[min(k, 3)] for k in after.values()) / mass / (v + 1)
    for d, t in words.items():
        want = 0.0
        for a, w in zip([b"<s>", *t], t):
            p = max(after[w] - d1[min(after[w], 3)], 0) / mass + base
            if total[a]:
                k = pair[a, w]
                p = max(k - d2[min(k, 3)], 0) / total[a] + sum(x * y for x, y in zip(d2, kinds[a])) / total[a] * p
            want += math.log10(p)
        assert got[d]["score"] == pytest.approx(want, rel=1e-6) and got[d]["train_tokens"] == n
        assert got[d]["base_score"] == pytest.approx(sum(math.log10((single[w] + 1) / (n + v + 1)) for w in t)) and got[d]["n_known"] == sum(single[w] > 0 for w in t)
    assert len(language_model.train(docs.select("text"), order=3).score([b"a b"])) == 4


def test_query_scores_by_trigrams(spark):
    """The query's scores equal brute force of an interpolated modified Kneser-Ney model of order 3."""
    got = {r["doc_id"]: r for r in language_model.query(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    words = {r["doc_id"]: ["<s>", "<s>", *(w.decode("latin-1") for w in (r["text"] or "").encode().lower().split()), "</s>"] for r in docs}
    counts = {3: Counter(), 2: Counter(), 1: Counter()}
    for d, t in words.items():
        if not got[d]["held_out"]:
            counts[3].update(zip(t, t[1:], t[2:]))
    for (_, b, c), k in counts[3].items():  # nothing stands before a begin: such pairs keep their counts
        counts[2][b, c] += k if b == "<s>" else 1
    counts[1].update(c for _, c in counts[2])
    known = {w for d, t in words.items() if not got[d]["held_out"] for w in t[2:]}

    def discounts(values):
        t = Counter(values)
        y = t[1] / (t[1] + 2 * t[2])
        return [0, *(min(max(k - (k + 1) * y * t[k + 1] / t[k], 0), k) for k in (1, 2, 3))]

    d = {n: discounts(c.values()) for n, c in counts.items()}
    mass, held = {}, {}
    for n in (2, 3):
        mass[n], held[n] = Counter(), Counter()
        for gram, k in counts[n].items():
            mass[n][gram[:-1]] += k
            held[n][gram[:-1]] += d[n][min(k, 3)]
    total = counts[1].total()
    back = sum(d[1][min(k, 3)] for k in counts[1].values()) / total / (len(known) + 1)
    for doc, t in words.items():
        want = 0.0
        for i in range(2, len(t)):
            k = counts[1][t[i]]
            p = (k - d[1][min(k, 3)]) / total + back
            for n in (2, 3):
                before = tuple(t[i - n + 1 : i])
                if mass[n][before]:
                    k = counts[n][(*before, t[i])]
                    p = (k - d[n][min(k, 3)]) / mass[n][before] + held[n][before] / mass[n][before] * p
            want += math.log10(p)
        assert got[doc]["score"] == pytest.approx(want, rel=1e-6)


def test_line_dedup(spark, odd):
    block = "\n".join(f"line {i} of a passage that stands in two places" for i in range(12))
    docs = spark.createDataFrame([(1, "own start\n" + block), (2, "another one\n" + block + "\nand an end"), (3, None), (4, ""), (5, "one line")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] > 6 and got[2]["text"].startswith("another one") and got[3]["text"] is None and got[4]["text"] == ""
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(line_dedup.ORACLE).fetchall()
    mine = line_dedup.dedup_lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).drop("key").collect()
    assert sorted(want) == sorted(tuple(r) for r in mine)
    assert line_dedup.without_repeats(odd).columns == odd.columns and line_dedup.dedup_lines(odd).count() == 11


def test_short_passages_go(spark):
    """Passages of 2 to 6 lines and over 50 words between lines of one's own: the later copy goes whole, all else stays."""
    rng = random.Random(8)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, want = [], {}
    for k in range(40):
        passage = [line(60 // (2 + k % 5) + 2) for _ in range(2 + k % 5)]
        for doc_id in (k, 100 + k):
            before, after = [line(9) for _ in range(4)], [line(9) for _ in range(4)]
            rows.append((doc_id, "\n".join(before + passage + after)))
            want[doc_id] = rows[-1][1] if doc_id < 100 else "\n".join(before + after)
    few = line(20) + "\n" + line(20)
    rows += [(200, "a b\n" + few), (201, "c d\n" + few), (202, None), (203, ""), (204, "\n")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in want} == want and {k: got[k] for k in (202, 203, 204)} == {202: None, 203: "", 204: "\n"}
    assert got[200] == "a b\n" + few and got[201].startswith("c d")


def test_vector_searches(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 16))
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [None] * 16), (1002, [float("nan")] * 16), (1100, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in exact_search.top_k(df, block_rows=100).collect()}
    w, ids = np.vstack((np.floor(x * 1024), np.zeros(16))).astype(int), np.append(np.arange(300), 1100)
    for q in (0, 100, 200, 1100):
        at = int(np.flatnonzero(ids == q)[0])
        order = [j for j in np.lexsort((ids, -(w @ w[at]))) if j != at][:10]
        assert [got[q, k + 1] for k in range(10)] == [(ids[j], w[at] @ w[j]) for j in order]
    near = ann_search.nearest(df, block_rows=100).collect()
    hit = sum(r["vec_id"] in set(np.argsort(-np.where(np.arange(300) == r["query_id"], -np.inf, x @ x[r["query_id"]]), kind="stable")[:20].tolist()) for r in near)
    assert hit / len(near) > 0.9 and exact_search.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("norms", ["equal", "lognormal", "one long"])
def test_neighbours_are_found_with_any_norms(spark, norms):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "lognormal":
        x *= np.exp(rng.normal(0, 0.5, 3000))[:, None]
    if norms == "one long":
        x[7] *= 10
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann_search.nearest(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert len(got) == 150 and all(len(v) == 20 for v in got.values())
    hit = sum(len(v & set(np.argsort(-np.where(np.arange(3000) == q, -np.inf, x @ x[q]))[:20].tolist())) for q, v in got.items())
    assert hit / 3000 > 0.99


def test_sentencepiece(odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    random.seed(2)
    texts = ["", " "] + ["".join(random.choice([*SIGNS, "▁", "<s>", "<0x0A>", "\x00", "th", "ing"]) for _ in range(random.randint(0, 14))) for _ in range(2000)]
    reference = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = codec.encode(texts)
    assert ids == reference.encode(texts) and codec.decode(ids) == reference.decode(ids)
    assert all(r["parity"] for r in sentencepiece_codec.encode_and_decode(odd, path).collect())
