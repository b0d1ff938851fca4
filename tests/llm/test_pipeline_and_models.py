"""The pipeline's stages and chain on odd tables, library parity on whole documents, and models against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from texlith.llm import _common, bpe, exact_search, language_id, language_model, packing, shingle_join, stores, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n: int) -> str:
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_strings_that_fool_polynomial_hashes():
    texts = [f"{s}\n{s.translate(str.maketrans('ab', 'ba'))}" for s in map(thue_morse, (512, 1024, 2048, 4096, 8192))]
    want = [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.loaded(BPE).ids(texts)] == want and bpe.loaded(BPE).counts(texts).tolist() == [len(x) for x in want]
    hashes, _ = _common.word_hashes([t.encode() for t in texts])
    assert len(set(hashes.tolist())) == 2 * len(texts)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["all of these words have one hash, all of them", "of them"]
    assert [x.tolist() for x in bpe.loaded(BPE).ids(texts)] == [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]


def test_whole_documents_equal_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = dict(zip(text, (e.ids for e in Tokenizer.from_file(BPE).encode_batch(list(text.values()), add_special_tokens=False)), strict=True))
    for r in token_counts.count_tokens(docs, BPE).collect():
        assert (r["n_tokens"], r["n_bytes"]) == (len(ids[r["doc_id"]]), len(text[r["doc_id"]].encode())) and r["over_limit"] == (r["n_tokens"] > 512)
    pieces = defaultdict(list)
    for r in packing.pack(docs, BPE, capacity=256).collect():
        pieces[r["doc_id"]].append(r)
    assert pieces.keys() == ids.keys()
    for doc, held in pieces.items():
        whole, at = np.array([*ids[doc], 0], "<u4"), 0
        for k, r in enumerate(sorted(held, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(whole[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(whole) and (len(held) == 1 or all(r["length"] == 256 for r in held if r["piece"]))


WORDS = ["", " ", "a", "a b", "a b c", "A  b\tc d", "a b c d e", "a b c d e f", "x y"]


def linked(rows: list[tuple]) -> dict:
    """Components by all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least, links = {i: i for i in sets}, [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {i: (len(sets[i]), least[i]) for i in sets}


@pytest.mark.parametrize("text", ["", "a b", "a b c", "a b c d e f"])
def test_join_of_one_row(spark, text):
    rows = [(7, text)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(rows)


def test_slices_of_few_words():
    for text in WORDS:
        assert [len(s) for s in shingle_join.shingle_sets([text.encode()])] == [linked([(7, text)])[7][0]]


def test_join_of_short_and_near_texts(spark):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate([*WORDS, *WORDS, None])]
    base = [rng.choice("pqrstuvwxyz") + str(rng.randrange(40)) for _ in range(60)]
    for i in range(30):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"n{rng.randrange(9)}"
        rows.append((100 + i, " ".join(words[: rng.randrange(40, 61)])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(rows)


def test_naive_bayes_equals_brute_force(spark):
    """Predictions and scores by counters of the same n-grams, hashed in Python."""
    rng = random.Random(2)
    letters = {"en": "aeioutnshr", "xx": "zqxkwvbpøé", "yy": "日本語aei"}
    rows = [(i, " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 9))), k) for i, k in enumerate(rng.choices(list(letters), k=60))]
    rows += [(90, None, "en"), (91, "", "xx"), (92, "12 !", None), (93, "aé", None), (94, "a", None)]
    buckets, smoothing = 1 << 8, 0.5

    def grams(text: str) -> list[int]:
        t, out = "".join(c if c.isalpha() else " " for c in f"\n{(text or '').lower()}"), []
        t = "".join(c for i, c in enumerate(t) if c != " " or i == 0 or t[i - 1] != " ")
        for n, spread in enumerate(language_id._SPREAD[1:], 2):
            for i in range(len(t) - n + 1):
                v = ord(t[i]) * language_id._SPREAD[0] % 2**32
                for k, odd in enumerate(language_id._SPREAD[1:n], 1):
                    v = (v * 0x01000193 + ord(t[i + k]) * odd) % 2**32
                out.append(((v ^ v >> 15) * 0x2C1B3C6D % 2**32) >> 24)
        return out

    counts, seen = {k: Counter() for k in letters}, Counter()
    for _, t, k in rows:
        if k:
            seen[k] += 1
            counts[k].update(grams(t))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.predict(df, language_id.fit(df, buckets, smoothing)).collect()}
    for i, t, _ in rows:
        log = {k: math.log(seen[k] / seen.total()) + sum(math.log((counts[k][g] + smoothing) / (counts[k].total() + smoothing * buckets)) for g in grams(t)) for k in sorted(letters)}
        best = max(log, key=log.get)
        if not any(c.isalpha() for c in t or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
        else:
            assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(1 / sum(math.exp(v - log[best]) for v in log.values()), rel=1e-4)


def test_identified(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang")
    model = language_id.fit(docs)
    assert language_id.identified(model, ["the and of it", "", "12", "a", "北京大学生活动中心今天开放给所有的学生和老师们来参加活动", "北京"]).tolist() == [True, False, False, True, False, True]
    assert language_id.identified(language_id.fit(docs.limit(0)), ["a", "1", ""]).tolist() == [True, False, False]
    many = spark.range(300).selectExpr("'x' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError):
        language_id.fit(many)


def test_files_that_are_gone_raise(spark, tmp_path):
    docs = spark.createDataFrame([(1, False, b"a b c"), (2, False, b"c d")], "doc_id long, held_out boolean, text binary")
    model = language_model.train(docs.select("text"))
    part = int(np.flatnonzero(model.sizes[2])[0])
    path = f"{model.store.direct}/n2-{part}"
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(OSError):
        model._held(2, part)
    import os

    os.remove(path)
    with pytest.raises(OSError):
        model._held(2, part)


class Cluster:
    """A session of another master without a checkpoint folder."""

    class conf:  # noqa: N801
        get = staticmethod(lambda key, default: default)

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"


def test_a_shared_folder_is_required_off_local_masters():
    with pytest.raises(RuntimeError):
        _common.shared_folder(Cluster)


def test_tables_of_a_failed_operator_go(spark, tmp_path):
    made = []

    @_common.cleaned
    def operator():
        made.append(_common.written(spark.range(3)).shared_path)
        raise KeyError

    with pytest.raises(KeyError):
        operator()
    from pathlib import Path

    assert not Path(made[0].removeprefix("file://")).exists()


def test_packed_grams_come_back():
    rng = np.random.default_rng(3)
    for width, kinds in ((1, 5), (2, 300), (3, 70_000), (5, 2**33)):
        columns, counts = language_model._summed([rng.integers(0, kinds, 400) for _ in range(width)], [], kinds)
        first, second = ([c[a:b] for c in (*columns, *counts)] for a, b in ((0, 2), (2, len(counts[0]))))
        blobs = [language_model._packed(x[:width], x[width:]) for x in (first, second)]
        assert all((a == b).all() for a, b in zip(language_model._unpacked(blobs, width, 1), (*columns, *counts), strict=True))
        count = np.array(counts[0]).astype(np.uint64) * rng.integers(1, 400, len(counts[0])).astype(np.uint64)
        context = [count, count // np.uint64(2), count - count // np.uint64(2), count * np.uint64(0)]
        held = language_model._mapped(np.frombuffer(language_model.gram_file(columns, count, context, 3), np.uint8))
        key = language_model.key_of(columns)
        hit, place = language_model.look_up(held, key, 3)
        assert len(hit) == len(key) and (language_model._bytes_at(held, "count", place) == count[hit]).all() and (language_model._bytes_at(held, "total", place) == count[hit]).all()
        other = rng.integers(0, 2**63, 500, dtype=np.uint64)
        assert len(language_model.look_up(held, other, 3)[0]) == 0


def test_exact_scores_that_leave_64_bits_raise(spark):
    df = spark.createDataFrame([(0, [1e300, 1.0]), (100, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        exact_search.top_k(df).collect()


def test_parts_deal_all_keys():
    part = np.array([3, 0, 3, 7, 0])
    assert {k: at.tolist() for k, at in stores.cuts(part, 8)} == {0: [1, 4], 3: [0, 2], 7: [3]}


ODD = [
    (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, " \n\t", None, "s", None), (None, "solo words are in this text", None, None, None), (5, "Same words in two places\nand a second line of them", "en", "a", 3),
    (6, "Same words in two places\nand a second line of them", "fr", "b", 3), (6, "Same words in two places\nand a second line of them", "fr", "b", 3), (7, "x " * 20000, "de", "a", 1), (8, "123 !!", "en", "a", 1), (9, "a", "en", "a", 1),
]


def run_all(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "a b c", None, None, None)], ODD], ids=["empty", "null", "three words, no language", "odd"])
def test_pipeline_of_odd_tables(spark, rows, tmp_path):
    got = run_all(spark, rows, tmp_path)
    kept = {r["doc_id"] for r in got}
    with_letters = {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
    assert kept <= with_letters and (kept == with_letters or rows is ODD and kept == with_letters - {6})


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage's rows on the smallest table: letters, lines, components and bins by plain Python from the rows of the stage before."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = _common.written(corpus_pipeline.identify(spark, docs, ""))
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    assert kept == {i: t for i, t in rows.items() if any(c.isalpha() for c in t or "")} and first.columns == docs.columns
    second = _common.written(corpus_pipeline.dedup_lines(spark, first, ""))
    lines = {r["doc_id"]: r["text"] for r in second.collect()}
    before = Counter(x for t in kept.values() for x in set(t.split("\n")))
    for i, t in lines.items():
        whole, at = kept[i].split("\n"), 0
        for x in t.split("\n"):  # a text's lines are some of those before, in their order
            at = whole.index(x, at) + 1
    gone = set(before) - {x for t in lines.values() for x in t.split("\n")}
    assert not gone and second.columns == docs.columns
    third = _common.written(corpus_pipeline.dedup_near(spark, second, ""))
    want = linked([(i, t) for i, t in lines.items()])
    assert {r["doc_id"] for r in third.collect()} == {i for i, (n, c) in want.items() if not n or c == i} and third.columns == docs.columns
    last = corpus_pipeline.pack(spark, third, "").collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in third.collect()}
    by_sequence = defaultdict(int)
    for r in last:
        by_sequence[r["sequence_id"]] += r["length"]
    assert max(by_sequence.values()) <= 2048 and len(by_sequence) <= math.ceil(sum(by_sequence.values()) / 2048) + 1
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in last)


