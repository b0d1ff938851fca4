"""Files, command line, server and evaluation."""

import json
import threading
import urllib.error
import urllib.request

import pytest

import texlith.__main__ as cli
from texlith import server
from texlith.plans import corpus, evaluation, scorer
from texlith.plans.embedders import EmbeddingError
from texlith.sources import submissions as S

WORDS = "garage park levy street parking tree shuttle bus lot shop customer flood bench light path".split()


def row(i, stance="support", **more):
    body = f"The {WORDS[i % 15]} and the {WORDS[(i * 7 + 3) % 15]} by the {WORDS[(i * 4 + 1) % 15]} are what we need there number {i}."
    return {"id": f"c{i:02d}", "stance": stance, "headline": f"About the {WORDS[i % 15]}", "body": body, **more}


@pytest.fixture
def folder(tmp_path):
    files = {
        "fixed_content": {"id": "a", "title": "A garage", "text": "The city will turn the garage into a park with trees and a path."},
        "corpus": [row(i, S.C.STANCES[i % 3]) for i in range(14)],
        "off_topic_anchors": ["My cat sleeps all day on the warm sofa.", "I cooked pasta with the red sauce."],
        "probes": {"_note": "x", "near": [row(3)], "other": [row(40, "mixed")]},
        "examples": {s: [{"id": f"{s}{k}", "expect": "novel", "label": "x", "headline": "A head", "body": "A body that is long enough."} for k in range(2)] for s in S.C.STANCES},
        "relevance_negatives": {"_comment": "x", "items": [{**row(50 + i), "topic": "t: x"} for i in range(3)]},
    }
    for name, value in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value, indent=1), encoding="utf-8")
    return tmp_path


def test_files_are_read(spark, folder):
    path = lambda n: str(folder / f"{n}.json")
    assert S.read_article(spark, path("fixed_content")).first()["title"] == "A garage" and S.read_corpus(spark, path("corpus")).count() == 14
    assert S.read_anchors(spark, path("off_topic_anchors")).count() == 2 and S.read_negatives(spark, path("relevance_negatives")).count() == 3
    assert {r["group"] for r in S.read_probes(spark, path("probes")).collect()} == {"near", "other"} and S.read_examples(spark, path("examples")).count() == 8


BROKEN = [
    (S.read_corpus, "[{"), (S.read_corpus, '{"a": 1}'), (S.read_corpus, json.dumps([row(1), row(1)])), (S.read_corpus, json.dumps([row(1, "odd")])), (S.read_anchors, "[1"), (S.read_anchors, "[]"), (S.read_anchors, '["a", " "]'),
    (S.read_anchors, "{}"), (S.read_article, '{"id": "a"}'), (S.read_article, '{"id": "a", "title": "b", "text": " "}'), (S.read_article, "[]"), (S.read_negatives, "{}"), (S.read_probes, '{"a": 3}'), (S.read_probes, "nope"),
    (S.read_examples, "{}"), (S.read_examples, json.dumps({s: [] for s in S.C.STANCES})),
]


@pytest.mark.parametrize("read, text", BROKEN)
def test_broken_files_raise(spark, tmp_path, read, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(S.DataError, match="x.json"):
        read(spark, str(tmp_path / "x.json"))


def test_missing_files_raise(spark, tmp_path):
    with pytest.raises(S.DataError):
        S.read_corpus(spark, str(tmp_path / "none.json"))


def test_command_line(spark, folder, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    run = lambda *a: (cli.main(["--data", str(folder), *a]), capsys.readouterr())
    code, said = run("corpus")
    values = [float(x.split()[1]) for x in said.out.splitlines()]
    assert code == 0 and len(values) == 14 and values == sorted(values, reverse=True)
    code, said = run("demo")
    assert code == 0 and len(said.out.splitlines()) == 2 and "Copy of an existing comment" in said.out
    code, said = run("score", "--headline", "Flood the lot", "--body", "The flooded level is what makes the trees there die.", "--stance", "mixed", "--json")
    assert code == 0 and 0 <= json.loads(said.out)["score"] <= 1
    code, said = run("score", "--headline", "x", "--body", "short", "--stance", "mixed")
    assert code == 2 and "body needs" in said.err
    items = [{**row(3), "id": "i1", "label": "paraphrase", "split": "dev"}, {**row(41), "id": "i2", "label": "novel", "split": "dev"}, {**row(42), "id": "i3", "label": "off_topic", "topic": "cats: x", "split": "dev"}, {**row(9), "id": "i4", "label": "tricky", "expect": ">= 0.9", "split": "dev"}, {**row(5), "id": "i5", "label": "novel", "split": "test"}]
    items += [{**row(60), "id": "s1", "label": "seq_first", "of": "p", "split": "dev"}, {**row(60), "id": "s2", "label": "seq_second", "of": "p", "split": "dev"}]
    (folder / "held.json").write_text(json.dumps({"items": items}))
    code, said = run("eval", "--items", str(folder / "held.json"), "--json")
    report = json.loads(said.out)
    assert code == 0 and report["n"] == 6 and report["pass_rates"]["paraphrase"] == [1, 1.0] and report["pass_rates"]["tricky"] == [1, 0.0] and list(report["by_topic"]) == ["cats"]
    assert [(f["label"], -f["score"]) for f in report["failures"]] == sorted((f["label"], -f["score"]) for f in report["failures"])
    assert run("eval", "--items", str(folder / "held.json"))[0] == 0
    (folder / "corpus.json").write_text("[")
    assert run("corpus")[0] == 2


def test_embedder_by_name(monkeypatch):
    assert corpus.embedder("hash-crc32-8").size == 8 and corpus.embedder().name == "hash-md5-64"
    monkeypatch.setenv("TEXLITH_EMBEDDER", "other")
    with pytest.raises(EmbeddingError):
        corpus.embedder()
    assert corpus.transient(TimeoutError()) and corpus.transient(urllib.error.HTTPError("u", 503, "", {}, None)) and not corpus.transient(urllib.error.HTTPError("u", 404, "", {}, None)) and not corpus.transient(ValueError())


def test_rules_of_items(spark):
    from pyspark.sql import functions as F

    rows = [("novel", 0.6, None, True), ("novel", 0.59, None, False), ("generic", 0.25, None, True), ("off_topic", 0.02, None, False), ("tricky", 0.3, ">= 0.3", True), ("tricky", 0.3, "<= 0.2", False), ("seq_second", 0.3, None, None)]
    got = spark.createDataFrame(rows, "label string, score double, expect string, want boolean").select("want", evaluation.passes(F.col("label"), F.col("score"), F.col("expect")).alias("ok")).collect()
    assert [r["ok"] for r in got] == [r["want"] for r in got]


def test_server(spark, folder, tmp_path):
    state, log = corpus.load_state(spark, str(folder)), str(tmp_path / "log.jsonl")
    (tmp_path / "log.jsonl").write_text("{broken")
    with server.make(state, 0, log) as http:
        threading.Thread(target=http.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{http.server_address[1]}"

        def ask(path, value=None, **headers):
            data = None if value is None else value if isinstance(value, bytes) else json.dumps(value).encode()
            request = urllib.request.Request(base + path, data, {"Content-Type": "application/json", **headers} if data is not None else headers)
            try:
                with urllib.request.urlopen(request) as r:
                    return r.status, r.read(), r.headers
            except urllib.error.HTTPError as e:
                return e.code, e.read(), e.headers

        size = lambda: json.loads(ask("/api/context")[1])["corpus_size"]
        good = {k: v for k, v in row(70, "undecided").items() if k != "id"}
        assert ask("/")[0] == 200 and size() == 14 and (tmp_path / "log.jsonl.corrupt").exists()
        status, data, headers = ask("/api/score", good)
        assert status == 200 and 0 <= json.loads(data)["score"] <= 1 and headers["X-Frame-Options"] == "DENY" and size() == 14
        assert ask("/api/score", {**good, "commit": 1})[0] == 200 and size() == 14
        done = json.loads(ask("/api/score", {**good, "commit": True})[1])
        assert size() == 14 + done["admitted"] and len(open(log).readlines()) == 1
        for value, code in (({**good, "body": "x"}, 400), ({**good, "stance": "no"}, 400), (b"{", 400), ([1], 400), ({**good, "body": "x" * 20000}, 400)):
            assert ask("/api/score", value)[0] == code
        assert ask("/api/score", good, Origin="http://evil.example")[0] == 403 and ask("/api/context", Host="evil.example")[0] == 403
        assert ask("/api/score", good, **{"Content-Type": "text/plain"})[0] == 415 and ask("/nope")[0] == 404 and ask("/api/score")[0] == 405
        again = server.App(state, log)
        assert len(again.state.submissions) == 14 + done["admitted"]
        assert ask("/api/reset", {})[0] == 200 and size() == 14
        http.shutdown()
    assert len(state.submissions) == 14 and scorer.ARTICLE == state.ids[0]
