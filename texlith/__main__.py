"""Command line: demo, corpus, score, eval and serve over a folder of JSON files. Exit codes: 0, 2 for a reported error, 130 when interrupted."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from texlith.functions.constants import STANCES
from texlith.plans import evaluation
from texlith.plans.corpus import load_state
from texlith.plans.embedders import EmbeddingError
from texlith.plans.scorer import ScoringError, Submission, score
from texlith.sources import submissions as S

EVAL = "items array<struct<id:string,label:string,headline:string,body:string,stance:string,split:string,topic:string,of:string,expect:string>>"


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("texlith").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def demo(args: argparse.Namespace) -> None:
    spark = _session()
    probes = S.read_probes(spark, f"{args.data}/probes.json")
    for r in probes.select("group", "id").join(score(probes, load_state(spark, args.data)), "id").orderBy("group", "id").collect():
        print(f"{r['group']:<18} {r['id']:<22} {r['score']:.3f} {r['novelty']:.3f} {r['relevance']:.3f} {r['relevance_gate']:.2f}  {r['verdict']}")


def corpus(args: argparse.Namespace) -> None:
    state = load_state(_session(), args.data)
    named = {s.id: s.headline for s in state.submissions}
    for id_, novelty in state.listing():
        print(f"{id_}  {novelty:.3f}  {named[id_]}")


def score_one(args: argparse.Namespace) -> None:
    spark = _session()
    row = spark.createDataFrame([(None, args.stance, args.headline, args.body)], S.SUBMISSION)
    r = S.validated(row).first()
    if r["error"]:
        raise S.DataError(r["error"])
    out = load_state(spark, args.data).score(Submission(None, r["headline"], r["body"], r["stance"]))
    print(json.dumps(out, indent=2) if args.json else "\n  - ".join([f"score {out['score']:.3f}  (novelty {out['novelty']:.3f} x relevance gate {out['relevance_gate']:.2f})", *out["reasons"]]))


def evaluate(args: argparse.Namespace) -> None:
    spark = _session()
    items = S._parsed(spark, args.items, f"struct<{EVAL.replace('items ', 'items:', 1)}>").selectExpr("inline(v.items)")
    items = items if args.split == "all" else items.where(items["split"] == args.split)
    out = evaluation.report(items, load_state(spark, args.data), args.failures)
    if args.json:
        print(json.dumps(out, indent=2))
        return
    for label, (n, rate) in out["pass_rates"].items():
        print(f"{label:<12} {n:>5} {'-' if rate is None else f'{rate:.0%}'}")
    print("by topic: " + "   ".join(f"{t}: {r:.0%}" for t, (_, r) in out["by_topic"].items()))
    print(f"AUC novel: {out['auc_novelty']}   AUC relevance: {out['auc_relevance']}   sequential: {out['sequential']}")
    for f in out["failures"]:
        print(f"  {f['label']:<10} {f['score']:.2f} gate {f['gate']:.2f}  {f['id']}: {f['headline']}")


def serve(args: argparse.Namespace) -> None:
    from texlith.server import serve

    serve(load_state(_session(), args.data), args.port, args.log)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="texlith")
    parser.add_argument("--data", default="data", help="folder of the corpus' JSON files")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("demo").set_defaults(run=demo)
    commands.add_parser("corpus").set_defaults(run=corpus)
    one = commands.add_parser("score")
    one.add_argument("--headline", required=True)
    one.add_argument("--body", required=True)
    one.add_argument("--stance", required=True, choices=STANCES)
    one.add_argument("--json", action="store_true")
    one.set_defaults(run=score_one)
    judge = commands.add_parser("eval")
    judge.add_argument("--items", required=True)
    judge.add_argument("--split", choices=["dev", "test", "all"], default="dev")
    judge.add_argument("--failures", type=int, default=10)
    judge.add_argument("--json", action="store_true")
    judge.set_defaults(run=evaluate)
    web = commands.add_parser("serve")
    web.add_argument("--port", type=int, default=8000)
    web.add_argument("--log", default="submissions.jsonl")
    web.set_defaults(run=serve)
    args = parser.parse_args(argv)
    try:
        args.run(args)
    except (ScoringError, S.DataError, EmbeddingError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130
    return 0


if __name__ == "__main__":
    sys.exit(main())
