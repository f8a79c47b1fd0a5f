"""Command line: ``spark-submit --py-files prosegauge.zip prosegauge/__main__.py COMMAND ...``

Plug-ins are named ``module:factory``.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import replace
from importlib import import_module

from prosegauge.config import Config, Pace
from prosegauge.plans.prompts import generate_prompts
from prosegauge.plans.responses import banned_sequences, collect_responses, generate_responses, shortfall
from prosegauge.plans.scoring import score_responses
from prosegauge.plans.training import prepare_training
from prosegauge.session import session
from prosegauge.sources.readers import load_lexicon, load_ranges, read_responses


def plugin(name: str) -> Callable:
    module, _, factory = name.partition(":")
    return getattr(import_module(module), factory)


def named_plugin(text: str) -> tuple[str, Callable]:
    name, _, target = text.partition("=")
    return name, plugin(target)


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="prosegauge")
    commands = parser.add_subparsers(dest="command", required=True)

    prompts = commands.add_parser("prompts", help="pair corpus to prompts, class corpora and ranges")
    prompts.add_argument("source")
    prompts.add_argument("out")
    prompts.add_argument("--dict-strings", action="store_true", help="records are dict-like strings")
    prompts.add_argument("--size", type=int, default=Config.range_size, help="rows per range; 0 for all")

    local = commands.add_parser("generate", help="continue the prompts with local models")
    local.add_argument("ranges")
    local.add_argument("out")
    local.add_argument("--model", type=named_plugin, action="append", required=True, metavar="NAME=MODULE:FACTORY")
    local.add_argument("--partitions", type=int, help="tasks a model runs in")
    local.add_argument("--variant", help="tag added to the model names")
    local.add_argument("--banned", help="file of terms not to be written")
    local.add_argument("--tokenizer", type=plugin, help="needed with --banned")

    chat = commands.add_parser("collect", help="collect replies of a chat service")
    chat.add_argument("ranges")
    chat.add_argument("out")
    chat.add_argument("--model", type=named_plugin, required=True, metavar="NAME=MODULE:FACTORY")
    chat.add_argument("--quota", type=int, help="distinct prompts per range; 0 for all")
    chat.add_argument("--tokenizer", type=plugin)
    chat.add_argument("--rejects", help="table for failed replies")

    train = commands.add_parser("training-rows", help="class corpora to token rows")
    train.add_argument("corpus")
    train.add_argument("out")
    train.add_argument("--tokenizer", type=plugin)

    score = commands.add_parser("score", help="score responses")
    score.add_argument("out")
    score.add_argument("--scorer", type=plugin, required=True)
    score.add_argument("--responses", help="response table")
    score.add_argument("--folder", action="append", metavar="MODEL=FOLDER", help="CSV files of one model")
    score.add_argument("--interval", type=float, default=Pace.interval, help="seconds between requests; 0 for none")
    score.add_argument("--lanes", type=int, default=Pace.lanes)
    score.add_argument("--resume", action="store_true")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    if args.command == "generate" and args.banned and not args.tokenizer:
        raise SystemExit("--banned needs --tokenizer")
    if args.command == "score" and bool(args.responses) == bool(args.folder):
        raise SystemExit("give either --responses or --folder")
    spark = session()
    config = Config()
    if args.command == "prompts":
        tables = generate_prompts(spark, args.source, args.out, replace(config, range_size=args.size), not args.dict_strings)
        for name, n in tables.counts.items():
            print(f"{name}: {n}")
    elif args.command == "training-rows":
        corpus = spark.read.schema("row_id bigint, text string, class int").parquet(args.corpus)
        prepare_training(corpus, args.out, config, args.tokenizer)
    elif args.command == "score":
        responses = read_responses(spark, args.responses) if args.responses else dict(f.split("=", 1) for f in args.folder)
        config = replace(config, pace=Pace(args.interval, args.lanes) if args.interval else None)
        score_responses(spark, responses, args.out, args.scorer, config, args.resume)
    else:
        schema = "row_id bigint, prompt string, toxicity_bin string"
        ranges = load_ranges(spark.read.schema(schema).parquet(args.ranges), config.labels)
        if args.command == "generate":
            banned = None
            if args.banned:
                banned = banned_sequences(load_lexicon(spark, args.banned), tokenizer=args.tokenizer)
            models = dict(args.model)
            generate_responses(ranges, args.out, models, config, args.variant, banned, partitions=args.partitions)
        else:
            name, factory = args.model
            got = collect_responses(ranges, args.out, name, factory, config, args.quota, args.tokenizer, rejects=args.rejects)
            quota = config.range_size if args.quota is None else args.quota
            for row in shortfall(ranges, got, quota).collect():
                print(f"{row.label}: {row.n_done} of {row.n_wanted} prompts have a reply")


if __name__ == "__main__":
    main()
