"""Command line: compress a token table, or build the command that serves a model with the same ratio."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
from collections.abc import Mapping, Sequence

from tokensieve.config import RATIO_VARIABLE, CompressionConfig, check_pruning_rate, ratio_from_environment

#: Options of the server that follow from the ratio, so callers can't give them.
OWNED = ("--hf-overrides", "--video-pruning-rate")


def checked_ratio(ratio: float) -> float:
    try:
        return CompressionConfig(retention_ratio=ratio).retention_ratio
    except ValueError as e:
        raise SystemExit(str(e)) from e


def serve_command(argv: Sequence[str], architecture: str, server: str = "vllm", environment: Mapping[str, str] | None = None, plugin: str = "tokensieve") -> tuple[list[str], dict[str, str]]:
    """(command, environment) that starts the server; what isn't known here is passed on, last."""
    parser = argparse.ArgumentParser(prog="tokensieve serve")
    parser.add_argument("model")
    parser.add_argument("--vision-retention-ratio", type=float, default=0.1)
    args, rest = parser.parse_known_args(list(argv))
    ratio = checked_ratio(args.vision_retention_ratio)
    taken = sorted({x.partition("=")[0] for x in rest} & set(OWNED))
    if taken:
        raise SystemExit(f"{', '.join(taken)} follows from --vision-retention-ratio")
    command = [server, "serve", args.model, "--hf-overrides", json.dumps({"architectures": [architecture]}), "--video-pruning-rate", str(1.0 - ratio), *rest]
    env = dict(os.environ if environment is None else environment)
    return command, {"VLLM_PLUGINS": plugin} | env | {RATIO_VARIABLE: str(ratio)}


def compress_table(argv: Sequence[str]) -> int:
    """Compress the Parquet token table at the first path into the second."""
    parser = argparse.ArgumentParser(prog="tokensieve compress")
    parser.add_argument("tokens")
    parser.add_argument("out")
    parser.add_argument("--ratio", type=float, help=f"{RATIO_VARIABLE}, or 0.1, unless given")
    parser.add_argument("--pruning-rate", type=float, help="the rate of the service whose tokens these are; has to fit the ratio")
    parser.add_argument("--alpha", type=float, default=0.7)
    parser.add_argument("--target-tokens", type=int)
    args = parser.parse_args(list(argv))
    try:
        ratio = ratio_from_environment() if args.ratio is None else checked_ratio(args.ratio)
        if args.pruning_rate is not None:
            check_pruning_rate(ratio, args.pruning_rate)
    except ValueError as e:
        raise SystemExit(str(e)) from e
    config = CompressionConfig(retention_ratio=ratio, alpha=args.alpha)

    from pyspark.sql import SparkSession

    from tokensieve.operators.compress import compress

    spark = SparkSession.builder.appName("tokensieve").getOrCreate()
    compress(spark.read.parquet(args.tokens), config, args.target_tokens).write.parquet(args.out)
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv[:1] == ["compress"]:
        return compress_table(argv[1:])
    if argv[:1] == ["serve"]:
        command, env = serve_command(argv[1:], os.environ.get("TOKENSIEVE_ARCHITECTURE", "TokensieveVideoModel"))
        return subprocess.call(command, env=env)
    raise SystemExit("usage: tokensieve compress|serve ...")


if __name__ == "__main__":
    sys.exit(main())
