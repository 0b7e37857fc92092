"""Command-line entry point (works with ``spark-submit`` or plain ``python -m tessera``).

    python -m tessera sft-set       --source SFT_PATH --out OUT [--format parquet|json]
    python -m tessera rl-set        --source RL_PATH --out OUT [--train-ratio 0.9 --key id]
    python -m tessera score         --source COMPLETIONS --out OUT [--dialect package|notebook]
                                    [--advantage-key prompt_id]
    python -m tessera judge-prompts --comparison JSON --exercises JSONL --out OUT [--rubric 3|4]
    python -m tessera judge-results --prompts PATH --verdicts PATH --out OUT
                                    --base NAME --tuned NAME --judge NAME

On a cluster the active session (and its ``spark.checkpoint.dir``) is used.
"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("sft-set")
    a.add_argument("--source", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--format", default="parquet")
    a.add_argument("--max-seq-length", type=int, default=2048)
    a.add_argument("--truncate-ratio", type=float, default=0.5)
    a.add_argument("--keep-non-numeric", action="store_true")
    b = sub.add_parser("rl-set")
    b.add_argument("--source", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--format", default="parquet")
    b.add_argument("--percentile", type=float, default=90)
    b.add_argument("--max-seq-length", type=int, default=2048)
    b.add_argument("--train-ratio", type=float)
    b.add_argument("--key")
    b.add_argument("--seed", type=int, default=42)
    c = sub.add_parser("score")
    c.add_argument("--source", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--dialect", default="package", choices=["package", "notebook"])
    c.add_argument("--completion", default="completion")
    c.add_argument("--answer", default="answer")
    c.add_argument("--advantage-key")
    d = sub.add_parser("judge-prompts")
    d.add_argument("--comparison", required=True)
    d.add_argument("--exercises", required=True)
    d.add_argument("--out", required=True)
    d.add_argument("--rubric", default="3", choices=["3", "4"])
    e = sub.add_parser("judge-results")
    e.add_argument("--prompts", required=True)
    e.add_argument("--verdicts", required=True, help="table with problem_id and raw")
    e.add_argument("--out", required=True)
    e.add_argument("--base", required=True)
    e.add_argument("--tuned", required=True)
    e.add_argument("--judge", required=True)
    e.add_argument("--rubric", default="3", choices=["3", "4"])
    e.add_argument("--dialect", default="full", choices=["full", "fence"])
    args = p.parse_args(argv)

    from tessera.plans import jobs
    from tessera.session import configure, get_session
    spark = configure(get_session(app_name=f"tessera-{args.cmd}"))

    if args.cmd == "sft-set":
        jobs.sft_set_job(spark, args.source, args.out, fmt=args.format, max_seq_length=args.max_seq_length,
                         truncate_ratio=args.truncate_ratio, filter_numeric_only=not args.keep_non_numeric)
        result = {"written": args.out}
    elif args.cmd == "rl-set":
        result = jobs.rl_set_job(spark, args.source, args.out, fmt=args.format, percentile=args.percentile,
                                 max_seq_length=args.max_seq_length, train_ratio=args.train_ratio,
                                 key=args.key, seed=args.seed)
    elif args.cmd == "score":
        from tessera.operators import rewards as R
        scored = R.score(spark.read.parquet(args.source), args.completion, args.answer, dialect=args.dialect)
        if args.advantage_key:
            scored = R.group_advantage(scored, args.advantage_key, "total")
        scored.write.mode("overwrite").parquet(args.out)
        result = {"written": args.out}
    elif args.cmd == "judge-prompts":
        jobs.judge_prompts_job(spark, args.comparison, args.exercises, args.out, rubric=args.rubric)
        result = {"written": args.out}
    else:
        raw = spark.read.parquet(args.verdicts).select("problem_id", "raw")
        result = jobs.judge_results_job(spark, args.prompts, raw, args.out, args.base, args.tuned,
                                        args.judge, rubric=args.rubric, dialect=args.dialect)
    print(json.dumps(result, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
