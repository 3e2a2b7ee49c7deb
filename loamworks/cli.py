"""Command line: ``python -m loamworks.cli run|dry-run|diff|hash|verify …``."""

from __future__ import annotations

import argparse
import json

from loamworks.plans import pipeline, policy, release


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("loamworks").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loamworks")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, args in {"run": ("policy", "input", "output"), "dry-run": ("policy", "input"), "pipeline": ("config",), "diff": ("a", "b"), "hash": ("policy",), "verify": ("path",), "reproduce": ("manifest", "input", "output")}.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        if name in ("run", "reproduce"):
            p.add_argument("--evaluation", help="Parquet of held-out items (item_id, source, text); needed unless the policy turns decontamination off")
    a = parser.parse_args(argv)
    if a.command == "hash":
        print(policy.load_policy(a.policy).digest())
    elif a.command == "diff":
        print(release.diff_report(policy.load_policy(a.a), policy.load_policy(a.b)))
    elif a.command == "pipeline":
        print(pipeline.run_pipeline(_spark(), pipeline.load_config(a.config)).count())
    elif a.command == "dry-run":
        print(policy.dry_run(_spark().read.parquet(a.input), policy.load_policy(a.policy)).first().asDict())
    elif a.command == "run":
        from loamworks.sources import tables

        p, spark = policy.load_policy(a.policy), _spark()
        curated = policy.execute(spark.read.parquet(a.input), p, spark.read.parquet(a.evaluation) if a.evaluation else None)
        tables.write_shards(curated.documents.drop("quality_scores"), f"{a.output}/data")
        tables.save_manifest(tables.make_manifest(p.name, tables.shard_manifest(spark, f"{a.output}/data"), p.to_dict(), [a.input], seed=p.seed, code=release.run_stamp()["code"], content=tables.content_hash(spark, f"{a.output}/data")), f"{a.output}/manifest.json")
    elif a.command == "verify":
        problems = [r.asDict() for r in release.verify_release(_spark(), a.path).collect()]
        print(json.dumps(problems, indent=2))
        return int(bool(problems))
    elif a.command == "reproduce":
        from loamworks.sources import tables

        spark = _spark()
        evaluation = spark.read.parquet(a.evaluation) if a.evaluation else None
        print(release.rebuild(spark, tables.load_manifest(a.manifest), lambda s, _: s.read.parquet(a.input), a.output, evaluation))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
