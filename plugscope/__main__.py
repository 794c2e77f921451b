"""Command line: analyse a directory of plugins, list it, or verify which target files are reachable."""

from __future__ import annotations

import argparse
import sys

from .functions import words as W


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("plugscope")
    p.add_argument("--analyze", metavar="DIR", help="directory of one plugin or of several")
    p.add_argument("--targets", metavar="TSV", help="verify these files instead, with --analyze as the corpus")
    p.add_argument("--config", metavar="JSON", help="configuration merged over the defaults")
    p.add_argument("--stats", action="store_true", help="only the summary")
    p.add_argument("--list-only", action="store_true", help="only the plugins")
    p.add_argument("--save", metavar="FILE", help="write the full report as JSON")
    p.add_argument("--chain-human", action="store_true")
    p.add_argument("--chain-json", action="store_true")
    p.add_argument("--compat", action="store_true", help="reproduce historical quirks")
    p.add_argument("--unauth", dest="levels", action="append_const", const="unauthenticated")
    for name in [*W.LEVELS[1:], "user"]:
        p.add_argument(f"--{name}", dest="levels", action="append_const", const=name)
    p.add_argument("--auth", action="store_true", help="all levels from subscriber up")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.analyze:
        parser().print_help()
        return 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .config import Config, load_config
    from .operators import report
    from .plans import analyze as A
    from .sources import corpus, sinks

    spark = SparkSession.builder.appName("plugscope").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = Config()
    if args.config:
        with open(args.config) as f:
            config = load_config(f.read())
    if args.targets:
        rows = corpus.targets_tsv(spark, args.targets).select(F.coalesce("plugin_dir", "plugin").alias("plugin_slug"), "relative_path", "cve")
        for r in sinks.reachability_lines(A.verify_reachability(corpus.read_corpus(spark, args.analyze), rows)).toLocalIterator():
            print(r["text"])
        return 0
    done = A.analyze_directory(spark, args.analyze, config, args.compat)
    if args.list_only:
        out = sinks.plugin_list(done.plugins)
    elif args.stats:
        out = [sinks.summary_text(done.summary().first().asDict())]
    else:
        kept = report.filter_levels(done.endpoints, args.levels, args.auth)
        if args.chain_json or args.chain_human:
            trees = report.call_trees(kept, done.facts.functions, done.reach)
            out = sinks.chain_json(trees) if args.chain_json else sinks.chain_report(trees)
        else:
            out = [*sinks.text_report(kept), sinks.summary_text(done.summary().first().asDict())]
    for line in out:
        print(line)
    if args.save:
        with open(args.save, "w") as f:
            f.writelines(f"{line}\n" for line in sinks.full_report(done))
    return 0


if __name__ == "__main__":
    sys.exit(main())
