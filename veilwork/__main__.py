"""python -m veilwork COMMAND: scan and redact texts, rules, generated data, exports, and reports over a folder of tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

#: Reports: command -> registered query.
REPORTS = {
    "review": "review_queue", "stats": "review_stats", "suggest": "rule_suggestions", "history": "run_summary", "compare": "run_trend", "evaluate": "score_table", "nervaluate": "semeval_modes", "errors": "error_examples",
    "signals": "store_stats", "pending": "pending_signals", "labelled": "labelled_signals", "models": "model_registry", "rollback": "model_rollback", "archive": "signal_archive", "audit": "audit_stats", "dictionaries": "dictionary_status",
}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilwork")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "redact"):
        c = sub.add_parser(name, help=f"{name} a Parquet table of texts, or one text")
        c.add_argument("--text")
        c.add_argument("--input")
        c.add_argument("--id", default="id")
        c.add_argument("--column", default="text")
        c.add_argument("--output")
        c.add_argument("--mode", default="staged")
        c.add_argument("--rules", help="a rule file instead of the built-in rules")
    rules = sub.add_parser("rules", help="list, add, remove, switch or try rules of a file")
    rules.add_argument("action", nargs="?", default="list", choices=["list", "add", "remove", "enable", "disable", "test", "check"])
    rules.add_argument("--file", help="the rule file; the built-in rules without one")
    for a in ("name", "pattern", "type", "text"):
        rules.add_argument(f"--{a}")
    rules.add_argument("--confidence", type=float, default=0.8)
    sub.add_parser("status", help="what the engine can do here")
    g = sub.add_parser("generate", help="made-up labelled texts")
    g.add_argument("what")
    g.add_argument("n", type=int)
    g.add_argument("--seed", type=int, default=1)
    g.add_argument("--output", required=True)
    e = sub.add_parser("export", help="corrections of a folder of tables as JSON lines")
    e.add_argument("folder")
    e.add_argument("--output", required=True)
    i = sub.add_parser("import", help="files of any kind as a table of texts")
    i.add_argument("folder")
    i.add_argument("--output", required=True)
    for name in [*REPORTS, "run"]:
        r = sub.add_parser(name, help=f"the query {REPORTS.get(name, 'of that name')} over a folder of tables")
        if name == "run":
            r.add_argument("query")
        r.add_argument("folder")
        r.add_argument("--output", help="a Parquet table; the first rows are printed without it")
    return p


def _rules(a, spark) -> int:
    from veilwork.operators.detect import Catalog

    catalog = Catalog.load(a.file) if a.file and (a.action != "add" or __import__("os").path.exists(a.file)) else Catalog()
    if a.action == "list":
        for r in catalog.rules:
            print(f"{r.name}\t{r.entity_type}\t{r.confidence}\t{'on' if r.enabled else 'off'}\t{r.regex}")
        return 0
    if a.action == "test":
        for hit in catalog.try_pattern(spark, a.pattern or catalog.get(a.name).regex, a.text):
            print(*hit, sep="\t")
        return 0
    if a.action == "check":
        bad = catalog.check(spark)
        print(*(f"{k}: {v}" for k, v in bad.items()), sep="\n")
        return int(bool(bad))
    if not a.file:
        raise SystemExit("--file names the rule file to change")
    if a.action == "add":
        done = catalog.add_pattern(a.name, a.pattern, a.type, a.confidence) is not None
    elif a.action == "remove":
        done = catalog.remove(a.name)
    else:
        done = catalog.enable(a.name, a.action == "enable")
    catalog.save(a.file)
    return int(not done)


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("veilwork").getOrCreate()
    from veilwork import Client, Config, redact, scan
    from veilwork.operators.detect import Catalog
    from veilwork.operators.fuse import stack_status
    from veilwork.runtime import staging

    with staging():
        if a.command in ("scan", "redact"):
            config = Config(mode=a.mode, catalog=Catalog.load(a.rules) if a.rules else Catalog())
            if a.text is not None:
                client = Client(spark, config)
                print(client.redact(a.text) if a.command == "redact" else "\n".join(map(str, client.scan(a.text))))
            else:
                (redact if a.command == "redact" else scan)(spark.read.parquet(a.input), a.id, a.column, config).write.mode("overwrite").parquet(a.output)
        elif a.command == "rules":
            return _rules(a, spark)
        elif a.command == "status":
            print(stack_status())
        elif a.command == "generate":
            from veilwork.operators.generate import generate

            generate(spark, a.what, a.n, a.seed).write.mode("overwrite").parquet(a.output)
        elif a.command == "export":
            from veilwork.sources.writers import export_corrections

            export_corrections(spark.read.parquet(f"{a.folder}/corrections.parquet").dropDuplicates(["id"]), a.output)
        elif a.command == "import":
            from veilwork.sources.documents import extract, read_folder

            extract(read_folder(spark, a.folder)).write.mode("overwrite").parquet(a.output)
        else:
            from veilwork.plans import registry

            df = registry.queries()[REPORTS.get(a.command) or a.query](spark, a.folder)
            if a.output:
                df.write.mode("overwrite").parquet(a.output)
            else:
                df.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
