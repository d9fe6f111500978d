"""The checker from a shell: python -m glyphmill [options]. It ends with 1 if anything is misspelled or failed."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from glyphmill import __version__
from glyphmill.operators.check import read_wordlists, report
from glyphmill.plans.tasks import read_config, spellcheck


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="glyphmill", description="Finds misspelled words.")
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    p.add_argument("-v", "--verbose", action="count", default=0, help="say more: tasks, their sources, their steps, and at four times what Spark says")
    which = p.add_mutually_exclusive_group()
    which.add_argument("-n", "--name", action="append", help="a task by its name; may be repeated")
    which.add_argument("-g", "--group", action="append", help="tasks by their group; may be repeated")
    p.add_argument("-b", "--binary", default="", help="the external checker's program")
    p.add_argument("-j", "--jobs", type=int, default=0, help="local cores; 0 for all")
    p.add_argument("-c", "--config", default="", help="the configuration's path")
    p.add_argument("-S", "--source", action="append", help="sources instead of the task's, with exactly one name")
    p.add_argument("-s", "--spellchecker", default="", choices=("", "builtin", "aspell", "hunspell"))
    p.add_argument("-x", "--skip-dict-compile", action="store_true", help="take compiled dictionaries where they are")
    p.add_argument("-d", "--dictionary", action="append", default=[], help="a list of known words; may be repeated")
    a = p.parse_args(arguments)
    jobs = a.jobs or read_config(a.config).get("jobs", 0)
    spark = SparkSession.builder.master(f"local[{jobs if jobs > 0 else '*'}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if a.verbose < 4:
        spark.sparkContext.setLogLevel("ERROR")
    base = read_wordlists(spark, a.dictionary) if a.dictionary else None
    text, failed = report(spellcheck(spark, a.config, a.name, a.group, a.source, base, a.spellchecker, a.binary, a.skip_dict_compile, a.verbose).drop("task_no", "task"))
    print(text)
    return int(failed)


if __name__ == "__main__":
    raise SystemExit(main())
