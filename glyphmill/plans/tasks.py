"""Configurations: a matrix of tasks, each with sources, a pipeline and a dictionary; and the call that runs them."""

from __future__ import annotations

import os
import sys
import warnings
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import encodings
from glyphmill.functions.globs import DEFAULT
from glyphmill.model import RESULT, Filter
from glyphmill.operators import check, external
from glyphmill.plans import pipeline
from glyphmill.sources import files

NAMES = (".glyphmill.yml", ".glyphmill.yaml", ".spelling.yml")


def load_yaml(text: str) -> dict:
    """A configuration from YAML. Only plain data: Python tags are refused."""
    found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("a configuration must be a mapping")
    return found


def read_config(path: str = "") -> dict:
    """The configuration in a file, or in the first of the usual names that exists."""
    name = path or next((n for n in NAMES if os.path.exists(n)), NAMES[0])
    if name == NAMES[-1] and not path:
        warnings.warn(f"{name} is an old name, use {NAMES[0]}", DeprecationWarning, stacklevel=2)
    with open(name, encoding="utf-8") as f:
        return load_yaml(f.read())


def renamed(config: dict, old: str, new: str) -> None:
    if old in config and new not in config:
        warnings.warn(f"{old!r} is an old name of {new!r}", DeprecationWarning, stacklevel=3)
        config[new] = config.pop(old)


@dataclass
class Task:
    name: str = ""
    group: str = ""
    hidden: bool = False
    sources: list[str] = field(default_factory=list)
    glob_flags: str = DEFAULT
    glob_pattern_limit: int = 1000
    expect_match: bool = True
    default_encoding: str = ""
    pipeline: list | None = field(default_factory=list)
    dictionary: dict = field(default_factory=dict)
    aspell: dict = field(default_factory=dict)
    hunspell: dict = field(default_factory=dict)


def tasks(config: dict) -> list[Task]:
    config = dict(config)
    renamed(config, "documents", "matrix")
    if "matrix" not in config:
        raise KeyError("matrix")
    if not isinstance(config["matrix"], list) or not config["matrix"]:
        raise ValueError("the matrix has no task")
    out = []
    for given in config["matrix"]:
        given = dict(given)
        renamed(given, "filters", "pipeline")
        known = {k: v for k, v in given.items() if k in Task.__dataclass_fields__ and (v is not None or k == "pipeline")}
        if isinstance(known.get("sources"), str):
            known["sources"] = [known["sources"]]
        out.append(Task(**known))
    return out


def chosen(every: list[Task], names: list[str] | None = None, groups: list[str] | None = None, sources: list[str] | None = None) -> list[Task]:
    """By name (of several with one name the last; hidden ones too), else by group, else all; without a name no hidden ones. Sources replace a task's own only if exactly one name is given."""
    names, groups = list(dict.fromkeys(names or [])), set(groups or [])
    if names:
        last = {t.name: t for t in every}
        if missing := [n for n in names if n not in last]:
            raise ValueError(f"no task has the name {missing[0]!r}")
        picked = [t for t in every if t.name in names and last[t.name] is t]
        if sources and len(names) == 1:
            picked = [Task(**(vars(t) | {"sources": list(sources)})) for t in picked]
        return picked
    picked = [t for t in every if not t.hidden and (not groups or t.group in groups)]
    if groups and not picked:
        raise ValueError("no task has one of the groups")
    return picked


def dictionary_of(spark: SparkSession, task: Task, base: DataFrame | None, skip_compile: bool = False) -> DataFrame:
    """The words that a task knows: the base dictionary and its own lists. With an output, the lists are written there, sorted, unless they are to be taken from there."""
    given = task.dictionary
    lists = list(given.get("wordlists", []))
    own = None
    output = given.get("output")
    if output and skip_compile and files.exists(spark, output):
        own = check.compiled(spark.read.text(output), column="value")
    elif lists:
        own = check.read_wordlists(spark, lists, given.get("encoding", "utf-8"))
        if output:
            own.coalesce(1).sortWithinPartitions("word").write.mode("overwrite").text(output)
            own = check.compiled(spark.read.text(output), column="value")
    parts = [p for p in (base, own) if p is not None]
    return check.compiled(*parts) if parts else spark.createDataFrame([], "word string")


#: Where a program's dictionary is written if the task names no place.
OUTPUT = "dictionary.dic"


def program_dictionary(spark: SparkSession, task: Task, checker: str, binary: str = "", skip_compile: bool = False) -> str:
    """The path of a task's lists as the program's own dictionary, "" if it has none."""
    given = task.dictionary
    lists, output = list(given.get("wordlists", [])), os.path.abspath(given.get("output", OUTPUT))
    options = task.aspell if checker == "aspell" else {}
    lang = options.get("lang", options.get("l", "en"))
    if not lists or checker == "aspell" and not lang:
        return ""
    if skip_compile and os.path.exists(output):
        return output
    encoding = given.get("encoding", "utf-8")
    return external.compile_words(check.read_wordlists(spark, lists, encoding), checker, output, lang, encoding if checker == "aspell" else "utf-8", binary or None)


def files_of_task(spark: SparkSession, task: Task) -> DataFrame:
    if not task.sources:
        raise ValueError(f"the task {task.name!r} has no sources")
    return files.read(spark, task.sources, task.glob_flags, int(task.glob_pattern_limit), task.expect_match)


def chunks_of_task(spark: SparkSession, task: Task) -> DataFrame:
    """Chunks of a task's files, after its pipeline. Without a pipeline a file is one chunk of the category "file"."""
    found = files_of_task(spark, task)
    steps = pipeline.build(task.pipeline, task.default_encoding)
    if steps is None:
        return pipeline.first(found, WholeFile(default_encoding=task.default_encoding))
    head, rest = steps[0], steps[1:]
    known = head.categories() if isinstance(head, Filter) else None
    return pipeline.apply(pipeline.first(found, head), rest, set(known) if known is not None else None)


class WholeFile(Filter):
    """A file as it is, for a checker without a pipeline: bytes that aren't in the default encoding are replaced."""

    universal_newlines = False

    def default_config(self) -> dict:
        return {}

    def read(self, raw: bytes, context: str, encoding: str):
        from glyphmill.model import Chunk

        mark = encodings.from_mark(raw)
        return [Chunk(raw.decode(mark or self.default_encoding, "replace"), context, mark or self.default_encoding, "file")]


def log(text: str, level: int, verbose: int) -> None:
    if verbose >= level:
        print(text, file=sys.stderr, flush=True)


def spellcheck(
    spark: SparkSession,
    config: str | dict = "",
    names: list[str] | None = None,
    groups: list[str] | None = None,
    sources: list[str] | None = None,
    dictionary: DataFrame | None = None,
    checker: str = "",
    binary: str = "",
    skip_dict_compile: bool = False,
    verbose: int = 0,
) -> DataFrame:
    """Results of all chosen tasks of a configuration (a path or a mapping), in one table with the task's number and name. verbose: 1 tells the tasks, 2 their sources and dictionaries, too, 3 their steps and programs' options.

    dictionary: words that all tasks know. checker: "builtin", "aspell" or "hunspell"; unset, what the configuration names as "spellchecker", else the built-in one."""
    config = read_config(config) if isinstance(config, str) else config
    checker = checker or config.get("spellchecker", "builtin")
    if checker not in ("builtin", "aspell", "hunspell"):
        raise ValueError(f"{checker!r} is no known checker")
    out = None
    for number, task in enumerate(chosen(tasks(config), names, groups, sources)):
        log(f"Running task: {task.name}...", 1, verbose)
        log(f"Sources: {', '.join(task.sources)}; dictionary: {task.dictionary or 'none'}", 2, verbose)
        log(f"Pipeline: {task.pipeline}; options of {checker}: {getattr(task, checker, {})}", 3, verbose)
        if checker == "builtin":
            found = check.check(chunks_of_task(spark, task), dictionary_of(spark, task, dictionary, skip_dict_compile))
        else:
            own = program_dictionary(spark, task, checker, binary, skip_dict_compile)
            if task.pipeline is None:
                found = external.check_files(files_of_task(spark, task), checker, getattr(task, checker), own, binary or None, task.default_encoding)
            else:
                found = external.check_by(chunks_of_task(spark, task), checker, getattr(task, checker), own, binary or None)
        found = found.withColumns({"task_no": F.lit(number), "task": F.lit(task.name)})
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], RESULT).withColumns({"task_no": F.lit(0), "task": F.lit("")})
