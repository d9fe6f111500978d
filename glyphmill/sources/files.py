"""Files by glob patterns, as rows of their bytes."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.globs import DEFAULT, Matcher, to_flags

FILES = "src_id string, context string, raw binary"


def listed(targets: list[str], flags: str = DEFAULT, limit: int = 1000) -> list[str]:
    """Paths of local files that the patterns match, in the order of the patterns; each once, unless NOUNIQUE is set."""
    out: list[str] = []
    for target in targets:
        match = Matcher(target, flags, limit)
        found = [p for root, deep in match.roots() for p in files_under(root, deep, "L" in match.letters) if match(p)]
        out += sorted(found if "Q" in match.letters else set(found))
    return out if "Q" in to_flags(flags) else list(dict.fromkeys(out))


def files_under(root: str, deep: bool, follow: bool) -> Iterator[str]:
    if os.path.isfile(root):
        yield root
    for folder, names, files in os.walk(root, followlinks=follow):
        if not deep:
            names.clear()
        for name in files:
            path = os.path.join(folder, name)
            yield os.path.normpath(path) if root == "." else path


def read(spark: SparkSession, targets: list[str], flags: str = DEFAULT, limit: int = 1000, expect_match: bool = True) -> DataFrame:
    """(src_id, context, raw) of the files that the patterns match. If none does, a RuntimeError unless expect_match is false.

    Local patterns are listed on the driver and read by the executors; patterns with a scheme ("s3a://", "hdfs://") are listed by Spark, by their folder
    without special characters, and chosen by the whole pattern there."""
    local = [t for t in targets if "://" not in t]
    far = [t for t in targets if "://" in t]
    paths = listed(local, flags, limit)
    parts = []
    if paths:
        binary = spark.read.format("binaryFile").load([f"file://{escaped(os.path.abspath(p))}" for p in paths])
        name = F.url_decode(F.regexp_replace("path", "^file:/*", "/")) if any(set(p) & set(" %+") for p in paths) else F.regexp_replace("path", "^file:/*", "/")
        here = os.getcwd().rstrip("/") + "/"
        relative = any(not os.path.isabs(p) for p in paths)
        shown = F.when(F.startswith(name, F.lit(here)), F.substring(name, len(here) + 1, 1 << 20)).otherwise(name) if relative else name
        parts.append(binary.select(shown.alias("src_id"), shown.alias("context"), F.col("content").alias("raw")))
    for target in far:
        scheme, _, rest = target.partition("://")
        match = Matcher(rest, flags, limit)
        roots = sorted({f"{scheme}://{root}" for root, _ in match.roots()})
        binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
        name = F.regexp_replace("path", r"^\w+:/*", "")
        yes = [p.pattern for p in match.yes]
        chosen = name.rlike("^(?:" + "|".join(yes) + ")$")
        if match.no:
            chosen &= ~name.rlike("^(?:" + "|".join(p.pattern for p in match.no) + ")$")
        parts.append(binary.where(chosen).select(F.col("path").alias("src_id"), F.col("path").alias("context"), F.col("content").alias("raw")))
    if expect_match and not paths and (not parts or all(p.isEmpty() for p in parts)):
        raise RuntimeError("None of the source targets matched any file: " + ", ".join(targets))
    out = spark.createDataFrame([], FILES)
    for p in parts:
        out = p if out is None or p is parts[0] else out.unionByName(p)
    return out


def escaped(path: str) -> str:
    """A path with what Hadoop takes for a pattern escaped."""
    return "".join("\\" + c if c in "{}[]*?\\," else c for c in path)


def stream(spark: SparkSession, folder: str, name_glob: str = "*") -> DataFrame:
    """The same rows of files that arrive in a folder, as a stream."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", name_glob).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("src_id"), F.col("path").alias("context"), F.col("content").alias("raw"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
