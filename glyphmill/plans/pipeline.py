"""A pipeline of steps as a plan over chunks.

Steps that are expressions stay in the JVM. Neighbouring steps that need Python run in one Arrow function, so that chunks cross over once.
Where all categories that can come to a flow control are known, it is decided when the plan is made; wildcards over unknown ones are expressions, too.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from glyphmill.functions import encodings
from glyphmill.functions.batches import PART, parts, tidied
from glyphmill.model import ALLOW, CHUNK, HALT, Chunk, Filter, FlowControl, Step
from glyphmill.operators import markdown, markup, plain, python_source, source_code

STEPS: dict[str, type[Step]] = {
    "text": plain.TextFilter,
    "url": plain.UrlFilter,
    "context": plain.ContextFilter,
    "markdown": markdown.MarkdownFilter,
    "html": markup.HtmlFilter,
    "xml": markup.XmlFilter,
    "odf": markup.OdfFilter,
    "ooxml": markup.OoxmlFilter,
    "python": python_source.PythonFilter,
    "javascript": source_code.JavaScriptFilter,
    "cpp": source_code.CppFilter,
    "stylesheets": source_code.StylesheetsFilter,
    "wildcard": plain.WildcardControl,
}


def register(name: str, step: type[Step]) -> None:
    """Makes a step of one's own known by a name. Its module must be importable on the workers."""
    STEPS[name] = step


def step_class(name: str) -> type[Step]:
    """By a known name (also with the last part of a dotted one), or of a module that has get_plugin()."""
    if name in STEPS:
        return STEPS[name]
    try:
        module = importlib.import_module(name)
    except ImportError:
        if (last := name.rsplit(".", 1)[-1]) in STEPS:
            return STEPS[last]
        raise
    for entry in ("get_plugin", "get_filter"):
        if hasattr(module, entry):
            return getattr(module, entry)()
    raise ValueError(f"{name} is no step")


def build(spec: list | None | bool = True, default_encoding: str = "") -> list[Step] | None:
    """Steps of a pipeline from names and {name: options}. Nothing or an empty list: the text filter; None: no pipeline."""
    if spec is None:
        return None
    steps: list[Step] = []
    for item in spec if isinstance(spec, list) and spec else ["text"]:
        if isinstance(item, dict):
            if len(item) != 1:
                raise ValueError("a step is a name, or one name with its options")
            ((name, options),) = item.items()
        else:
            name, options = item, {}
        kind = step_class(name)
        if issubclass(kind, FlowControl):
            if not steps:
                raise ValueError("a pipeline can't begin with a flow control")
            steps.append(kind(options))
        elif issubclass(kind, Filter):
            steps.append(kind(options, default_encoding))
        else:
            raise ValueError(f"{name} is neither a filter nor a flow control")
    return steps


@dataclass(frozen=True)
class Guarded:
    """A filter and the flow control right before it, if any: of several in a row the last decides."""

    step: Filter
    control: FlowControl | None = None


def guard(steps: list[Step]) -> list[Guarded]:
    out, control = [], None
    for step in steps:
        if isinstance(step, FlowControl):
            control = step
        else:
            out.append(Guarded(step, control))
            control = None
    return out


def flow(control: FlowControl, category: Column, known: set[str] | None) -> tuple[Column, Column] | None:
    """(allowed, halted) for a category column: decided here for all categories that can come, if they are known; else by the control's expressions, None if it has none."""
    if known is None:
        return control.columns(category)
    by = {c: control.adjust(c) for c in sorted(known)}
    pick = lambda status: [c for c, s in by.items() if s == status]
    return (category.isin(pick(ALLOW)) if pick(ALLOW) else F.lit(False)), (category.isin(pick(HALT)) if pick(HALT) else F.lit(False))


def apply(chunks: DataFrame, steps: list[Step], categories: set[str] | None = None) -> DataFrame:
    """All steps on chunks. Chunks with an error, binary ones and those that were halted pass unchanged. categories: all that come in, if known."""
    pending: list[Guarded] = []
    known = set(categories) if categories is not None else None

    def flush(df: DataFrame) -> DataFrame:
        if not pending:
            return df
        done = list(pending)
        pending.clear()
        return df.mapInArrow(tidied(python_steps(done)), CHUNK)

    for g in guard(steps):
        routed = flow(g.control, F.col("category"), known) if g.control else (F.lit(True), F.lit(False))
        text = g.step.column(F.col("text"))
        if text is not None and routed is not None:
            chunks = flush(chunks)
            open_ = ~F.col("halted") & F.col("error").isNull() & F.col("text").isNotNull()
            allowed, halted = routed
            on = open_ & allowed
            if g.control:
                chunks = chunks.withColumn("halted", F.col("halted") | (open_ & halted))
                on = ~F.col("halted") & F.col("error").isNull() & F.col("text").isNotNull() & allowed
            chunks = chunks.withColumns({"text": F.when(on, text).otherwise(F.col("text")), "category": F.when(on, F.lit(g.step.column_category())).otherwise(F.col("category"))})
        else:
            pending.append(g)
        own = g.step.categories()
        if own is None or known is None:
            known = None
        else:
            known = (known if g.control else set()) | set(own)
    return flush(chunks).select(*[F.col(f.name) for f in CHUNK])


TEXT, RAW = CHUNK.names.index("text"), CHUNK.names.index("raw")


def filled(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Chunks as batches of about PART characters, unless one has more."""
    out: list[dict] = []
    size = 0
    for row in rows:
        out.append(row)
        size += len(row["text"] or "") + len(row["raw"] or b"")
        if size > PART:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def python_steps(guards: list[Guarded]):
    """Steps as one function over batches of chunks."""
    schema = to_arrow_schema(CHUNK)

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            yield from one(row, 0)

    def one(row: dict, k: int) -> Iterator[dict]:
        if k == len(guards) or row["error"] is not None or row["halted"] or row["text"] is None:
            yield row
            return
        g = guards[k]
        status = g.control.adjust(row["category"]) if g.control else ALLOW
        if status == HALT:
            yield row | {"halted": True}
        elif status != ALLOW:
            yield from one(row, k + 1)
        else:
            for new in stepped(row, g.step):
                yield from one(new, k + 1)

    def apply_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, TEXT, RAW):
                yield from filled(run(part.to_pylist()), schema)

    return apply_all


def stepped(row: dict, step: Filter) -> list[dict]:
    """The chunks that a filter makes of one; of an exception, one with the error."""
    try:
        step.ready()
        made = step.process(Chunk(row["text"], row["context"], row["encoding"] or "", row["category"] or "text"))
    except Exception as e:
        return [row | {"error": f"{type(e).__name__}: {e}"}]
    return [as_row(row["src_id"], [*(row["path"] or []), i], c) for i, c in enumerate(made)]


def as_row(src_id: str, path: list[int], c: Chunk) -> dict:
    raw = isinstance(c.text, bytes)
    return {"src_id": src_id, "path": path, "text": None if raw else c.text, "raw": c.text if raw else None, "context": c.context, "encoding": c.encoding, "category": c.category, "error": c.error, "halted": False}


def first(files: DataFrame, step: Filter) -> DataFrame:
    """Chunks of files (src_id, context, raw: binary) by a pipeline's first step, which finds the encoding."""
    schema = to_arrow_schema(CHUNK)
    files = files.select(F.col("src_id").cast("string"), F.coalesce(F.col("context").cast("string"), F.lit("")).alias("context"), F.col("raw").cast("binary")).where("raw is not null")
    if type(step) is plain.TextFilter and step.column(F.col("raw")) is not None and step.default_encoding in ("utf-8", "utf8"):
        return first_text(files, step)

    def chunks(batch: pa.RecordBatch) -> Iterator[dict]:
        for i in range(len(batch)):
            src, context, raw = (batch.column(k)[i].as_py() for k in range(3))
            for k, c in enumerate(encodings.read(raw, context, step)):
                yield as_row(src, [k], c)

    def apply_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2):
                yield from filled(chunks(part), schema)

    return files.mapInArrow(tidied(apply_first), CHUNK)


def first_text(files: DataFrame, step: plain.TextFilter) -> DataFrame:
    """As first, for text as it is with UTF-8 for its default: a file in UTF-8 without a mark is its text, and only others come to Python."""
    found = F.col("raw").cast("string")
    easy = F.is_valid_utf8(found) & (F.length("raw") > 0) & encodings.mark_column(F.col("raw")).isNull()
    kind = pa.struct([(name, pa.string()) for name in ("text", "encoding", "error")])

    def read(raws: pa.Array, contexts: pa.Array) -> pa.Array:
        made = [None if raw is None else encodings.read(raw.as_py(), context.as_py(), step)[0] for raw, context in ((r if r.is_valid else None, c) for r, c in zip(raws, contexts))]
        return pa.array([None if c is None else {"text": c.text, "encoding": c.encoding, "error": c.error} for c in made], kind)

    other = files.select("src_id", "context", F.when(easy, found).alias("text"), F.arrow_udf(read, "struct<text:string,encoding:string,error:string>")(F.when(~easy, F.col("raw")), F.col("context")).alias("other"))
    mine = F.col("text").isNotNull()
    values = {
        "path": F.array(F.lit(0)),
        "text": F.when(mine, F.col("text")).otherwise(F.col("other.text")),
        "raw": F.lit(None).cast("binary"),
        "encoding": F.when(mine, F.lit("utf-8")).otherwise(F.col("other.encoding")),
        "category": F.when(F.col("other.error").isNull(), F.lit("text")).otherwise(F.lit("")),
        "error": F.col("other.error"),
        "halted": F.lit(False),
    }
    return other.select(*(values[n].alias(n) if n in values else F.col(n) for n in CHUNK.names))


def chunks_of(df: DataFrame, id_col: str, text_col: str, category: Column | str = "text", context: Column | None = None) -> DataFrame:
    """A table's texts as chunks; rows without id or text are left out, rows that repeat an id are chunks of one source."""
    src = F.col(id_col).cast("string")
    return df.select(
        src.alias("src_id"),
        F.array(F.lit(0)).alias("path"),
        F.col(text_col).cast("string").alias("text"),
        F.lit(None).cast("binary").alias("raw"),
        (src if context is None else context).alias("context"),
        F.lit("utf-8").alias("encoding"),
        (F.lit(category) if isinstance(category, str) else category).alias("category"),
        F.lit(None).cast("string").alias("error"),
        F.lit(False).alias("halted"),
    ).where("src_id is not null and text is not null")
