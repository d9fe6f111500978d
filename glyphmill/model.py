"""Chunks of text, results, and the steps that turn chunks into chunks."""

from __future__ import annotations

import codecs
import re
import unicodedata
import warnings
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import types as T

#: path: the ordinal at each step, which restores the order of a source's chunks. Of text and raw one is null. halted: no further step applies.
CHUNK = T.StructType(
    [
        T.StructField("src_id", T.StringType()),
        T.StructField("path", T.ArrayType(T.IntegerType())),
        T.StructField("text", T.StringType()),
        T.StructField("raw", T.BinaryType()),
        T.StructField("context", T.StringType()),
        T.StructField("encoding", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("halted", T.BooleanType()),
    ]
)
RESULT = T.StructType(
    [
        T.StructField("src_id", T.StringType()),
        T.StructField("path", T.ArrayType(T.IntegerType())),
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("context", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

#: Names that web pages use and Python doesn't know.
ALIASES = dict(pair.split(">") for pair in "x-sjis>shift-jis windows-874>cp874 macintosh>mac-roman x-mac-cyrillic>mac-cyrillic iso-8859-8-i>iso-8859-8".split())
CATEGORY = re.compile(r"[\w-]+", re.ASCII)


def encoding_name(name: str) -> str:
    """The canonical name of an encoding, without byte order or mark; "" stays (binary)."""
    name = name.lower()
    if not name:
        return name
    name = ALIASES.get(name, name)
    for family in ("utf-16", "utf-32"):
        if name.startswith(family):
            return family
    return codecs.lookup("utf-8" if name == "utf-8-sig" else name).name


@dataclass(frozen=True)
class Chunk:
    text: str | bytes
    context: str
    encoding: str
    category: str
    error: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "encoding", encoding_name(self.encoding))
        if not self.error and not CATEGORY.fullmatch(self.category):
            raise ValueError(f"{self.category!r} is not a valid category")

    def but(self, **changes) -> Chunk:
        return replace(self, **changes)


class Step:
    """Options and their checks, common to filters and flow controls. Steps are built on the driver and sent to the workers; what can't be sent is made in setup(), once in each."""

    def default_config(self) -> dict | None:
        """Options by name with their defaults, whose types bind; None takes any."""
        return None

    def __init__(self, options: dict | None = None) -> None:
        defaults, options = self.default_config(), options or {}
        self.config = dict(defaults or {})
        if defaults is None and options:
            warnings.warn(f"{type(self).__name__} names no defaults: its options aren't checked", stacklevel=2)
        for key, value in options.items():
            if defaults is not None:
                if key not in defaults:
                    raise KeyError(f"{key!r} is not an option of {type(self).__name__}")
                value = self.validated(key, value)
            self.config[key] = value
        self._ready = False

    def validated(self, key: str, value):
        """The value as the type of the option's default."""
        like = self.default_config()[key]
        name = f"{type(self).__name__}: {key}"
        if isinstance(like, bool):
            if not isinstance(value, bool):
                raise ValueError(f"{name} must be true or false")
        elif isinstance(like, str):
            if not isinstance(value, str):
                raise ValueError(f"{name} must be a string")
        elif isinstance(like, int):
            if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value):
                raise ValueError(f"{name} must be an integer")
            return int(value)
        elif isinstance(like, float):
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise ValueError(f"{name} must be a number")
            return float(value)
        elif isinstance(like, (list, tuple, set)):
            if not isinstance(value, list):
                raise ValueError(f"{name} must be a list")
            return type(like)(value)
        elif isinstance(like, dict) and not isinstance(value, dict):
            raise ValueError(f"{name} must be a mapping")
        return value

    def setup(self) -> None:
        """Prepares what process() or adjust() needs; called once before the first of them."""

    def ready(self) -> None:
        if not self._ready:
            self.setup()
            self._ready = True

    def __getstate__(self) -> dict:
        return {"config": self.config, "_ready": False}


class Filter(Step):
    """A step from one chunk to any number. As a pipeline's first step it also says how a file's encoding is found and decoded."""

    #: Text is read with "\r\n" and "\r" as "\n".
    universal_newlines = True
    #: Whether the filter reads the file's bytes by itself (containers).
    binary = False

    def __init__(self, options: dict | None = None, default_encoding: str = "utf-8") -> None:
        super().__init__(options)
        self.default_encoding = (default_encoding or "utf-8").lower()

    def __getstate__(self) -> dict:
        return super().__getstate__() | {"default_encoding": self.default_encoding}

    def header_encoding(self, head: bytes) -> str | None:
        """An encoding that the first bytes name."""
        return None

    def content_encoding(self, raw: bytes) -> str | None:
        """An encoding that the whole content tells."""
        return None

    def magic_encoding(self, raw: bytes) -> str | None:
        """An encoding told by the very first bytes, before anything else; "" means binary. None: byte order marks only."""
        return None

    def categories(self) -> tuple[str, ...] | None:
        """All categories it can give, if they are known beforehand."""
        return None

    def column(self, text: Column) -> Column | None:
        """The new text as an expression over the old one, where the filter keeps one chunk per chunk and needs no Python; else None."""
        return None

    def column_category(self) -> str:
        """The category of chunks made by column()."""
        return "text"

    def process(self, chunk: Chunk) -> list[Chunk]:
        return [chunk.but(category="text")]

    def read(self, raw: bytes, context: str, encoding: str) -> list[Chunk]:
        """A file's chunks, if this is the first step."""
        text = raw.decode(encoding)
        if self.universal_newlines:
            text = newlines(text)
        return self.process(Chunk(text, context, encoding, "text"))


ALLOW, SKIP, HALT = 0, 1, 2


class FlowControl(Step):
    """Says for a category what the next filter does with its chunks: ALLOW applies it, SKIP passes by it, HALT goes straight to the checker."""

    def columns(self, category: Column) -> tuple[Column, Column] | None:
        """Whether it allows and whether it halts, as expressions over any category; None if it has none."""
        return None

    def adjust(self, category: str) -> int:
        return ALLOW


def newlines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def normal_form(text: str, form: str) -> str:
    return unicodedata.normalize(form, text)
