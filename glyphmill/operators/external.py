"""Checking by an external program (Aspell or Hunspell), one process for the chunks of a batch's encoding.

The engine's own checker needs none; this is for those who have the programs and their dictionaries on all workers.
"""

from __future__ import annotations

import codecs
import os
import subprocess
import tempfile
from collections.abc import Iterator
from contextlib import nullcontext

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from glyphmill.functions.batches import parts, tidied
from glyphmill.model import CHUNK, RESULT

#: Bytes in a line that the programs take; bytes of chunks that one process gets.
LINE, LARGE = 8191, 4 << 20

#: Options that would change what the program does altogether, or that it asks a terminal for.
_BOTH_WAYS = "affix-compress backup byte-offsets clean-affixes guess ignore-repl invisible-soundslike partially-expand rem-sug-split-char reverse save-repl set-prefix skip-invalid-words sug-repl-table sug-typo-analysis suggest time validate-affixes validate-words".split()
NOT_ASPELL = frozenset([*_BOTH_WAYS, *(f"dont-{x}" for x in _BOTH_WAYS if x != "rem-sug-split-char"), *"? P a add-sug-split-char b c keyboard keymapping m prefix repl sug-mode v warn x".split()])
NOT_HUNSPELL = frozenset("1 D G L P S a h help l m s v vv w".split())


def options(given: dict, refused: frozenset[str]) -> list[str]:
    """Arguments of a mapping of options: true is a flag, a list repeats its option, false and what is refused are left out."""
    out: list[str] = []
    for key, value in given.items():
        if key in refused or value is False or value is None:
            continue
        name = f"-{key}" if len(key) == 1 else f"--{key}"
        for one in value if isinstance(value, list) else [value]:
            out += [name] if one is True else [name, str(one)]
    return out


def aspell(encoding: str = "", given: dict | None = None, dictionary: str = "", file: str | None = None, binary: str = "aspell") -> list[str]:
    given = {"mode": "none"} | (given or {})
    parts = [["--encoding", encoding] if encoding else [], ["--add-extra-dicts", dictionary] if dictionary else []]
    return [binary, "list", *parts[0], *parts[1], *options(given, NOT_ASPELL), *([] if file is None else [file])]


def hunspell(encoding: str = "", given: dict | None = None, dictionary: str = "", file: str | None = None, binary: str = "hunspell") -> list[str]:
    parts = [["-i", encoding] if encoding else [], ["-p", dictionary] if dictionary else []]
    return [binary, "-l", *parts[0], *parts[1], *options(given or {}, NOT_HUNSPELL), *([] if file is None else [file])]


def short_lines(text: str, encoding: str, most: int = LINE) -> Iterator[bytes]:
    """The text's lines, none of more than so many bytes: longer ones are broken at their last white space that fits, else between characters."""
    for line in text.splitlines():
        raw = line.encode(encoding)
        while len(raw) > most:
            head = raw[:most].decode(encoding, "ignore")
            space = max(head.rfind(" "), head.rfind("\t"))
            head = head[: space + 1] if space > 0 else head
            part = head.encode(encoding)
            yield part
            raw = raw[len(part) :]
        yield raw


def safe_encoding(encoding: str) -> str:
    """The programs don't take UTF-16 and UTF-32."""
    return "utf-8" if not encoding or encoding.startswith(("utf-16", "utf-32")) else encoding


def ask(command: list[str], given: bytes | None) -> list[str]:
    """The lines that the program prints; a RuntimeError with what it said if it fails."""
    done = subprocess.run(command, input=given, stdin=subprocess.DEVNULL if given is None else None, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, check=False)
    said = done.stdout.decode("utf-8", "replace")
    if done.returncode:
        raise RuntimeError(said.strip() or f"{command[0]} ended with {done.returncode}")
    return [w for w in said.replace("\r", "").split("\n") if w]


def ask_distinct(command: list[str], given: bytes | None) -> list[str]:
    """The distinct lines that the program prints, sorted: they are read from a file, as a large text's words are many more than its distinct ones."""
    with tempfile.TemporaryFile() as said, tempfile.TemporaryFile() if given is not None else open(os.devnull, "rb") as asked:
        if given is not None:
            asked.write(given)
            asked.seek(0)
        code = subprocess.run(command, stdin=asked, stdout=said, stderr=subprocess.STDOUT, check=False).returncode
        said.seek(0)
        if code:
            raise RuntimeError(said.read().decode("utf-8", "replace").strip() or f"{command[0]} ended with {code}")
        lines = {line.rstrip(b"\n") for line in said}
    return sorted({line.decode("utf-8", "replace").replace("\r", "") for line in lines} - {""})


def sentinel(number: int) -> str:
    """A word that no dictionary has, for the end of a chunk."""
    letters = []
    while number or not letters:
        number, k = divmod(number, 26)
        letters.append(chr(97 + k))
    return "Qzxvqjwzk" + "".join(letters) + "qzxjvkqw"


def ask_all(command: list[str], chunks: list[list[bytes]], encoding: str) -> list[list[str]] | None:
    """The words printed for each of several chunks by one process, told apart by what it prints between them; None if that can't be told."""
    marks = [sentinel(k) for k in range(len(chunks))]
    lines = [line for chunk, mark in zip(chunks, marks) for line in (*chunk, mark.encode(encoding))]
    try:
        said = ask(command, b"\n".join(lines) + b"\n")
    except RuntimeError:
        return None
    places = {w: i for i, w in enumerate(said) if w.startswith("Qzxvqjwzk")}
    at = [places.get(mark, -1) for mark in marks]
    if len(places) != len(marks) or sorted(at) != at or at[0] < 0:
        return None
    return [said[a + 1 : b] for a, b in zip([-1, *at], at)]


def check_by(chunks: DataFrame, program: str = "aspell", given: dict | None = None, dictionary: str = "", binary: str | None = None) -> DataFrame:
    """Results as of the engine's own checker, by a program. Whatever goes wrong with a chunk, also one that its encoding can't hold, is that chunk's error.

    Chunks of a batch, or of LARGE bytes of it, and an encoding go through one process; only if that fails, or its answers can't be told apart, each has its own."""
    if program not in ("aspell", "hunspell"):
        raise ValueError(f"{program!r} is no known checker")
    make = aspell if program == "aspell" else hunspell
    text_at, raw_at = CHUNK.names.index("text"), CHUNK.names.index("raw")
    schema = to_arrow_schema(RESULT)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, text_at, raw_at, most=LARGE)):
            out, asked = [], {}
            for row in batch.to_pylist():
                result = {k: row[k] for k in ("src_id", "path", "context", "category", "error")} | {"words": []}
                text = row["text"] if row["text"] is not None else (row["raw"] or b"").decode("utf-8", "replace")
                if row["error"] is None:
                    if not text.strip():
                        continue
                    encoding = safe_encoding(row["encoding"] or "")
                    try:
                        asked.setdefault(encoding, []).append((result, [x for x in short_lines(text, encoding) if x.strip()]))
                    except Exception as e:
                        result["error"] = f"{type(e).__name__}: {e}"
                out.append(result)
            for encoding, some in asked.items():
                command = make(encoding, given, dictionary, None, binary or program)
                found = ask_all(command, [lines for _, lines in some], encoding) if len(some) > 1 else None
                for k, (result, lines) in enumerate(some):
                    try:
                        result["words"] = sorted(set(found[k] if found else ask(command, b"\n".join(lines) + b"\n")))
                    except Exception as e:
                        result["error"] = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_pylist(out, schema)

    return chunks.mapInArrow(tidied(apply), RESULT)


def check_files(found: DataFrame, program: str, given: dict | None = None, dictionary: str = "", binary: str | None = None, encoding: str = "") -> DataFrame:
    """Results for whole files (src_id, context: the path, raw), which no pipeline has read: Aspell gets a file's bytes and name, Hunspell its name.

    A file that isn't on the worker's own file system has a temporary copy while it is checked."""
    schema = to_arrow_schema(RESULT)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                src, context, content = (batch.column(k)[i] for k in range(3))
                if not content.is_valid:
                    continue
                src, context = src.as_py(), context.as_py()
                raw = content.as_py() if program == "aspell" else None
                if raw is not None and not raw.strip():
                    continue
                result = {"src_id": src, "path": [0], "words": [], "context": context, "category": "file", "error": None}
                try:
                    with nullcontext() if os.path.exists(context) else tempfile.NamedTemporaryFile() as copy:
                        if copy:
                            copy.write(content.as_buffer())
                            copy.flush()
                        name = copy.name if copy else context
                        command = aspell(encoding, given, dictionary, name, binary or program) if program == "aspell" else hunspell(encoding, given, dictionary, name, binary or program)
                        result["words"] = ask_distinct(command, raw)
                except Exception as e:
                    result["error"] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([result], schema)

    return found.select(*(found[c].cast("string") for c in ("src_id", "context")), "raw").mapInArrow(tidied(apply), RESULT)


def compile_words(words: DataFrame, program: str, output: str, lang: str = "en", encoding: str = "utf-8", binary: str | None = None) -> str:
    """Writes the words (word: distinct), sorted, as the program's own dictionary. The file is one that a program on each worker loads whole, so that its words may come to the driver."""
    os.makedirs(os.path.dirname(os.path.abspath(output)), exist_ok=True)
    if os.path.exists(output):
        os.remove(output)
    raw = b"".join(r.word.encode(encoding) + b"\n" for r in words.orderBy("word").toLocalIterator())
    if program == "aspell":
        ask([binary or program, "--lang", lang, "--encoding", codecs.lookup(encoding).name, "create", "master", output], raw)
    else:
        with open(output, "wb") as f:
            f.write(raw)
    return output
