"""Prompt texts out of files, and their chunks by heading."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import suffix

PROSE = (".instructions", ".md", ".prompt", ".txt")
SUFFIXES = (*PROSE, ".dart", ".js", ".json", ".jsx", ".py", ".ts", ".tsx", ".yaml", ".yml")
_TRIPLE = re.compile(r'"""(.*?)"""|\'\'\'(.*?)\'\'\'', re.S)
_TEMPLATE = re.compile(r"`([^`]*)`", re.S)
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*$")
LONG = 50


def _strings(value):
    if isinstance(value, str):
        yield value
    for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from _strings(v)


def prompt_text(path: str, content: str) -> str | None:
    """The prompt text of a file: all of prose; long string literals of code; block scalars of YAML; long strings of JSON. None if there is none."""
    end = "." + path.rsplit(".", 1)[-1].lower()
    found: list[str] = []
    if end in PROSE:
        return content
    if end in (".py", ".dart"):
        found = [a or b for a, b in _TRIPLE.findall(content)]
    elif end in (".js", ".jsx", ".ts", ".tsx"):
        found = _TEMPLATE.findall(content)
    elif end == ".json":
        try:
            found = list(_strings(json.loads(content)))
        except ValueError:
            return None
    elif end in (".yaml", ".yml"):
        block, depth = None, 0
        for line in content.split("\n"):
            indent = len(line) - len(line.lstrip())
            if block is not None and (not line.strip() or indent > depth):
                block.append(line.strip())
                continue
            if block is not None:
                found.append("\n".join(block))
                block = None
            if re.search(r":\s*[|>][-+]?\s*$", line):
                block, depth = [], indent
        if block is not None:
            found.append("\n".join(block))
    found = [f.strip() for f in found if len(f.strip()) > LONG]
    return "\n\n".join(found) or None


def _parts(lines: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    """A long section cut at rules and at second blank lines; parts of over 20 words stay, or else the whole."""
    if len(lines) <= 15 or sum(len(t.split()) for _, t in lines) <= 80:
        return [lines]
    out, now, blank = [], [], 0
    for n, t in lines:
        blank = blank + 1 if not t.strip() else 0
        if re.fullmatch(r"\s*-{3,}\s*", t) or blank == 2:
            out.append(now)
            now = []
        else:
            now.append((n, t))
    out.append(now)
    return [p for p in out if sum(len(t.split()) for _, t in p) > 20] or [lines]


def chunks_of(content: str) -> list[tuple[str, int, int, str, int]]:
    """(text, first line, last line, heading, level); a section holds its subsections, text without headings is one root chunk."""
    lines = list(enumerate(content.split("\n"), 1))
    heads, fenced = [], False
    for n, t in lines:
        fenced ^= t.lstrip().startswith("```")
        m = _HEADING.match(t)
        if m and not fenced:
            heads.append((n, len(m[1]), m[2]))
    if not heads:
        sections = [(lines, "(root)", 0)]
    else:
        sections = []
        for i, (n, level, title) in enumerate(heads):
            end = next((m for m, l, _ in heads[i + 1 :] if l <= level), len(lines) + 1)
            sections.append((lines[n - 1 : end - 1], title, level))
    out = []
    for part, title, level in sections:
        for p in _parts(part):
            text = "\n".join(t for _, t in p).strip()
            if text:
                out.append((text, p[0][0], p[-1][0], title, level))
    return out


def prompt_files(files: DataFrame, min_bytes: int = 200) -> DataFrame:
    """Files that may hold instructions: of a prompt suffix, and not very small."""
    return files.where(suffix(F.col("path")).isin(*SUFFIXES) & (F.col("length") >= min_bytes))


def chunk_files(files: DataFrame, min_chars: int = 100) -> DataFrame:
    """file, seq, text, line_start, line_end, heading, heading_level of files (path, content) with enough prompt text."""

    def run(batches):
        for b in batches:
            rows = []
            for p, t in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                text = prompt_text(p or "", t or "")
                if text and len(text) >= min_chars:
                    rows += [(p, k, *c) for k, c in enumerate(chunks_of(text))]
            cols = list(zip(*rows)) or [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "seq", "text", "line_start", "line_end", "heading", "heading_level"])

    return files.select("path", "content").mapInArrow(run, "file string, seq long, text string, line_start int, line_end int, heading string, heading_level int")
