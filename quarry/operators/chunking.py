"""Documents to chunks: block readers for five formats and one assembler.

A reader turns a document's lines into blocks; the assembler packs blocks into
chunks of bounded length that keep their section path and line range.  Lengths
are in UTF-16 units, as everywhere in this engine's limits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarry.config import ChunkLimits
from quarry.functions.text import SPACE, SPACES

_SPACES = SPACES
_RUN = re.compile(f"{SPACE}+")
_GRAPHEME = regex.compile(r"\X")
#: Characters that can be of a grapheme of several, or of two UTF-16 units; below them every character is one of both.
_JOINING = re.compile("[\r\u0300-\U0010ffff]")

# Elements whose content is never visible.
HIDDEN = ("script", "style", "template", "noscript", "svg", "math")
# Elements that end a run of text.
BLOCK_LEVEL = (
    "address", "article", "aside", "blockquote", "br", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr",
    "ul",
)
# Named entities.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ensp": " ", "emsp": " ", "thinsp": " ", "hellip": "…", "mdash": "—", "ndash": "–", "copy": "©", "reg": "®", "trade": "™"}
# Fixed pattern: a source line that opens a declaration.
DECLARATION = re.compile(
    rf"(?a:(export{SPACE}+)?(async{SPACE}+)?(public|private|protected|internal|static|final|abstract|open|const|let|var)?{SPACE}*(class|interface|type|enum|struct|trait|impl|func|function|def|fn|module|namespace|package)\b)"
)


@dataclass
class Block:
    start: int
    end: int
    text: str
    path: list[str | None] = field(default_factory=list)
    boundary: bool = True


def units16(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def strip(text: str) -> str:
    return text.strip(_SPACES)


def collapse(text: str) -> str:
    return strip(_RUN.sub(" ", text))


def section_name(text: str, limits: ChunkLimits) -> str:
    return collapse(text)[: limits.section_max_chars]


def _entered(path: list, level: int, name: str) -> list:
    """The path after a heading of this level; levels that were skipped stay empty (None)."""
    kept = path[: level - 1]
    return kept + [None] * (level - 1 - len(kept)) + [name]


def _gathered(rows: list[tuple[int, str]], path=(), boundary=True) -> Iterator[Block]:
    """One block of numbered lines, unless they are blank."""
    text = strip("\n".join(line for _, line in rows))
    if text:
        yield Block(rows[0][0], rows[-1][0], text, list(path), boundary)


def text_blocks(lines: list[str], limits: ChunkLimits) -> Iterator[Block]:
    """Paragraphs between blank lines."""
    held: list[tuple[int, str]] = []
    for row in [*enumerate(lines, 1), (0, "")]:
        if strip(row[1]):
            held.append(row)
        elif held:
            yield from _gathered(held)
            held = []


def markdown_blocks(lines: list[str], limits: ChunkLimits) -> Iterator[Block]:
    """Headings, which set the section; fenced code, whole; paragraphs."""
    path: list[str | None] = []
    held: list[tuple[int, str]] = []
    fence = None
    for number, line in enumerate(lines, 1):
        mark = re.match(rf"{SPACE}*(```|~~~)", line)
        if fence:
            held.append((number, line))
            if mark and strip(line).startswith(fence):
                yield from _gathered(held, path, False)
                held, fence = [], None
            continue
        heading = re.fullmatch(rf"(#{{1,6}}){SPACE}+(.*[^{_SPACES}]){SPACE}*", line)
        if mark or heading or not strip(line):
            if held:
                yield from _gathered(held, path, False)
                held = []
            if mark:
                fence, held = mark[1], [(number, line)]
            elif heading:
                path = _entered(path, len(heading[1]), section_name(heading[2], limits))
                yield Block(number, number, strip(line), list(path))
            continue
        held.append((number, line))
    if held:
        yield from _gathered([*held, (len(lines), "")] if fence else held, path, False)


def _sectioned(lines: list[str], opens, names) -> Iterator[Block]:
    """Blocks that begin at lines for which `opens` holds, under the latest of their `names`."""
    held: list[tuple[int, str]] = []
    section = ""
    for number, line in enumerate(lines, 1):
        if opens(line):
            if held:
                yield from _gathered(held, [section] if section else [])
                held = []
            section = names(line) or section
        held.append((number, line))
    if held:
        yield from _gathered(held, [section] if section else [])


def structured_blocks(lines: list[str], limits: ChunkLimits) -> Iterator[Block]:
    """JSON and YAML by top-level members, which name the section."""
    top = re.compile(rf"(?a:[^\s{{}}\[\],]|{SPACE}{{0,2}}[\"']?[\w.-]+[\"']?{SPACE}*:)")
    key = re.compile(rf"(?a:(?:{SPACE}|-)*[\"']?([\w.-]+)[\"']?{SPACE}*:)")

    def opens(line: str) -> bool:
        return bool(top.match(line)) and not (line[:1] in _SPACES and line[:1] and not re.match(rf"(?a:{SPACE}{{0,2}}[\"']?[\w.-]+[\"']?{SPACE}*:)", line))

    def names(line: str) -> str:
        m = key.match(line)
        return section_name(m[1], limits) if m else ""

    return _sectioned(lines, opens, names)


def code_blocks(lines: list[str], limits: ChunkLimits) -> Iterator[Block]:
    """Source code by declarations that begin in the first column."""
    return _sectioned(lines, lambda line: line[:1] not in ("", *_SPACES) and bool(DECLARATION.match(line)), lambda line: section_name(line, limits))


def decode_entities(text: str) -> str:
    """Named and numbered entities, once; what isn't one stays."""

    def one(m: re.Match) -> str:
        name = m[1].lower()
        if not name.startswith("#"):
            return ENTITIES.get(name, m[0])
        digits, base = (name[2:], 16) if name.startswith("#x") else (name[1:], 10)
        code = int(digits, base) if len(digits) < 12 else 0
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    return re.sub(r"&(#x[0-9a-f]+|#[0-9]+|[a-z][a-z0-9]*);", one, text, flags=re.IGNORECASE | re.ASCII)


def _tag_end(text: str, at: int) -> int:
    """After the '>' that closes a tag; quoted attribute values may hold others."""
    while m := re.compile(r"[\"'>]").search(text, at):
        if m[0] == ">":
            return m.end()
        close = text.find(m[0], m.end())
        if close < 0:
            break
        at = close + 1
    return len(text)


def _html_events(text: str) -> Iterator[tuple[str, object, int]]:
    """('text', string, at), ('open' | 'close', element, at); hidden content, comments and declarations give nothing."""
    at, size = 0, len(text)
    name_at = re.compile(r"</?([A-Za-z0-9:-]+)", re.ASCII)
    while at < size:
        lt = text.find("<", at)
        if lt != at:
            yield "text", text[at : lt if lt >= 0 else size], at
            if lt < 0:
                return
            at = lt
        if text.startswith("<!--", at):
            close = text.find("-->", at + 4)
            at = size if close < 0 else close + 3
        elif text[at + 1 : at + 2] in ("!", "?") and at + 1 < size:
            at = _tag_end(text, at)
        elif not (m := name_at.match(text, at)):
            yield "text", "<", at
            at += 1
        else:
            name, end = m[1].lower(), _tag_end(text, m.end())
            closing = text[at + 1] == "/"
            if not closing and name in HIDDEN:
                if text[end - 2 : end - 1] != "/":
                    shut = re.compile(rf"</{re.escape(name)}(?=[>/]|{SPACE}|$)", re.IGNORECASE).search(text, end)
                    end = _tag_end(text, shut.start()) if shut else size
            else:
                yield "close" if closing else "open", name, at
            at = end


def html_blocks(lines: list[str], limits: ChunkLimits) -> Iterator[Block]:
    """Visible text; headings set the section, block-level elements end a run, other tags separate words."""
    text = "\n".join(lines)
    path: list[str | None] = []
    run: list[str] = []
    heading: list[str] | None = None
    level, start, line, counted = 0, 1, 1, 0

    def visible(parts: list[str]) -> str:
        return collapse(decode_entities("".join(parts)))

    def ended(parts: list[str], boundary: bool) -> Iterator[Block]:
        if content := visible(parts):
            yield Block(start, line, content, list(path), boundary)

    for kind, what, at in [*_html_events(text), ("end", "", len(text))]:
        line += text.count("\n", counted, at)
        counted = at
        grade = re.fullmatch("h([1-6])", what) if kind in ("open", "close") else None
        if kind == "text" or kind in ("open", "close") and not grade and what not in BLOCK_LEVEL:
            piece = what if kind == "text" else " "
            if heading is not None:
                heading.append(piece)
            else:
                if not run:
                    start = line
                run.append(piece)
            continue
        if kind == "end" or kind == "open" and grade:
            if kind == "open":
                yield from ended(run, False)
                run = []
        elif heading is None and not grade:
            yield from ended(run, False)
            run = []
        if heading is not None and (grade or kind == "end"):
            if content := visible(heading):
                path = _entered(path, level, section_name(content, limits))
                yield Block(start, line, content, list(path))
            heading = None
        if kind == "end":
            yield from ended(run, False)
        elif kind == "open" and grade:
            heading, level, start = [], int(grade[1]), line


READERS = {"markdown": markdown_blocks, "text": text_blocks, "html": html_blocks, "json": structured_blocks, "yaml": structured_blocks, "code": code_blocks}


def pieces(text: str, most: int) -> list[str]:
    """The text cut into pieces of at most `most` units, never inside a grapheme."""
    if not _JOINING.search(text):
        return [text[a : a + most] for a in range(0, max(1, len(text)), most)]
    if units16(text) <= most:
        return [text]
    out, held, size = [], [], 0
    for cluster in _GRAPHEME.findall(text):
        n = units16(cluster)
        if held and size + n > most:
            out.append("".join(held))
            held, size = [], 0
        held.append(cluster)
        size += n
    return [*out, "".join(held)]


def chunk_document(source: str, text: str, form: str, limits: ChunkLimits = ChunkLimits()) -> Iterator[dict]:
    """Chunks of a document, in order: source, ord, id, section_path, start_line, end_line, content."""
    lines = re.split(r"\r?\n", text)
    groups: list[tuple[Block, list[str], int]] = []
    for block in READERS[form](lines, limits):
        for i, piece in enumerate(pieces(block.text, limits.max_chars)):
            size = units16(piece)
            if groups:
                first, parts, length = groups[-1]
                full = length + size + 2 > limits.max_chars
                if not full and not (block.boundary and i == 0 and length >= limits.min_chars):
                    first.end = block.end
                    groups[-1] = (first, [*parts, piece], length + 2 + size)
                    continue
            groups.append((Block(block.start, block.end, "", block.path), [piece], size))
    number = 0
    for first, parts, _ in groups:
        if content := strip("\n\n".join(parts)):
            identity = hashlib.sha256(f"{source}:{first.start}:{content}".encode("utf-8", "surrogatepass")).hexdigest()[:16]
            yield {"source": source, "ord": number, "id": identity, "section_path": first.path, "start_line": first.start, "end_line": first.end, "content": content}
            number += 1


CHUNK = "source string, ord int, id string, section_path array<string>, start_line int, end_line int, content string"
_ARROW = pa.schema([("source", pa.string()), ("ord", pa.int32()), ("id", pa.string()), ("section_path", pa.list_(pa.string())), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string())])


def chunk_corpus(docs: DataFrame, limits: ChunkLimits = ChunkLimits()) -> DataFrame:
    """docs (id, format, text) -> chunks; a document with null text or an unknown format gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = [c for r in batch.slice(a, 256).to_pylist() if r["text"] is not None and r["format"] in READERS for c in chunk_document(r["id"], r["text"], r["format"], limits)]
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return docs.select("id", "format", "text").mapInArrow(run, CHUNK)
