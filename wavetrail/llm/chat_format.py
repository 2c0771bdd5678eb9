"""Chat formatting with typed content parts.

A message is a list of parts: text, image, audio, document. A visitor flattens them, in order, into one segment of template text:
text is escaped so that no control string of the template survives in it, any other part becomes a placeholder, and its
reference and expanded token count are recorded. Messages without a part list are split at inline references
(``![caption](file.png)``); every piece keeps its source, so the written conversation reads back exactly.

Turns are flattened one by one where they lie; only finished segments are grouped by conversation. The output has one row per
conversation, which is as large as its longest conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetrail.llm.registry import query, table

ESCAPE = "\\"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: What opens and closes a turn. Other roles are written as <|role|>name<|text|>text<|end|>.
TURNS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
BEGIN = "<s>"
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>", *PLACEHOLDERS.values()]
KINDS = {
    "image": ("png", "jpg", "jpeg", "gif", "webp"),
    "audio": ("mp3", "wav", "flac", "ogg"),
    "document": ("pdf", "docx", "pptx", "xlsx"),
}
#: Tokens of a part without dimensions, and per patch of 14 x 14 pixels, second, page.
DEFAULT_TOKENS = {"image": 576, "audio": 750, "document": 1024}
PATCH, PER_SECOND, PER_PAGE = 14, 25, 512

_TO_ESCAPE = re.compile(r"\\|[<\[](?=" + "|".join(sorted({re.escape(c[1:]) for c in CONTROLS})) + ")")
_ESCAPED = re.compile(r"\\(\\?)")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_INLINE = re.compile(r"!\[[^\[\]\n]*\]\(([^()\x00-\x20]+?\.([A-Za-z0-9]{2,5}))\)")

PARTS_TYPE = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()),
    T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("seconds", T.DoubleType()),
    T.StructField("pages", T.LongType()),
]))
_SEGMENT = "conv_id long, turn long, role string, segment string, attachments array<struct<kind:string,ref:string,source:string,tokens:long>>"
_FORMATTED = (
    "conv_id long, n_turns long, formatted string, loss array<struct<start:long,stop:long>>, "
    "attachments array<struct<turn:long,role:string,kind:string,ref:string,source:string,tokens:long>>, expanded_tokens long"
)


def escape(text: str) -> str:
    """A backslash after every backslash and after the first character of every control string."""
    return _TO_ESCAPE.sub(lambda m: m.group() + ESCAPE, text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def split_inline(text: str) -> list[dict]:
    """Text and inline references as parts; the parts' texts joined give the text back."""
    by_suffix = {s: kind for kind, suffixes in KINDS.items() for s in suffixes}
    parts, at = [], 0
    for m in _INLINE.finditer(text):
        kind = by_suffix.get(m.group(2).lower())
        if kind:
            if m.start() > at:
                parts.append({"kind": "text", "text": text[at : m.start()]})
            parts.append({"kind": kind, "text": m.group(), "ref": m.group(1)})
            at = m.end()
    if at < len(text):
        parts.append({"kind": "text", "text": text[at:]})
    return parts


def part_tokens(part: dict) -> int:
    """Tokens that a part's placeholder stands for."""
    kind = part["kind"]
    if kind == "image" and part.get("width") and part.get("height"):
        return -(-part["width"] // PATCH) * -(-part["height"] // PATCH)
    if kind == "audio" and part.get("seconds"):
        return -int(-part["seconds"] * PER_SECOND // 1)
    if kind == "document" and part.get("pages"):
        return part["pages"] * PER_PAGE
    return DEFAULT_TOKENS[kind]


class Flatten:
    """Visits the parts of one message in order; an unknown kind is kept as text."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        visitor: Callable[[dict], None] = getattr(self, f"visit_{part.get('kind')}", self.visit_text)
        visitor(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self.attach(part)

    visit_audio = visit_document = visit_image

    def attach(self, part: dict) -> None:
        self.pieces.append(PLACEHOLDERS[part["kind"]])
        self.attachments.append({"kind": part["kind"], "ref": part.get("ref"), "source": part.get("text") or "", "tokens": part_tokens(part)})


def flatten(text: str | None, parts: list[dict] | None = None) -> tuple[str, list[dict]]:
    visitor = Flatten()
    for part in split_inline(text or "") if parts is None else parts:
        if part is not None:
            visitor.visit(part)
    return "".join(visitor.pieces), visitor.attachments


def write_conversation(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(role, segment) in order, as template text; and the spans of assistant segments in it."""
    out, at, loss = [BEGIN], len(BEGIN), []
    for role, segment in turns:
        before, after = TURNS.get(role) or (f"<|role|>{escape(role)}<|text|>", "<|end|>")
        if role == "assistant":
            loss.append((at + len(before), at + len(before) + len(segment)))
        out += [before, segment, after]
        at += len(before) + len(segment) + len(after)
    return "".join(out), loss


def restore(segment: str, sources: Iterator[str]) -> str:
    """A segment's text: placeholders give way to their sources, the rest is unescaped."""
    out, at = [], 0
    for m in _CONTROL.finditer(segment):
        out += [unescape(segment[at : m.start()]), next(sources)]
        at = m.end()
    return "".join([*out, unescape(segment[at:])])


def read_conversation(formatted: str, sources: list[str]) -> list[tuple[str, str]]:
    """(role, text) of every turn, from the template text alone and the attachments' sources."""
    turns, left, at = [], iter(sources), len(BEGIN)
    marks = {opening.strip(): (role, opening, closing) for role, (opening, closing) in TURNS.items() if role != "assistant"}
    placeholders = set(PLACEHOLDERS.values())

    def until(start: int, end: str) -> int:
        for m in _CONTROL.finditer(formatted, start):
            if m.group() == end:
                return m.start()
            if m.group() not in placeholders:
                break
        raise ValueError(f"no {end} after {start}")

    while at < len(formatted):
        m = _CONTROL.match(formatted, at)
        if m and m.group() in marks:
            role, opening, closing = marks[m.group()]
        elif m and m.group() == "<|role|>":
            stop = until(m.end(), "<|text|>")
            role, closing = unescape(formatted[m.end() : stop]), "<|end|>"
            opening = formatted[at : stop + len("<|text|>")]
        else:
            role, (opening, closing) = "assistant", TURNS["assistant"]
        start = at + len(opening)
        stop = until(start, closing.strip()) - (len(closing) - len(closing.lstrip()))
        turns.append((role, restore(formatted[start:stop], left)))
        at = stop + len(closing)
    return turns


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("segment", pa.string()),
        ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("source", pa.string()), ("tokens", pa.int64())]))),
    ])
    for batch in batches:
        data = batch.to_pydict()
        parts = data.get("parts") or [None] * batch.num_rows
        done = [flatten(text, own) for text, own in zip(data["text"], parts, strict=True)]
        yield pa.RecordBatch.from_pydict(
            {"conv_id": data["conv_id"], "turn": data["turn"], "role": [r or "" for r in data["role"]], "segment": [s for s, _ in done], "attachments": [a for _, a in done]}, schema
        )


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    attachment = [("turn", pa.int64()), ("role", pa.string()), ("kind", pa.string()), ("ref", pa.string()), ("source", pa.string()), ("tokens", pa.int64())]
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        ("attachments", pa.list_(pa.struct(attachment))), ("expanded_tokens", pa.int64()),
    ])
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            turns = row["turns"]
            formatted, loss = write_conversation([(t["role"], t["segment"]) for t in turns])
            found = [{"turn": t["turn"], "role": t["role"], **a} for t in turns for a in t["attachments"]]
            rows.append({
                "conv_id": row["conv_id"], "n_turns": len(turns), "formatted": formatted, "loss": [{"start": a, "stop": b} for a, b in loss],
                "attachments": found, "expanded_tokens": sum(a["tokens"] for a in found),
            })
        yield pa.RecordBatch.from_pylist(rows, schema)


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss (spans of assistant text), attachments, expanded_tokens.

    messages: conv_id, turn, role, text and, if wanted, parts (``PARTS_TYPE``); other columns are ignored. Null text or role is empty, a
    null conv_id is a conversation of its own, turns are ordered with null first, equal turns by role and content, and repeated rows
    stay. No rows give no rows.
    """
    own = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")]
    if "parts" in messages.columns:
        own.append(F.col("parts").cast(PARTS_TYPE))
    segments = messages.select(*own).mapInArrow(_segments, _SEGMENT)
    grouped = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "segment", "attachments"))).alias("turns"))
    return grouped.mapInArrow(_conversations, _FORMATTED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in _DIGESTS])
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            formatted, sources = row["formatted"], [a["source"] for a in row["attachments"]]
            turns = read_conversation(formatted, sources)
            of_assistant = iter([a["source"] for a in row["attachments"] if a["role"] == "assistant"])
            loss = "".join(restore(formatted[s["start"] : s["stop"]], of_assistant) for s in row["loss"])
            digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode())
            rows.append({
                "conv_id": row["conv_id"], "n_turns": len(turns), "turns_sha256": digest.hexdigest(), "loss_chars": len(loss),
                "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(formatted),
                "n_attachments": len(sources), "expanded_tokens": row["expanded_tokens"],
            })
        yield pa.RecordBatch.from_pylist(rows, schema)


_DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold, read from their text, loss spans and attachments."""
    types = ", ".join(f"{n} {'string' if n.endswith('sha256') else 'long'}" for n in _DIGESTS)
    return formatted.mapInArrow(_digests, types)


_PIECES = {kind: rf"!\[[^\[\]\n]*\]\([^()\x00-\x20]+\.(?i:{'|'.join(suffixes)})\)" for kind, suffixes in KINDS.items()}
_ANY = "|".join(_PIECES.values())
_SQL = f"""
WITH m AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
    SELECT *, regexp_replace(text, '{_ANY}', chr(1), 'g') AS plain,
        {", ".join(f"len(regexp_extract_all(text, '{p}')) AS n_{kind}" for kind, p in _PIECES.items())}
    FROM m
), s AS (
    SELECT *, n_image + n_audio + n_document AS n_parts,
        length(plain) + length(plain) - length(replace(plain, chr(92), ''))
        + {" + ".join(f"(length(plain) - length(replace(plain, '{c}', ''))) // {len(c)}" for c in CONTROLS)}
        + {" + ".join(f"{len(PLACEHOLDERS[k]) - 1} * n_{k}" for k in KINDS)} AS segment_chars
    FROM p
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST({len(BEGIN)} + sum(segment_chars + CASE role {" ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in TURNS.items())}
        ELSE {len("<|role|><|text|><|end|>")} + length(role) END) AS BIGINT) AS formatted_chars,
    CAST(sum(n_parts) AS BIGINT) AS n_attachments,
    CAST(sum({" + ".join(f"{n} * n_{k}" for k, n in DEFAULT_TOKENS.items())}) AS BIGINT) AS expanded_tokens
FROM s GROUP BY conv_id
"""


@query("op10_chat_format", _SQL)
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold control strings."""
    extra = spark.sql(
        "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(messages.unionByName(extra)))
