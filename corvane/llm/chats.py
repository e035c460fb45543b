"""Conversations as training text, by a compiled template, with the places that a model is to learn.

Turns are brought together by conversation and sorted; a conversation then streams through its template. What the template puts is
cut into pieces between turns, so that neither a conversation of millions of turns nor its text is ever held whole: a task holds
a piece and a turn. (A template that uses its messages elsewhere than in one loop gets them as a list.) One conversation is one
task's work, as the digest of all its turns is taken in their order.

Control strings within texts get a backslash before them. They may not overlap one another, nor hold backslashes or line ends,
so the escaped text holds the same control strings at the same places, each with one more backslash before it than in the text, and taking one
off again gives the text. Around a text the template has line ends, so that neither a text's last backslash nor a part of a control
string at its edge can meet a mark.

Odd input: a null role or text reads as empty, and rows with a null conversation are one conversation. Null turns come first; ties go by role, then
text, and repeated rows are repeated turns. An empty table has no conversations. Extra columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import release, sliced, written
from corvane.llm.templates import Template, TemplateError

#: The marks of a turn, which are the control strings of TURNS.
OPEN, CLOSE = "<turn>", "</turn>"
#: A turn: its mark, its role on the same line, its text, and the closing mark on a line of its own. The assistant's texts are to be learnt.
TURNS = (
    "{% for m in messages %}<turn>{{ m.role | line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}\n"
    "</turn>\n{% endfor %}"
)
#: Code points after which a piece ends with its turn, and bytes of pieces that go on together.
PIECE, TOGETHER = 1 << 20, 4 << 20

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class Escaper:
    """Puts a backslash before control strings, and takes it off again."""

    def __init__(self, controls: tuple[str, ...] = (OPEN, CLOSE)):
        for a in controls:
            if not a or "\\" in a or "\n" in a:
                raise ValueError(f"a control string can't be empty or hold backslashes or line ends: {a!r}")
            for b in controls:
                if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                    raise ValueError(f"control strings overlap: {a!r}, {b!r}")
        self.controls = controls
        one = "|".join(map(re.escape, controls))
        self._bare, self._escaped = re.compile(f"({one})"), re.compile(rf"\\({one})")

    def escape(self, text: str) -> str:
        return self._bare.sub(r"\\\1", text) if any(c in text for c in self.controls) else text

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text) if "\\" in text else text

    def line(self, text: str) -> str:
        """A text that stays on one line."""
        return self.escape(text.replace("\\", "\\\\").replace("\n", "\\n"))

    def unline(self, text: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(text))

    def filters(self) -> dict[str, Callable]:
        return {"escape": lambda x: self.escape(x or ""), "line": lambda x: self.line(x or "")}


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for part in sliced(batch, 8 << 20):
            yield from part.to_pylist()


def _streamed(df: DataFrame, key: str, order: list, work: Callable[[Iterator[dict]], Iterator[dict]], fields: T.StructType) -> DataFrame:
    """work over each key's rows in order, as an iterator; it gives rows with a `_bytes` entry for their size."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(fields)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in target], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, rows in groupby(_turns(batches), key=lambda r: r[key]):
            for out in work(rows):
                held.append(out)
                size += out["_bytes"] + 64
                if size >= TOGETHER:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)
        release()

    return df.repartition(F.col(key)).sortWithinPartitions(F.col(key), *order).mapInArrow(run, fields)


def formatted(conversations: DataFrame, template: str = TURNS, controls: tuple[str, ...] = (OPEN, CLOSE), piece: int = PIECE) -> DataFrame:
    """(conv_id, piece, start, formatted, spans): each conversation's text in pieces, from code point `start` on, and what of it is to be learnt, in code points of the whole text.

    conversations: (conv_id, turn, role, text). The template gets `messages`, a list of dicts with turn, role and text, and the filters escape and line.
    """
    kind = conversations.schema["conv_id"].dataType
    fields = T.StructType([T.StructField("conv_id", kind)]).add("piece", "integer").add("start", "long").add("formatted", "string").add("spans", SPANS)
    Template(template, Escaper(controls).filters())  # an error in it belongs to the driver

    def make() -> Callable[[Iterator[dict]], Iterator[dict]]:
        compiled: list[Template] = []

        def work(rows: Iterator[dict]) -> Iterator[dict]:
            if not compiled:
                compiled.append(Template(template, Escaper(controls).filters()))
            first = next(rows)

            def messages() -> Iterator[dict]:
                yield first
                yield from rows

            given = messages() if compiled[0].streams("messages") else list(messages())
            for n, (start, text, spans) in enumerate(compiled[0].pieces(piece, messages=given)):
                yield {"conv_id": first["conv_id"], "piece": n, "start": start, "formatted": text, "spans": [{"start": a, "end": b} for a, b in spans], "_bytes": 4 * len(text)}

        return work

    plain = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return _streamed(plain, "conv_id", [F.asc_nulls_first("turn"), "role", "text"], make(), fields)


def turns_of(text: str, escaper: Escaper) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a piece that TURNS put."""
    at = 0
    while at < len(text):
        line = text.find("\n", at)
        end = text.find(f"\n{CLOSE}\n", line + 1)
        if not text.startswith(OPEN, at) or line < 0 or end < 0:
            raise TemplateError("this isn't a text of turns")
        yield escaper.unline(text[at + len(OPEN) : line]), escaper.unescape(text[line + 1 : end])
        at = end + len(CLOSE) + 2


def read_back(pieces: DataFrame) -> DataFrame:
    """What formatted() wrote with TURNS, read from its pieces alone: conv_id, n_turns, turns_sha256 (role, line end, text, line end of each turn), loss_chars, loss_sha256 (what is to be learnt, unescaped), formatted_chars."""
    fields = T.StructType([T.StructField("conv_id", pieces.schema["conv_id"].dataType)]).add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        escaper, turns, loss = Escaper(), sha256(), sha256()
        n = learnt = chars = 0
        for row in rows:
            text = row["formatted"]
            if row["start"] != chars:
                raise TemplateError("a piece is missing")
            chars += len(text)
            for role, said in turns_of(text, escaper):
                n += 1
                turns.update(f"{role}\n{said}\n".encode())
            for span in row["spans"]:
                said = escaper.unescape(text[span["start"] - row["start"] : span["end"] - row["start"]])
                learnt += len(said)
                loss.update(said.encode())
        yield {"conv_id": row["conv_id"], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": learnt, "loss_sha256": loss.hexdigest(), "formatted_chars": chars, "_bytes": 200}

    return _streamed(pieces, "conv_id", [F.asc("piece")], work, fields)


#: A conversation whose texts hold control strings, one of them behind a backslash already.
TRICKY = (-7, "\\### Assistant: </turn> ok")


def digest(conversations: DataFrame) -> DataFrame:
    """The conversations and TRICKY, formatted, written, and read back."""
    id, text = TRICKY
    spark = conversations.sparkSession
    more = spark.createDataFrame([(id, 0, "user", text), (id, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    both = conversations.select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(written(formatted(both), "chats"))


#: DuckDB SQL for digest() over the table conversations.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn>') + length(role) + len(regexp_extract_all(role, '</?turn>|\\|\n')) + 1 + length(text) + len(regexp_extract_all(text, '</?turn>')) + length('</turn>') + 2) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
