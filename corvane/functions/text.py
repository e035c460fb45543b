"""Text functions as columns. Regular expressions are chosen to agree with Python's unicode classes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's \s matches.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
NOT_SPACE = r"[^\p{IsWhite_Space}\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]+"
#: Line ends as of Python's splitlines.
LINE_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LINE_END = rf"\r\n|[{LINE_BREAKS}]"
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

#: Words that the lexical index passes over.
STOP_WORDS = (
    "a an and are as at be but by for from has have how in into is it its of on or that "
    "the this to was were what when where which who will with "
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по "
    "только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если "
    "уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей "
    "может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз "
    "тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом "
    "один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец "
    "два об другой хоть после над больше тот через эти нас про всего них какая много "
    "разве эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой "
    "им более всегда конечно всю между"
).split()


#: A character that composition may change or move: none is below.
_COMPOSES = r"[^\x{0}-\x{2ff}]"
#: Bytes of texts that a task composes at once.
_SLICE = 8 << 20


def nfc(text: Column | str) -> Column:
    """Composed form; Spark has no function for it. Only texts with a character that may change go to Python, in slices of about _SLICE bytes."""

    @F.arrow_udf("string")
    def compose(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            step = max(1, int(len(batch) * _SLICE / max(_SLICE, batch.nbytes)))
            parts = [pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in batch.slice(at, step).to_pylist()], pa.string()) for at in range(0, len(batch), step)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(compose(F.when(text.rlike(_COMPOSES), text)), text)


def squeeze(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def normalize_query(text: Column) -> Column:
    """Composed, control characters and white space runs as one blank, trimmed. Null stays null."""
    return squeeze(F.regexp_replace(nfc(text), _CONTROL, " "))


def fold(text: Column) -> Column:
    """Lower case, sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def terms(text: Column) -> Column:
    """Folded words of two letters or more that aren't stop words, in order, unstemmed."""
    found = F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def words(text: Column) -> Column:
    """Runs of characters that aren't white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({NOT_SPACE}+)"), F.lit(1))


def lower_words(text: Column) -> Column:
    """The set of lower-cased words."""
    return F.array_distinct(words(F.lower(text)))


def strip_cell(text: Column) -> Column:
    """Without bold and code marks, white space squeezed."""
    return squeeze(F.regexp_replace(text, r"\*\*|__|`", ""))


def split_row(line: Column) -> Column:
    """The cells of a table row: one bar at either end doesn't count."""
    bare = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(bare, r"\|", -1), strip_cell)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def is_row(line: Column) -> Column:
    return line.contains("|")  # so it isn't blank


def is_separator(line: Column) -> Column:
    """A row of dashes, bare rules included."""
    return line.contains("-") & line.rlike(f"^(?:{SPACE}|[|:-])+$")


def embed_text(text: Column, *path: Column | list[Column]) -> Column:
    """Path parts joined by a guillemet over the text; empty and null parts are left out. Parts are strings or arrays of strings."""
    parts = F.filter(F.concat(*(p for p in path)), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " › "), F.lit("\n\n"), text)).otherwise(text)


def bounded(text: Column, most: int) -> Column:
    """The first `most` characters."""
    return F.left(text, F.lit(most))


def with_instruction(text: Column, instruction: str) -> Column:
    """The query as the dense encoder gets it."""
    return F.concat(F.lit(instruction), text) if instruction else text


def redact(text: Column) -> Column:
    """Token values masked."""
    return F.regexp_replace(text, r"(?i)(token=)[^\s&]+", "$1***")


def trace_id(header: Column) -> Column:
    """The trace of a W3C traceparent header, null where the header isn't one."""
    pattern = r"^[0-9a-f]{2}-([0-9a-f]{32})-[0-9a-f]{16}-[0-9a-f]{2}$"
    found = F.regexp_extract(F.lower(strip(header)), pattern, 1)
    return F.when((found != "") & (found != "0" * 32), found)


def listed_lines(content: Column, original: Column, most: int) -> Column:
    """The distinct lines of a list in order, without bullets and numbers, without the original and lines of one letter; at most `most`."""
    lines = F.transform(F.split(content, LINE_END), lambda x: strip(F.regexp_replace(strip(x), r"^[-•*0-9. \t]+", "")))
    kept = F.filter(lines, lambda x: (F.length(x) >= 2) & (fold(x) != fold(strip(original))))
    return F.slice(F.array_distinct(kept), 1, most)
