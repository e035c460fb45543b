"""Markdown structure as DataFrame plans: lines, tables, section paths, chunks and table facts.

A document becomes a row for each line, and running windows over its lines give sections and tables, so that a line carries what
the lines before it come to and no list of them. Which table headers count seems sequential, as a header inside an earlier table doesn't. But the line
after a header is a rule, which ends the table before it; so a header lies in the table of the header just before it or in none, and of
headers that each lie in the one before every second counts. Rows carry the document's id only; no step gathers more than one table.

Texts are shuffled once, by document, before they are cut into lines; what follows stays where the document is, so that neither lines nor what is made of them are sent again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions.identity import FACT_BASE
from corvane.sources.scratch import bucketed

_HEADING = r"^(#{1,6})" + X.SPACE + r"+(.*)$"
_LEVELS = range(1, 7)
#: The document's id in stored lines: a name of its own, without the table's qualifier, by which Spark sees that parts put together lie by document already.
_KEY = "_key"


def lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line, raw, bare, at, row, separator, level, title): at is the line's first character, counted from 0."""
    ends = X.LINE_END
    inside = f"[^{X.LINE_BREAKS}]"
    whole = F.coalesce(F.col(text), F.lit(""))
    any_end = F.regexp_extract_all(whole, F.lit(f"({inside}*(?:{ends})|{inside}+)"), F.lit(1))
    feeds = F.filter(F.split(whole, "(?<=\n)", -1), lambda x: x != "")  # much quicker, where line feeds are all the ends there are
    pieces = F.when(F.translate(whole, X.BREAKS.replace("\n", ""), "") == whole, feeds).otherwise(any_end)
    each = docs.select(id, text).repartition(id).select(id, F.posexplode(pieces).alias("line", "raw"))
    order = Window.partitionBy(id).orderBy("line")
    bare = F.translate("raw", X.BREAKS, "")  # a piece has no break but its end
    stripped = X.strip(F.col("bare"))
    found = each.withColumn("at", F.coalesce(F.sum(F.length("raw")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("bare", bare)
    marked = found.withColumn("row", X.is_row(F.col("bare"))).withColumn("separator", X.is_separator(F.col("bare")))
    marked = marked.withColumn("level", F.when(F.col("bare").contains("#"), F.length(F.regexp_extract(stripped, _HEADING, 1))).otherwise(0))
    return marked.withColumn("title", F.when(F.col("level") > 0, X.strip_cell(F.regexp_extract(stripped, _HEADING, 2))).otherwise(""))


def outlined(lined: DataFrame, id: str = "doc_id") -> DataFrame:
    """Lines with the table that holds them and its start and end (or nulls), path (section titles) and segment (tables begun so far).

    A table is a header row over a separator, and the body rows after it; end is past the last, and tables don't overlap. A heading of level
    L is on the path if no heading of level L or less came after it; paths are made where headings stand and carried on. All of this is windows over the lines of one document.
    """
    order, back, whole = Window.partitionBy(id).orderBy("line"), Window.partitionBy(id).orderBy(F.desc("line")), Window.partitionBy(id)
    sofar, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    body = F.col("row") & ~F.col("separator")
    ends = lined.withColumn("_stop", F.min(F.when(~body, F.col("line"))).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("_end", F.coalesce(F.lead("_stop", 2).over(order), F.max("line").over(whole) + 1)).withColumn("_head", F.col("row") & F.coalesce(F.lead("separator").over(order), F.lit(False)))
    within = F.coalesce(F.last(F.when(F.col("_head"), F.col("_end")), ignorenulls=True).over(before) > F.col("line"), F.lit(False))
    nested = ends.withColumn("_n", F.sum(F.col("_head").cast("int")).over(sofar)).withColumn("_first", F.col("_head") & ~within)
    since = F.col("_n") - F.last(F.when(F.col("_first"), F.col("_n")), ignorenulls=True).over(sofar)
    counted = nested.withColumn("_taken", F.col("_head") & (since % 2 == 0))
    own = F.last(F.when(F.col("_taken"), F.struct(F.col("line").alias("start"), F.col("_end").alias("end"))), ignorenulls=True).over(sofar)
    held = counted.withColumn("_m", own).withColumn("_t", F.sum(F.col("_taken").cast("int")).over(sofar).cast("int") - 1)
    inside = F.col("line") < F.col("_m.end")
    marked = held.select(*lined.columns, *(F.when(inside, c).alias(n) for c, n in ((F.col("_t"), "table"), (F.col("_m.start"), "start"), (F.col("_m.end"), "end"))))
    marked = marked.withColumn("heading", (F.col("level") > 0) & F.col("table").isNull())
    for n in _LEVELS:
        marked = marked.withColumn(f"_h{n}", F.last(F.when(F.col("heading") & (F.col("level") == n), F.struct("line", "title")), ignorenulls=True).over(sofar))
    keeps = []
    for n in _LEVELS:
        own = F.col(f"_h{n}")
        above = [F.coalesce(F.col(f"_h{m}")["line"], F.lit(-1)) for m in range(1, n)]
        holds = own.isNotNull() & (own["line"] > F.greatest(*above, F.lit(-1)) if above else own.isNotNull())
        keeps.append(F.when(holds, own["title"]))
    made = F.when(F.col("heading"), F.filter(F.array(*keeps), lambda t: t.isNotNull()))
    path = F.coalesce(F.last(made, ignorenulls=True).over(sofar), F.array().cast("array<string>"))
    segment = F.sum(F.when(F.col("line") == F.col("start"), 1).otherwise(0)).over(sofar)
    return marked.withColumn("path", path).withColumn("segment", segment).drop(*(f"_h{n}" for n in _LEVELS))


def tables(lined: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, table, start, end) of every table."""
    return outlined(lined, id).where("line = start").select(id, "table", "start", "end")


def page_of(offset: Column, pages: Column) -> Column:
    """The first page whose boundary lies past the offset, else the last; null without pages."""
    past = F.size(F.filter(pages, lambda b: b <= offset))
    return F.when(pages.isNull() | (F.size(pages) == 0), F.lit(None).cast("int")).otherwise(F.least(past + 1, F.size(pages)))


def windows(n: Column, size: int, overlap: int) -> Column:
    """Where word windows start among n words (null if there are none): the last is the first that reaches the end."""
    step = max(1, size - overlap)
    return F.when(n > 0, F.sequence(F.lit(0), (F.ceil(F.greatest(n - size, F.lit(0)) / step) * step).cast("int"), F.lit(step)))


def word_windows(docs: DataFrame, size: int, overlap: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, chunk_index, n_words, text) of plain texts: windows of words as they stand in the text."""
    pieces = F.regexp_extract_all(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"^{X.SPACE}+", ""), F.lit(f"({X.NOT_SPACE}+|{X.SPACE}+)"), F.lit(1))
    cut = docs.select(id, pieces.alias("p")).withColumn("n", F.floor((F.size("p") + 1) / 2).cast("int"))
    each = cut.select(id, "p", "n", F.posexplode(windows(F.col("n"), size, overlap)).alias("chunk_index", "first"))
    words = F.least(F.lit(size), F.col("n") - F.col("first"))
    return each.select(id, F.col("chunk_index").cast("long").alias("chunk_index"), words.cast("long").alias("n_words"), F.array_join(F.slice("p", F.col("first") * 2 + 1, words * 2 - 1), "").alias("text"))


def _prose(marked: DataFrame, size: int, overlap: int, id: str) -> DataFrame:
    """Word windows of each segment. A line gives each window that it lies in its own part of it, cut at the window's first and last word, with its line end if the window goes on."""
    step = max(1, size - overlap)
    each = marked.where(F.col("table").isNull()).select(id, "segment", "line", "at", "raw", "bare", "path", F.when(F.col("level") == 0, F.size(X.words(F.col("bare")))).otherwise(0).alias("m"))
    run, whole = Window.partitionBy(id, "segment").orderBy("line"), Window.partitionBy(id, "segment")
    placed = each.withColumn("past", F.sum("m").over(run).cast("int")).withColumn("n", F.sum("m").over(whole).cast("int")).withColumn("first", F.col("past") - F.col("m"))
    last = F.ceil(F.greatest(F.col("n") - size, F.lit(0)) / step)
    low = F.greatest(F.lit(0), F.floor((F.col("first") - size) / step) + 1).cast("int")
    high = F.least(last, F.ceil(F.col("past") / step) - 1).cast("int")
    within = placed.where(F.col("n") > F.col("first")).withColumn("low", low).withColumn("high", high).where("low <= high")
    runs = F.when(F.col("m") > 0, F.regexp_extract_all("bare", F.lit(f"({X.NOT_SPACE}+|{X.SPACE}+)"), F.lit(1)))
    cut = within.withColumn("r", runs).withColumn("lead", F.when(F.col("r")[0].rlike(f"^{X.SPACE}"), 1).otherwise(0))
    joined = lambda lo, hi: F.array_join(F.slice("r", lo + 1, hi - lo), "")

    def part(k: Column) -> Column:
        stop = F.least(k * step + size, F.col("n"))
        begins, ends = k * step >= F.col("first"), stop <= F.col("past")
        lo = F.when(begins, 2 * (k * step - F.col("first")) + F.col("lead")).otherwise(0)
        hi = F.when(ends, 2 * (stop - 1 - F.col("first")) + F.col("lead") + 1).otherwise(F.size("r"))
        said = F.when(~begins & ~ends, F.col("raw")).when(ends, joined(lo, hi)).otherwise(F.concat(joined(lo, hi), F.substr("raw", F.length("bare") + 1)))
        place = lambda x: (F.col("at") + F.length(joined(F.lit(0), x))).cast("int")
        return F.struct(k.alias("k"), said.alias("said"), F.when(begins, place(lo)).alias("from"), F.when(ends, place(hi)).alias("to"), F.when(begins, F.col("path")).alias("path"), (stop - k * step).cast("long").alias("token_count"))

    parts = cut.select(id, "segment", "line", F.inline(F.transform(F.sequence("low", "high"), part)))
    span = parts.groupBy(id, "segment", "k").agg(F.array_sort(F.collect_list(F.struct("line", "said"))).alias("l"), *(F.max(c).alias(c) for c in ("from", "to", "path", "token_count")))
    return span.select(id, "from", "to", F.lit(0).alias("part"), X.strip(F.array_join("l.said", "")).alias("text"), "path", "token_count", F.lit(None).cast("int").alias("table_index"))


def _outline(docs: DataFrame, id: str, text: str) -> DataFrame:
    """The outlined lines as a table in buckets of documents (by _KEY), for what reads them several times: len is a line's length with its end."""
    lined = bucketed(outlined(lines(docs, id, text), id).drop("bare", "title", "heading"), "lines", id).withColumnRenamed(id, _KEY)
    return lined.withColumn("bare", F.translate("raw", X.BREAKS, "")).withColumn("len", F.length("raw"))


def _groups(counts: Column, header: Column, whole: Column, size: int) -> Column:
    """The row at which each group of a table's rows starts (the first at 0, rows or not), from word counts: rows go in order into groups of as many words as the size leaves beside the header."""

    def place(so: Column, x: Column) -> Column:
        new = (whole > size) & so["used"].isNotNull() & (so["used"] + x > F.greatest(F.lit(1), size - header))
        used = F.when(new, x).otherwise(F.coalesce(so["used"], F.lit(0)) + x)
        return F.struct((so["i"] + 1).alias("i"), used.alias("used"), F.when(new, F.concat(so["starts"], F.array(so["i"]))).otherwise(so["starts"]).alias("starts"))

    begin = F.struct(F.lit(0).alias("i"), F.lit(None).cast("int").alias("used"), F.array(F.lit(0)).alias("starts"))
    return F.aggregate(counts, begin, place, lambda so: so["starts"])


def _table_chunks(marked: DataFrame, size: int, id: str) -> DataFrame:
    """A chunk for each group of rows of a table, with the table's two head lines; a table without rows is one chunk."""
    count = lambda c: F.size(X.words(c))
    inside = marked.where("table is not null").withColumn("n", count(F.col("bare")))
    line = F.struct("line", "bare", "n", "at", "path")
    is_head = F.col("line") < F.col("start") + 2
    grouped = inside.groupBy(id, "table").agg(F.array_sort(F.collect_list(F.when(is_head, line))).alias("head"), F.array_sort(F.collect_list(F.when(~is_head, F.struct("line", "n", "bare")))).alias("r"), F.sum("n").alias("total"), F.max_by(F.col("at") + F.col("len"), "line").cast("int").alias("to"))
    spread = grouped.select(id, "table", "head", "to", "r", _groups(F.col("r.n"), F.col("head")[0]["n"], F.col("total"), size).alias("g"))

    def part(start: Column, i: Column) -> Column:
        rows = F.slice("r", start + 1, F.coalesce(F.get("g", i + 1), F.size("r")) - start)
        return F.struct(i.alias("part"), X.strip(F.array_join(F.concat(F.col("head.bare"), rows["bare"]), "\n")).alias("text"))

    first = F.col("head")[0]
    each = spread.select(id, "table", "to", first["at"].cast("int").alias("from"), first["path"].alias("path"), F.inline(F.transform("g", part)))
    return each.select(id, "from", "to", "part", "text", "path", count(F.col("text")).cast("long").alias("token_count"), F.col("table").alias("table_index"))


def chunks(docs: DataFrame, size: int, overlap: int, id: str = "doc_id", text: str = "text", pages: str | None = None, marked: DataFrame | None = None) -> DataFrame:
    """(id, chunk_index, text, section_path, page_from, page_to, token_count, table_index) in document order.

    Prose becomes word windows that cross headings but not tables, with the section path of their first word;
    a table is one chunk, or chunks with its header repeated where it has more words than the size. pages: a column of character boundaries.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    marked = _outline(docs, id, text) if marked is None else marked
    both = _prose(marked, size, overlap, _KEY).unionByName(_table_chunks(marked, size, _KEY))
    bound = both.join(docs.select(F.col(id).alias(_KEY), F.col(pages).alias("_pages")), _KEY) if pages else both.withColumn("_pages", F.lit(None).cast("array<int>"))
    order = Window.partitionBy(_KEY).orderBy("from", "part")
    return bound.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("long")).select(
        F.col(_KEY).alias(id), "chunk_index", "text", F.col("path").alias("section_path"), page_of(F.col("from"), F.col("_pages")).alias("page_from"), page_of(F.col("to"), F.col("_pages")).alias("page_to"), "token_count", "table_index",
    )


def _facts(marked: DataFrame, id: str) -> DataFrame:
    order = Window.partitionBy(id).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    above = F.last(F.when(X.strip(F.col("bare")) != "", F.struct("bare", "row", "separator", "level")), ignorenulls=True).over(order)
    a = F.col("_above")
    caption = F.when(a.isNull() | a["row"] | a["separator"] | (a["level"] > 0), F.lit("")).otherwise(X.strip_cell(a["bare"]))
    head = F.when(F.col("line") == F.col("start"), F.struct(caption.alias("caption"), X.split_row(F.col("bare")).alias("headers"), F.col("path").alias("section_path")))
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.withColumn("_above", above).withColumn("_own", F.last(head, ignorenulls=True).over(sofar)).where("table is not null and line > start + 1")
    cells = inside.withColumn("cells", X.split_row(F.col("bare"))).where(F.exists("cells", lambda c: c != "")).select(id, "table", "line", "cells", "_own.*")
    named = F.transform("cells", lambda c, i: F.when(c == "", None).when((i < F.size("headers")) & (F.get("headers", i) != ""), F.concat(F.get("headers", i), F.lit(": "), c)).otherwise(c))
    said = F.array_join(F.filter(named, lambda p: p.isNotNull()), "; ")
    lead = F.when(F.col("caption") == "", F.lit("")).otherwise(F.concat("caption", F.lit(". ")))
    return cells.select(
        id, (F.row_number().over(Window.partitionBy(id).orderBy("line")) - 1).cast("long").alias("fact"), F.col("table").alias("table_index"), (F.row_number().over(Window.partitionBy(id, "table").orderBy("line")) - 1).cast("long").alias("row_index"),
        "caption", "section_path", "headers", "cells", F.concat(lead, said, F.lit(".")).alias("text"),
    )


def _wholes(marked: DataFrame, told: DataFrame, id: str) -> DataFrame:
    """(id, table_index, table_markdown) of tables that have facts: the caption over the table's lines."""
    lined = marked.where("table is not null").groupBy(id, F.col("table").alias("table_index")).agg(F.array_sort(F.collect_list(F.struct("line", X.rstrip(F.col("bare")).alias("t")))).alias("l"))
    named = told.groupBy(id, "table_index").agg(F.first("caption").alias("caption"))
    whole = F.concat(F.when(F.col("caption") == "", F.lit("")).otherwise(F.concat("caption", F.lit("\n"))), F.array_join("l.t", "\n"))
    return lined.join(named, [id, "table_index"]).select(id, "table_index", whole.alias("table_markdown"))


def facts(docs: DataFrame, id: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """(id, fact, table_index, row_index, caption, section_path, headers, cells, text[, table_markdown]): a row for each table row that isn't blank.

    With `whole` each fact carries its whole table, which is what the index stores; without it the table's size doesn't matter.
    """
    marked = outlined(lines(docs, id, text), id)
    told = _facts(marked, id)
    return told.join(_wholes(marked, told, id), [id, "table_index"]).select(*told.columns, "table_markdown") if whole else told


def units(docs: DataFrame, size: int, overlap: int, id: str = "doc_id", text: str = "text", pages: str | None = None, whole: bool = True) -> DataFrame:
    """Chunks and facts as one table: facts are numbered from FACT_BASE, and what comes from tables carries its whole table (if `whole`). kind is prose, table or fact."""
    marked = _outline(docs, id, text)
    told = _facts(marked, _KEY).withColumnRenamed(_KEY, id)
    rows = told.select(id, (F.col("fact") + FACT_BASE).alias("chunk_index"), "text", "section_path", F.lit(None).cast("int").alias("page_from"), F.lit(None).cast("int").alias("page_to"), F.size(X.words(F.col("text"))).cast("long").alias("token_count"), "table_index")
    both = chunks(docs, size, overlap, id, text, pages, marked).select(rows.columns).unionByName(rows)
    if whole:
        both = both.join(_wholes(marked.withColumnRenamed(_KEY, id), told, id), [id, "table_index"], "left").select(*rows.columns, "table_markdown")
    kind = F.when(F.col("chunk_index") >= FACT_BASE, "fact").when(X.strip(F.col("text")).startswith("|"), "table").otherwise("prose")
    return both.withColumn("kind", kind)
