"""Benchmark decontamination with DataFrame operations only.

Benchmark items become windows of `width` consecutive normalised words (an item of fewer
words is one window). The windows form a hash set. Each word position of a document gives the hash of the window that starts there.

While the hash set is within a checked bound it is broadcast: documents are read once, hash hits are verified on the words
themselves inside the join, and one row for each document survives to carry its word count. What is
shuffled is that row and the verified hits.

Beyond the bound the positions are semi-joined with the set by shuffle, as numbers only (row, place, length, hash); a document's
surviving places come together again at its text, which is verified once. No position carries the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import lower_az, numbered, with_plain_names

#: Words: runs of characters that are not ASCII, or digits, or lower-case letters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows that are broadcast at most: about 200 bytes each on an executor.
BROADCAST_WINDOWS = 100_000


def words(text: Column) -> Column:
    """The normalised words of a text; null has none."""
    return F.regexp_extract_all(lower_az(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def window_hash(words: Column, start: Column, length: int) -> Column:
    return F.xxhash64(F.slice(words, start + F.lit(1), length))


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """Distinct (h, win, len, item_id) of all windows of the benchmark's items. item_id becomes a string."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = items.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))).alias("at"))
    return starts.select("item_id", F.slice("w", F.col("at") + 1, width).alias("win")).distinct().select(F.xxhash64("win").alias("h"), "win", F.size("win").alias("len"), "item_id")


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 13, row: str | None = None) -> DataFrame:
    """(row, doc_id, n_words, spans [(pos, len)], items) for each row of docs.

    row tells apart rows that share a doc_id; it is the column named by `row` if docs, a table then, has one. Null and empty texts have no words and no hits; null item ids
    count as no item, though their windows still mark hits; an empty benchmark gives no hits.
    """
    windows = benchmark_windows(benchmark, width)
    sizes = {r["len"]: r["n"] for r in windows.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most width rows
    few = sum(sizes.values()) <= BROADCAST_WINDOWS
    if not few and row is None:
        docs, row = numbered(docs.select("doc_id", "text"), "_row"), "_row"
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    base = docs.select(number.alias("row"), "doc_id", words(F.col("text")).alias("w"))
    n = F.size("w")

    def at_each(length: int) -> Column:
        spot = lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), window_hash(F.col("w"), i, length).alias("h"))
        return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), spot)).otherwise(F.array().cast("array<struct<pos:int,len:int,h:bigint>>"))

    places = [at_each(k) for k in sorted(sizes)]
    if not few:
        return _shuffled_hits(base, windows, reduce(F.concat, places))
    own = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("len"), F.xxhash64("row").alias("h")))
    each = base.select("row", "doc_id", "w", n.cast("long").alias("n_words"), F.inline(reduce(F.concat, places, own)).alias("pos", "len", "h"))
    b = F.broadcast(windows).select(F.col("h").alias("b_h"), "win", F.col("len").alias("b_len"), "item_id")
    same = (F.col("h") == F.col("b_h")) & (F.col("pos") >= 0) & (F.col("len") == F.col("b_len")) & (F.slice("w", F.greatest(F.col("pos"), F.lit(0)) + 1, F.col("b_len")) == F.col("win"))
    found = each.join(b, same, "left").where("win is not null or pos = -1").select("row", "doc_id", "n_words", "item_id", F.when(F.col("win").isNotNull(), F.struct("pos", "len")).alias("span"))
    return found.groupBy("row", "doc_id", "n_words").agg(F.collect_set("span").alias("spans"), F.collect_set("item_id").alias("items"))


def _shuffled_hits(base: DataFrame, windows: DataFrame, places: Column) -> DataFrame:
    """hits() where the windows are too many to broadcast. base: (row, doc_id, w) over a numbered table."""
    spots = base.select("row", F.inline(places).alias("pos", "len", "h"))
    likely = spots.join(windows.select("h", "len").distinct(), ["h", "len"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("pos", "len", "h")).alias("spots"))
    texts = base.select("row", "w").join(likely, "row").select("row", "w", F.inline("spots")).select("row", "pos", "len", "h", F.slice("w", F.col("pos") + 1, F.col("len")).alias("win"))
    sure = texts.join(windows.select("h", "win", "item_id"), ["h", "win"]).groupBy("row").agg(F.collect_set(F.struct("pos", "len")).alias("spans"), F.collect_set("item_id").alias("items"))
    none = lambda c: F.coalesce(c, F.array().cast(sure.schema[c].dataType)).alias(c)
    return base.select("row", "doc_id", F.size("w").cast("long").alias("n_words")).join(sure, "row", "left").select("row", "doc_id", "n_words", none("spans"), none("items"))


def covered(spans: Column) -> Column:
    """How many positions the spans cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))

    def add(acc: Column, x: Column) -> Column:
        end = x["pos"] + x["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["hit"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["pos"]))).alias("hit"))

    return F.aggregate(F.array_sort(spans), start, add)["hit"].cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, row: str | None = None) -> DataFrame:
    """row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans for each row of docs.

    A document is contaminated if it has a hit and the hit words are at least one in `share` of its words.
    """
    return hits(docs, benchmark, width, row).select(
        "row", "doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "spans",
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, remove: str = "documents") -> DataFrame:
    """docs without what the benchmark contaminates, columns as they were.

    remove="documents" drops contaminated rows; remove="spans" cuts the hit words (and the gaps after them) out of
    every text. Rows with null texts stay. Rows are numbered in a written copy, so that every job sees the same numbers.
    """
    plain = with_plain_names(docs)
    ids = plain.columns[docs.columns.index("doc_id")]
    rows = numbered(plain, "_row")
    marked = contamination(rows.select("_row", F.col(ids).alias("doc_id"), "text"), benchmark, width, share, "_row")
    if remove == "documents":
        bad = marked.where("contaminated").select(F.col("row").alias("_row"))
        return rows.join(bad, "_row", "left_anti").select(*plain.columns).toDF(*docs.columns)
    if remove != "spans":
        raise ValueError(f"remove is documents or spans, not {remove}")
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))))
    cut = marked.where("n_hit > 0").select(F.col("row").alias("_row"), hit.alias("_hit"))
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all(F.col("text"), F.lit(rf"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|{gap}"), F.lit(0))
    lead = F.when(F.col("text").rlike(f"^{gap}"), 1).otherwise(0)
    # word k is piece 2k + lead, and the gap after it the next one
    kept = F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains("_hit", F.floor((i - lead) / 2).cast("int"))), "")
    joined = rows.join(cut, "_row", "left").withColumn("text", F.when(F.col("_hit").isNull(), F.col("text")).otherwise(kept))
    return joined.select(*plain.columns).toDF(*docs.columns)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The result columns of the query."""
    return contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: DuckDB SQL for digest() over the tables documents and benchmark.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bs AS (
  SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, list_aggregate(w[i + 1 : i + 13], 'string_agg', ' ') AS g, least(len(w), 13) AS k FROM bs
), ks AS (
  SELECT DISTINCT k FROM win
), dk AS (
  SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k
), h AS (
  SELECT dk.doc_id, dk.i, dk.k, win.item_id FROM dk JOIN win ON win.k = dk.k AND win.g = list_aggregate(dk.w[dk.i + 1 : dk.i + dk.k], 'string_agg', ' ')
), p AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS q FROM h) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.s, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)
"""
