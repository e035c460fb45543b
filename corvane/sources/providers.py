"""Hosted encoders, rerankers and expanders over tables: every text gets an outcome, a value or an error.

Distinct texts are sent once, in batches. A batch that fails for good is halved until the text that it fails for stands alone, so one bad
text costs a few more calls and nobody else's value. Errors that may pass are tried again first. A provider that is down is not asked for each text:
after some texts in a row that failed alone with a passing error, the rest of the task's texts are told UNAVAILABLE, and may be sent in a later run.
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.functions import text as X

#: A request: a path and a body to a reply.
Post = Callable[[str, dict], dict]
#: Texts in a row that fail alone with a passing error before a task stops asking.
GIVE_UP = 3


class ProviderError(Exception):
    """Why a call failed, and whether it may succeed when it is repeated."""

    def __init__(self, code: str, retryable: bool = False):
        super().__init__(code)
        self.code, self.retryable = code, retryable


def http_post(base_url: str, token: str, timeout: float) -> Post:
    """JSON over HTTP. Timeouts and statuses that may pass (429 and from 500 on) are retryable."""

    def post(path: str, body: dict) -> dict:
        request = urllib.request.Request(base_url.rstrip("/") + path, json.dumps(body).encode(), {"Authorization": f"Bearer {token}", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return json.load(reply)
        except urllib.error.HTTPError as e:
            raise ProviderError(f"HTTP_{e.code}", e.code == 429 or e.code >= 500) from e
        except (TimeoutError, urllib.error.URLError, json.JSONDecodeError) as e:
            raise ProviderError("TIMEOUT" if isinstance(e, TimeoutError) else "UPSTREAM", True) from e

    return post


# --- replies ---


def _listed(raw: dict, name: str, n: int) -> list[dict]:
    found = raw.get(name)
    if not isinstance(found, list) or len(found) != n:
        raise ProviderError("COUNT_MISMATCH")
    ordered: list = [None] * n
    for item in found:
        at = item.get("index", 0) if isinstance(item, dict) else None
        if not isinstance(at, int) or not 0 <= at < n or ordered[at] is not None:
            raise ProviderError("BAD_INDEX")
        ordered[at] = item
    return ordered


def dense_vectors(post: Post, model: str, dimension: int, normalize: bool = True) -> Callable[[list[str]], list]:
    """Texts to vectors in the texts' order, whatever the reply's; counts, lengths and numbers are checked."""

    def send(texts: list[str]) -> list:
        raw = post("/embeddings", {"model": model, "input": texts, "encoding_format": "float", "dimensions": dimension})
        out = []
        for item in _listed(raw, "data", len(texts)):
            vector = item.get("embedding")
            if not isinstance(vector, list) or len(vector) != dimension:
                raise ProviderError("INVALID_DIMENSION")
            vector = [float(x) for x in vector]
            if not all(map(math.isfinite, vector)):
                raise ProviderError("NOT_FINITE")
            norm = math.sqrt(sum(x * x for x in vector)) if normalize else 1.0
            out.append([x / norm for x in vector] if norm else vector)
        return out

    return send


def sparse_vectors(post: Post, model: str) -> Callable[[list[str]], list]:
    """Texts to lists of (idx, weight)."""

    def send(texts: list[str]) -> list:
        found = post("/sparse", {"model": model, "input": texts}).get("vectors")
        if not isinstance(found, list) or len(found) != len(texts):
            raise ProviderError("COUNT_MISMATCH")
        out = []
        for v in found:
            if len(v["indices"]) != len(v["values"]) or not all(map(math.isfinite, v["values"])):
                raise ProviderError("BAD_VECTOR")
            out.append([{"idx": i, "weight": float(w)} for i, w in zip(v["indices"], v["values"], strict=True)])
        return out

    return send


def variants(post: Post, model: str, most: int, hyde: bool = False) -> Callable[[list[str]], list]:
    """A query to the text that lists its variants, one a line; a call for each query."""
    ask = f"Rephrase the search query in {most} different ways, one a line." + (" End with one short sentence that a document answering it might hold." if hyde else "")

    def send(texts: list[str]) -> list:
        out = []
        for t in texts:
            raw = post("/chat/completions", {"model": model, "messages": [{"role": "system", "content": ask}, {"role": "user", "content": t}]})
            try:
                out.append(str(raw["choices"][0]["message"]["content"] or ""))
            except (KeyError, IndexError, TypeError) as e:
                raise ProviderError("BAD_REPLY") from e
        return out

    return send


# --- calls ---


@dataclass
class Caller:
    """Calls for lists of texts, with retries and halving."""

    send: Callable[[list[str]], list]
    attempts: int = 3
    wait: Callable[[int], float] = lambda n: float(2**n)
    sleep: Callable[[float], None] = time.sleep
    down: int = field(default=0)

    def outcomes(self, texts: list[str], before: int = 0) -> list[tuple[object, str | None, int]]:
        """(value, error, attempts) of each text in order."""
        if not texts:
            return []
        if self.down >= GIVE_UP:
            return [(None, "UNAVAILABLE", before)] * len(texts)
        error = ProviderError("UPSTREAM")
        for n in range(1, self.attempts + 1):
            try:
                values = self.send(texts)
                if len(values) != len(texts):
                    raise ProviderError("COUNT_MISMATCH")
                self.down = 0
                return [(v, None, before + n) for v in values]
            except ProviderError as e:
                error = e
                if not e.retryable:
                    break
                if n < self.attempts:
                    self.sleep(self.wait(n - 1))
        if len(texts) == 1:
            self.down = self.down + 1 if error.retryable else 0
            return [(None, error.code, before + n)]
        half = len(texts) // 2
        return self.outcomes(texts[:half], before + n) + self.outcomes(texts[half:], before + n)


@dataclass(frozen=True)
class Provider:
    """What is called, how it answers and in which batches."""

    send: Callable[[list[str]], list]
    kind: T.DataType
    batch: int = 32
    attempts: int = 3
    wait: Callable[[int], float] = lambda n: float(2**n)


def told(texts: DataFrame, provider: Provider) -> DataFrame:
    """(text, value, error, attempts) of each row of texts (text), which should be distinct. Null texts are passed over."""
    fields = T.StructType([T.StructField("text", T.StringType()), T.StructField("value", provider.kind), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())])
    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = Caller(provider.send, provider.attempts, provider.wait)
        for batch in batches:
            for at in range(0, batch.num_rows, provider.batch):
                some = batch.column(0).slice(at, provider.batch).to_pylist()
                found = caller.outcomes(some)
                columns = (some, *([x[i] for x in found] for i in range(3)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return texts.select("text").where("text is not null").mapInArrow(run, fields)


def with_values(rows: DataFrame, text: str, provider: Provider, value: str = "value") -> DataFrame:
    """rows with the value, `<value>_error` and `<value>_attempts` of their text. Each distinct text is sent once; null texts have the error EMPTY."""
    from corvane.sources.scratch import written

    distinct = rows.select(F.col(text).alias("text")).where("text is not null").distinct()
    found = written(told(distinct, provider), "provided")  # calls cost: never twice
    named = found.select(F.col("text").alias("_text"), F.col("value").alias(value), F.col("error").alias(f"{value}_error"), F.col("attempts").alias(f"{value}_attempts"))
    joined = rows.join(named, F.col(text) == F.col("_text"), "left").drop("_text")
    return joined.withColumn(f"{value}_error", F.when(F.col(text).isNull(), "EMPTY").otherwise(F.col(f"{value}_error")))


def reranker(post: Post, model: str, attempts: int = 2, wait: Callable[[int], float] = lambda n: 0.5) -> Callable[[DataFrame], DataFrame]:
    """A reranker for searches: candidates (query_id, id, query, text) to (query_id, id, score, error). One call a query, whose candidates are bounded; if it fails, all of them have its error."""

    def rerank(candidates: DataFrame) -> DataFrame:
        fields = T.StructType([candidates.schema["query_id"], candidates.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())])
        target = to_arrow_schema(fields)

        def one(table: pa.Table) -> pa.Table:
            table = table.sort_by("id")
            ids, texts, query = table["id"].to_pylist(), table["text"].to_pylist(), table["query"][0].as_py()

            def send(_: list[str]) -> list:
                raw = post("/rerank", {"model": model, "query": query, "documents": texts, "top_n": len(texts)})
                found: dict[int, float] = {}
                if not isinstance(raw.get("results"), list):
                    raise ProviderError("BAD_REPLY")
                for item in raw["results"]:
                    at, score = item.get("index"), item.get("relevance_score", item.get("score"))
                    if not isinstance(at, int) or not 0 <= at < len(texts) or score is None:
                        raise ProviderError("BAD_INDEX")  # what wasn't sent can't come back
                    found[at] = float(score)
                return [found]

            [(scores, error, _)] = Caller(send, attempts, wait).outcomes([query or ""])
            rows = {"query_id": table["query_id"].to_pylist(), "id": ids, "score": [None if scores is None else scores.get(i) for i in range(len(ids))], "error": [error] * len(ids)}
            return pa.table([pa.array(rows[f.name], f.type) for f in target], schema=target)

        return candidates.groupBy("query_id").applyInArrow(one, fields)

    return rerank


def expander(provider: Provider, most: int, encode: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """An expander for searches: (query_id, text) to (query_id, variant_id, dense, sparse). A query that fails has no variants: expansion may help and never harms.

    provider: texts to lists of lines. encode: adds dense and sparse (or nulls) to rows with a text.
    """

    def expand(wanted: DataFrame) -> DataFrame:
        listed = with_values(wanted, "text", provider, "lines").where("lines is not null")
        each = listed.select("query_id", F.posexplode(X.listed_lines(F.col("lines"), F.col("text"), most)).alias("n", "text"))
        return encode(each.withColumn("variant_id", F.concat_ws("/", F.col("query_id").cast("string"), "n"))).select("query_id", "variant_id", "dense", "sparse")

    return expand
