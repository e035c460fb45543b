"""Counters of queries, gathered while they run."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Metrics:
    """Named counters with labels. observed() counts a DataFrame's rows as they pass, without another job."""

    def __init__(self):
        self.values: dict[tuple[str, tuple[tuple[str, str], ...]], float] = defaultdict(float)
        self._pending: list[tuple[str, dict, Observation]] = []

    def add(self, name: str, value: float = 1.0, **labels: str) -> None:
        self.values[name, tuple(sorted(labels.items()))] += value

    def observed(self, df: DataFrame, name: str, **labels: str) -> DataFrame:
        watch = Observation()
        self._pending.append((name, labels, watch))
        return df.observe(watch, F.count(F.lit(1)).alias("n"))

    def render(self) -> str:
        """All counters as text, one a line; waits for the observed queries to have run."""
        for name, labels, watch in self._pending:
            self.add(name, watch.get["n"], **labels)
        self._pending = []
        show = lambda labels: "{" + ",".join(f'{k}="{v}"' for k, v in labels) + "}" if labels else ""
        return "\n".join(f"{name}{show(labels)} {value:g}" for (name, labels), value in sorted(self.values.items()))


class StreamCounts(StreamingQueryListener):
    """Counts the batches, rows and failures of streaming queries into metrics, as they report them: no job of its own.

    Add it with spark.streams.addListener(); reports come on another thread, some time after their batch.
    """

    def __init__(self, metrics: Metrics, names: dict[str, str] | None = None):
        """names: from a query's id to what it is called in labels; others go by their own name or id."""
        self.metrics, self.names, self.ended = metrics, names or {}, 0

    def _label(self, id: object, name: str | None) -> str:
        return self.names.get(str(id)) or name or str(id)

    def onQueryStarted(self, event) -> None:
        self.names.setdefault(str(event.id), event.name or str(event.id))
        self.metrics.add("stream_starts_total", query=self._label(event.id, event.name))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        label = self._label(p.id, p.name)
        self.metrics.add("stream_batches_total", query=label)
        self.metrics.add("stream_input_rows_total", p.numInputRows, query=label)
        self.metrics.add("stream_seconds_total", (p.durationMs or {}).get("triggerExecution", 0) / 1000, query=label)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended += 1
        if event.exception is not None:
            self.metrics.add("stream_failures_total", query=self._label(event.id, None))
