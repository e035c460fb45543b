"""The pipeline's stages, each against its own input, and the registered names."""

import random
import re
from collections import Counter, defaultdict

import duckdb

import __spark_entry__ as entry
import corpus_pipeline
from corvane.llm import decontamination, jaccard_join, quality, queries, toxicity
from corvane.llm.common import written

DIR = "/root/testdata/sf0.001"


def test_names():
    names = entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    assert "pipeline" in names and sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")) == list(range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_stages(spark):
    docs = queries.table(spark, DIR, "documents")
    labels, bench = (queries.table(spark, DIR, t) for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, DIR), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if name == "toxicity":
            want = ids(toxicity.toxicity(docs, labels).where("predicted = 0"))
        elif name == "quality_classifier":
            want = ids(quality.quality(docs).where("keep"))
        elif name == "ngram_jaccard_join":
            want = ids(jaccard_join.jaccard_components(docs).where("doc_id = component_id"))
        else:
            want = ids(decontamination.digest(docs, bench).where("not contaminated"))
        assert ids(out) == want
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert sorted({r["doc_id"] for r in packed.collect()}) == ids(docs)


def near_copy_components(texts, words=5, percent=80):
    """The smallest position in each text's component, by brute force over the pairs that share a shingle; None for texts without words."""
    sets, held = [], defaultdict(list)
    for i, text in enumerate(texts):
        own = (text or "").encode().lower().split()
        sets.append({tuple(own[a : a + words]) for a in range(max(1, len(own) - words + 1))} if own else set())
        for s in sets[-1]:
            held[s].append(i)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in enumerate(sets):
        for j, common in Counter(j for s in own for j in held[s] if j < i).items():
            if 100 * common >= percent * (len(own) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) if sets[i] else None for i in range(len(texts))]


def test_near_copies_at_five_words_and_four_fifths(spark):
    """Against brute force; the edits make pairs between 0.8 of 5-word shingles and 0.85 of 4-word ones."""
    rng, rows = random.Random(7), []
    for _ in range(40):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([30, 60, 100, 250]))]
        for edits in (0, rng.randint(0, max(1, len(base) // 40)), rng.randint(1, 1 + len(base) // 25)):
            copy = list(base)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = f"new{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    given = [r["text"] for r in queries.table(spark, DIR, "documents").orderBy("doc_id").collect()]
    texts = rows + given + [None, "", "two words", "TWO words"]
    docs = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "near")
    least = near_copy_components(texts)
    want = [i for i, c in enumerate(least) if c is None or c == i]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, DIR).collect()) == want
    strict = near_copy_components(texts, 4, 85)
    assert any(a != b for a, b in zip(least, strict, strict=True))  # the two thresholds can be told apart here


def test_decontamination_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = sorted(tuple(r[x] for x in columns) for r in queries.op10_benchmark_decontamination(spark, DIR).collect())
    assert got == sorted(c.sql(f"select {', '.join(columns)} from ({decontamination.SQL})").fetchall())
