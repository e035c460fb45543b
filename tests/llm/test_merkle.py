"""The manifest against a plain recursive tree."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from corvane.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos string, g int, node string"


BLOCK = merkle.FANOUT**merkle.LEVELS


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return digest(*(encoded(row[c]) for c in ("doc_id", "source", "lang", "n_chars")), encoded(text))


def tree(nodes):
    """(top, for each node the (left, right) lists of its path)"""
    paths, places, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for path, at in zip(paths, places, strict=True):
            run = at - at % 8
            path.append((level[run:at], level[at + 1 : run + 8]))
        level = [digest(*level[i : i + 8]) for i in range(0, len(level), 8)]
        places = [p // 8 for p in places]
    return level[0], paths


def brute(rows):
    groups = {}
    for row in rows:
        text = row["text"]
        if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups.setdefault(row["lang"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row, row["text"]), leaf_of(row, text)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, above = tree([built[g][0] for g in names])
    for g, up in zip(names, above, strict=True):
        for (known, id, leaf, node), path in zip(sorted(groups[g]), built[g][1], strict=True):
            for left, right in path + up:
                node = digest(*left, node, *right)
            yield (id if known else None, leaf, built[g][0], root, digest(*(x for a, b in path + up for x in a + b)), node, node == root)


def table(spark, rows):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return [dict(zip(names, r, strict=True)) for r in rows], spark.createDataFrame(rows, SCHEMA)


def key(row):
    return tuple(str(x) for x in row)


def held(spark, rows, levels=merkle.LEVELS):
    plain, docs = table(spark, rows)
    got = [tuple(r) for r in merkle.tampered_manifest(docs.repartition(5), levels).collect()]
    assert sorted(got, key=key) == sorted(brute(plain), key=key)
    return got


def test_against_a_plain_tree(spark):
    rng = random.Random(4)
    langs = ["en", "de", None, "", "\U0001f600", "éa", "ß", "zz", "a", "b", "c"]  # over eight groups: the tree above has two levels
    rows = [(rng.choice([None, *range(400)]), rng.choice([None, "", "Plain Text", "ärger Ü", "lower"]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, 7]), "x", 1, "y") for _ in range(700)]
    got = held(spark, rows + rows[:40])  # repeated rows
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_one_leaf_and_none(spark):
    rows = held(spark, [(5, "A", "en", None, 1, None, None, None)])
    assert rows[0][1] == rows[0][2] == rows[0][3] and rows[0][4] == digest()
    _, empty = table(spark, [])
    assert merkle.tampered_manifest(empty).count() == 0


@pytest.mark.parametrize("n", [BLOCK, BLOCK + 1, 2 * BLOCK + 9])
def test_groups_of_several_blocks(spark, n):
    rows = [(i, "Text" if i % 2 else "text", "en" if i else "de", "s", i, None, None, None) for i in range(n + 1)]
    held(spark, rows)


@pytest.mark.parametrize("n", [9, 600])
def test_blocks_of_blocks(spark, n):
    """Blocks of eight places: several tables of blocks above each other, for the groups and for the groups' tops."""
    rng = random.Random(n)
    rows = [(i, "Aa", f"{rng.randrange(90)}" if i % 2 else "zz", None, None, None, None, None) for i in range(n)]
    held(spark, rows, 1)


def test_paths_fold_to_the_root(spark):
    _, docs = table(spark, [(i, "x" * (i % 50), "en" if i % 3 else None, "s", i, None, None, None) for i in range(300)])
    rows = merkle.manifest(docs, paths=True).collect()
    assert all(r["verified"] for r in rows)
    for r in rows[::17]:
        node = r["leaf"]
        for side in r["path"]:
            node = digest(side["left"], node, side["right"])
        assert node == r["root"] and digest(*(x for s in r["path"] for x in (s["left"], s["right"]))) == r["proof_sha256"]


def test_very_long_text_and_other_keys(spark):
    docs = spark.createDataFrame([("b", "Ü" * 3_000_000, 1), ("a", "", 1), (None, None, 2)], "name string, body string, kind int")
    rows = {r["name"]: r for r in merkle.manifest(docs, "name", "kind", ("name", "body"), seen=F.when(F.col("name") == "a", F.lit("0" * 64))).collect()}
    assert rows["b"]["leaf"] == digest("1:b", f"{6_000_000}:", "Ü" * 3_000_000)
    assert rows["b"]["verified"] and rows[None]["verified"] and not rows["a"]["verified"]
    assert rows["a"]["subroot"] == digest(rows["a"]["leaf"], rows["b"]["leaf"])
