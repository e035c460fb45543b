"""Decontamination, Jaccard join, components, toxicity, quality, HTML, media and the language model."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import components, decontamination, html, jaccard_join, media, pitman_yor, quality, toxicity

DIR = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, extra=True):
    kind = "doc_id long, text string" + (", row string, score string, label string" if extra else "")
    return spark.createDataFrame([(*r, "a", "b", "c") if extra else r for r in rows], kind)


# --- decontamination ---

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def model_hits(text, items, width=13):
    words = WORD.findall((text or "").translate(UPPER))
    hit, found = set(), set()
    for item, passage in items:
        own = WORD.findall((passage or "").translate(UPPER))
        k = min(width, len(own))
        for a in range(len(own) - k + 1 if own else 0):
            for b in range(len(words) - k + 1):
                if words[b : b + k] == own[a : a + k]:
                    hit.update(range(b, b + k))
                    found.add(item)
    names = sorted(str(i) for i in found if i is not None)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


def test_contamination_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["a", "b", "É", "x1", "B"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 13, 14, 20])))) for i in range(12)] + [(50, None), (51, "--"), (None, "zz yy"), (9, "zz yy")]
    texts = [None, "", "..", "zz, YY", "zz yy zz yy"] + [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(60)]
    rows = [(i % 40, t) for i, t in enumerate(texts)]
    got = decontamination.digest(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = sorted((i, *(m := model_hits(t, items)), m[1] > 0 and 20 * m[1] >= m[0]) for i, t in rows)
    assert sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got) == want


def test_the_shuffled_join_gives_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontamination.digest(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, decontamination.digest(docs, bench).collect())) == want
    assert any(r[-1] for r in want)


def test_removal(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = frame(spark, [(1, "Keep. One, two three! End x"), (2, None), (3, "clean"), (3, "clean"), (4, "(one two three)")])
    whole = decontamination.decontaminate(docs, bench, 3)
    assert sorted((r["doc_id"], r["text"] or "") for r in whole.collect()) == [(2, ""), (3, "clean"), (3, "clean")]
    assert whole.columns == docs.columns
    spans = decontamination.decontaminate(docs, bench, 3, remove="spans")
    assert sorted((r["doc_id"], r["text"] or "") for r in spans.collect()) == [(1, "Keep. End x"), (2, ""), (3, "clean"), (3, "clean"), (4, "(")]
    assert decontamination.digest(docs.where("false"), bench).count() == 0
    assert decontamination.digest(docs, bench.where("false")).where("n_hit > 0").count() == 0


# --- Jaccard join ---


def model_components(rows, words=4, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted(((d is None, d or 0, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at] = f"new{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    texts = [None, "", "\n ", "one two", "ONE two", "one\vtwo", "a b c", "x y z w", "x y z w v"]
    for _ in range(14):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([7, 12, 40, 200, 500]))] + passage * rng.randint(0, 1)
        texts.append(" ".join(base))
        chain = base
        for _ in range(rng.randint(0, 9)):  # chains: neighbours link, ends may not
            chain = edited(rng, chain, rng.choice([0, 1, 1, 2, max(1, len(chain) // 60)]))
            texts.append(" ".join(chain))
    rng.shuffle(texts)
    rows = [(None if i == 5 else i // 2 * 2 + 100, t) for i, t in enumerate(texts)]
    got = jaccard_join.jaccard_components(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got), key=str) == model_components(rows)


def test_near_misses_within_hot_signatures(spark):
    """Many texts of one template at about the threshold: pairs across components are gone through in blocks."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, 3))) for i in range(120)]
    got = jaccard_join.jaccard_components(frame(spark, rows, False)).collect()
    assert sorted(((False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == model_components(rows)


def test_signatures_meet_whenever_sets_are_similar():
    rng, signer = random.Random(3), jaccard_join.Signer(85)
    for _ in range(400):
        n = rng.choice([7, 8, 15, 30, 60, 150, 400])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(rng.randint(0, n // 5)):
            if rng.random() < 0.5:
                b.add(rng.getrandbits(64))
            elif len(b) > 1:
                b.remove(rng.choice(sorted(b)))
        x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
        if a != b and 100 * len(a & b) >= 85 * len(a | b):
            assert set(signer.signatures(x).tolist()) & set(signer.signatures(y).tolist())
            p, q = (np.frombuffer(jaccard_join.bins_of(v), dtype=np.uint8).astype(int) for v in (x, y))
            assert np.abs(p - q).sum() <= len(a ^ b)


def test_bins_of_different_widths_bound_the_distance():
    rng = random.Random(11)
    sets = []
    for n in (100, 256, 257, 500, 513, 2048, 2049, 4097, 9000):
        a = {rng.getrandbits(64) for _ in range(n)}
        sets += [a, set(sorted(a)[: n * 9 // 10]) | {rng.getrandbits(64) for _ in range(n // 5)}]
    bins = [jaccard_join.bins_of(np.array(sorted(s), dtype=np.uint64)) for s in sets]
    assert {len(b) for b in bins} == {128, 256, 512, 1024, 2048}
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    got = jaccard_join.bin_distances([bins[i] for i, _ in pairs], [bins[j] for _, j in pairs])
    assert all(d <= len(sets[i] ^ sets[j]) for d, (i, j) in zip(got.tolist(), pairs, strict=True))
    assert all(d == 0 for d, (i, j) in zip(got.tolist(), pairs, strict=True) if i == j)


def test_one_of_each(spark):
    docs = frame(spark, [(5, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, "z"), (8, None), (7, "")])
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id != 8").collect()) == [(2, "a b c d e f"), (7, ""), (9, "z")]
    assert kept.count() == 4
    assert jaccard_join.one_of_each(docs.where("false")).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}


# --- toxicity ---


def test_nearest_are_exact():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(500):
        t = np.sort(rng.choice(60, rng.integers(0, 7), replace=False))
        v = rng.random(len(t))
        rows.append((t, v / np.sqrt((v**2).sum()) if len(t) else v))
    index = toxicity.Index({f"t{i}": i for i in range(60)}, np.ones(60), np.arange(500), rng.integers(0, 2, 500), np.ones(500), rows, 0.1)
    full = np.zeros((500, 60))
    for i, (t, v) in enumerate(index.rows):
        full[i, t] = v
    for _ in range(100):
        t = np.sort(rng.choice(60, rng.integers(1, 6), replace=False))
        v = rng.random(len(t))
        v /= np.sqrt((v**2).sum())
        q = np.zeros(60)
        q[t] = v
        cosine = full @ q
        want = sorted(((-round(c, 12), i) for i, c in enumerate(cosine) if c > 0))[: index.k]
        assert [i for _, i in index.nearest(t, v)] == [i for _, i in want]


def _toxic_rows(n=600):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('bcdfg')}{rng.randrange(300)}or" for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words[5] = rng.choice(["vilefoo", "vilebar", "vilebaz", f"vile{i}x"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = _toxic_rows()
    rows += [(9_001, None), (9_002, ""), (None, "vilefoo"), (1, "vilefoo x"), (1, "vilefoo x")]
    lab = spark.createDataFrame([*labels, (9_002, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, rows), lab).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    wrong = [r for r in held if r["predicted"] != truth[r["doc_id"]]]
    assert len(wrong) <= 0.03 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[9_001]["score"] == by[9_002]["score"] < 0.5 and by[9_001]["evidence"] == []
    assert all(zlib.crc32(str(e).encode()) % 5 for r in got for e in r["evidence"])
    docs = frame(spark, rows)
    kept = toxicity.without_toxic(docs, lab)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["predicted"]}


def test_toxicity_without_labels(spark):
    rows, labels = _toxic_rows(20)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.toxicity(frame(spark, rows), lab.where("false")).where("predicted = 1").count() == 0
    assert toxicity.toxicity(frame(spark, []), lab).count() == 0


# --- quality ---


def test_expectation_maximisation_finds_accuracies():
    rng = random.Random(1)
    rates = [(0.95, 0.05), (0.9, 0.2), (0.8, 0.1)]  # votes good: on good, on bad
    counts, truth = Counter(), Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        vote = "".join("2" if rng.random() < 0.2 else str(int(rng.random() < r[0 if good else 1])) for r in rates)
        counts[vote] += 1
        truth[vote] += good
    post, model, share = quality.posteriors(counts)
    assert abs(share - 0.8) < 0.05
    assert all(abs(model[i, 1, 1] - r[0]) < 0.05 and abs(model[i, 0, 1] - r[1]) < 0.1 for i, r in enumerate(rates))
    assert all(abs(post[v] - truth[v] / n) < 0.15 for v, n in counts.items() if n > 200)
    assert quality.posteriors({})[0] == {}


def test_quality_against_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality(docs).join(labels, "doc_id").select("keep", "quality").collect()
    assert sum(r["keep"] == bool(r["quality"]) for r in got) >= 0.98 * len(got)
    assert sum(r["quality"] and not r["keep"] for r in got) <= 0.01 * len(got)


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "the and of it is the word that was in it."), (3, "### $$$ %%%"), (4, "WORD!! " * 50)]
    got = quality.quality(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    docs = frame(spark, rows)
    assert quality.kept(docs).columns == docs.columns
    assert quality.quality(docs.where("false")).count() == 0 and quality.kept(docs.where("false")).count() == 0


# --- HTML ---

PROSE = "It was the best of the times and it is said that all of the people were in it."


def test_articles_lose_what_surrounds_them():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if (a<b) x("</p>")</script></head><body>
    <header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice"><p>{PROSE}</p></div>
    <article><h1>Head &amp; tail</h1><p>{PROSE}<p>Short.<p><b>Open {PROSE}<br><p>a&nbsp;&lt;b&gt;
    c<!-- gone --><aside>{PROSE}</aside><form>{PROSE}</form><div id="comments"><p>{PROSE}</p></div></article>
    <div class="ad">Buy</div><footer>&copy; x</footer></body></html>"""
    assert html.main_text(page) == f"Head & tail\n{PROSE}\nShort.\nOpen {PROSE}\na <b> c"


def test_pages_without_article():
    page = f"<body><div class='menu'><a href=1>One</a></div><h2>Title</h2><p>{PROSE} {PROSE}</p><p>Short.</p><p>{PROSE} {PROSE}</p><p><a href=2>{PROSE}</a></p><p>Copyright</p>"
    assert html.main_text(page) == f"Title\n{PROSE} {PROSE}\nShort.\n{PROSE} {PROSE}"


@pytest.mark.parametrize("name", ["has-sidebar", "hasSidebar", "content-sidebar-wrap", "with-ads", "comments-open", "no-header", "page no-header has-nav", "site-banner", "sidebar"])
def test_names_of_what_holds_the_text(name):
    inner = f"<h1>Title</h1><p>{PROSE}</p>"
    for root in ("article", "main"):
        assert html.main_text(f'<body><div class="{name}"><{root}>{inner}</{root}></div><p>{PROSE}</p></body>') == f"Title\n{PROSE}"
    if name not in ("site-banner", "sidebar"):
        assert html.main_text(f'<body><div class="{name}"><h2>Title</h2><p>{PROSE} {PROSE}</p></div></body>') == f"Title\n{PROSE} {PROSE}"


def test_headers_in_articles():
    for head in ('<header class="entry-header">', '<div class="post-header">', '<div id="articleHeader">'):
        tag = head[1:].split()[0]
        page = f'<div class="site-header"><h1>Site</h1></div><article>{head}<h1>Title</h1></{tag}><p>{PROSE}</p></article>'
        assert html.main_text(page) == f"Title\n{PROSE}"


@pytest.mark.parametrize("name", ["comments", "sidebar", "related-posts", "widget-area"])
def test_articles_that_are_not_the_pages(name):
    for root in ("article", "main"):
        assert html.main_text(f'<{root}><p>{PROSE}</p></{root}><div class="{name}"><article><p>Other {PROSE}</p></article></div>') == PROSE
        assert html.main_text(f'<div class="{name}"><article><p>Other {PROSE}</p></article></div><{root}><p>{PROSE}</p></{root}>') == PROSE
    hidden = f'<div hidden><div class="banner"><article>{PROSE}</article></div></div>'
    assert html.main_text(f"{hidden}<p>{PROSE} {PROSE}</p>") == f"{PROSE} {PROSE}"


@pytest.mark.parametrize("page", [None, "", "plain text", "<", "<p", "<!--", "<script>", "</p></div>", "<a href='x", "&#xZZ; &bogus; &#0;", "<p>" * 2000, "\x00<b>\x00"])
def test_broken_pages(page):
    assert isinstance(html.main_text(page), str)


def test_whole_pages_of_the_tables(spark):
    import html as unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        blocks = (" ".join(unescape.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", article))
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


# --- media ---


def png():
    chunk = lambda n, d: len(d).to_bytes(4, "big") + n + d + zlib.crc32(n + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes([0, 0, 0, 1, 0, 0, 0, 1, 8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def samples():
    import gzip
    import io
    import zipfile

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a", "b")
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0x80, 0, 0]) + bytes(6) + b"\x2c" + bytes([0, 0, 0, 0, 1, 0, 1, 0, 0]) + b"\x02\x02\x44\x01\x00\x3b"
    bmp = b"BM" + (58).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + bytes(8) + b"\x01\x00\x18\x00" + bytes(28)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x05\x08\x00\x01\xff\xda\x00\x03\x00\x12\x34\xff\xd9"
    return {"image/png": png(), "image/gif": gif, "image/bmp": bmp, "image/jpeg": jpeg, "audio/wav": media.wav(b"12345"), "application/zip": packed.getvalue(), "application/gzip": gzip.compress(b"x" * 5000), "application/pdf": b"%PDF-1.4\nx\nstartxref\n9\n%%EOF"}


def test_formats_are_confirmed_and_carved():
    sniffer = media.Sniffer()
    for kind, data in samples().items():
        assert sniffer.find(data) == [(0, len(data), kind, 0)], kind
        assert sniffer.find(b"junk BM RIFF " + data + b" tail") == [(13, len(data), kind, 0)], kind
        broken = data[: len(data) - 3]
        assert (0, len(data), kind, 0) not in sniffer.find(broken), kind
    both = b"--" + png() + b"--" + media.wav(png())
    assert [f[2:] for f in sniffer.find(both)] == [("image/png", 0), ("audio/wav", 0), ("image/png", 1)]


def test_media_in_containers():
    import io
    import zipfile

    sniffer, packed = media.Sniffer(), io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.png", png())
        z.writestr("b.zip", samples()["application/zip"])
    found = sniffer.find(media.wav(b"xy" + packed.getvalue() + bytes(9)))
    assert [f[2:] for f in found] == [("audio/wav", 0), ("application/zip", 1), ("image/png", 2), ("application/zip", 2)]
    assert found[1][:2] == (46, len(packed.getvalue()))
    cut = media.wav(packed.getvalue()[:-30]) + packed.getvalue()[-30:]  # ends after its container
    assert [f[2:] for f in sniffer.find(cut) if f[2] == "application/zip" and f[0] == 44] == []
    twice = b"%PDF-1.4\nx\nstartxref\n9\n%%EOF\nupdate\nstartxref\n20\n%%EOF"
    assert sniffer.find(twice + b" " + twice) == [(0, len(twice), "application/pdf", 0), (len(twice) + 1, len(twice), "application/pdf", 0)]


def test_many_headers_take_linear_time():
    import time

    sniffer = media.Sniffer()
    for magic in (b"%PDF-1", b"PK\x03\x04", b"\xff\xd8\xff\xc0\x00\x02\xff\xda\x00\x02"):
        start = time.process_time()
        assert sniffer.find(magic * 60_000) == []
        assert time.process_time() - start < 5


def test_declared_types_are_corrected(spark):
    rows = [(1, bytearray(png()), "image/jpeg"), (2, bytearray(b"text"), None), (3, None, "image/png"), (4, bytearray(b"x" + png()), None), (5, bytearray(b""), "image/png")]
    got = {r["id"]: r for r in media.sniff(spark.createDataFrame(rows, "id long, media binary, declared_type string")).collect()}
    assert [(got[i]["detected_type"], got[i]["corrected"], len(got[i]["carved"])) for i in range(1, 6)] == [("image/png", True, 0), (media.UNKNOWN, False, 0), (None, False, 0), (media.UNKNOWN, False, 1), (media.UNKNOWN, True, 0)]


def test_media_round_trip(spark):
    rows = [(1, None), (2, ""), (3, "é" * 32), (4, "x" * 65), (4, "x" * 65), (None, "RIFF GIF89a BM %PDF-1"), (6, "y" * 200_000)]
    got = media.media_features(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t in rows if d == r["doc_id"]) or ""
        data = text.encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r["feature"] == f"audio/wav;declared=text/plain;corrected=1;samples={len(padded)};embedded="
        assert r["media_sha256"] == hashlib.sha256(media.wav(padded)).hexdigest() and r["media_bytes"] == len(media.wav(padded))
    assert media.media_features(frame(spark, [])).count() == 0
    pdf = "%PDF-1.4 é startxref 9 %%EOF"
    (got,) = media.media_features(frame(spark, [(1, f"see {pdf} there")])).collect()
    assert got["feature"].endswith(f"embedded=application/pdf@4+{len(pdf.encode())}/1")
    clash = spark.createDataFrame([(bytearray(b"x" + png()), None, 5)], "media binary, declared_type string, carved int")
    assert media.sniff(clash).columns == ["media", "declared_type", "detected_type", "corrected", "carved"] and len(media.sniff(clash).first()["carved"]) == 1


# --- language model ---


def test_stirling_numbers():
    import math

    table = pitman_yor.stirling(0.0, 6)  # without discount: unsigned Stirling numbers of the first kind
    assert [round(math.exp(table[5, t])) for t in range(1, 6)] == [24, 50, 35, 10, 1]


def test_tables_follow_their_conditional():
    rng = np.random.default_rng(0)
    d, a, c = 0.5, 2.0, 6
    table = pitman_yor.stirling(d)
    t = pitman_yor.draw_tables(np.full(40_000, c), np.full(40_000, a), d, table, rng)
    chance = np.exp(table[c, 1 : c + 1] + np.log(a) * np.arange(1, c + 1))
    chance /= chance.sum()
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / 40_000 - chance).max() < 0.01
    big = pitman_yor.draw_tables(np.array([10**6]), np.array([3.0]), d, table, rng)[0]
    assert 3 < big < 200


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    word, context = np.repeat(np.arange(40), 15), np.tile(rng.choice(pitman_yor.CLASSES, 15, replace=False), 40)
    count = rng.geometric(0.3, len(word))
    count[::50] = 3000
    model = pitman_yor.Model(seen=40)
    for s in range(4):
        seats = pitman_yor.Seats(word, context, count, 40, 1)
        for _ in seats.states(model, s):
            pass
        model.history.append(seats.totals())
    none = np.zeros(0, dtype=np.int64)
    for u in (int(context[0]), pitman_yor.START, 99):
        known = pitman_yor.Seats(word, context, count, 40, 1).predictive(model, np.arange(40), np.full(40, u)).sum()
        unknown = pitman_yor.Seats(none, none, none, 1, 2).predictive(model, np.zeros(1, dtype=np.int64), np.array([u]))[0]
        assert abs(known + unknown - 1) < 1e-9


def test_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "no id"), (100_001, None), (100_002, ""), (5, "twin\x0bTWIN x"), (5, "twin\x0bTWIN x")], "doc_id long, text string")
    rows = docs.unionByName(odd).withColumn("row", F.lit("clash"))
    path_rows = [(r["doc_id"], r["text"]) for r in rows.collect()]
    from corvane.llm.common import written

    got = pitman_yor.lm_scores(written(rows, "lm-test")).collect()
    assert len(got) == len(path_rows)
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER)), None] for _, t in path_rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in path_rows]
    counts = Counter(w for ws, h in zip(tokens, held, strict=True) for w in ws if not h)
    n, v = sum(counts.values()), len(counts)
    want = sorted((d if d is not None else -1, h, len(ws), sum(counts[w] > 0 for w in ws), round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 5)) for (d, _), ws, h in zip(path_rows, tokens, held, strict=True))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # a lower perplexity on held-out texts
    assert all(r["score"] < 0 for r in got)
    assert pitman_yor.lm_scores(written(rows.where("false"), "lm-none")).count() == 0


def test_deep_pages():
    """Depth and end tags without a start cost time in proportion only."""
    assert html.main_text("<div>" * 50_000 + f"<p>{PROSE} {PROSE}</p>" + "</div>" * 50_000) == f"{PROSE} {PROSE}"
    assert html.main_text("<div>" * 50_000 + "</section>" * 50_000 + f"<p>{PROSE} {PROSE}</p>") == f"{PROSE} {PROSE}"


def test_pages_that_repeat_and_extra_columns(spark):
    page = f"<article><p>{PROSE}</p></article>"
    rows = [(1, "u", page, "x", 7), (1, "u", page, "x", 7), (None, None, None, None, None), (2, "v", "", "y", 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got.collect()) == [(0, "", 0), (1, PROSE, len(PROSE)), (1, PROSE, len(PROSE)), (2, "", 0)]
    assert html.extract(pages.limit(0)).collect() == []


def test_length_alone_casts_no_vote():
    """Few different words count at any length: the same text, longer and longer."""
    at = list(quality.LABELLERS).index("few different words")
    few, many = [f"word{i}" for i in range(30)], [f"word{i}" for i in range(450)]
    reader = quality.Reader()
    for n in (500, 2_900, 3_100, 40_000):
        assert quality.votes(reader.read(" ".join(few[i % 30] for i in range(n)))[0])[at] == str(quality.BAD), n
        assert quality.votes(reader.read(" ".join(many[i % 450] for i in range(n)))[0])[at] == str(quality.GOOD), n
    # against counting window by window
    text = " ".join(random.Random(3).choice(many) for _ in range(1_234)).split()
    want = sum(len(set(text[a : a + quality.WINDOW])) for a in (0, 500, 1000)) / 1_234
    assert reader.read(" ".join(text))[0].distinct == want


def test_scores_over_many_small_files(spark):
    """A task that reads many files gets rows of several of them in one batch, whose numbers don't follow one another."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 30)))) for i in range(400)]
    got = pitman_yor.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(40)).collect()
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 == 2}
    counts = Counter(w for d, t in rows if d not in held for w in [*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    want = [(d, d in held, len(t.split()) + 1, sum(counts[w] > 0 for w in [*t.split(), None]), n, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in [*t.split(), None]), 5)) for d, t in rows]
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want


def test_contexts_are_words(spark):
    """Two words of one ending are two contexts: what follows one says nothing of what follows the other."""
    rows = [(i, "alphaxx north" if i % 2 else "betaxx south") for i in range(200)]
    odd = [(1000, "alphaxx north"), (1001, "alphaxx south"), (1002, "betaxx south"), (1003, "betaxx north")]
    got = {r["doc_id"]: r["score"] for r in pitman_yor.lm_scores(spark.createDataFrame(rows + odd, "doc_id long, text string")).collect()}
    assert got[1000] > got[1001] + 1 and got[1002] > got[1003] + 1


def test_packed_numbers_come_back():
    rng = np.random.default_rng(5)
    for kind in ("u1", "<u2", "<u4", "<u8", "<i8"):
        for n in (0, 1, 1000):
            x = rng.integers(0, np.iinfo(kind).max, n, dtype=kind, endpoint=True)
            assert (pitman_yor.unpacked(pitman_yor.packed(x, kind), kind) == x).all()
            x.sort()
            assert (pitman_yor.unpacked(pitman_yor.packed(x, kind, True), kind, True) == x).all()
