"""The operators against brute force, on few rows with every edge case."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from argloom.llm import impact_search, license_scan, mixing, near_dedup, ngram_model, pii, quality_rules, sentencepiece_codec, token_shards, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, votes int, rows string"
SOUND = "doc_id long, text string, lang string, source string, n_chars long"


def make(seed=0, n=60):
    """Random texts with copies, near copies, repeats, junk, nulls; doc_ids once each."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "délta", "the", "of", "mit", "License", "apache", "general", "public", "ε", "x@y.org", "10.0.0.300", "+1 (555) 123-4567", "4111 1111 1111 1111", "a▁b", "##", "1.2.3.4"]
    texts = [None, "", " ", "\n\n", "one", "one two three", "ONE two three", "x" * 3000, "a b c d e " * 500]
    while len(texts) < n:
        texts.append(" ".join(rng.choice(words) + rng.choice(["", ".", "\n", "  "]) for _ in range(rng.choice([3, 12, 60, 200]))))
    for t in list(texts[9:25]):
        w = t.split(" ")
        texts += [t, " ".join(w[: len(w) // 9] + w[len(w) // 9 + 1 :]), t + " end"]
    return [(i, t, "en", ["b", "a", None, "c"][rng.randrange(4)], len(t or ""), 7, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA)


@pytest.fixture(scope="module")
def messy(spark):
    """Null ids and repeated rows too."""
    rows = make(1, 30)
    return spark.createDataFrame(rows + rows[5:9] * 3 + [(None, "no id at all here now", "en", "a", 1, 1, "r")] * 2, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 90)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def test_sentencepiece(docs, messy, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (docs, messy):
        want = sorted(str((r["doc_id"], len(i := sp.encode(r["text"] or "")), sha(",".join(map(str, i))), sha(sp.decode(i)))) for r in df.collect())
        assert sorted(str(tuple(r)) for r in sentencepiece_codec.digest(df, MODEL).collect()) == want
    out = sentencepiece_codec.encode(docs, MODEL, decoded="votes").collect()
    assert all(r["ids"] == sp.encode(r["text"] or "") and r["votes"] == sp.decode(r["ids"]) for r in out)
    assert sentencepiece_codec.digest(none, MODEL).count() == 0


def test_chunks_of_strange_text():
    table = sentencepiece_codec.ChunkTable(MODEL)
    rng = random.Random(4)
    texts = ["".join(rng.choice(" ▁  ab\nÉ́😀,<0x41>\t\x00　") for _ in range(rng.randrange(30))) for _ in range(3000)]
    ids = table.model.encode(texts, num_threads=1)
    assert table.written(texts) == [(",".join(map(str, i)), t) for i, t in zip(ids, table.model.decode(ids), strict=True)]


def brute_quality(text):
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = collections.Counter(grams)
    repeat = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat)


def test_quality(docs, messy, none, labels):
    for df in (docs, messy):
        out = quality_rules.run(df, labels).collect()
        texts = collections.defaultdict(set)
        for r in df.collect():
            texts[r["doc_id"]].add(brute_quality(r["text"] or ""))
        assert len(out) == df.count()
        for r in out:
            counts = tuple(r[c] for c in quality_rules.COUNTS)
            assert counts in texts[r["doc_id"]]
            assert r["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.run(none, labels).count() == 0
    assert quality_rules.run(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_forest_finds_the_odd_one():
    x = np.random.default_rng(0).normal(size=(500, 3))
    forest = quality_rules.grow(np.vstack([x, [[9, 9, 9]]]))
    score = forest.score(np.vstack([x, [[9, 9, 9]]]))
    assert score.argmax() == 500 and score[500] > np.quantile(score, 0.99)


def levels(sizes):
    """Targets by stopping sources one after the other."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, stopped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}
    while True:
        left = sum(sizes.values()) - sum(stopped.values())
        open_ = [s for s in sizes if s not in stopped]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s: 3 * sizes[s] for s in open_ if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return stopped | share
        stopped |= over


def test_mixing(spark, docs, messy, none):
    for df in (docs, messy):
        out, by = mixing.plan(df).collect(), collections.Counter()
        size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in df.collect()}
        assert len(out) == df.count() and all(r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] for r in out)
        for r in df.collect():
            by[r["source"]] += size[r["doc_id"]]
        want = levels(dict(by))
        got = collections.Counter()
        for r, s in zip(sorted(out, key=str), sorted(mixing.plan(df).collect(), key=str), strict=True):
            assert r == s
        source = {r["doc_id"]: r["source"] for r in df.collect()}
        for r in out:
            got[source[r["doc_id"]]] += r["taken"]
            assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
        assert all(abs(got[s] - want[s]) <= max(size.values()) for s in want)
    taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.plan(docs).collect()}
    mixed = mixing.resampled(docs)
    assert mixed.columns == docs.columns and all(r["count"] == taken[r["doc_id"]] or not WORD.search(r["text"] or "") for r in mixed.groupBy("doc_id", "text").count().collect())
    assert mixing.plan(none).count() == 0


def test_mixing_with_many_sources(messy, monkeypatch):
    """Goals too large to be sent to every task are joined by a shuffle, with the same rows."""
    want = sorted(map(str, mixing.plan(messy).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(map(str, mixing.plan(messy).collect())) == want


def brute_pii(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii._luhn(digits(m[0]))]
    return sorted(out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15])


def test_pii_base_spans():
    rng = random.Random(3)
    for _ in range(20000):
        t = "".join(rng.choice("aB1 2.@+-()9305.4 @a.b4111111111111111é") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == brute_pii(t)


def test_pii(docs, messy, none):
    for df in (docs, messy):
        want = collections.Counter((r["doc_id"], hashlib.sha256(pii._written(brute_pii(r["text"] or "")).encode()).hexdigest()) for r in df.collect())
        out = pii.run(df).collect()
        assert collections.Counter((r["doc_id"], r["base_sha256"]) for r in out) == want
        assert all(len([x for x in r["spans"].split(",") if x]) >= r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in out)
    clean = pii.redact(docs, pii.train(docs))
    assert clean.columns == docs.columns and not any(brute_pii(r["text"] or "") for r in clean.collect()) and clean.where("text is null").count() == 1
    assert pii.run(none).count() == 0


def test_warc(spark, none):
    html = ["<p>" + "x" * 200, "short", None, "é" * 60 + "\r\n\r\nWARC/1.0\r\n", ""]
    pages = [(i, [f"http://www.a.org/{i % 3}?q#f", None, "https://b.net:80/ x\ny"][i % 3], html[i % 5]) for i in range(40)] + [(None, "http://z.org", html[0])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = warc.run(df).orderBy("part", "pos").collect()
    first = {}
    for i, _, h in sorted(pages[:40]):
        first.setdefault(h or "", i)
    for r in out:
        h = html[r["page_id"] % 5] or "" if r["page_id"] is not None else html[0]
        own = r["page_id"] if len(h.encode()) < 100 or r["page_id"] is None else first[h]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "response" if own == r["page_id"] else "revisit", None if own == r["page_id"] else own)
    keys = [warc._order(r.asDict()) for r in out]
    assert len(out) == 41 and keys == sorted(keys)
    assert warc.run(df.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for k in range(8):
        runs = [sorted(({"urlkey": rng.choice("ab"), "ts": str(rng.randrange(5)), "page_id": rng.randrange(9)} for _ in range(rng.randrange(6))), key=warc._order) for _ in range(k)]
        assert [warc._order(x) for x in warc.LoserTree(runs)] == sorted(warc._order(x) for r in runs for x in r)


def test_token_shards(docs, messy, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    out = token_shards.run(docs, WORDS).orderBy("doc_id").collect()
    start = 0
    for r, d in zip(out, docs.orderBy("doc_id").collect(), strict=True):
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (d["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_shards.run(messy, WORDS).count() == messy.count() and token_shards.run(none, WORDS).count() == 0


def test_wavelet_matrix():
    v = np.random.default_rng(0).integers(0, 37, 3000).astype(np.uint32)
    for m in (token_shards.WaveletMatrix.of(v), token_shards.unpack(token_shards.pack([1, None], np.array([2999, 1]), v))[2]):
        assert (m.decode() == v).all() and [m.access(i) for i in range(0, 3000, 77)] == v[::77].tolist()
        assert m.occurrences(5) == np.flatnonzero(v == 5).tolist() and m.rank(7, 1234) == (v[:1234] == 7).sum() and m.count(99) == 0


def test_ngram_model(docs, messy, none):
    for df in (docs, messy):
        data = [(r["doc_id"], WORD.findall((r["text"] or "").translate(LOWER)) + ["</s>"]) for r in df.collect()]
        held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
        uni, pairs = collections.Counter(), collections.Counter()
        for i, t in data:
            if not held(i):
                uni.update(t), pairs.update(zip(["<s>", *t], t, strict=False))
        follows, after, times = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0]), collections.Counter()
        for (u, v), n in pairs.items():
            follows[v] += 1
            after[u][min(n, 3) - 1] += 1
            times[u] += n
        d2, d1 = (ngram_model.discounts(np.array([sum(n == k for n in c.values()) for k in (1, 2, 3, 4)])) for c in (pairs, follows))
        cut = lambda n, d: d[min(n, 3) - 1] if n else 0
        left = sum(cut(n, d1) for n in follows.values()) / len(pairs)

        def p(u, v):
            low = (follows[v] - cut(follows[v], d1)) / len(pairs) + left / (len(uni) + 1)
            return low if not times[u] else (pairs[u, v] - cut(pairs[u, v], d2)) / times[u] + np.dot(after[u], d2) / times[u] * low

        total, want = sum(uni.values()), collections.defaultdict(list)
        assert sum(p("the", v) for v in uni) + p("the", None) == pytest.approx(1)
        for i, t in data:
            want[i].append((held(i), len(t), sum(uni[w] > 0 for w in t), total, sum(math.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in t), sum(math.log10(p(u, v)) for u, v in zip(["<s>", *t], t, strict=False))))
        for r in ngram_model.run(df).collect():
            assert any(tuple(r)[1:] == pytest.approx(w) for w in want[r["doc_id"]])
    assert ngram_model.run(none).count() == 0


@pytest.mark.parametrize("order", [3, 4])
def test_ngram_model_of_higher_order(spark, messy, none, order):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    cut = lambda n, d: d[min(n, 3) - 1] if n else 0
    rare = spark.createDataFrame([(1000 + i, " ".join(f"w{(i * j) % 97} x{j % 5}" for j in range(40)), "en", "a", 1, 1, "r") for i in range(30)], SCHEMA)
    for df in (messy, messy.union(rare)):
        data = [(r["doc_id"], ["<s>"] + WORD.findall((r["text"] or "").translate(LOWER)) + ["</s>"]) for r in df.collect()]
        raw = [collections.Counter() for _ in range(order + 1)]
        for i, t in data:
            for k in range(1, order + 1) if not held(i) else ():
                raw[k].update(tuple(t[j : j + k]) for j in range(len(t) - k + 1))
        of = [collections.Counter() for _ in range(order + 1)]
        of[order] = raw[order]
        for k in range(1, order):
            of[k].update(g[1:] for g in raw[k + 1])
            of[k].update({g: n for g, n in raw[k].items() if g[0] == "<s>" and k > 1})
        d = [None] + [ngram_model.discounts(np.array([sum(n == m for n in c.values()) for m in (1, 2, 3, 4)])) for c in of[1:]]
        behind = collections.defaultdict(list)
        for c in of[1:]:
            for g, n in c.items():
                behind[g[:-1]].append(n)
        vocabulary = {w for (w,) in raw[1]} - {"<s>"}

        def p(context, v):
            g, k = (*context, v), len(context) + 1
            low = p(context[1:], v) if context else 1 / (len(vocabulary) + 1)
            ns = behind.get(tuple(context), [])
            return (of[k][g] - cut(of[k][g], d[k]) + sum(cut(n, d[k]) for n in ns) * low) / sum(ns) if ns else low

        for context in (("the", "of"), ("<s>", "one"), ("x1", "the")):
            assert sum(p(context, v) for v in [*vocabulary, None]) == pytest.approx(1)
        want = collections.defaultdict(list)
        for i, t in data:
            want[i].append((len(t) - 1, sum(math.log10(p(tuple(t[max(0, j - order + 1) : j]), t[j])) for j in range(1, len(t)))))
        for r in ngram_model.run(df, order=order).collect():
            assert any((r["n_tokens"], r["score"]) == pytest.approx(w) for w in want[r["doc_id"]])
    assert ngram_model.run(none, order=order).count() == 0


def test_near_dedup(spark, docs, messy, none):
    documents = docs.toPandas()  # noqa: F841  read by the SQL
    want = sorted(duckdb.sql("with documents as (select * from documents) select * from (" + near_dedup.LINKS_SQL + ")").fetchall())
    out = near_dedup.run(docs).collect()
    assert sorted(map(tuple, out)) == want and sum(not r["kept"] for r in out) > 20
    odd = near_dedup.run(messy).collect()
    assert len(odd) == messy.count() and all(r["component_id"] is None and r["kept"] for r in odd if r["doc_id"] is None)
    assert near_dedup.run(none).count() == 0


def _family(rng):
    base, texts = [f"w{i}" for i in range(150)], []
    for _ in range(300):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    return texts


def _chain(rng):
    """Each text is near the one before, and far from those much earlier."""
    w, texts = [f"w{i}" for i in range(150)], []
    for i in range(160):
        w = w[:]
        w[i * 3 % 150] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    return texts


def _passage(rng):
    """A long passage with ends of their own; some of these come twice, a little changed."""
    texts = []
    for i in range(140):
        own = [f"y{rng.randrange(10**6)}" for _ in range(70)]
        texts += [" ".join([f"w{j}" for j in range(90)] + own)] + [" ".join([f"w{j}" for j in range(90)] + own[:-1] + ["end"])] * (i % 3 == 0)
    return texts


@pytest.mark.parametrize("make", [_family, _chain, _passage])
@pytest.mark.parametrize("pivots", [1, 4])
def test_near_dedup_of_large_groups(spark, monkeypatch, make, pivots):
    texts = make(random.Random(8))
    random.Random(9).shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 40)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 32)
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    twice = [*enumerate(texts), *list(enumerate(texts))[:5]]
    out = rows(near_dedup.run(spark.createDataFrame(twice, "doc_id long, text string")))
    assert [out[i]["component_id"] for i in range(len(texts))] == root


def test_impact_search(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = [(i, (rng.normal(size=16) * 0.3).tolist()) for i in range(700)]
    vectors += [(700, vectors[0][1]), (701, vectors[0][1]), (800, None), (801, [float("nan")] * 16), (802, [None] * 16), (None, vectors[1][1])]
    monkeypatch.setattr(impact_search, "SHARD", 100)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    out = impact_search.top_k(df, F.col("vec_id") % 100 == 0).collect()
    x = {i: np.floor(np.float32(v).astype(float) * 1024).astype(int) for i, v in vectors if i is not None and i < 800}
    for q in range(0, 701, 100):
        want = sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q)[:10]
        assert [(r["rank"], -r["score"], r["vec_id"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] == [(k + 1, *w) for k, w in enumerate(want)]
    assert impact_search.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_impact_search_of_repeated_queries(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.normal(size=16) * 0.3).tolist()) for i in range(350)]
    vectors += [vectors[0], (100, vectors[7][1]), (100, vectors[8][1])]
    monkeypatch.setattr(impact_search, "SHARD", 100)
    out = impact_search.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0)
    x = [(i, np.floor(np.float32(v).astype(float) * 1024).astype(int)) for i, v in vectors]
    want = [(q, k + 1, i, -s) for q, y in x if q % 100 == 0 for k, (s, i) in enumerate(sorted((-int(y @ v), i) for i, v in x if i != q)[:10])]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_license_scan(spark, docs, messy, none):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for df in (docs, messy):
        want = collections.Counter()
        for r in df.collect():
            w, found = word.findall((r["text"] or "").translate(LOWER)), []
            for phrase, label in license_scan.PHRASES:
                p = phrase.split()
                found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
            want[r["doc_id"], len(w), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({x for _, x in found}))] += 1
        assert collections.Counter(tuple(r)[:6] for r in license_scan.run(df).collect()) == want
    text = "So: this program is free software, you can really redistribute it and or modify it under terms of the GNU general public license"
    out = rows(license_scan.run(spark.createDataFrame([(1, text), (2, "Licensed under CC BY-NC 4.0."), (3, "licensed under nothing")], "doc_id long, text string")))
    assert (out[1]["labels"], out[2]["labels"], out[3]["labels"], out[3]["score"]) == ("gpl", "cc-by-nc", "", 0.0) and out[2]["score"] == 1.0
    assert license_scan.run(none).count() == 0


def test_license_templates(spark):
    """Clauses of bodies are found, and whole texts passed as templates."""
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert license_scan._common(a, b) == table[-1][-1]
    mit = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    long = " ".join(f"Word{i * i % 1009}," for i in range(3000))
    df = spark.createDataFrame([(1, "x = 1\n# " + mit), (2, "See: " + long + " End."), (3, "nothing here at all")], "doc_id long, text string")
    assert [r["labels"] for _, r in sorted(rows(license_scan.run(df)).items())] == ["mit", "", ""]
    assert [r["labels"] for _, r in sorted(rows(license_scan.run(df, templates=[(long, "own")])).items())] == ["", "own", ""]


def test_pipeline_against_brute_force(spark, docs, labels, tmp_path):
    import corpus_pipeline
    import sentencepiece

    plain = docs.drop("votes", "rows")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Stage by stage from what the operators say of their own input.
    df = plain
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, df, str(tmp_path)).collect(), SOUND)
        ids, kept = [r["doc_id"] for r in df.collect()], collections.Counter(r["doc_id"] for r in after.collect())
        if name == "quality_rules":
            want = {r["doc_id"]: 1 for r in quality_rules.run(df, labels).collect() if r["kept"]}
        elif name == "near_duplicates":
            documents = df.toPandas()  # noqa: F841
            want = {i: 1 for i, _, _, k in duckdb.sql("with documents as (select * from documents) select * from (" + near_dedup.LINKS_SQL + ")").fetchall() if k}
        elif name == "personal_data":
            want = dict.fromkeys(ids, 1)
            assert not any(brute_pii(r["text"] or "") for r in after.collect())
        else:
            want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.plan(df).collect() if r["taken"]}
        assert kept == want, name
        df = after
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert sorted((r["doc_id"], r["text"], r["ids"], r["decoded"]) for r in out) == sorted((r["doc_id"], r["text"], i := sp.encode(r["text"]), sp.decode(i)) for r in df.collect())
