"""Spelling variants, learned partitions and collocations against brute force, with edge cases."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.llm import collocations, learned_partitions, queries, spelling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "document_id long, text string, lang string, word string, part int, n string"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns that clash with names used inside."""
    long = "Analytics analytiks, the END of the line; été ÉTÉ Straße " * 3000
    rows = [
        (1, None, "en", "w", 1, "x"),
        (2, "", None, None, None, None),
        (None, "analytics analytics Analytic", None, "w", 1, "x"),
        (None, "analytics analytics Analytic", None, "w", 1, "x"),
        (5, long, "en", "w", 1, "x"),
        (6, long, "en us", "w", 1, "x"),
        (7, " \t\n.,;", "en", "w", 1, "x"),
        (8, "new york\tcity is new york city: new york\x0bcity a\x85b " * 40, "", "w", 1, "x"),
        (9, "\x00 \x1c 日本 \U0001f642 \x00 \x1c 日本 \U0001f642\n" * 40, "日本", "w", 1, "x"),
    ]
    return spark.createDataFrame(rows, DOC).withColumn("_h", F.lit(1)).withColumn("near", F.lit("x"))


# spelling variants


def brute_words(rows, noise=31):
    seen = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 2}


def brute_variants(n):
    """Near words by looking for each other word with one letter left out or masked."""
    masks = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            masks["r", w[:i] + "\0" + w[i + 1 :]].add(w)
            masks["d", w[:i] + w[i + 1 :]].add(w)
    out = {}
    for w in n:
        near = set()
        for i in range(len(w)):
            near |= masks["r", w[:i] + "\0" + w[i + 1 :]]
            if w[:i] + w[i + 1 :] in n:
                near.add(w[:i] + w[i + 1 :])
        near |= masks["d", w]
        near -= {w}
        form = min(near, key=lambda x: (-n[x], x)) if near else None
        out[w] = (form if form and n[form] >= 10 * n[w] else None, len(near))
    forms = {w: f for w, (f, _) in out.items()}
    rows = []
    for w, (form, near) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, form, root, n[w], near, n[form] if form else None))
    return sorted(rows)


def test_spelling_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in queries.op11_spelling_variants(spark, SF).collect())
    want = brute_variants(brute_words(docs))
    assert got == want
    assert any(r[1] for r in want)


def test_spelling_edges(edge):
    rows = [(r["document_id"], r["text"]) for r in edge.collect()]
    got = sorted(tuple(r) for r in spelling.spelling_variants(edge).collect())
    assert got == brute_variants(brute_words(rows))
    assert spelling.spelling_variants(edge.limit(0)).count() == 0


def test_spelling_chains_and_ties(spark):
    counts = {"abcdefg": 2, "abcdefh": 20, "abcdeih": 200, "abcdeihk": 200, "zzzzzzz": 5, "zzzzzzzz": 49, "yzzzzzz": 50, "xzzzzzz": 50}
    text = " ".join(" ".join([w] * n) for w, n in counts.items())
    df = spark.createDataFrame([(1, text)], "document_id long, text string")
    got = {r["word"]: tuple(r)[1:] for r in spelling.spelling_variants(df, noise=0).collect()}
    assert got["abcdefg"] == ("abcdefh", "abcdeih", 2, 1, 20)
    assert got["abcdefh"][:2] == ("abcdeih", "abcdeih")
    assert got["zzzzzzz"] == ("xzzzzzz", "xzzzzzz", 5, 3, 50)
    assert got["zzzzzzzz"][0] is None


def test_every_edit_shares_a_signature():
    rng = np.random.default_rng(3)
    letters = list("abcdeé")
    for _ in range(300):
        w = list(rng.choice(letters, rng.integers(7, 15)))
        other, i = w.copy(), int(rng.integers(len(w)))
        kind = rng.integers(3)
        if kind == 0:
            other[i] = "ÿ"
        elif kind == 1:
            del other[i]
        else:
            other.insert(i, str(rng.choice(letters)))
        place, found = spelling.signatures(["".join(w), "".join(other)])
        assert set(found[place == 0]) & set(found[place == 1]), (w, other)


# collocations


def brute_phrases(rows, least=30, top=2000):
    counts, n, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, b in candidates.items():
            parts = [p[i : i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1)]
            inside |= {q for q in parts if 100 * b >= 80 * f[q]}
        best = []
        for p, a in candidates.items():
            if p not in inside:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found_phrases(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("suffixes", [1 << 20, 500])
def test_collocations_with_hot_routes(spark, edge, monkeypatch, suffixes):
    """Also with routes so small that leading phrases are hot, and texts cut into many slices."""
    monkeypatch.setattr(collocations, "ROUTE_SUFFIXES", suffixes)
    monkeypatch.setattr(collocations, "SLICE", 20_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").unionByName(edge.select("text", "lang"))
    want = brute_phrases([tuple(r) for r in docs.collect()], least=12)
    assert found_phrases(collocations.mine_collocations(docs, least=12)) == want
    assert {r[0] for r in want} >= {"en", "en us", "", "日本"}


def test_collocation_limits(spark, edge):
    assert collocations.mine_collocations(edge.limit(0)).count() == 0
    few = collocations.mine_collocations(edge, top=1)
    assert few.groupBy("lang").count().where("count > 1").count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_001
    rows = [("en", "a", 1, big), ("en", "b", 1, big - 5), ("en", "a b", 2, big - 7)]
    df = spark.createDataFrame(rows, "lang string, phrase string, k int, f long")
    row = collocations.score_phrases(df).first()
    assert row["score"] == 2_000_000 * (big - 7) // (2 * big - 5)


def test_equal_partitions_count_every_prefix():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 4, (500, 4))
    for k in range(1, 4):
        keys[keys[:, k - 1] < 0, k] = -1
        keys[rng.random(500) < 0.2, k] = -1
        keys[keys[:, k - 1] < 0, k] = -1
    weights = rng.integers(1, 5, 500)
    want = Counter()
    for r, n in zip(keys.tolist(), weights.tolist()):
        for d in range(1, 5):
            if -1 not in r[:d]:
                want[tuple(r[:d])] += n
    for least in (1, 20):
        got = {}
        for rows, depth, size in collocations.equal_partitions(keys, weights, least):
            got.update({tuple(keys[r, :depth].tolist()): int(n) for r, n in zip(rows, size)})
        assert got == {p: n for p, n in want.items() if n >= least}


# learned partitions


def brute_nearest(ids, vectors, wanted, k):
    m = np.asarray(vectors, float)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q in wanted:
        score = unit @ unit[ids.index(q)]
        order = [i for i in sorted(range(len(ids)), key=lambda i: (-round(score[i], 12), ids[i])) if ids[i] != q]
        out[q] = [ids[i] for i in order[:k]]
    return out


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, 16))
    return [(i, (centres[i % 40] + 0.5 * rng.standard_normal(16)).tolist()) for i in range(n)]


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r[0], r["rank"])):
        out[r[0]].append(r[2])
    return out


def test_learned_recall_and_fewer_partitions(spark):
    rows = clustered(6000)
    # copies of one vector hold a third of all rows
    rows += [(6000 + i, rows[3][1]) for i in range(3000)]
    df = spark.createDataFrame(rows, "incident_id long, embedding array<double>")
    asked = df.where("incident_id % 50 = 0").withColumnRenamed("incident_id", "query_id")
    found = learned_partitions.learned_neighbours(asked, df, k=5, partitions=16)
    got, probes = answers(found), found.first()["probes"]
    ids = [r[0] for r in rows]
    want = brute_nearest(ids, [r[1] for r in rows], [i for i in ids if i % 50 == 0], 5)
    assert probes < 12
    assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    # of equal vectors the smallest ids
    assert got[6050] == [3, 6000, 6001, 6002, 6003]


def test_learned_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = [r["vec_id"] for r in rows]
    got = queries.op12_learned_partitions(spark, SF)
    assert got.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    want = brute_nearest(ids, [r["embedding"] for r in rows], [i for i in ids if i % 50 == 0], 5)
    found = defaultdict(list)
    for r in got.orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    assert dict(found) == want


def test_learned_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], "x"), (0, [1.0, 0.0], "x"), (1, [2.0, 0.0], None), (2, [0.0, 0.0], "x"), (3, None, "x"), (4, [nan, 1.0], "x"),
        (5, [inf, 1.0], "x"), (6, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (8, [1e300, 1e300], "x"), (9, [1e-300, 0.0], "x"),
        (10, [1.0, 2.0, 3.0], "x"), (11, [], "x"), (50, [0.0, 0.0], "x"),
    ]
    df = spark.createDataFrame(rows, "incident_id long, embedding array<double>, part string").withColumn("id", F.lit(1)).withColumn("v", F.lit(2))
    asked = df.where("incident_id % 50 = 0").withColumnRenamed("incident_id", "query_id")
    got = [(r["query_id"], r["rank"], r["incident_id"], round(r["score"], 9)) for r in learned_partitions.learned_neighbours(asked, df, k=5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 9, 1.0), (0, 3, 8, 0.707106781), (0, 4, None, 0.707106781)]
    assert learned_partitions.learned_neighbours(asked, df.limit(0)).count() == 0
    assert learned_partitions.learned_neighbours(asked.limit(0), df).count() == 0
    texts = df.where("incident_id IN (0, 1, 9)").withColumn("incident_id", F.col("incident_id").cast("string"))
    named = learned_partitions.learned_neighbours(texts.where("incident_id = '9'"), texts, "incident_id", "incident_id")
    assert [(r["query_id"], r["incident_id"]) for r in named.orderBy("rank").collect()] == [("9", "0"), ("9", "1")]


def test_balanced_partition_has_equal_sizes(spark):
    unit = np.array([r[1] for r in clustered(1024)])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    graph = learned_partitions.neighbour_graph(spark, unit)
    label = learned_partitions.balanced_partition(unit, graph, 8)
    assert set(np.bincount(label)) == {128}
    cut = (label[graph] != label[:, None]).mean()
    assert cut < 0.5
