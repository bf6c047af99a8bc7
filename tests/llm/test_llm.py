"""The corpus operators on small watched tables: brute force, round trips, edge cases."""

import collections
import json
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftwatch.llm import (
    common,
    context_mixing,
    fingerprints,
    mixing,
    near_duplicates,
    packing,
    quality_classifier,
    quality_rules,
    queries,
    tool_calls,
    toxicity,
    url_filter,
)

SF = "/root/testdata/sf0.001"
DOC = "document_id long, collection_name string, text string, extra string"
EDGE = [
    (1, "orders", None, "a"),
    (2, "orders", "", "b"),
    (3, None, " \t\n ", "c"),
    (4, "users", "one", "d"),
    (5, "users", "the cat and the dog of the house " * 400, None),
    (6, "users", "the cat and the dog of the house " * 400, None),
    (7, "users", "Don't stop: été 日本 \U0001f642 a b <|x|>", "e"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOC).withColumn("_h", F.lit(1)).withColumn("key", F.lit("x"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


# quality rules


def brute_rules(text):
    w = split(text)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, edge, empty):
    docs = queries.watched(spark, SF).select("document_id", "text").union(edge.select("document_id", "text"))
    docs = docs.union(spark.createDataFrame([(8, "a b c a b c\nx\n\nx\ny # $\n x"), (9, "a b a b a b a")], "i long, t string"))
    rows = quality_rules.apply_quality_rules(docs).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.apply_quality_rules(empty).count() == 0


def test_quality_rules_slow_way(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 2)  # too few places: windows are compared as text
    texts = ["a b c d a b c e a b c", "a a a a a a", "a b c d e f g"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(quality_rules.repeated_window_words(quality_rules.word_array(F.col("text")))).collect()]
    assert got == [brute_rules(t)[4] for t in texts]


# toxicity


def test_toxicity(spark, edge, empty):
    docs = queries.watched(spark, "/root/testdata/sf0.01")
    labels = queries.toxicity_labels(spark, "/root/testdata/sf0.01")
    test = F.col("document_id") % 3 == 0
    model = toxicity.fit_chain(docs, labels.where(~test), queries.CHAIN)
    rows = toxicity.predict_chain(docs, model).join(labels.where(test), "document_id").collect()
    right = sum((r.p_toxic >= 0.5) == (r.toxic == 1) for r in rows)
    # some labelled texts hold no telling word; always answering no would get this many
    assert right > sum(r.toxic == 0 for r in rows)
    assert sum(r.p_toxic >= 0.5 and r.toxic == 0 for r in rows) <= 0.05 * len(rows)
    assert sum((r.p_degraded >= 0.5) == (r.degraded == 1) for r in rows) / len(rows) > 0.95
    # the chain feeds the first category's logit to the second model
    assert len(model.weights[1]) == len(model.weights[0]) + 1
    out = toxicity.predict_chain(edge, model)
    assert out.columns == [*edge.columns, "p_degraded", "p_toxic"]
    assert all(0 <= r.p_toxic <= 1 for r in out.collect())
    assert toxicity.predict_chain(empty, model).count() == 0
    blank = toxicity.fit_chain(empty, labels.limit(0), queries.CHAIN)
    assert toxicity.predict_chain(edge, blank).count() == len(EDGE)


# near duplicates


def brute_groups(texts, width, percent=80):
    def shingles(t):
        w = lower(t)
        return frozenset(zip(*[w[k:] for k in range(width)])) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in texts.items()}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                top[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies():
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 90, 60)]
    rows = {}
    for i in range(150):  # one crowd of near copies around the limit, some of them equal
        w = list(base)
        for k in rng.integers(0, 60, i % 6):
            w[k] = f"x{rng.integers(0, 40)}"
        rows[i] = " ".join(w)
    for i in range(150, 200):
        rows[i] = " ".join(f"y{k}" for k in rng.integers(0, 30, rng.integers(0, 40)))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    texts = near_copies() | {200: None, 201: "", 202: "One", 203: "one", 204: "two words", 205: "Two Words"}
    df = spark.createDataFrame([(i, "c", t) for i, t in texts.items()] + [(7, "c", texts[7])], "document_id long, collection_name string, text string")
    got = near_duplicates.near_duplicates(df, width=width, small_node=4, block=16).collect()
    want = brute_groups(texts, width)
    assert {r.document_id: (r.n_shingles, r.component_id) for r in got} == want
    # the repeated row of document 7 has its own result
    assert len(got) == len(want) + 1 and all(r.kept == (r.document_id == r.component_id) for r in got)


def test_near_duplicates_without_id(spark):
    same = "one two three four five six seven"
    rows = [(None, same), (5, same), (None, same), (9, same), (None, None)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "document_id long, text string")).collect()
    assert sorted((r.document_id or 0, r.n_shingles, r.component_id, r.kept) for r in got if r.document_id) == [(5, 3, 5, True), (9, 3, 5, False)]
    assert sorted(r.n_shingles for r in got if r.document_id is None and r.component_id is None and r.kept) == [0, 3, 3]


def test_links_at_a_lower_limit(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(200):  # 101 of 200 words shared by two: similarity 101 / 200
        mark = lambda n: [f"{k}.{x}" for x in rng.integers(0, 10**9, n)]
        both = mark(101)
        rows += [(2 * k, " ".join(both + mark(50))), (2 * k + 1, " ".join(both + mark(49)))]
    docs = spark.createDataFrame(rows, "document_id long, text string")
    got = near_duplicates.near_duplicates(docs, width=1, percent=50).collect()
    assert sum(not r.kept for r in got) == 200
    assert near_duplicates.trees_for(80) == 18 and near_duplicates.bits_apart(80) == 22 and near_duplicates.trees_for(100) == 1


def test_near_duplicates_empty(empty):
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_small_results_are_written_in_few_files(spark, monkeypatch):
    many = spark.range(5000).repartition(200, "id")
    kept = common.stored(many)
    assert len(kept.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in kept.collect()) == list(range(5000))
    # what reads much keeps its tasks
    monkeypatch.setattr(common, "WRITE_BYTES", 1)
    assert len(common.stored(many).inputFiles()) == 200


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.id: r.component_id for r in common.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_ranked_tokens_in_arrow():
    texts = [None, "", " ", "\n a\tb  ", "A\x0b\x0cZ\x1c\x1d\x85 \u3000x\xa0y B b", "\xc9t\xe9 \xc9 zz a zz", "a"]
    top = {b"a": 0, context_mixing.END: 1, b"b": 2}
    cut = pa.array(["left out"] + texts).slice(1)
    got = context_mixing._ranked(cut, *context_mixing._top_array(top))
    want = [[*common.words(t), context_mixing.END] for t in texts]
    past = len(top) - context_mixing.TOP_CLASSES
    assert got.ids.tolist() == [top.get(x, past + context_mixing.tail_class(x)) for w in want for x in w]
    assert got.size.tolist() == [len(w) for w in want]
    rare = got.rare.to_pylist()
    assert [(r, rare[k]) for r, k in zip(got.rare_row.tolist(), got.rare_at.tolist())] == [(r, x) for r, w in enumerate(want) for x in w if x not in top]


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("in_task", [7, 1000])
def test_components_joined_in_tasks(spark, kind, in_task):
    rng = np.random.default_rng(5)
    pairs = [(f"{a:03}", f"{b:03}") for a, b in rng.integers(0, 300, (170, 2)).tolist()] + [(f"{400 + i}", f"{401 + i}") for i in range(40)] + [(None, "000"), ("007", "007")]
    edges = spark.createDataFrame(pairs, "a string, b string").select(F.col("a").cast(kind), F.col("b").cast(kind)).repartition(5)
    rows = common.connected_components(edges, in_task=in_task).collect()
    want = {r.id: r.component_id for r in common.connected_components(edges).collect()}
    assert {r.id: r.component_id for r in rows} == want and len(rows) == len(want) > 200


def test_near_duplicates_join_few_links_without_rounds(spark, monkeypatch):
    calls, write = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df: calls.append(1) or write(df))
    docs = spark.createDataFrame(list(near_copies().items()), "document_id long, text string")
    near_duplicates.near_duplicates(docs, width=2, small_node=4, block=16)
    # at most four sets of links, each written once as it came and once joined
    assert 2 <= len(calls) <= 8


# mixing


def test_mixing(spark, edge, empty):
    docs = queries.watched(spark, "/root/testdata/sf0.01").withColumn("collection_name", F.when(F.col("document_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("document_id") % 4)))
    weights = spark.createDataFrame([("hot", 0.5), ("c0", 0.3), ("c1", 0.1), ("c2", 0.1)], "collection_name string, weight double")
    rows = mixing.mix_collections(docs, weights, block_chars=2000, period=100).collect()
    assert len(rows) == docs.count()
    named = [r for r in rows if r.slot is not None]
    assert {r.collection_name for r in rows if r.slot is None} == {"c3"}
    assert all(r.release <= r.slot < r.deadline for r in named)
    of = {(r.collection_name, r.block): r.slot for r in named}
    assert all(of[r.collection_name, r.block] == r.slot for r in named) and len(set(of.values())) == len(of)
    out = mixing.mix_collections(edge).collect()
    assert len(out) == len(EDGE) and all(r.slot is not None for r in out)
    assert mixing.mix_collections(empty).count() == 0


def test_slots_keep_to_weights(spark):
    weights = spark.createDataFrame([("a", 0.47), ("b", 0.31), (None, 0.2), ("d", 0.02)], "collection_name string, weight double")
    shares = mixing.whole_shares(weights, period=400)
    table = mixing.slot_table(shares).orderBy("slot_in_period").collect()
    share = {r.collection_name: r.share for r in shares.collect()}
    period = sum(share.values())
    assert [r.slot_in_period for r in table] == list(range(period))
    had = collections.Counter()
    for t, r in enumerate(table, 1):
        had[r.collection_name] += 1
        assert all(abs(had[k] - t * share[k] / period) < 1 for k in share)


def earliest_deadline_first(shares):
    """The key of every slot of a period, slot by slot."""
    period, done, out = sum(a for _, a in shares), [0] * len(shares), []
    for t in range(period):
        due = [(-(-(done[i] + 1) * period // a), i) for i, (_, a) in enumerate(shares) if done[i] * period < (t + 1) * a]
        i = min(due)[1]
        out.append(shares[i][0])
        done[i] += 1
    return out


@pytest.mark.parametrize("near", [2, 14])
def test_slots_equal_earliest_deadline_first(spark, monkeypatch, near):
    monkeypatch.setattr(mixing, "NEAR", near)
    shares = [(None, 31), ("a", 200), ("b", 1), *((f"c{i:02d}", 1 + i * i % 17) for i in range(30))]
    table = mixing.slot_table(spark.createDataFrame(shares, "collection_name string, share long")).orderBy("slot_in_period").collect()
    assert [r.collection_name for r in table] == earliest_deadline_first(shares)
    jobs = collections.defaultdict(list)
    for r in table:
        jobs[r.collection_name].append(r.job)
    assert all(j == list(range(len(j))) for j in jobs.values())


def test_a_thousand_collections(spark):
    weights = spark.range(1000).selectExpr("concat('c', id) AS collection_name", "1.0D / (1 + id) AS weight")
    shares = common.stored(mixing.whole_shares(weights))
    slots = mixing.slot_table(shares).withColumn("lag", F.col("slot_in_period") - F.col("job") * F.col("period") / F.col("share"))
    wide = F.col("period") / F.col("share")
    # released after the exact time less one slot, done before the next block's exact time
    row = slots.agg(F.countDistinct("slot_in_period").alias("n"), F.min("lag").alias("low"), F.max(F.col("lag") + 1 - wide).alias("late"))
    row = row.first()
    assert row.n == 100_000 and row.low > -1 and row.late < 1


# packing


def test_packing(spark, edge, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    docs = queries.watched(spark, SF).select("document_id", "text").union(edge.select(F.col("document_id") + 10_000, "text"))
    pieces = packing.token_pieces(docs, queries.vocabulary())
    rows = packing.pack_pieces(pieces, shard_rows=64).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.document_id].append(r)
    for d in docs.collect():
        mine = sorted(by[d.document_id], key=lambda r: r.piece)
        ids = np.frombuffer(b"".join(bytes(r.token_ids) for r in mine), "<u4").tolist()
        assert ids == tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]
        assert [r.start for r in mine] == [2048 * k for k in range(len(mine))]
        assert all(r.length == 2048 for r in mine[:-1])
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(bins) <= 1.05 * math.ceil(sum(r.length for r in rows) / 2048) + len(rows) / 64 + 1
    assert packing.pack_pieces(packing.token_pieces(empty, queries.vocabulary())).count() == 0


def test_local_search_empties_bins():
    lengths = [60, 60, 60, 40, 40, 20, 20]
    bins = [[0, 5], [1, 4], [2], [3, 6]]
    better = packing.improve(bins, lengths, 100)
    assert sorted(i for b in better for i in b) == list(range(7))
    assert len(better) == 3 and all(sum(lengths[i] for i in b) <= 100 for b in better)


def test_local_search_leaves_no_gain():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(30, 60, 200).tolist(), [1] * 90 + rng.integers(20, 99, 80).tolist(), [7] * 50, [100] * 3, []):
        better = packing.improve(packing.best_fit(lengths, 100), lengths, 100)
        assert sorted(i for b in better for i in b) == list(range(len(lengths)))
        fill = [sum(lengths[i] for i in b) for b in better]
        assert all(f <= 100 for f in fill)
        if len(better) == -(-sum(lengths) // 100):
            continue
        for x, donor in enumerate(better):
            single = [lengths[i] for i in donor]
            give = {*single, *(a + b for k, a in enumerate(single) for b in single[k + 1 :])}
            for y, other in enumerate(better):
                if x != y and fill[x] <= fill[y] < 100 and fill[x] < 100:
                    gains = {g - t for g in give for t in (0, *(lengths[i] for i in other))}
                    assert not any(0 < g <= 100 - fill[y] for g in gains)


# fingerprints


def test_fingerprints(spark, edge, empty):
    for t in ("abababab", "a", "aaaa", "", "日本日本日"):
        parts = [t[a:b] for a, b in zip([0, *fingerprints.phrase_ends(t)], fingerprints.phrase_ends(t))]
        assert "".join(parts) == t and len(set(parts[:-1])) == len(parts[:-1])
    h = fingerprints.phrase_hashes("abcabc")
    assert len(h) == len(fingerprints.phrase_ends("abcabc")) and h[0] != h[1]
    rows = {r.document_id: r for r in fingerprints.add_fingerprints(edge).collect()}
    assert rows[1].fingerprint == rows[2].fingerprint == "" and rows[5].fingerprint == rows[6].fingerprint != ""
    assert fingerprints.add_fingerprints(empty).count() == 0


def test_fingerprint_query(spark):
    got = {r.doc_id: r for r in queries.op1_fingerprints(spark, SF).collect()}
    docs = common.table(spark, SF, "documents").orderBy("doc_id").collect()
    import hashlib

    assert len(got) == len(docs)
    for k, d in enumerate(docs):
        t, after = d.text or "", docs[(k + 1) % len(docs)].text or ""
        half = len(t) // 2
        assert got[d.doc_id].n_chars == len(t)
        assert got[d.doc_id].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    mean = lambda c: sum(r[c] for r in got.values()) / len(got)
    assert mean("near_edited") > mean("near_next") + 0.2


def test_successor(spark, empty):
    ids = [5, 1, 9, 1_000_000, 3, 2, 70]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "no")], "document_id long, text string")
    for chunk in (1, 2, 100):
        got = {r.document_id: r.next_text for r in fingerprints.with_successor(df, "document_id", ["text"], chunk).collect()}
        order = sorted(ids)
        assert got == {**{a: f"t{b}" for a, b in zip(order, order[1:])}, 1_000_000: "no", None: "t1"}
    assert fingerprints.with_successor(empty, "document_id", ["text"]).count() == 0


def test_successor_keeps_every_row(spark):
    ids = [*range(3000), 2**40, *[7] * 5, *[None] * 400]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "document_id long, text string")
    for chunk in (16, 5000):
        rows = fingerprints.with_successor(df, "document_id", ["document_id", "text"], chunk).collect()
        assert sorted(r.text for r in rows) == sorted(r.next_text for r in rows) == sorted(f"t{k}" for k in range(len(ids)))
        # one ring through all rows, ascending, rows without an id last
        after = {r.text: r for r in rows}
        at, seen = "t0", []
        while len(seen) < len(rows):
            seen.append(after[at].document_id)
            at = after[at].next_text
        assert at == "t0" and seen == sorted(i for i in ids if i is not None) + [None] * 400
    starts = fingerprints._range_starts(df.where("document_id IS NOT NULL").selectExpr("document_id AS v"), 3006, 16)
    assert len(starts) > 150  # one far id leaves the ranges even


def test_fingerprints_of_null_and_repeated_ids(spark, tmp_path):
    rows = [(3, "abcdef"), (None, "xyz"), (None, None), (3, "abcdef"), (1, "hello there")]
    spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_fingerprints(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 0), (0, 3), (1, 11), (3, 6), (3, 6)]


def lz_set(text):
    seen, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    return seen


def test_likeness_is_that_of_the_phrase_sets(spark):
    got = queries.op1_fingerprints(spark, SF).orderBy("doc_id").collect()
    texts = [d.text or "" for d in common.table(spark, SF, "documents").orderBy("doc_id").collect()]
    off = []
    for k, r in enumerate(got):
        a, b = lz_set(texts[k]), lz_set(texts[(k + 1) % len(texts)])
        if len(a) > 200 and len(b) > 200:
            off.append(r.near_next - len(a & b) / len(a | b))
    # 128 minimum hashes: a standard error of 0.044 at most
    assert len(off) > 50 and abs(np.mean(off)) < 0.02 and np.max(np.abs(off)) < 0.2


# quality classifier


def test_quality_classifier(spark, edge, empty):
    rows = queries.op2_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in common.table(spark, "/root/testdata/sf0.01", "labels").collect()}
    out = [r for r in rows if r.doc_id in labels and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in out) / len(out) > 0.93
    w = quality_classifier.fit_quality(empty, spark.createDataFrame([], "document_id long, quality int"))
    scored = quality_classifier.score_quality(edge, w)
    assert scored.columns == [*edge.columns, "score", "predicted"] and scored.count() == len(EDGE)


# tool calls


def test_tool_calls(spark):
    schemas = {"find": {"limit": "integer", "name": "string?"}, "count": {}}
    calls = spark.createDataFrame(
        [
            ("i1", "a", "find", '{"name":"x","limit":3}', None),
            ("i1", "a", "find", '{"name":"x","limit":3}', None),
            ("i1", "b", "find", '{"limit":"3","odd":1}', "a"),
            ("i1", "c", "count", "not json", "b"),
            ("i1", "d", "drop", "{}", "gone"),
            ("i2", "a", "count", "{}", "b"),
            ("i2", "b", "count", "{}", "a"),
            (None, "z", "count", "{}", None),
        ],
        "incident_id string, call_id string, tool_name string, args string, after string",
    )
    results = spark.createDataFrame([("i1", "a", "ok"), ("i1", "q", "lost")], "incident_id string, call_id string, response string")
    rows = {(r.incident_id, r.call_id): r for r in tool_calls.link_tool_calls(calls, results, schemas).collect()}
    assert len(rows) == 8
    assert [rows["i1", k].depth for k in "abcd"] == [0, 1, 2, 0]
    assert rows["i2", "a"].depth is None  # a circle
    assert rows["i1", "a"].linked and rows["i1", "a"].valid and not rows["i1", "b"].linked
    assert rows["i1", "b"].errors == ["unexpected odd", "limit is not integer"]
    assert rows["i1", "c"].errors == ["arguments are no JSON object"] and rows["i1", "d"].errors == ["unknown tool"]
    assert rows["i1", "q"].errors == ["no call"] and not rows["i1", "q"].linked
    record = rows["i1", "a"].record
    assert record == json.dumps(json.loads(record), sort_keys=True, separators=(",", ":"))
    assert json.loads(record)["arguments"] == {"limit": 3, "name": "x"} and json.loads(record)["response"] == "ok"
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_call_depth_of_a_long_chain(spark):
    calls = spark.createDataFrame([("i", f"{k:04}", f"{k - 1:04}" if k else None) for k in range(100)], "incident_id string, call_id string, after string")
    assert {r.call_id: r.depth for r in tool_calls.call_depth(calls).collect()} == {f"{k:04}": k for k in range(100)}


# urls


def test_urls(spark):
    rules = queries.URL_RULES
    urls = [
        "http://www.EXAMPLE.org/es/5", "https://example.org/en/12#top", "https://a.org/x", "http://b.com/de/1?x", "https://c.net/p",
        "https://m.c.net/p/", "http://d.net/q", None, "no url", "http://com/fr/", "https://b.com/fr/9", "http://e.net", "https://notorg/x",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    links = spark.createDataFrame([("https://c.net/p", "http://b.com/de/7"), ("http://d.net/q", "http://b.com/de/7"), ("http://d.net/q", "https://a.org/y")], "a string, b string")
    alone = {r.page_id: r for r in url_filter.judge_urls(pages, rules).collect()}
    assert [alone[k].rule for k in range(13)] == ["example.org/es/", "example.org/en/1", "org/", "com/de/", None, None, None, None, None, "com/fr/", "com/fr/", None, None]
    assert alone[0].host == "www.example.org" and alone[0].path == "/es/5" and alone[7].host == alone[8].path == ""
    tied = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, rules, links.limit(1)).collect()}
    assert tied[4] == tied[5] == "block" and tied[6] == tied[7] == "allow"
    both = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, rules, links).collect()}
    assert both[4] == both[6] == "allow" and both[3] == "block"  # an allowed alias comes first, an own rule before it
    html = spark.createDataFrame(
        [("http://s.net/a", '<link href="/b" rel="canonical">'), ("http://s.net/c", "<meta http-equiv='refresh' content='0;url=https://t.net/d'>"), ("http://s.net/e", None)],
        "url string, html string",
    )
    found = {(r.a, r.b) for r in url_filter.declared_links(html).collect()}
    assert found == {("http://s.net/a", "http://s.net/b"), ("http://s.net/c", "https://t.net/d")}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_links_in_any_spelling(spark):
    page = "https://s.net/x/y/a.html?q=1"
    cases = {
        '<LINK REL="CANONICAL" HREF="/b">': "https://s.net/b",
        "<link href=d.html rel=canonical>": "https://s.net/x/y/d.html",
        "<META HTTP-EQUIV='Refresh' CONTENT=\"0; URL='../z/./e'\">": "https://s.net/x/z/e",
        '<link rel="alternate canonical" href="../../../up/..">': "https://s.net/",
        '<link rel="canonical" href="//T.net/p?a=1&amp;b=2">': "https://T.net/p?a=1&b=2",
        '<link rel="canonical" href="?q=2">': "https://s.net/x/y/a.html?q=2",
        '<link rel="canonical" href="#top">': None,
        '<link rel="canonical" href="mailto:me@s.net">': None,
        '<link rel="stylesheet" href="canonical.css">': None,
        '<meta http-equiv="content-type" content="text/html; url=/no">': None,
        '<link rel="canonical">': None,
    }
    rows = [(page, h) for h in cases] + [(page, '<link rel=stylesheet href=s.css>\n<link rel=canonical href=/1><link rel="canonical" href="/2">')]
    rows += [(None, '<link rel="canonical" href="/b">'), ("no url", '<link rel="canonical" href="b">'), ("http://r.net", '<link rel="canonical" href="b">')]
    pages = spark.createDataFrame(rows, "url string, html string")
    want = [(page, b) for b in cases.values() if b] + [(page, "https://s.net/1"), (page, "https://s.net/2"), ("http://r.net", "http://r.net/b")]
    assert sorted((r.a, r.b) for r in url_filter.declared_links(pages).collect()) == sorted(want)


def test_url_columns_of_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://b.com/de/1", "mine", "r", "id")], "page_id long, url string, host string, rule string, id string")
    row = url_filter.judge_urls(pages, queries.URL_RULES).first()
    assert (row.host, row.rule, row.verdict, row.id) == ("b.com", "com/de/", "block", "id")


# context mixing


def test_context_mixing(spark, edge, empty):
    rows = {r.doc_id: r for r in queries.op4_context_mixing(spark, SF).collect()}
    docs = {r.doc_id: lower(r.text) + ["\n"] for r in common.table(spark, SF, "documents").collect()}
    train = collections.Counter(w for i, t in docs.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    total = sum(train.values())
    norm = math.log10(total + 0.1 * (len(train) + 1))
    for i, t in docs.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in train for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10(train[w] + 0.1) - norm for w in t), rel=1e-9)
    out = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    scored = context_mixing.score_texts(edge.withColumn("train", F.lit(False))).collect()
    assert len(scored) == len(EDGE) and all(r.n_known == 0 and math.isfinite(r.score) for r in scored)
    assert context_mixing.score_texts(empty.withColumn("train", F.lit(True))).count() == 0


def test_bit_probabilities_sum_to_one():
    tables = tuple(np.random.default_rng(3).normal(size=s).astype(np.float32) for s in (4096, 65536, 4096, 4096))
    model = context_mixing.ContextModel({}, np.zeros(0), np.arange(256), np.zeros(256), tables, 4096, 0, 0.0)
    score = context_mixing.Scorer(model)
    start = np.array([3, 9], np.int64)
    every = [np.append(start, c) for c in range(256)]
    same = np.arange(256)
    first = score(context_mixing._coded([start], same))[0]
    whole = score(context_mixing._coded(every, same))
    assert sum(10 ** (whole - first)) == pytest.approx(1, abs=1e-3)


def test_long_texts_are_mixed_as_a_whole(spark, monkeypatch):
    texts = [("a b c d e f g " * 900, False), ("x y z " * 1500, False), ("a b", False), (None, False), ("b c d x " * 50, True)]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "document_id int, text string, train boolean")
    scores = []
    for slice_, long in ((1 << 22, 8192), (50, 8192), (1 << 22, 1)):
        monkeypatch.setattr(context_mixing, "SLICE", slice_)
        monkeypatch.setattr(context_mixing, "LONG", long)
        scores.append([r.score for r in context_mixing.score_texts(docs).orderBy("document_id").collect()])
    assert scores[0] == pytest.approx(scores[2], rel=1e-9) and scores[1] == pytest.approx(scores[2], rel=1e-9)


def test_context_mixing_cuts_few_texts_at_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"one two{i % 7} three " * (20 + i % 30), i % 3 > 0) for i in range(200)], "document_id long, text string, train boolean").coalesce(1)
    want = [tuple(r) for r in context_mixing.score_texts(docs).orderBy("document_id").collect()]
    cut = context_mixing._tokens

    def few(texts):
        assert len(texts) == 1 or sum(len(t) + 1 for t in texts.to_pylist()) <= 5_001
        return cut(texts)

    monkeypatch.setattr(context_mixing, "_tokens", few)
    monkeypatch.setattr(context_mixing, "PIECE", 5_000, raising=False)
    got = [tuple(r) for r in context_mixing.score_texts(docs).orderBy("document_id").collect()]
    assert got == want


def test_packing_leaves_large_ids_beside_nulls_alone(spark):
    ids = [2**60 + 1, 2**60 + 3, None, None, -5]
    df = spark.createDataFrame([(i, 0, 10, n) for n, i in enumerate(ids)], "document_id long, piece int, length int, mark int")
    rows = packing.pack_pieces(df, capacity=25).orderBy("mark").collect()
    assert [r.document_id for r in rows] == ids
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r.offset)
    assert sorted(map(sorted, by.values())) == [[0], [0, 10], [0, 10]]


def test_rows_with_equal_or_null_ids_are_scored_apart(spark):
    rows = [(None, "a b c", True), (None, "b", False), (7, "a b c", False), (7, "z z", True), (8, None, False)]
    docs = spark.createDataFrame(rows, "document_id int, text string, train boolean")
    got = sorted((r.document_id or 0, r.n_tokens) for r in context_mixing.score_texts(docs).collect())
    assert got == [(0, 2), (0, 4), (7, 3), (7, 4), (8, 1)]


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stored(stage(spark, now, SF))
        assert after.columns == docs.columns and after.select("doc_id").distinct().count() == after.count()
        if name == "quality_rules":
            want = {r.doc_id for r in quality_rules.apply_quality_rules(docs).where("kept").collect()}
            assert {r.doc_id for r in after.collect()} == want
        if name == "near_duplicates":
            groups = brute_groups({r.doc_id: r.text for r in now.collect()}, 5)
            assert {r.doc_id for r in after.collect()} == {i for i, (_, c) in groups.items() if i == c}
        if name == "mixing":
            assert after.count() == now.count()
        now = after
    rows = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in now.collect()}


def test_pipeline_keeps_documents_without_id(spark):
    import corpus_pipeline

    some = common.table(spark, SF, "documents").limit(40)
    docs = common.stored(some.unionByName(some.limit(3).withColumn("doc_id", F.lit(None).cast(some.schema["doc_id"].dataType))))
    stages = dict(corpus_pipeline.STAGES)
    after = common.stored(stages["near_duplicates"](spark, docs, SF))
    unnamed = sorted(r.text for r in docs.where("doc_id IS NULL").collect())
    assert len(unnamed) == 3 and sorted(r.text for r in after.where("doc_id IS NULL").collect()) == unnamed
    placed = stages["packing"](spark, common.stored(stages["mixing"](spark, after, SF)), SF)
    assert placed.where("doc_id IS NULL AND piece = 0").count() == 3


def test_pipeline_sequences_keep_to_weights(spark):
    import corpus_pipeline

    # sizes 4 : 1 : 1, so weights 2 : 1 : 1 until the small sources run out after two thirds
    source = F.expr("CASE id % 6 WHEN 0 THEN 'b' WHEN 1 THEN 'c' ELSE 'a' END")
    text = F.expr("concat(repeat('some words of a text ', 28), id)")
    docs = spark.range(18_000).select(F.col("id").alias("doc_id"), text.alias("text"), source.alias("source"))
    stages = dict(corpus_pipeline.STAGES)
    mixed = common.stored(stages["mixing"](spark, docs, SF))
    placed = stages["packing"](spark, mixed, SF)
    assert set(placed.columns) == {"doc_id", "piece", "start", "length", "sequence_id", "offset"}
    sums = placed.join(docs, "doc_id").groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).orderBy("sequence_id").collect()
    total, had, checked = sum(r.n for r in sums), collections.Counter(), 0
    for k, r in enumerate(sums):
        had[r.source] += r.n
        done = sum(had.values())
        if 0.1 * total < done < 0.6 * total and sums[k + 1].sequence_id != r.sequence_id:
            checked += 1
            assert abs(had["a"] / done - 0.5) < 0.05 and abs(had["b"] / done - 0.25) < 0.05
    assert checked > 100
    again = stages["packing"](spark, docs.repartition(7), SF)
    assert sorted(again.collect()) == sorted(placed.collect())


def test_packing_in_order(spark):
    rows = [(i % 5, i, None if i % 7 == 6 else i % 7 * 3, 10 + i % 90) for i in range(2000)]
    pieces = spark.createDataFrame(rows, "piece int, document_id long, place long, length long")
    got = packing.pack_pieces(pieces, shard_rows=200, capacity=100, order="place").collect()
    assert sorted((r.piece, r.document_id, r.place, r.length) for r in got if r.place is not None) == sorted(r for r in rows if r[2] is not None)
    assert len(got) == 2000
    spans = collections.defaultdict(list)
    for r in got:
        spans[r.sequence_id >> 32].append(99 if r.place is None else r.place)
    ranges = [spans[k] for k in sorted(spans)]
    assert len(ranges) == 10 and all(max(a) <= min(b) for a, b in zip(ranges, ranges[1:]))
    assert max(map(len, ranges)) < 300
    assert packing.pack_pieces(pieces.limit(0), order="place").count() == 0


def test_bitmap_keeps_every_id(spark):
    rows = spark.range(-3000, 3000).selectExpr("id", "'t' AS text").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS id, 't' AS text"))
    ids = spark.range(0, 500)
    inside = common.perhaps_in(rows, common.marks(ids))
    outside = common.perhaps_in(rows, common.marks(ids), how="left_anti")
    assert {r["id"] for r in ids.collect()} <= {r["id"] for r in inside.collect()}
    assert inside.count() + outside.count() == 6001 and inside.count() < 600
    assert common.perhaps_in(rows, common.marks(ids.limit(0))).count() == 0


def test_near_duplicates_make_no_pairs_inside_a_group(spark, monkeypatch):
    """Thirty near copies are linked through pivots; no pair of a group is made once it is known."""
    rows = [(i, " ".join([f"w{j}" for j in range(200)] + [f"own{i}"])) for i in range(30)]
    seen, across = [], near_duplicates._across

    def counted(pairs, *more):
        left = across(pairs, *more)
        seen.append((pairs.select("a", "b").distinct().count(), left.count()))
        return left

    monkeypatch.setattr(near_duplicates, "_across", counted)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "document_id long, text string"), width=2).collect()
    assert {r["component_id"] for r in got} == {0}
    assert seen[0][0] < 30 * 29 // 4 and seen[0][1] == 0
