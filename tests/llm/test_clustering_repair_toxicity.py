"""Centroid clustering, conversation repair and toxicity against brute force, DuckDB and held-out labels."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plantpulse.llm import centroid_clustering as cc, conversation_repair as cr, toxicity as tx
from plantpulse.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


# -- op11 ------------------------------------------------------------------

def lloyd(ids, vectors, k=8, rounds=10):
    x = [[int(np.floor(1024 * float(np.float32(e)))) for e in v] for v in vectors]
    first = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"3:{ids[i]}".encode()).hexdigest(), x[i]))[:k]
    c = [x[i] for i in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), i) for i, m in enumerate(c))[::-1]

    for _ in range(rounds):
        own = [near(v)[0] for v in x]
        c = [[sum(col) // len(col) for col in zip(*[v for v, o in zip(x, own, strict=True) if o == i], strict=True)] if i in own else m
             for i, m in enumerate(c)]
    return c, [near(v) for v in x]


def test_clusters_against_plain_rounds_with_unusable_vectors(spark):
    rnd = random.Random(4)
    good = [[rnd.gauss(g % 3, 0.3) for _ in range(64)] for g in range(60)]
    good += [good[0], good[0], [0.0] * 64, [1e30] + [0.0] * 63]  # repeated rows, a constant one, one beyond the clamp
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] * 64]
    rows = [(i, v, i, "own") for i, v in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, cluster string")
    found, centroids = cc.cluster(df)
    clamped = [[max(-2.0 ** 16, min(2.0 ** 16, e)) for e in v] for v in good]
    want, near = lloyd(range(len(good)), clamped)
    assert centroids == want
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in found.collect()} == dict(enumerate(near))
    few, c = cc.cluster(df.limit(3))
    assert len(c) == 3 and {r["distance"] for r in few.collect()} == {0}
    none, c = cc.cluster(df.limit(0))
    assert none.count() == 0 and c == []


def test_intervals_hold_every_vector_and_certain_cells_are_right():
    rng = np.random.default_rng(3)
    x = rng.integers(-600, 600, (500, 7))
    edges = cc.cell_edges(np.array([(c.min(), c.max(), c.mean(), c.std()) for c in x.T]), bits=5)
    cells, centroids = cc.to_cells(x, edges), rng.integers(-400, 400, (5, 7)).tolist()
    least, most = cc.interval_tables(edges, centroids)
    m = np.array(centroids).sum(axis=0) // 5
    for j, c in enumerate(centroids):
        exact = ((x - np.array(c)) ** 2 - (x - m) ** 2)
        for d in range(7):
            assert (least[d][cells[:, d], j] <= exact[:, d]).all() and (exact[:, d] <= most[d][cells[:, d], j]).all()
    placed, true = cc.place(cells, (least, most)), cc.nearest(x, centroids)[0]
    assert (placed >= 0).any() and (placed < 0).any() and (placed[placed >= 0] == true[placed >= 0]).all()
    assert (cc.assign(x, cells, (least, most), centroids) == true).all()


def test_rounds_fetch_only_open_vectors(spark):
    rnd = random.Random(8)
    rows = [(i, [rnd.gauss(5 * (i % 8), 0.2) for _ in range(64)]) for i in range(800)]
    va = cc.VaFile(cc.kept_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")))
    old = [[5 * 1024 * g] * 64 for g in range(7)] + [[5 * 1024 * 6 + 9] * 64]  # one group is not met, one is shared
    new = [[s // t[-1] for s in t[:-1]] if t[-1] else c for t, c in zip(va.totals(old), old, strict=True)]
    assert 100 <= va.undecided(old, new).count() <= 200
    assert [[a + b for a, b in zip(t, m, strict=True)] for t, m in zip(va.totals(old), va.moved(old, new), strict=True)] == va.totals(new)
    plan = va.undecided(old, new)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<at:bigint,cells:binary>" in plan


def test_clusters_against_duckdb(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    rel = con.sql(ORACLE_SQL["op11_centroid_clustering"])
    got = QUERIES["op11_centroid_clustering"](spark, SF).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())


# -- op12 ------------------------------------------------------------------

def cheapest(codes):
    """Dijkstra over (cost, edits so far)."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        c, a, i, s = heapq.heappop(heap)
        if i > len(codes):
            return c, a
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(codes) and s in (0, 3):
            heapq.heappush(heap, (c, a, i + 1, 0))
        for r, t in cr.STEPS[s].items():
            if r in "ua":
                heapq.heappush(heap, (c + 5, a + "I", i, t))
        if i < len(codes):
            heapq.heappush(heap, (c + 2, a + "D", i + 1, s))
            code = codes[i]
            if code != "-":
                more = 5 if code.isupper() else 0
                for r, t in cr.STEPS[s].items():
                    if r == code.lower():
                        heapq.heappush(heap, (c + more, a + "K", i + 1, t))
                    if r in "ua":
                        heapq.heappush(heap, (c + more + 1, a + "R", i + 1, t))


@pytest.mark.parametrize("block", [1, 2, 3, 32])
def test_auction_against_dijkstra(block):
    rnd, repairer = random.Random(block), cr.Repairer(block)
    for _ in range(1500):
        codes = "".join(rnd.choice("-suaxSUAXuaua") for _ in range(rnd.randrange(12)))
        assert repairer.repair(codes) == cheapest(codes), codes


def test_prices_are_dual_feasible_and_long_lattices_stay_linear():
    rnd = random.Random(5)
    codes = "".join(rnd.choice("-suaxSUAuaua") for _ in range(40))
    arcs = cr.lattice(codes, None)
    prices = [0] * (len(arcs) + 1)
    cr.auction(arcs, 0, prices)
    assert all(prices[i] <= c + prices[j] for i, out in enumerate(arcs) for c, j, _ in out)
    assert prices[0] == cheapest(codes)[0]
    long = "".join(rnd.choice("-suauauaUA") for _ in range(20_000))
    cost, audit = cr.Repairer().repair(long)
    assert cost > 0 and sum(e != "I" for e in audit) == len(long)


def plain_repair(rows):
    """The whole contract for one conversation's damaged (turn, role, text) rows, in order."""
    blank = " \t\n\x0b\x0c\r"
    seen, codes, n = [], "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = [c for c in text if c not in blank]
        code = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if not body:
            n["blank"] += 1
            code = "-"
        elif (role, text) in seen:
            n["duplicate"] += 1
            code = "-"
        elif body[-1] not in ".!?":
            n["truncated"] += 1
            code = code.upper()
        seen.append((role, text))
        codes += code
    turns = {t for t, _, _ in rows if t is not None}
    starts = [r[:1] for _, r, _ in rows]
    cost, audit = cheapest(codes)
    kept, state, left = [], "", list(rows)
    for e in audit:
        need = "a" if state == "u" else "u"
        if e == "I":
            kept.append({"a": "assistant", "u": "user"}[need] + ":")
            state = need
            continue
        _, role, text = left.pop(0)
        if e != "D":
            role = {"a": "assistant", "u": "user"}[need] if e == "R" else role
            kept.append(f"{role}:{text}")
            state = role[0]
    assert re.fullmatch("(s?(ua)+)?", "".join(k[0] for k in kept))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(kept).encode()).hexdigest())


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: plain_repair(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))) for c, r in out.items()}


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_conversations_against_plain_repair(spark):
    rnd = random.Random(6)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["Hi.", "Yes!  ", "cut off", "", " \t\n", None, "Ä?", "x" * 5000 + "."]
    rows = [(c if c else None, rnd.choice([None, t, t, t, t // 2, 3 * t]), rnd.choice(roles), rnd.choice(texts))
            for c in range(60) for t in range(rnd.randrange(1, 14))]
    rows += [(100, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(300)] + rows[:5]
    rows += [(200 + i, 0, "user", "x") for i in range(25)]  # some have no row left
    df = spark.createDataFrame([(*r, 1, "own") for r in rows], "conv_id bigint, turn bigint, role string, text string, present int, audit string")
    got = cr.repair_conversations(cr.damaged(df), with_texts=False).collect()
    want = plain_damage(rows)
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want and len(got) == len(want)
    assert any(w[6] == "" and w[7] == hashlib.sha256(b"").hexdigest() for w in want.values())
    whole = {r["conv_id"]: r["repaired"] for r in cr.repair_conversations(cr.damaged(df)).collect()}
    assert {c: hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in rs).encode()).hexdigest() for c, rs in whole.items()} \
        == {c: w[7] for c, w in want.items()}
    assert cr.repair_conversations(cr.damaged(df.limit(0))).count() == 0


def test_conversation_query_against_plain_repair(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_conversation_repair"](spark, SF).collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == plain_damage(rows)


# -- op13 ------------------------------------------------------------------

def arrays(texts):
    b = [t.lower().encode() for t in texts]
    return np.frombuffer(b"".join(b), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in b])]).astype(np.int64)


def test_feature_sets_against_plain_words():
    texts = ["", "...", "One two, two THREE four five", "aa bb", "aa bb", "l'été d'un", "abcdefgh abcdefxx abcde"]
    r, b = tx.rows_of_buckets(*arrays(texts), bits=24)

    def plain(text):
        words = [w for w in re.findall(rb"[0-9a-z'\x80-\xff]+", text.lower().encode())]
        return {("w", w) for w in words} | {(k, w[:k]) for k in tx.STEMS for w in words} | {
            (g, a, c) for g in tx.PAIRS for a, c in zip(words, words[g:], strict=False)}

    names = {}
    for i, t in enumerate(texts):
        own = set(b[r == i].tolist())
        assert len(own) == len(plain(t)), t
        names[i] = own
    assert names[3] == names[4] and len(names[6] & names[6]) == len(names[6])


def test_long_texts_have_the_features_of_short_ones(monkeypatch):
    rnd = random.Random(9)
    text = " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9))) for _ in range(3000))
    whole = tx.rows_of_buckets(*arrays(["x", text, "y z"]), bits=20)
    monkeypatch.setattr(tx, "SLICE", 1000)
    monkeypatch.setattr(tx, "BLOCK", 64)
    cut = tx.rows_of_buckets(*arrays(["x", text, "y z"]), bits=20)
    assert all((a == c).all() for a, c in zip(whole, cut, strict=True))


def test_ftrl_against_the_plain_rule():
    rng = np.random.default_rng(2)
    rows = [np.append(np.unique(rng.integers(0, 30, 6)), 30) for _ in range(80)]
    y, weight = rng.integers(0, 2, 80).astype(float), rng.uniform(1, 3, 80)
    got = tx.ftrl(rows, y, weight, 30, epochs=2, alpha=0.5, beta=1.0, l1=0.7, l2=0.1)
    z, n = [0.0] * 31, [0.0] * 31

    def w(i):
        bound = 0.0 if i == 30 else 0.7
        if abs(z[i]) <= bound:
            return 0.0
        return -(z[i] - (bound if z[i] > 0 else -bound)) / ((1.0 + n[i] ** 0.5) / 0.5 + 0.1)

    order = np.random.default_rng(11)
    for _ in range(2):
        for j in order.permutation(80):
            own = rows[j].tolist()
            ws = [w(i) for i in own]
            g = weight[j] * (1 / (1 + np.exp(-sum(ws))) - y[j])
            for i, wi in zip(own, ws, strict=True):
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5
                z[i] += g - sigma * wi
                n[i] += g * g
    assert np.allclose(got, [w(i) for i in range(31)]) and (got[:-1] == 0).any()


def labelled(spark, n=400):
    rnd = random.Random(3)
    words = ["tree", "house", "river", "cloud", "paper", "stone", "light", "green"]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(5, 200)))
        toxic = i % 5 == 0
        docs.append((i, text + (" You IDIOT!" if toxic else "."), "own"))
        labels.append((i, 1, int(toxic)))
    labels += [(1, 1, 1), (None, 1, 1), (2, 1, None), (9999, 1, 1)]  # a clash, no id, no label, no text
    docs += [(None, None, "own"), (5001, "", "own"), (5002, "... !!", "own"), (5003, "green idiot paper", "own"), (5003, "green paper", "own"),
             (5004, "stone " * 300_000 + "idiot", "own")]
    return (spark.createDataFrame(docs, "doc_id bigint, text string, score string"),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_toxicity_learns_and_scores_edge_rows(spark):
    docs, labels = labelled(spark)
    sample = tx.fit_sample(docs, labels)
    used = {r["text"] for r in sample.collect()}
    assert not used & {r["text"] for r in docs.where(tx.held_out() | (F.col("doc_id") == 1)).collect()}
    assert tx.fit_sample(docs, labels, max_docs=20).count() <= 20
    model = tx.fit(sample)
    assert 0 < len(model[0]) < 500
    got = tx.score(docs, model).collect()
    assert len(got) == docs.count() and got[0].asDict().keys() == {"doc_id", "text", "score", "predicted"}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["predicted"] == int("idiot" in (r["text"] or "").lower()), r["doc_id"]
    plain = 1 / (1 + np.exp(-model[2]))
    assert all(abs(r["score"] - plain) < 1e-12 for r in got if not re.search("[a-z]", r["text"] or ""))
    none = tx.fit(tx.fit_sample(docs, labels.limit(0)))
    assert {r["score"] for r in tx.score(docs, none).collect()} == {0.5}
    one = tx.fit(tx.fit_sample(docs, labels.where("toxic = 0")))
    assert len({r["score"] for r in tx.score(docs, one).collect()}) == 1
    assert tx.score(docs.limit(0), model).count() == 0


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op13_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id") \
        .groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r["toxic"]: r["p"] for r in got}
    assert share[1] > 0.8 and share[0] < 0.01
