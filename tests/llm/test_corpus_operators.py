"""The corpus operators against brute force, the tokenizers' own libraries, DuckDB and held-out labels."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import struct
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from plantpulse.llm import bpe, fingerprints, language_id, line_dedup, minhash, packing, quality_classifier, quality_rules, token_counts, url_filters
from plantpulse.llm.graph import connected_components
from plantpulse.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: Nulls, empty and blank texts, ties, repeated rows, a long text, special strings, other scripts.
TEXTS = [None, "", "   \n\t", "a", "one two three four", "one two three four", "x" * 5000, "word " * 4000,
         "l'été d'Ängström's we've <|endoftext|> 123 ４５ 漢字　\x85 end  ", "\n\n  tab\tand \x0b feed\x1c!!", "😀 ՘ ²¾ 's 'S're"]


def frame(spark, texts=None, extra=True):
    rows = [(None if i == 0 else min(i, 9), t, None, None, None) for i, t in enumerate(TEXTS if texts is None else texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    names = ("score", "kept", "n_tokens", "n_lines", "hashes", "verdict", "bytes") if extra else ()
    return df.withColumns({n: F.lit("own") for n in names})


@pytest.mark.parametrize("texts", [None, []])
def test_edge_rows_give_a_row_each(spark, texts):
    docs = frame(spark, texts)
    n = docs.count()
    model = language_id.fit(docs, F.col("text"), F.lit("en"))
    got = language_id.identify(docs, model).collect()
    assert len(got) == n and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if not (r["text"] or "").strip())
    nothing = quality_classifier.fit(docs.limit(0).select("text", F.lit(1).alias("label"), F.lit(1).alias("order")))
    assert all(r["score"] == 0.5 for r in quality_classifier.score(docs, nothing).collect())
    assert quality_rules.quality_rules(docs).count() == n
    done = line_dedup.dedup_lines(docs).collect()
    assert len(done) == n and all(r["source"] is None for r in done)
    assert len(minhash.near_duplicates(docs).collect()) == n
    assert len({(r["doc_id"], r["piece"]) for r in packing.pack(docs, packing.n_words(F.col("text"))).collect()}) >= min(n, 10)
    assert fingerprints.fingerprint(docs).count() == n
    near = fingerprints.with_next(docs.select("doc_id", "text"))
    assert near.where("not guest").count() == n
    assert token_counts.token_counts(docs, P.path("byte_bpe_50k.json")).count() == n
    coded = bpe.encode(docs, P.path(bpe.VOCABULARY))
    assert [r["bytes"] for r in bpe.decode(coded, P.path(bpe.VOCABULARY)).collect()] == [(r["text"] or "").encode() for r in coded.collect()]


def test_every_pipeline_stage_takes_edge_rows(spark):
    for texts in (None, []):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = frame(spark, texts)
            assert stage(spark, docs, SF).columns == docs.columns


def test_pipeline_stages_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(900_000, "12345 67890 !!", "en", "s", 14)], docs.schema)
    base = " ".join(f"w{i}ord" for i in range(120))
    near = spark.createDataFrame([(900_001, base, "en", "s", 0), (900_002, base + " tail", "en", "s", 0)], docs.schema)
    docs = docs.union(junk).union(near)
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    assert ids(docs) - ids(corpus_pipeline.language_id(spark, docs, SF)) == {900_000}
    kept = ids(corpus_pipeline.quality(spark, docs, SF))
    assert kept == {r["doc_id"] for r in quality_rules.quality_rules(docs).collect() if r["kept"]}
    left = ids(corpus_pipeline.near_dedup(spark, docs, SF))
    near = minhash.near_duplicates(docs.select("doc_id", "text"), corpus_pipeline.NEAR_PERCENT).collect()
    assert left == {r["component_id"] for r in near} and 900_002 not in left
    packed = corpus_pipeline.packing(spark, docs, SF)
    assert ids(packed) == ids(docs)


def test_components_against_union_find(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(90)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = connected_components(spark.createDataFrame(edges + [(None, 1)], "u bigint, v bigint")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in parent}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_banded_distance_against_the_full_table():
    rnd = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randrange(9))) for _ in range(2))
        for k in range(4):
            assert line_dedup.within(a, b, k) == (distance(a, b) <= k)


@pytest.mark.parametrize("k,group_pairs", [(1, 4096), (1, 4), (2, 4)])
def test_near_lines_against_all_pairs(spark, monkeypatch, k, group_pairs):
    monkeypatch.setattr(line_dedup, "GROUP_PAIRS", group_pairs)
    rnd = random.Random(k)
    lines = {f"the common template of line {i:03d} with a common end" for i in range(40)}
    for x in list(lines)[:25]:
        p = rnd.randrange(len(x))
        lines |= {x[:p] + x[p + 1:], x[:p] + "q" + x[p:], x[:p] + "é" + x[p + 1:]}
    lines |= {"".join(rnd.choice("abc") for _ in range(rnd.randrange(20, 24))) for _ in range(60)}
    lines = sorted(lines)
    docs = spark.createDataFrame([("\n".join(lines[i::7]),) for i in range(7)], "text string")
    got = {(r["u"], r["v"]) for r in line_dedup.near_lines(docs, k).collect()}
    ids = {x: line_dedup.line_id(x) for x in lines}
    want = {tuple(sorted((ids[a], ids[b]))) for a, b in itertools.combinations(lines, 2)
            if abs(len(a) - len(b)) <= k and distance(a, b) <= k}
    assert got == want and want


@pytest.mark.parametrize("group_pairs,stars", [(4096, False), (4096, True), (6, True)])
def test_near_lines_with_edits_by_length(spark, monkeypatch, group_pairs, stars):
    monkeypatch.setattr(line_dedup, "GROUP_PAIRS", group_pairs)
    rnd = random.Random(group_pairs)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 9)))
    lines = {"abababab" * 14, "abababab" * 13 + "abaab", "ab" * 54 + "xy", "a" * 100, "a" * 104, "b" + "a" * 101}  # segments that repeat
    for n in (20, 39, 40, 61, 85, 100, 101, 150):
        base = (" ".join(word() for _ in range(40)))[:n]
        lines.add(base)
        for _ in range(14):
            x = base
            for _ in range(rnd.randrange(1, 8)):
                p = rnd.randrange(len(x))
                x = rnd.choice([x[:p] + x[p + 1:], x[:p] + rnd.choice("abq") + x[p:], x[:p] + "z" + x[p + 1:]])
            lines.add(x)
    lines |= {f"a template of somewhat more than a hundred characters with one short number {i} in it, and an end to it all" for i in range(0, 60_000, 1_700)}
    lines = sorted(lines)
    docs = spark.createDataFrame([("\n".join(lines[i::5]),) for i in range(5)], "text string")
    got = {(r["u"], r["v"]) for r in line_dedup.near_lines(docs, 5, 20, 20, stars).collect()}
    ids = {x: line_dedup.line_id(x) for x in lines}
    want = {tuple(sorted((ids[a], ids[b]))) for a, b in itertools.combinations(lines, 2) if min(len(a), len(b)) >= 20
            and line_dedup.within(a, b, min(5, max(1, min(len(a), len(b)) // 20)))}  # held against the full table above

    def classes(links):
        least = {x: x for x in ids.values()}
        for _ in ids:
            for u, v in links:
                least[u] = least[v] = min(least[u], least[v])
        return least

    assert want and (got <= want and classes(got) == classes(want) if stars else got == want)


def test_line_dedup_drops_lines_with_a_word_replaced(spark):
    base = "the first of these lines is long enough that one of its words may well be another one without making it a new line"
    other = base.replace("long", "wide")
    docs = spark.createDataFrame([(1, base), (2, other), (3, base.replace("may well", "may")), (4, base.replace("long enough", "of another kind"))], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_near"] for r in line_dedup.dedup_lines(docs).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}


def test_line_dedup_keeps_first_lines(spark):
    same, near = "a line that stands in several documents", "a line that stands in several documentz"
    docs = spark.createDataFrame([(3, f"{same}\nown three"), (1, f"own one\n{same}\n\n{same}"), (2, f"{near}\n\nown two")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["n_near"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: (f"own one\n{same}\n", 1, 0), 2: ("\nown two", 1, 1), 3: ("own three", 1, 0)}


def test_pipeline_drops_near_copies_from_four_fifths_on(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i, gone in enumerate((6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 20)):
        rows.append((1 + i, " ".join(base[:60 - gone] + [f"z{i}_{j}" for j in range(2)])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    alike = lambda a, b, p: 100 * len(a & b) >= p * len(a | b)
    reach = {0}
    for _ in rows:
        reach |= {j for j in range(len(rows)) if any(alike(sets[i], sets[j], 80) for i in reach)}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).select("doc_id").collect()} == {i for i in range(len(rows)) if i not in reach - {0}}
    pair = docs.where("doc_id in (0, 3)")
    assert 0.80 <= len(sets[0] & sets[3]) / len(sets[0] | sets[3]) < 0.85
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, pair, SF).select("doc_id").collect()} == {0}
    assert (minhash.bands_for(85), minhash.bands_for(80)) == (25, 37)


def test_near_cloud_against_all_pairs(spark):
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(90):  # copies from almost equal to barely alike
        w = list(base)
        for _ in range(rnd.randrange(7)):
            w[rnd.randrange(60)] = f"x{rnd.randrange(40)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [{tuple(t.split()[i:i + 5]) for i in range(56)} for t in texts]
    comp = list(range(90))
    for a, b in itertools.combinations(range(90), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            lo, hi = sorted((comp[a], comp[b]))
            comp = [lo if c == hi else c for c in comp]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == dict(enumerate(comp)) and 1 < len(set(comp)) < 90


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    place = [[c[0] for c in want.description].index(c) for c in columns]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())


def test_url_decisions_follow_links(spark):
    html = '<html><head><link rel="canonical" href="{}"></head></html>'
    pages = spark.createDataFrame([
        (1, "http://x.net/es/a", None), (2, "http://other.org/p", html.format("http://x.net/es/a")),
        (3, "https://other.org/p/#top", None), (4, "http://ok.com/q", html.format("http://x.net/es/a")),
        (5, "http://free.org/", None), (6, None, "x"), (7, "no scheme", None), (8, "http://other.org/p", None)], "page_id bigint, url string, html string")
    rules = url_filters.rules_frame(spark, url_filters.RULES)
    for standing, third in ((True, "block"), (False, "allow")):  # page 3 differs by scheme and slash from page 2
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.url_filters(pages, rules, standing=standing).collect()}
        assert got == {1: ("net/es/", "block"), 2: (None, "block"), 3: (None, third), 4: ("com/", "allow"),
                       5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "block")}


def test_a_slash_alone_links_no_pages(spark, tmp_path):
    rows = [(1, "http://x.net/es/"), (2, "http://x.net/es"), (3, "https://x.net/es/"), (4, "http://x.net:80/es#a"), (5, "HTTP://X.net/es")]
    spark.createDataFrame([(i, u, None) for i, u in rows], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.op3_url_filters(spark, str(tmp_path)).collect()}
    assert got == {1: ("net/es/", "block"), 2: (None, "allow"), 3: ("net/es/", "block"), 4: (None, "allow"), 5: (None, "allow")}


def test_boundaries_are_optimal():
    rnd = random.Random(3)
    for _ in range(30):
        h = {x: rnd.randrange(1, 9) for x in rnd.sample(range(1, 30), 9)}
        cost = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in h.items())
        best = min(cost([*c, max(h)]) for c in itertools.combinations(sorted(h)[:-1], 2))
        got = packing.optimal_boundaries(h, 3)
        assert len(got) == 3 and cost(got) == best


def test_batches_fit_the_budget(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.op7_packing(spark, SF).collect()
    lengths = {r[0]: r[1] for r in docs.select("doc_id", packing.n_words(F.col("text"))).collect()}
    total, batches = dict.fromkeys(lengths, 0), {}
    for r in rows:
        total[r["doc_id"]] += r["length"]
        assert r["start"] == r["piece"] * packing.MAX_LEN
        if r["length"]:
            assert r["length"] <= r["padded_len"]
            batches.setdefault((r["bucket"], r["batch_id"]), []).append(r["padded_len"])
    assert total == lengths
    sizes = {k: sum(v) for k, v in batches.items()}
    assert max(sizes.values()) <= packing.BUDGET
    for bucket in {k[0] for k in sizes}:  # all batches but a bucket's last are full
        own = sorted(k for k in sizes if k[0] == bucket)
        assert [k[1] for k in own] == list(range(len(own)))
        assert all(sizes[k] + batches[k][0] > packing.BUDGET for k in own[:-1])


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_winnowing_against_plain_loops(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["A", "b", "cé"]) for _ in range(n)) for n in (0, 1, 4, 5, 19, 20, 21, 60, 200)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", fingerprints.winnow(F.col("text")).alias("p"))
    for r in got.collect():
        words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in r["text"].lower().split()]

        def chain(values):
            seed = 42
            for v in values:
                seed = xxhash.xxh64_intdigest(struct.pack("<Q", v), seed)
            return seed

        grams = [chain(words[i:i + 5]) for i in range(len(words) - 4)] or [chain(words)] * bool(words)
        keys = [h >> 31 for h in grams]
        chosen = []
        for a in range(max(1, len(keys) - 15) if keys else 0):
            window = range(a, min(a + 16, len(keys)))
            best = min(window, key=lambda i: (keys[i], -i))
            if best not in chosen:
                chosen.append(best)
        top = (1 << fingerprints.POSITION_BITS) - 1
        assert r["p"] == [keys[i] << fingerprints.POSITION_BITS | top - i for i in chosen], r["text"]


def test_edited_texts(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect(), reverse=True)
    want = {}
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(t) // 2
        want[i] = hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest()
    rows = fingerprints.op9_fingerprints(spark, SF).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in rows} == want and len(rows) == len(docs)
    assert np.mean([r["near_edited"] for r in rows]) > 0.2 > np.mean([r["near_next"] for r in rows])


def test_bpe_as_the_library(spark):
    with open(P.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(6)
    texts = [t for t in TEXTS if t] + ["".join(rnd.choice(["a", "'", "s", "'ll", " ", "\n", "é", "漢", "1", "!", "\x1c", "՘"])
                                               for _ in range(rnd.randrange(25))) for _ in range(2000)] + ["qab" * 5000]
    e = bpe.encoder(P.path(bpe.VOCABULARY))
    got = {i: [] for i in range(len(texts))}
    for i, ids, _ in bpe.encode_texts(texts, e):
        got[i] += ids.tolist()
    assert [got[i] for i in range(len(texts))] == [own.encode_ordinary(t) for t in texts]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in bpe.op4_bpe(spark, SF).collect():
        ids = own.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_token_counts_as_the_library(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rnd = random.Random(7)
    texts = [t for t in TEXTS if t is not None] + [
        "".join(rnd.choice(["a", "'", "s", "'ve", " ", "  ", "\n", "é", "漢", "1", "!", "<|endoftext|>", "<|", "The", "x" * 70])
                for _ in range(rnd.randrange(30))) for _ in range(3000)] + ["q" * 40_000 + "ing" * 9_000]
    m = token_counts.machine(P.path("byte_bpe_50k.json"))
    want = [len(x.ids) for x in own.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_texts(texts, m).tolist() == want
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in token_counts.op10_token_counts(spark, SF).collect():
        assert r["n_tokens"] == len(own.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert r["n_bytes"] == len(docs[r["doc_id"]].encode()) and r["over_limit"] == (r["n_tokens"] > 1024)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    langs = language_id.op1_language_id(spark, sf).where("held_out").join(docs, "doc_id")
    assert langs.where("lang = lang_pred").count() >= 0.97 * langs.count() > 0
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    marks = quality_classifier.op8_quality_classifier(spark, sf).where("held_out").join(labels, "doc_id")
    assert marks.where("quality = predicted").count() >= 0.93 * marks.count() > 0


def plain_language(texts, labelled, bits=language_id.BITS):
    """Naive Bayes over counted n-grams, one text at a time."""
    def grams(x):
        x = x.lower()
        codes = np.array([ord(c) for c in x], dtype=np.uint32)
        g = language_id.features(codes, bits)
        return [int(g[o][i]) for o in range(3) for i in range(o, len(x))]

    counts, docs = {}, Counter()
    for x, lang in labelled:
        docs[lang] += 1
        counts.setdefault(lang, Counter()).update(grams(x))
    out = []
    for x in texts:
        g, logs = grams(x), {}
        for lang, c in counts.items():
            size = sum(c.values()) + (1 << bits)
            logs[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((c[b] + 1) / size) for b in g) / math.sqrt(len(g))
        top = max(logs.values())
        odds = {lang: math.exp(v - top) for lang, v in logs.items()}
        best = min(odds, key=lambda lang: (-odds[lang], lang))
        out.append((best, odds[best] / sum(odds.values())))
    return out


def test_language_scores_against_plain_naive_bayes(spark):
    rnd = random.Random(5)
    labelled = [("".join(rnd.choice(a) for _ in range(rnd.randint(3, 60))), lang)
                for lang, a, n in (("aa", "abcde fgh", 60), ("bb", "defghij kl", 12), ("cc", "kl mnoß", 3)) for _ in range(n)]
    labelled = [(x + "a", lang) for x, lang in labelled]
    texts = ["abc", "kl", "deg hij", "ß no", "zzz", "a", "mnk lkd eab", "fgh" * 40]
    docs = spark.createDataFrame(labelled, "text string, lang string")
    model = language_id.fit(docs, F.col("text"), F.col("lang"))
    got = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    for r, (lang, score) in zip(got, plain_language(texts, labelled), strict=True):
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4
    # frequent languages are thinned, rare ones are not
    few = language_id.fit(docs, F.col("text"), F.col("lang"), max_docs=12)
    assert few[0] == ["aa", "bb", "cc"] and np.allclose(few[1], model[1])
    assert np.allclose(few[2][:, 1:], model[2][:, 1:]) and not np.allclose(few[2][:, 0], model[2][:, 0])


def test_cascade_order_follows_cost_and_rejection_and_repeats(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}x{i}" for j in range(20)) + "!" * (i % 2) + "#" * (i % 8 == 0)) for i in range(200)], "doc_id bigint, text string")
    t = F.col("text")
    rules = [quality_rules.Rule("dear", t.rlike("#"), quality_rules.PATTERN), quality_rules.Rule("never", F.col("n_words") < 0),
             quality_rules.Rule("cheap", F.col("n_symbols") > 0), quality_rules.Rule("often", F.contains(t, F.lit("!")), quality_rules.SEARCH)]
    sample = quality_rules.base_columns(docs)
    orders = [[r.name for r, _, _ in quality_rules.estimated_order(sample, list(reversed(rules)) if k else rules)] for k in range(2)]
    assert orders == [["often", "cheap", "dear", "never"]] * 2
    failed = [sorted((r["doc_id"], r["failed_rule"] or "") for r in quality_rules.quality_rules(docs, rules=x).collect()) for x in (rules, rules[::-1])]
    assert failed[0] == failed[1] and {x for _, x in failed[0]} == {"", "often", "cheap"}


def test_only_lines_near_a_line_that_stays_are_removed(spark):
    rnd = random.Random(12)
    base = "".join(rnd.choice("abcdefghij ") for _ in range(60)).replace("\n", " ").strip() + " end of the line"
    chain = [base]
    for i in range(30):  # each line is one edit from the one before
        chain.append(chain[-1][:2 * i] + "Z" + chain[-1][2 * i + 1:])
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(chain)], "doc_id bigint, text string")
    left = [r["text"] for r in line_dedup.dedup_lines(docs).collect() if r["text"]]
    assert 1 < len(left) < len(chain)
    k = min(5, len(base) // 20)
    assert all(x in left or any(distance(x, y) <= k for y in left) for x in chain)
    assert all(distance(x, y) > 0 for x, y in itertools.combinations(left, 2))


def test_different_texts_of_one_id_keep_their_own_lines(spark):
    rows = [(7, "one line that both documents hold\nsecond"), (7, "ANOTHER UNIQUE LINE of this text\none line that both documents hold"),
            (None, "x unique a\ny"), (None, "only here, and nowhere else\nx unique a"), (8, "one line that both documents hold")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect()), key=str)
    texts = "\n".join(t for _, t, _ in got)
    for line in ("ANOTHER UNIQUE LINE of this text", "second", "only here, and nowhere else", "y"):
        assert texts.split("\n").count(line) == 1
    assert texts.split("\n").count("one line that both documents hold") == 1 and texts.split("\n").count("x unique a") == 1


def test_sketches_never_exceed_the_edits(spark):
    rnd = random.Random(4)
    pairs = []
    for _ in range(300):
        a = "".join(rnd.choice("abcdeé漢 ") for _ in range(rnd.randrange(80)))
        b = list(a)
        for _ in range(rnd.randrange(6)):
            at = rnd.randrange(len(b) + 1)
            b[at:at + rnd.randrange(2)] = rnd.choice(["x", "", "a"])
        pairs.append((a, "".join(b)))
    s = [line_dedup.sketches([a, b]).tolist() + [distance(a, b)] for a, b in pairs]
    df = spark.createDataFrame(s, "a bigint, b bigint, d int").select("d", line_dedup.sketch_distance(F.col("a"), F.col("b")).alias("s"))
    assert all(r["s"] <= 2 * r["d"] for r in df.collect()) and df.where("s > 0").count() > 100


def test_quality_features_of_long_texts_do_not_depend_on_slices(monkeypatch):
    rnd = random.Random(3)
    text = " ".join(rnd.choice(["word", "other", "x" * 90, "word"]) for _ in range(4000)).encode()
    buf, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)], dtype=np.int64)
    weights = np.random.default_rng(1).normal(size=(1 << 18, 2))
    whole, sums = quality_classifier._row_buckets(buf, offsets, 0, 18), quality_classifier.indicator_sums(buf, offsets, weights)
    monkeypatch.setattr(quality_classifier, "SLICE", 1000)
    assert (quality_classifier._row_buckets(buf, offsets, 0, 18) == whole).all()
    assert np.allclose(quality_classifier.indicator_sums(buf, offsets, weights), sums)


def test_near_duplicates_tell_texts_of_one_id_apart(spark):
    words = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    w, v, x = words("w"), words("v"), words("x")
    rows = [(1, w), (2, w), (2, v), (3, v + " tail"), (None, v), (None, x), (None, x), (None, None), (4, "  "), (2, words("own")), (2, w)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    want = [(1, 36, 1, True), (2, 36, 1, False), (2, 36, 1, False), (2, 36, 2, True), (3, 37, 2, False), (None, 36, 2, False),
            (None, 36, None, True), (None, 36, None, True), (None, 0, None, True), (4, 0, 4, True), (2, 36, 2, True)]
    assert got == sorted(want, key=str)
    left = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()), key=str)
    assert left == sorted([(1, w), (2, v), (None, x), (None, x), (None, None), (4, "  "), (2, words("own"))], key=str)


HREFS = ["/es/a", "b", "../es/a", "../../es/a?x=1&amp;y=2", "./../x/./c", "..", ".", "?p=1", "#top", "//other.net/es/a", "http://x.net/es/a", "HTTP://x.net/q/../es/a#f",
         "mailto:a@b.c", "/es/go?to=http://free.org/", "  es/a ", "a:b", "x/?u=../y", ""]
PAGES = ["http://x.net/q/r/page", "http://x.net", "http://x.net?p=2", "https://x.net/q/#f", "http://x.net/q/r/?a=/b/c"]


def test_links_resolve_as_urls_do(spark):
    from urllib.parse import urldefrag, urljoin, urlsplit

    rows = [(p, h) for p in PAGES for h in HREFS]
    df = spark.createDataFrame([(p, f'''<p><LINK data-x='1' rel="canonical" href='{h}'>''') for p, h in rows], "url string, html string")
    got = {(r["src"], urldefrag(r["dst"])[0].rstrip("/")) for r in url_filters.html_links(df).collect()}
    want = set()
    for p, h in rows:
        h = h.strip().replace("&amp;", "&")
        if h and not h.startswith(("#", "mailto", "a:b")):
            d = urldefrag(urljoin(p, h))[0].replace("HTTP", "http")
            at = urlsplit(d)  # joined once more, as urljoin leaves dots of a reference with a host
            want.add((p, (urljoin(d, at._replace(scheme="", netloc="").geturl()) if at.path else d).rstrip("/")))
    assert {(s, d.replace("HTTP", "http")) for s, d in got} == want


def test_url_query_follows_relative_links_as_duckdb(spark, tmp_path):
    link = "<html><link rel=canonical href='{}'><meta http-equiv=\"Refresh\" content=\"0; url='{}'\">"
    rows = [(i, f"http://s{i}.org/d/e", link.format(h, "")) for i, h in enumerate(h.replace("../es", "http://x.net/z/../es") for h in HREFS)]
    rows += [(100, "http://x.net/fr/p", "<link rel='canonical' href='../es/a'>"), (101, "http://y.org/", link.format("", "http://x.net/es/a")),
             (102, "http://x.net/other/p", "<link href='../es/a' rel='x canonical'>"), (103, "http://x.net/es/a", None), (104, None, link.format("/es/a", "")),
             (105, "http://www.free.com/k", "<link rel=canonical href=http://x.net/es/a>"), (106, "http://x.net/n", "<meta http-equiv=refresh content='3;URL=es/a'>")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.op3_url_filters(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == {r[0]: r[1:] for r in con.execute(url_filters.OP3_SQL).fetchall()}
    assert {i for i in got if got[i][2] is None and got[i][3] == "block"} >= {101, 102, 106} and got[105][3] == "allow"


@pytest.mark.parametrize("group_pairs", [4096, 6])
def test_line_dedup_leaves_no_two_near_lines(spark, monkeypatch, group_pairs):
    monkeypatch.setattr(line_dedup, "GROUP_PAIRS", group_pairs)
    rnd = random.Random(8)
    lines = []
    for n in (30, 64, 110):
        base = "".join(rnd.choice("abcdefghij ") for _ in range(n)).strip() + "end"
        for _ in range(45):  # more than the edits part many of them, but each is near many others
            x = base
            for _ in range(rnd.randrange(1, 5)):
                p = rnd.randrange(len(x))
                x = rnd.choice([x[:p] + x[p + 1:], x[:p] + rnd.choice("QZ") + x[p:], x[:p] + "Y" + x[p + 1:]])
            lines.append(x)
    rnd.shuffle(lines)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    got = {r["doc_id"] for r in line_dedup.dedup_lines(docs).collect() if r["text"]}
    near = lambda a, b: a == b or line_dedup.within(a, b, min(5, max(1, min(len(a), len(b)) // 20)))
    want = []
    for i, x in enumerate(lines):
        if not any(near(lines[j], x) for j in want):
            want.append(i)
    assert got == set(want) and 3 < len(want) < 100


def test_line_dedup_misses_no_link_inside_connected_groups(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "GROUP_PAIRS", 6)
    rnd, lines = random.Random(3), []
    for n in (104, 140):
        base = "".join(rnd.choice("abcdefghij ") for _ in range(n)).strip() + "end"
        for _ in range(70):
            x = base
            for _ in range(rnd.randrange(2, 5)):
                p = rnd.randrange(len(x))
                x = rnd.choice([x[:p] + x[p + 1:], x[:p] + rnd.choice("QZ") + x[p:], x[:p] + "Y" + x[p + 1:]])
            lines.append(x)
    rnd.shuffle(lines)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    left = [r["text"] for r in line_dedup.dedup_lines(docs).collect() if r["text"]]
    assert left and not any(line_dedup.within(a, b, 5) for a, b in itertools.combinations(left, 2))


def test_whole_texts_reach_python_workers_in_small_batches(spark, monkeypatch):
    import plantpulse.llm.common as common

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = spark.range(0, 2 * common.TEXT_ROWS + 10, 1, 1).mapInArrow(common.lean(sizes), "n bigint")
    before = spark.conf.get(common.BATCH_ROWS)
    got = [r["n"] for r in common.write_shared(rows, "sizes", texts=True).collect()]
    assert max(got) <= common.TEXT_ROWS and sum(got) == 2 * common.TEXT_ROWS + 10
    assert spark.conf.get(common.BATCH_ROWS) == before
    seen = {}
    for module in (line_dedup, minhash):
        monkeypatch.setattr(module, "write_shared", lambda df, name, texts=False: (seen.__setitem__(name, texts), common.write_shared(df, name, texts))[1])
    words = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, words), (2, words + " eleven"), (3, words + "\n" + words[:-1])], "doc_id bigint, text string")
    assert [r["component_id"] for r in minhash.near_duplicates(docs, 80).orderBy("doc_id").collect()] == [1, 1, 3]
    assert sorted((r["doc_id"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect()) == [(1, 0), (2, 0), (3, 2)]
    assert {name for name, texts in seen.items() if texts} == {"sketches", "sets", "line-index", "line-probes"}


def test_keys_of_a_batch_hold_one_slice_of_lines(spark, monkeypatch):
    import tracemalloc

    class Taken:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    rnd = random.Random(3)
    texts = ["\n".join("%0500x" % rnd.getrandbits(2000) for _ in range(20)).encode() for _ in range(800)]
    want = {line_dedup.line_id(x) for t in texts for x in t.decode().split("\n")}
    asked = []
    monkeypatch.setattr(line_dedup, "line_keys", lambda lines, *more: (asked.append(sum(map(len, lines))),
                                                                       (np.zeros(len(lines), np.int64), np.arange(len(lines))))[1])
    run = line_dedup.key_rows(Taken(), 5, 20, 20)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])
    found = set()
    tracemalloc.start()
    for out in run([batch]):
        found.update(out.column(1).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 8 MB of lines, of which a slice is held, beside the ids of those seen
    assert found == want and max(asked) <= line_dedup.SLICE and peak < 6 << 20


def test_pair_sketches_never_exceed_the_edits_and_part_swapped_words(spark):
    rnd, pairs = random.Random(6), [("", ""), ("a", "b"), ("", "ab")]
    for _ in range(300):
        a = "".join(rnd.choice("abcdeé漢😀 ") for _ in range(rnd.randrange(120)))
        b = list(a)
        for _ in range(rnd.randrange(6)):
            at = rnd.randrange(len(b) + 1)
            b[at:at + rnd.randrange(2)] = rnd.choice(["x", "", "a"])
        pairs.append((a, "".join(b)))
    rows = [[int(x) for x in line_dedup.pair_sketches([a, b]).ravel()] + [distance(a, b)] for a, b in pairs]
    apart = line_dedup.sketch_distance(F.col("a"), F.col("c")) + line_dedup.sketch_distance(F.col("b"), F.col("d"))
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint, d bigint, n int").select("n", apart.alias("s"))
    assert all(r["s"] <= 4 * r["n"] for r in df.collect()) and df.where("s > 0").count() > 100
    # the same characters in another order: their counts agree, their neighbours do not
    words = "marble lantern copper window garden thistle velvet harbour pepper silver".split()
    lines = [" ".join(words), "".join(sorted(" ".join(words)))]
    counts = line_dedup.sketches(lines).tolist()
    assert counts[0] == counts[1]
    row = [[*(int(x) for x in (counts[i], *line_dedup.pair_sketches(lines)[i])), 3, i] for i in range(2)]
    names = ", ".join(f"{n} {t}" for n, t in line_dedup.SKETCH.items())
    p, q = (spark.createDataFrame([x], names).select(F.struct("*").alias(n)) for x, n in zip(row, "pq", strict=True))
    assert [r["near"] for r in p.crossJoin(q).select(line_dedup.may_be_near("p", "q").alias("near")).collect()] == [False]


def test_settling_lines_shuffles_no_small_side(spark, monkeypatch):
    plans = []
    write = line_dedup.write_shared
    monkeypatch.setattr(line_dedup, "write_shared", lambda df, name, **more: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), write(df, name, **more))[1])
    links = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 6), (6, 7)], "u bigint, v bigint")
    waiting = spark.createDataFrame([(4,), (4,), (99,)], "id bigint")
    monkeypatch.setattr(line_dedup, "drop_shared", lambda *frames: None)
    open_, gone = line_dedup.settled(links, waiting)
    assert {r["id"] for r in gone.collect()} == {2}
    assert {(r["u"], r["v"]) for r in open_.collect()} == {(4, 5), (5, 6), (6, 7)}
    open_, gone = line_dedup.settled(links, None)
    assert {r["id"] for r in gone.collect()} == {2, 5, 7} and not open_.count()
    assert all("broadcast" in plan for name, plan in plans if name in ("line-gone", "line-open") and "Join" in plan)


def test_hashes_of_rare_characters_are_those_of_all(spark):
    from plantpulse.llm.kernels import CharHashes, _code_hashes, mix

    text = "plain é漢😀\uffff𐀀end" * 40
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    with np.errstate(over="ignore"):
        assert (_code_hashes(codes) == mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))).all()
    n = len(text) // 40
    of = CharHashes(codes).of(np.arange(0, len(text), n), np.arange(n, len(text) + 1, n))
    assert len(set(of.tolist())) == 1


def test_lines_with_a_word_are_counted(spark):
    texts = [None, "", " \t\n\x0b\x0c\r", "a", "\n a\n\n\tb \n\u00a0\n", "one\r\ntwo\n \x85", "\u2028\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r["n_lines"] for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()]
    assert got == [sum(any(c not in " \t\n\x0b\x0c\r" for c in x) for x in (t or "").split("\n")) for t in texts]


def test_pipeline_language_stage_gives_python_small_batches(spark, monkeypatch):
    seen = {}
    write = corpus_pipeline.write_shared
    monkeypatch.setattr(corpus_pipeline, "write_shared", lambda df, name, texts=False: (seen.__setitem__(name, texts), write(df, name, texts))[1])
    docs = spark.createDataFrame([(i, "these are the words of one text", "en") for i in range(12)] + [(12, "12 34", None), (13, None, "en")],
                                 "doc_id bigint, text string, lang string")
    got = corpus_pipeline.language_id(spark, docs, SF)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == set(range(12))
    assert True in seen.values()
