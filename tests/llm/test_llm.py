import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.llm import blocks as B
from hindcast.llm import decontamination as dec
from hindcast.llm import language_id as lid
from hindcast.llm import lm_scoring as lm
from hindcast.llm import mixing, near_dedup, nearest, quality, substring_dedup, token_counts, warc

DIR = "/root/testdata/sf0.001"
ODD = [(None, "a b"), (901, None), (902, ""), (903, " \n"), (904, "a b"), (904, "a b"), (905, "x" * 5000)]


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows):
    """With columns whose names clash with those used inside."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("block", "payload", "kind", "n", "label")})


def bare(df):
    return df.limit(0)


def test_word_hashes_follow_words():
    texts = [b"a bb  ccc\n", b"", None, b"bb a", b"w" * (B.SEGMENT + 7)]
    s, e, h, first = B.Block(np.arange(5), texts).words()
    words = b"\n".join(t or b"" for t in texts).split()
    assert len(words) == len(h) and len(set(zip(words, h.tolist()))) == len(set(words)) and first.tolist() == [0, 3, 3, 3, 5, 6]


def test_token_counts(spark):
    rows = documents(spark) + ODD + [(i, t) for i, t in enumerate([" ", "  \n\n a", "it's  don't\t<|endoftext|>  a", "日本語　 　x", "x   y"], 5000)]
    got = sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.token_counts(frame(spark, rows)).collect())
    n = token_counts.pieces(token_counts.vocabulary(), [t or "" for _, t in rows])
    assert got == sorted((i or -1, int(k)) for (i, _), k in zip(rows, n))
    assert token_counts.token_counts(bare(frame(spark, ODD))).count() == 0


def test_lm_base_scores_and_model(spark):
    rows = documents(spark)
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = {i: (t or "").encode().translate(low).split() + ["end"] for i, t in rows}
    count = Counter(w for i, t in tokens.items() if zlib.crc32(b"%d" % i) % 7 != 2 for w in t)
    total, kinds = sum(count.values()), len(count)
    got = lm.lm_scores(frame(spark, rows)).collect()
    for r in got:
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in tokens[r.doc_id]), rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[r.doc_id]), sum(count[w] > 0 for w in tokens[r.doc_id]), total)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert len(lm.lm_scores(frame(spark, ODD)).collect()) == len(ODD) and lm.lm_scores(bare(frame(spark, ODD))).count() == 0


def plain_scores(rows):
    """Scores by exact levels of all n-grams, and tokens of each text."""
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = {i: [b""] + t.encode().translate(low).split() + [b""] for i, t in rows}
    one, two = Counter(), Counter()
    for i, w in tokens.items():
        if zlib.crc32(b"%d" % i) % 7 != 2:
            one.update(w[1:]), two.update(zip(w, w[1:]))
    mean, total = lm.means(), sum(one.values()) + len(one) + 1
    level = lambda c: mean[lm.levels(np.array([c]))[0]]

    def p(v, w):
        k = lm.WEIGHT if one[v] else 0.0
        return k * min(1, level(two[v, w]) / max(level(one[v]), 1)) + (1 - k) * (level(one[w]) + 1) / total

    return {i: sum(math.log10(p(v, x)) for v, x in zip(w, w[1:])) for i, w in tokens.items()}


def test_lm_filter_grows_with_its_entries(spark, monkeypatch):
    monkeypatch.setattr(lm, "BITS_EACH", 1 << 15)  # more than 2^28 bits in all, and no false positives
    learned = [i for i in range(2000) if zlib.crc32(b"%d" % i) % 7 != 2]
    held = [i for i in range(2000) if zlib.crc32(b"%d" % i) % 7 == 2]
    texts = [t for _, t in documents(spark) if t][:150]
    rows = list(zip(learned, texts + texts)) + list(zip(held, texts))  # every bigram at least twice
    want = plain_scores(rows)
    assert {r.doc_id: r.score for r in lm.lm_scores(frame(spark, rows)).collect()} == pytest.approx(want, rel=1e-9)


def test_lm_learns_bigrams_seen_once(spark):
    rows = [(i, t) for i, t in documents(spark) if t]
    got, want = {r.doc_id: r.score for r in lm.lm_scores(frame(spark, rows)).collect()}, plain_scores(rows)
    off = [abs(got[i] - want[i]) / abs(want[i]) for i in want]  # by false positives alone
    assert sum(off) / len(off) < 0.01


def test_filter_has_no_false_negatives():
    keys = np.random.default_rng(0).integers(0, 2**64, 2000, dtype=np.uint64)
    level = np.random.default_rng(1).integers(1, 9, 2000)
    mine = keys[B.bucket_of(keys, 1) == 0]
    flt = lm.part_filter(mine, level, 1 << 17)
    assert (lm.probe(flt, 1 << 17, 1, mine) >= level).all()
    assert (lm.probe(flt, 1 << 17, 1, mine + np.uint64(1)) > 0).mean() < 0.1


def windows_removed(rows, size=50):
    first, words = {}, [((i if i is not None else 2**63), (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = {x for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for x in range(k, k + size)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out)


def test_substrings_against_brute_force(spark):
    rnd, common = random.Random(1), [random.Random(7).choice("abcdefgh") for _ in range(80)]
    rows = list(ODD)
    for i in range(40):
        t = [["a"] * rnd.randint(0, 120), ["a", "b"] * rnd.randint(0, 70), [rnd.choice("abc") for _ in range(150)]][i % 3]
        rows.append((i, " ".join(t[:40] + (common[rnd.randint(0, 20) :] if i % 4 == 0 else []) + t[40:])))
    got = substring_dedup.dedup_substrings(frame(spark, rows).repartition(3)).withColumn("h", F.sha2("text", 256)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else 2**63, r.n_words, r.n_removed, r.h) for r in got) == windows_removed(rows)
    assert all(r.block == r.payload == "x" for r in got)
    assert substring_dedup.dedup_substrings(bare(frame(spark, ODD))).count() == 0


def classes(rows, similar=0.8):
    bags = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in rows if (w := (t or "").split())}
    root = {i: i for i, _ in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = sum((bags[a] & bags[b]).values())
            if both >= similar * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i, _ in rows}


def test_near_duplicates_against_all_pairs(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    base, rows = [rnd.choice(words) for _ in range(120)], []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 8)):
            w[rnd.randrange(120)] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, ""), (903, "a b"), (904, "a  b"), (905, "b a"), (906, rows[0][1])]
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == classes(rows)
    assert near_dedup.near_duplicates(frame(spark, ODD)).count() == len(ODD) and near_dedup.near_duplicates(bare(frame(spark, ODD))).count() == 0


def test_signatures_are_unbiased():
    rnd = random.Random(3)
    w = [f"w{i}" for i in range(200)]
    a = [rnd.choice(w) for _ in range(60)] * 3
    b = a[:100] + [rnd.choice(w) for _ in range(80)]
    texts = [" ".join(x).encode() for x in (a, b)]
    doc, s, c, _ = near_dedup.multisets(B.Block(np.arange(2), texts))
    sig = near_dedup.signatures(doc, s, c, 2, 20_000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(near_dedup.overlaps(texts)[0], abs=0.015)


@pytest.mark.parametrize("name,table", [("op2_mixing", "documents"), ("op5_warc", "pages"), ("op3_substring_dedup", "documents")])
def test_rows_equal_those_of_sql(spark, name, table):
    from hindcast.llm.registry import QUERIES, SQL

    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    df, rel = QUERIES[name](spark, DIR), con.sql(SQL[name])
    assert sorted(map(tuple, df.select(*rel.columns).collect()), key=repr) == sorted(rel.fetchall(), key=repr)


def test_mixing_edges(spark):
    rows = spark.createDataFrame([(None, None, None, None, 1), (1, "a b", None, "x", 2), (1, "a b", None, "x", 2), (2, "", "en", "src1", 3)], "doc_id long, text string, lang string, source string, copies int")
    assert mixing.mix(rows).columns == ["doc_id", "text", "lang", "source", "copies"] and mixing.mix(rows).count() >= 1
    assert mixing.mix(bare(rows)).count() == 0


def test_warc_round_trip(spark):
    big = "x" * 200
    rows = [(5, "u\r\n v", big), (3, None, big), (None, "n", big), (4, "a", None), (6, "b", "é\r\n\r\n"), (7, "c", "s"), (8, "c", "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(1))
    shared = B.Shared(spark, "t")
    index = warc.normalise(warc.archive_pages(pages, shared), shared)
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    assert {i for i, r in got.items() if r.record_type == "revisit"} == {5, None} and got[5].refers_to == 3
    assert bytes(got[6].payload).decode() == rows[4][2] and got[4].payload_bytes == 0 and got[5].payload_bytes == 200
    assert all(r.payload_digest == hashlib.sha256((next(t for i, _, t in rows if i == k) or "").encode()).hexdigest() for k, r in got.items())
    assert warc.read_records(warc.normalise(warc.archive_pages(bare(pages), s := B.Shared(spark, "t")), s)).count() == 0


def test_nearest_recall(spark):
    got = nearest.op6_nearest(spark, DIR).collect()
    e = spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in e]), np.array([r.embedding for r in e], float)
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hits, total = hits + len(best & {r.vec_id for r in got if r.query_id == ids[q]}), total + 10
    assert hits / total >= 0.9
    odd = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [0.0, 0.0]), (3, None), (4, [math.nan, 1.0]), (5, [1.0, None]), (7, [1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in nearest.nearest(odd, F.col("vec_id") == 0).collect()] == [(1, 0.5)]
    assert nearest.nearest(bare(odd), F.col("vec_id") == 0).count() == 0


def test_nearest_is_exact_in_a_tight_cluster(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 16))
    x[::3] = x[0] + 1e-3 * rng.standard_normal((1000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    got = nearest.nearest(rows, F.col("vec_id") < 30).collect()
    for q in range(30):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == np.argsort(d, kind="stable")[:10].tolist()


def test_language_accuracy_and_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = lid.learn(docs)
    held = lid.identify(docs, model).where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held > 0.98
    got = lid.identify(frame(spark, ODD + [(906, "123 $$$")]), model).collect()
    assert len(got) == len(ODD) + 1 and {r.lang_pred for r in got if r.doc_id in (901, 902, 903, 906)} == {"und"}
    assert lid.identify(bare(frame(spark, ODD)), model).count() == 0 and lid.learn(bare(docs)) is None
    text = {l: docs.where(F.col("lang") == l).first().text[:300] for l in ("en", "fr")}
    spans = lid.identify(frame(spark, [(1, text["fr"] + " " + text["en"])]), model).first().spans
    assert [s.lang for s in spans] == ["fr", "en"]


def test_alignment_and_leaks(spark):
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (rng.integers(1, 6, rng.integers(1, n)).astype(np.uint64) for n in (12, 30))
        h, best = np.zeros((len(a) + 1, len(b) + 1)), 0
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert dec.align(a, b[None])[0][0] == h.max()
    item = " ".join(f"word{i}" for i in range(30))
    edited = " ".join(f"word{i}" if i % 6 else "other" for i in range(30))
    rows = ODD + [(1, "x y z " + item + " end"), (2, "so " + edited), (3, "word1 word2 but not more of it")]
    bench = spark.createDataFrame([(7, item), (8, None), (None, "a")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dec.find_leaks(frame(spark, rows), bench).collect()} == {(1, 7), (2, 7)}
    assert dec.find_leaks(frame(spark, rows), bench, slice_bytes=100).count() == 2
    assert dec.find_leaks(bare(frame(spark, rows)), bench).count() == 0 and dec.find_leaks(frame(spark, rows), bare(bench)).count() == 0


def test_leaks_of_an_item_of_frequent_words(spark):
    rnd = random.Random(5)
    common = [f"w{i}" for i in range(20)]
    some = lambda n: [rnd.choice(common) for _ in range(n)]
    head, tail = some(25), some(25)
    item = " ".join(head + [f"rare{i}" for i in range(10)] + tail)
    rows = [(i, " ".join(some(60))) for i in range(1, 301)] + [(0, " ".join(head + ["other"] * 10 + tail))]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id: r.score for r in dec.find_leaks(frame(spark, rows), bench).collect()}[0] >= 0.75


def test_quality_separates_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    r = quality.classify(docs, labels).select("doc_id", F.col("quality").alias("p"), F.col("toxic").alias("t")).join(labels, "doc_id")
    assert r.agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("quality")).cast("double"))).first()[0] > 0.95
    assert r.where("toxic = 0 and t >= 0.5").count() == 0
    odd = frame(spark, ODD).withColumns({"source": F.lit(None).cast("string"), "lang": F.lit("en")})
    assert quality.classify(odd, labels).count() == len(ODD) and quality.classify(odd, bare(labels)).count() == len(ODD) and quality.classify(bare(odd), labels).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = P.STAGES[0][1](spark, docs, DIR)
    assert kept.columns == docs.columns and ids(kept) == ids(docs)
    near = P.STAGES[1][1](spark, docs, DIR)
    assert ids(near) == {c for c in classes(documents(spark)).values()}
    assert P.run(spark, DIR).columns == [*P.COLUMNS, "copies"]
