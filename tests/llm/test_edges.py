import gzip
import io
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.llm import blocks as B
from hindcast.llm import decontamination as dec
from hindcast.llm import language_id as lid
from hindcast.llm import lm_scoring as lm
from hindcast.llm import mixing, near_dedup, quality, substring_dedup, warc
from tests.llm.test_llm import DIR, bare, classes, documents, frame, windows_removed

DOCS = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.parametrize("seed", range(2))
def test_mixing_of_repeated_rows_equals_sql(spark, seed):
    rnd, rows = random.Random(seed), []
    for i in range(30):
        text = " ".join(["w"] * rnd.randint(0, 9))
        rows += [(i, text, rnd.choice(["en", "de"]) if seed else "en", "s1") for _ in range(rnd.randint(1, 4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(map(tuple, mixing.mix(docs).select("doc_id", "lang", "source", "copies").collect())) == sorted(con.sql(mixing.mix_sql()).fetchall())


def test_mixing_weights_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s1"), (2, "a b c", "de", "s1"), (3, "x", "fr", "s2")], "doc_id long, text string, lang string, source string")
    assert {r.lang for r in mixing.mix(docs, share=1.0, languages={"de": 0.0}).collect()} == {"en", "fr"}
    assert mixing.mix(docs, domains={"d0": 0.0, "d1": 0.0, "d2": 0.0, "d3": 0.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, languages={"de": -1.0})


def test_lookup_beyond_the_broadcast_bound(spark, monkeypatch):
    many = spark.createDataFrame([(i, i % 3) for i in range(300)] + [(300, None)], "id long, k int")
    one = spark.createDataFrame([(0, "a"), (1, "b")], "k int, v string")
    want = [sorted(map(tuple, B.meet(many, one, ["k"], ["id"], how).collect()), key=repr) for how in ("inner", "left")]
    monkeypatch.setattr(B, "FEW_ROWS", 1)
    assert [sorted(map(tuple, B.meet(many, one, ["k"], ["id"], how).collect()), key=repr) for how in ("inner", "left")] == want


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master, applicationId = "spark://somewhere:7077", "a"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError):
        B.Shared(Session, "x")


def test_blocks_are_bounded_by_documents():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x"] * 1000), pa.array([{"a": i} for i in range(1000)])], ["doc_id", "text", "carried"])
    got = list(B.blocks(iter([batch, batch]), docs=300))
    assert [len(b) for b in got] == [300] * 6 + [200]
    from pyspark.sql.types import LongType, StructField, StructType

    along = [x["a"] for b in got for x in B.Block.unpack(b.pack()).along(StructType([StructField("a", LongType())])).to_pylist()]
    assert along == [*range(1000), *range(1000)]


def test_language_of_letters_only(spark):
    model = lid.learn(spark.read.parquet(DOCS))
    rows = [(1, "the cat — — — — — — — — — — is in the house"), (2, "Ωμέγα λόγος"), (3, "— … “”"), (4, "नमस्ते दुनिया"), (None, "the cat is in the house")]
    got = {r.doc_id: (r.lang_pred, r.score, r.held_out) for r in lid.identify(frame(spark, rows), model).collect()}
    assert got[1][:2] == ("en", 1.0) and got[3][:2] == ("und", 0.0) and got[None] == ("en", 1.0, False)
    assert got[2][0] in model.langs and got[2][1] == got[4][1] == 0.0
    beside = lid.identified(frame(spark, rows).withColumn("score", F.lit("old")), model)
    assert beside.columns == ["doc_id", "text", "block", "payload", "kind", "n", "label", "lang_pred", "score"] and beside.where("block = 'x'").count() == 5


def test_scripts_of_code_points():
    table, names = lid.scripts()
    of = lambda c: names[table[ord(c)]]
    assert [of(c) for c in "eéßΩжאعकกあ漢한"] == ["LATIN", "LATIN", "LATIN", "GREEK", "CYRILLIC", "HEBREW", "ARABIC", "DEVANAGARI", "THAI", "HIRAGANA", "CJK", "HANGUL"]
    assert not table[[ord(c) for c in "—…×«»‰€"]].any()


def test_viterbi_against_plain_recursion():
    rng = np.random.default_rng(0)
    for n in (3, 300):
        scores = rng.normal(size=(11, n)).astype(np.float32)
        first = np.array([0, 4, 4, 11])
        got = lid.viterbi(scores, first, 1.5)
        for lo, hi in zip(first[:-1], first[1:]):
            value = np.zeros(n)
            for i in range(lo, hi):
                value = (np.maximum(value, value.max() - 1.5) if i > lo else value) + scores[i]
            mine = scores[np.arange(lo, hi), got[lo:hi]].sum() - 1.5 * (got[lo + 1 : hi] != got[lo : hi - 1]).sum() if hi > lo else 0.0
            assert mine == pytest.approx(value.max(), abs=1e-4)


def test_substring_columns_are_kept(spark):
    rows = [(1, "a " * 60), (2, "a " * 60), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit("old"), "at": F.expr("TIMESTAMP'2024-01-01 00:00:00.123456'"), "m": F.create_map(F.lit("k"), F.lit(1)), "bucket": F.lit(None).cast("decimal(9,2)")})
    out = substring_dedup.dedup_substrings(docs)
    assert out.columns == ["doc_id", "text", "at", "m", "bucket", "n_words", "n_removed"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].n_removed == 60 and got[1].n_words == 60 and got[None].n_words == 0
    assert all(r["at"].microsecond == 123456 and r.m == {"k": 1} and r.bucket is None for r in got.values())


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_substring_rounds_only_rule_out(spark, rounds):
    rnd = random.Random(rounds)
    common = [rnd.choice("abcdefgh") for _ in range(90)]
    rows = [(i, " ".join([rnd.choice("ab") for _ in range(60)] + common[rnd.randint(0, 25) :] + [rnd.choice("abcd") for _ in range(40)])) for i in range(20)]
    got = substring_dedup.dedup_substrings(frame(spark, rows), rounds=rounds).withColumn("h", F.sha2("text", 256)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.h) for r in got) == windows_removed(rows)


def test_names_are_equal_for_equal_strings_only():
    texts = [b"a b a b c d", b"x a b a b c", b"q r s t"]
    block, r = B.Block(np.arange(3), texts), None
    places, rows = substring_dedup.ask_words(block, 0, 4)
    asked = [B.unpack(p) for _, _, _, p in rows]
    told = [substring_dedup.name_words(4)([a], b) for a, (_, _, b, _) in zip(asked, rows)]
    names = np.concatenate([t[0] for t in told]).astype(np.uint64)
    r = substring_dedup.Reader(places, 4, [names])
    words = b" ".join(texts).split()
    by_name = {}
    for w, n in zip(words, r.names.tolist()):
        if n:
            assert by_name.setdefault(n, w) == w
    assert set(by_name.values()) == {b"a", b"b", b"c"}  # the others stand in one text alone


def test_archive_padding_and_truncation():
    data = gzip.compress(b"one") + gzip.compress(b"two")
    read = lambda x, piece=7: b"".join(warc.inflate(io.BytesIO(x), piece))
    assert read(data) == b"onetwo" == read(data + b"\0" * 600) and read(b"") == b""
    for cut in (data[:-3], data[:-9], data[: len(gzip.compress(b"one")) + 4]):
        with pytest.raises(ValueError):
            read(cut)


def test_sidecars_name_members(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * (i * 60)) for i in range(6)] + [(9, None, None)], "page_id long, url string, html string")
    shared = B.Shared(spark, "t")
    index = warc.normalise(warc.archive_pages(pages, shared), shared)
    side = warc.read_sidecars(spark, shared)
    cols = ["path", "offset", "length", "page_id", "record_type"]
    assert sorted(map(tuple, side.select(cols).collect())) == sorted(map(tuple, index.select(cols).collect()))
    assert {r.page_id: r.payload_bytes for r in warc.read_records(side).collect()} == {**{i: i * 60 for i in range(6)}, 9: 0}


def test_quality_of_labels_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    r = quality.classify(docs, labels, held=held).where(held).select("doc_id", F.col("quality").alias("p"), F.col("toxic").alias("t")).join(labels, "doc_id")
    assert r.agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("quality")).cast("double"))).first()[0] > 0.9
    one = labels.where("quality = 1").withColumn("toxic", F.lit(None).cast("int"))
    got = quality.classify(docs.limit(5), one.unionByName(one)).collect()
    assert len(got) == 5 and all(0 <= r.quality <= 1 and r.toxic == 0.5 for r in got)


def test_site_rates_against_the_formula(spark):
    rows = [("a", "x", 1, 0), ("a", "x", 0, 0), ("a", "y", 1, 1), ("b", "x", 0, 0), ("b", "x", 0, 1), ("b", "x", 1, 0), ("c", "z", 1, 0)]
    got = {(r.host, r.path): r for r in quality.site_rates(spark.createDataFrame(rows, "host string, path string, quality int, toxic int"), B.Shared(spark, "t")).collect()}
    y, hosts = np.array([r[2] for r in rows], float), np.array([r[0] for r in rows])
    m = y.mean()

    def strength(groups):
        n = np.array([len(g) for g in groups], float)
        p = np.array([g.mean() for g in groups])
        noise, mass = m * (1 - m), n.sum() - (n * n).sum() / n.sum()
        between = max(((n * (p - m) ** 2).sum() - (len(n) - 1) * noise) / mass, noise * 1e-3)
        return min(max(noise / between - 1, 1), 1000)

    by_host = [y[hosts == h] for h in "abc"]
    k = strength(by_host)
    want = (y[hosts == "a"].sum() + k * m) / (3 + k)
    assert got[None, None].quality_rate == pytest.approx(m) and got["a", None].quality_rate == pytest.approx(want)
    k2 = strength([y[[0, 1]], y[[2]], y[3:6], y[[6]]])
    assert got["a", "y"].quality_rate == pytest.approx((1 + k2 * want) / (1 + k2))


def test_leaks_by_share_of_edited_words(spark):
    rnd = random.Random(2)
    items = [[f"w{rnd.randrange(400)}" for _ in range(40)] for _ in range(30)]
    rows, found = [], {}
    for e, share in enumerate((0.0, 0.1, 0.2)):
        for i, item in enumerate(items):
            edited = [w if rnd.random() >= share else f"z{rnd.randrange(400)}" for w in item]
            rows.append((e * 100 + i, " ".join([f"q{rnd.randrange(300)}" for _ in range(50)] + edited)))
    rows += [(900 + i, " ".join(f"q{rnd.randrange(300)}" for _ in range(90))) for i in range(20)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    for r in dec.find_leaks(frame(spark, rows), bench).collect():
        found.setdefault(r.doc_id // 100, set()).add((r.doc_id % 100, r.item_id))
    for e, least in enumerate((30, 30, 26)):
        assert len(found[e] & {(i, i) for i in range(30)}) >= least
    assert 9 not in found
    left = dec.drop_leaks(frame(spark, rows + [(None, " ".join(items[0]))]), bench, slice_bytes=500)
    assert left.columns == frame(spark, rows).columns and {r.doc_id for r in left.collect()} >= {900 + i for i in range(20)} and left.where("doc_id is null").count() == 0


def test_scores_are_log_probabilities_when_the_filter_is_full(spark, monkeypatch):
    monkeypatch.setattr(lm, "BITS_EACH", 1)
    assert all(r.score <= 0 for r in lm.lm_scores(frame(spark, documents(spark))).collect())


def test_near_duplicates_of_equal_ids_keep_the_least(spark):
    rows = [(1, "b c d e f g"), (1, "a c d e f g"), (2, "x y z u v w"), (None, "x y z u v w"), (None, None)]
    got = {(r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(frame(spark, rows)).collect()}
    assert got == {(1, "a c d e f g"), (2, "x y z u v w"), (None, None), (None, "x y z u v w")}


def test_each_stage_against_a_plain_version(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    extra = docs.withColumn("label", F.lit("x")).unionByName(docs.limit(1).selectExpr("cast(null as bigint) AS doc_id", "text", "lang", "source", "n_chars", "'x' AS label"))
    stages = dict(P.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "substring_dedup", "decontamination", "mixing"]
    for stage in list(stages.values())[:-1]:
        assert stage(spark, extra, DIR).columns == P.COLUMNS and stage(spark, docs.limit(0), DIR).count() == 0
    assert stages["mixing"](spark, docs.limit(0), DIR).count() == 0
    assert stages["language_id"](spark, extra, DIR).where("doc_id is null").count() == 1
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "— 12", "en", "s", 4), (3, "Ωμέγα λόγος", "en", "s", 11)], docs.schema)
    assert stages["language_id"](spark, docs.unionByName(odd), DIR).count() == docs.count()
    rows = documents(spark)
    want = {i: (n, gone) for i, n, gone, _ in windows_removed(rows)}
    cut = {r.doc_id: r for r in stages["substring_dedup"](spark, docs, DIR).collect()}
    assert set(cut) == {i for i, (n, gone) in want.items() if gone == 0 or gone < n}
    assert all(len((r.text or "").split()) == want[i][0] - want[i][1] and r.n_chars == len(r.text) for i, r in cut.items())
    leaks = {r.doc_id for r in dec.find_leaks(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in stages["decontamination"](spark, docs, DIR).collect()} == {i for i, _ in rows} - leaks
    assert {r.doc_id for r in stages["near_dedup"](spark, docs, DIR).collect()} == set(classes(rows).values())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    assert sorted(map(tuple, stages["mixing"](spark, docs, DIR).select("doc_id", "copies").collect())) == sorted(con.sql(mixing.mix_sql(columns="doc_id, copies")).fetchall())


def test_stages_send_a_text_once_in_bounded_batches(spark, monkeypatch):
    import corpus_pipeline
    import pyarrow as pa

    def sized(model, names, *_):  # each row gets the bytes of its batch
        def run(batches):
            for b in batches:
                n = [b.nbytes] * b.num_rows
                yield pa.RecordBatch.from_arrays([*(pa.array(n) if c in ("doc_id", "n_chars") else pa.array(["x"] * b.num_rows) for c in names), pa.array(["x"] * b.num_rows), pa.array([1.0] * b.num_rows)], [*names, "lang_pred", "score"])

        return run

    monkeypatch.setattr(lid, "_beside", sized)
    monkeypatch.setattr(lid, "learn", lambda docs: None)
    docs = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('some words ', 10000)").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(110000).cast("long").alias("n_chars"))
    try:
        found = [r.n_chars for r in corpus_pipeline.identify_languages(spark, docs, "").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert len(found) == 200 and max(found) < B.BLOCK_BYTES + 300_000
    assert max(found) > B.BLOCK_BYTES // 2  # no less than a block either
    assert sum(1 / (n / 110_000) for n in found) < 3.5  # 22 MB of texts in three batches
