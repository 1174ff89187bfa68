"""Mixing sources to target weights by hierarchical budgeting.

Leaves are sources within languages within domains.  A node's capacity is its tokens times
``max_epochs``, summed upwards.  From the root down each budget is shared among siblings by weight, and
what a sibling can't take goes to the others in proportion (the exact fill by a sort on capacity over
weight), so a shortage stays among siblings until their parent is full, and only then moves up.

A leaf takes its documents whole for as many epochs as its budget holds, then, of the next epoch's
seeded order, the longest prefix whose tokens fit.  Prefixes are found by range of the order's hash:
sums a range come first, and only the range that holds the end is looked at closer, so no leaf is one
task.  Texts are read where they lie: the ends of prefixes, a row a leaf, go to them.

Null domains, languages and sources are nodes of their own, named ``none``.  A node of weight 0 takes
nothing; weights below 0 are an error.  A null text has no tokens.  A null ``doc_id`` is ordered as the
text ``none``; rows with equal ids stand side by side, fewer tokens first, then by the hash of the
text.  Of rows alike in all that as many are taken as fit.  A text of any length is one row, taken
whole or not at all.  Other columns are kept, but for a column named ``copies``, which is replaced.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.llm import blocks as B

WORDS = r"[^\x20\x09-\x0D]+"
SEED, SHARE, MAX_EPOCHS = "mix-1", 0.6, 2
DOMAINS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}
LANGUAGES = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}


def domain_of(source: Column) -> Column:
    """The default domains: a source's number modulo 4."""
    return F.concat(F.lit("d"), (F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("bigint"), F.lit(0)) % 4).cast("string"))


def _weight(name: str, weights: dict[str, float]) -> Column:
    w = F.lit(1.0)
    for k, v in weights.items():
        w = F.when(F.col(name) == k, v).otherwise(w)
    return w


def _fill(nodes: DataFrame, parents: list[str], name: str, budget: str) -> DataFrame:
    """Adds ``got``: each node's part of its parent's ``budget``, by ``w`` and no more than ``cap``."""
    part = F.when(F.col("w") > 0, F.col("cap") / F.nullif("w", F.lit(0.0))).otherwise(float("inf"))
    by = Window.partitionBy(*parents).orderBy(part.asc(), F.col(name).asc())
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.nullif(F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)), F.lit(0.0))
    out = nodes.withColumn("level", (F.col(budget) - before) / rest).withColumn("full", F.coalesce(part <= F.col("level"), F.lit(False)))
    level = F.coalesce(F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(*parents)), F.lit(0.0))
    return out.withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * level)).drop("level", "full", budget, "w")


def budgets(leaves: DataFrame, share: float, max_epochs: int, domains: dict[str, float], languages: dict[str, float], sources: dict[str, float]) -> DataFrame:
    """``budget`` in tokens of each leaf of ``domain``, ``lang``, ``source`` and ``tokens``."""
    leaf = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    langs = leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    tops = langs.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = leaf.agg((F.coalesce(F.sum("tokens"), F.lit(0)).cast("double") * share).alias("all_tokens"))
    tops = _fill(tops.join(F.broadcast(total)).withColumn("w", _weight("domain", domains)).withColumn("top", F.lit(0)), ["top"], "domain", "all_tokens")
    langs = _fill(langs.join(tops.select("domain", F.col("got").alias("of")), "domain").withColumn("w", _weight("lang", languages)), ["domain"], "lang", "of")
    out = _fill(leaf.join(langs.select("domain", "lang", F.col("got").alias("of")), ["domain", "lang"]).withColumn("w", _weight("source", sources)), ["domain", "lang"], "source", "of")
    return out.select("domain", "lang", "source", "tokens", F.floor(F.col("got") + 1e-6).alias("budget"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
    domains: dict[str, float] = DOMAINS, languages: dict[str, float] = LANGUAGES, sources: dict[str, float] = {}, domain: Column | None = None,
) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, with ``copies``: in how many epochs.  The target is ``share`` of all tokens."""
    if any(w < 0 for table in (domains, languages, sources) for w in table.values()):
        raise ValueError("weights must not be negative")
    q = lambda c: F.col(f"`{c}`")
    shared = B.Shared(docs.sparkSession, "mixing")
    name = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    slim = docs.select(
        name(domain if domain is not None else domain_of(q(source))).alias("domain"), name(q(lang)).alias("lang"), name(q(source)).alias("source"),
        name(q(doc_id)).alias("id"), F.coalesce(F.regexp_count(q(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("n"), F.xxhash64(q(text)).alias("h"), F.struct(*(q(c) for c in docs.columns)).alias("row"),
    )
    leaf, key = ["domain", "lang", "source"], ["at", "n", "h"]
    slim_ids = shared.write(slim.drop("row"), "tokens")
    plan = budgets(slim_ids.groupBy(*leaf).agg(F.sum("n").alias("tokens")), share, max_epochs, domains, languages, sources)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.nullif("tokens", F.lit(0)))).otherwise(0).cast("long")
    plan = shared.write(plan.withColumn("epochs", whole).withColumn("left", F.col("budget") - F.col("epochs") * F.col("tokens")), "plan", few=True)
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("epochs").cast("string"), F.col("id")))
    place = lambda rows: rows.withColumn("at", order).withColumn("range", F.substring("at", 1, 3))
    placed = place(B.meet(slim_ids, plan.drop("budget", "tokens"), leaf, ["id"]))
    sums = placed.groupBy(*leaf, "range", "left").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*leaf).orderBy("range"))
    cut = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n")).where("before <= left and upto > left")
    cut = shared.write(cut.select(*leaf, "range", "before"), "ranges", few=True)
    # within the range that holds the end, rows alike in ``key`` are one, ``m`` times
    ends = B.meet(placed, cut, [*leaf, "range"], ["id"]).groupBy(*leaf, *key, "range", "before", "left").agg(F.count("*").alias("m"))
    upto = F.sum(F.col("m") * F.col("n")).over(Window.partitionBy(*leaf).orderBy(*key))
    ends = ends.withColumn("start", F.col("before") + upto - F.col("m") * F.col("n")).where("start <= left")
    fit = F.when(F.col("n") == 0, F.col("m")).otherwise(F.least("m", F.floor((F.col("left") - F.col("start")) / F.nullif("n", F.lit(0)))))
    ends = ends.withColumn("fit", fit).where("fit > 0").groupBy(*leaf).agg(F.max(F.struct(*key, "fit", "m")).alias("last"))
    edge = plan.select(*leaf, "epochs").join(cut.select(*leaf, F.col("range").alias("cut")), leaf, "left").join(ends, leaf, "left")
    edge = shared.write(edge, "edge", few=True)
    rows, mine, last = place(B.meet(slim, edge, leaf, ["id"])), F.struct(*key), F.struct(*(F.col(f"last.{c}") for c in key))
    inside = F.col("cut").isNull() | (F.col("range") < F.col("cut")) | F.coalesce(mine <= last, F.lit(False))
    keep = [F.col("row").getField(c).alias(c) for c in docs.columns if c != "copies"]
    out = lambda rows, more: rows.withColumn("copies", (F.col("epochs") + F.when(more & (F.col("epochs") < max_epochs), 1).otherwise(0)).cast("long")).where("copies > 0").select(*keep, "copies")
    if edge.where("last.fit < last.m").isEmpty():
        return out(rows, inside)
    # some end lies among rows that are alike: those are written with where they lay, counted there and numbered
    level = F.coalesce(F.col("cut").isNotNull() & (mine == last) & (F.col("last.fit") < F.col("last.m")), F.lit(False))
    alike = shared.write(rows.where(level).withColumns({"part": F.spark_partition_id(), "fit": F.col("last.fit")}).drop("last"), "alike")
    parts = alike.groupBy(*leaf, "part").agg(F.count("*").alias("m"))
    parts = parts.withColumn("earlier", F.sum("m").over(Window.partitionBy(*leaf).orderBy("part")) - F.col("m")).drop("m")
    nth = F.row_number().over(Window.partitionBy(*leaf, "part").orderBy("id"))
    alike = alike.join(parts, [*leaf, "part"]).withColumn("nth", F.col("earlier") + nth)
    return out(rows.where(~level), inside).unionByName(out(alike, F.col("nth") <= F.col("fit")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(B.read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return out.select("doc_id", "lang", "source", "copies")


def _case(name: str, weights: dict[str, float]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in weights.items()) + " ELSE 1.0::DOUBLE END"


def _fill_sql(nodes: str, parents: str, name: str, budget: str) -> str:
    by = f"PARTITION BY {parents} ORDER BY cap / w, {name}"
    return f"""SELECT *, CASE WHEN cap / w <= level THEN cap ELSE w * max(CASE WHEN cap / w > level THEN level END) OVER (PARTITION BY {parents}) END AS got
      FROM (SELECT *, ({budget} - coalesce(sum(cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ({nodes}))"""


def mix_sql(table: str = "documents", columns: str = "doc_id, lang, source, copies") -> str:
    return f"""
WITH d AS (
  SELECT *, 'd' || (coalesce(try_cast(regexp_extract(source, '(\\d+)$', 1) AS BIGINT), 0) % 4) AS domain_, coalesce(lang, 'none') AS lang_, coalesce(source, 'none') AS source_,
    coalesce(doc_id::VARCHAR, 'none') AS id_, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_ FROM {table}
), leaf AS (SELECT domain_, lang_, source_, sum(n_)::BIGINT AS tokens, sum(n_)::DOUBLE * {MAX_EPOCHS} AS cap, 1.0::DOUBLE AS w FROM d GROUP BY ALL),
l AS (SELECT domain_, lang_, sum(cap) AS cap, {_case("lang_", LANGUAGES)} AS w FROM leaf GROUP BY domain_, lang_),
t AS (SELECT domain_, sum(cap) AS cap, {_case("domain_", DOMAINS)} AS w, 0 AS top_ FROM l GROUP BY domain_),
t2 AS ({_fill_sql("SELECT t.*, b FROM t, (SELECT sum(tokens)::DOUBLE * " + str(SHARE) + "::DOUBLE AS b FROM leaf)", "top_", "domain_", "b")}),
l2 AS ({_fill_sql("SELECT l.*, t2.got AS b FROM l JOIN t2 USING (domain_)", "domain_", "lang_", "b")}),
f AS ({_fill_sql("SELECT leaf.*, l2.got AS b FROM leaf JOIN l2 USING (domain_, lang_)", "domain_, lang_", "source_", "b")}),
plan AS (SELECT *, budget - epochs * tokens AS left_ FROM (SELECT *, CASE WHEN tokens > 0 THEN floor(budget / tokens) ELSE 0 END::BIGINT AS epochs FROM (SELECT domain_, lang_, source_, tokens, floor(got + 1e-6)::BIGINT AS budget FROM f))),
o AS (SELECT d.*, epochs, left_, md5('{SEED}|' || epochs || '|' || id_) AS at_ FROM d JOIN plan USING (domain_, lang_, source_)),
c AS (SELECT *, epochs + CASE WHEN epochs < {MAX_EPOCHS} AND sum(n_) OVER (PARTITION BY domain_, lang_, source_ ORDER BY at_, n_ ROWS UNBOUNDED PRECEDING) <= left_ THEN 1 ELSE 0 END AS copies FROM o)
SELECT {columns} FROM c WHERE copies > 0
"""


QUERIES = {"op2_mixing": op2_mixing}
SQL = {"op2_mixing": mix_sql()}
