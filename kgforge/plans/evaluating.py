"""Queries on evaluation: what was found against what was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgforge.functions.text import compact, has_mojibake
from kgforge.operators import evaluation

from .registry import Tables, query

PREDICTED = "length(text) > 1000"


def judged(t: Tables) -> DataFrame:
    """Documents with labels: quality expected, a long text predicted."""
    return t.documents.withColumn("own", F.length("text") > 1000).join(t.labels, "doc_id").withColumn("gold", F.col("quality") == 1)


def outcomes(t: Tables) -> DataFrame:
    hit = lambda a, b: (F.col("own") == a) & (F.col("gold") == b)
    return judged(t).select("doc_id", "source", *[hit(a, b).cast("int").alias(n) for n, a, b in (("tp", True, True), ("fp", True, False), ("fn", False, True))])


@query("a19_micro_prf", f"""
WITH o AS (SELECT CAST({PREDICTED} AND quality = 1 AS INT) AS tp, CAST({PREDICTED} AND quality <> 1 AS INT) AS fp, CAST(NOT {PREDICTED} AND quality = 1 AS INT) AS fn FROM documents JOIN labels USING (doc_id)),
s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM o)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s""")
def a19(t: Tables) -> DataFrame:
    return evaluation.micro(outcomes(t)).select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("a20_bootstrap", f"""
WITH o AS (SELECT doc_id, source, CAST({PREDICTED} AND quality = 1 AS INT) AS tp, CAST({PREDICTED} AND quality <> 1 AS INT) AS fp, CAST(NOT {PREDICTED} AND quality = 1 AS INT) AS fn FROM documents JOIN labels USING (doc_id)),
b AS (SELECT tp, fp, fn, b, md5(concat_ws('|', '0', doc_id, source, tp, fp, fn) || '|' || b) AS h FROM o, range({2000 // evaluation.DRAWS}) t(b)),
d AS (SELECT tp, fp, fn, b * {evaluation.DRAWS} + j AS rep, (CAST('0x' || substr(h, CAST(j * 4 + 1 AS BIGINT), 4) AS INT) + 0.5) / 65536 AS u FROM b, range({evaluation.DRAWS}) t(j)),
n AS (SELECT *, {" + ".join(f"CAST(u > {x!r} AS INT)" for x in evaluation.poisson_steps())} AS n FROM d),
s AS (SELECT rep, sum(tp * n) / nullif(sum(tp * n) + sum(fp * n), 0) AS p, sum(tp * n) / nullif(sum(tp * n) + sum(fn * n), 0) AS r FROM n GROUP BY rep)
SELECT round(quantile_cont(2 * p * r / nullif(p + r, 0), 0.025), 9) AS f1_low, round(quantile_cont(2 * p * r / nullif(p + r, 0), 0.975), 9) AS f1_high FROM s""")
def a20(t: Tables) -> DataFrame:
    return evaluation.bootstrap(outcomes(t))


# Expected are the brands of the parts that a customer ordered, found are those of returned ones.
SETS = """
g AS (SELECT o_custkey AS k, p_brand AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
f AS (SELECT o_custkey AS k, p_brand AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY ALL)"""


def brands(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("o_custkey").alias("k"), F.col("p_brand").alias("v"), "l_returnflag")


@query("a21_macro_prf", f"""
WITH {SETS}, c AS (SELECT k, (SELECT count(*) FROM g x WHERE x.k = g.k) AS ng, (SELECT count(*) FROM f WHERE f.k = g.k) AS nf, (SELECT count(*) FROM f JOIN g y ON y.k = f.k AND y.v = f.v WHERE f.k = g.k) AS r FROM (SELECT DISTINCT k FROM g) g),
e AS (SELECT CASE WHEN nf = 0 THEN 0 ELSE r / nf END AS p, r / ng AS q FROM c)
SELECT round(avg(p), 6) AS macro_precision, round(avg(q), 6) AS macro_recall, round(avg(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END), 6) AS macro_f1 FROM e""")
def a21(t: Tables) -> DataFrame:
    out = evaluation.macro(brands(t), brands(t).where("l_returnflag = 'R'"), "k", "v")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("a22_conformance_rates", """
SELECT round(avg(CAST(event_type IN ('view', 'click', 'purchase') AS INT)), 6) AS conformance, round(avg(CAST(NOT contains(props, CAST(user_id AS VARCHAR)) AS INT)), 6) AS subject_hallucination FROM events""")
def a22(t: Tables) -> DataFrame:
    out = evaluation.rates_of(t.events, conformance=F.col("event_type").isin("view", "click", "purchase"), subject_hallucination=~F.contains("props", F.col("user_id").cast("string")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("a23_recall_by_kind", f"""
WITH {SETS} SELECT CASE WHEN v < 'Brand#15' THEN 'entity' WHEN v < 'Brand#3' THEN 'value' ELSE 'other' END AS kind, count(*) AS gold, count(*) FILTER (WHERE (k, v) IN (SELECT k, v FROM f)) AS found FROM g GROUP BY 1""")
def a23(t: Tables) -> DataFrame:
    gold = brands(t).select("k", "v").distinct()
    own = brands(t).where("l_returnflag = 'R'").select("k", "v").distinct().withColumn("hit", F.lit(True))
    kind = F.when(F.col("v") < "Brand#15", "entity").when(F.col("v") < "Brand#3", "value").otherwise("other")
    return gold.join(own, ["k", "v"], "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("gold"), F.count("hit").alias("found"))


@query("a24_miss_causes", """
SELECT CASE WHEN l_quantity < 5 THEN 'too small' WHEN l_discount > 0.08 THEN 'too cheap' WHEN l_shipdate < o_orderdate THEN 'too early' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'unexplained' END AS cause, l_linestatus AS relation, count(*) AS n
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def a24(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    ordered = {"too small": F.col("l_quantity") < 5, "too cheap": F.col("l_discount") > 0.08, "too early": F.col("l_shipdate") < F.col("o_orderdate"), "returned": F.col("l_returnflag") == "R"}
    return evaluation.causes(rows, ordered, "unexplained").groupBy("cause", F.col("l_linestatus").alias("relation")).agg(F.count("*").alias("n"))


@query("a25_f1_ceiling", """
WITH e AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS ok, count(*) AS gold FROM lineitem GROUP BY 1)
SELECT CAST(sum(ok) AS BIGINT) AS reachable, CAST(sum(gold) AS BIGINT) AS gold, round(avg(2 * ok / (gold + ok)), 6) AS f1_ceiling FROM e""")
def a25(t: Tables) -> DataFrame:
    out = evaluation.f1_ceiling(t.lineitem.withColumn("ok", F.col("l_returnflag") != "R"), "l_orderkey", F.col("ok"))
    return out.withColumn("f1_ceiling", F.round("f1_ceiling", 6))


@query("a26_artifacts", """
SELECT count(*) - count(DISTINCT text) AS duplicates, count(*) FILTER (WHERE regexp_matches(text, 'Ã[\\x{80}-\\x{bf}]|Â[\\x{80}-\\x{bf}]|â€')) AS mojibake, count(*) FILTER (WHERE length(text) < 20) AS fragments, count(*) FILTER (WHERE lang = source) AS self_loops FROM documents""")
def a26(t: Tables) -> DataFrame:
    return t.documents.agg((F.count("*") - F.count_distinct("text")).alias("duplicates"), F.count_if(has_mojibake(F.col("text"))).alias("mojibake"), F.count_if(F.length("text") < 20).alias("fragments"), F.count_if(F.col("lang") == F.col("source")).alias("self_loops"))


@query("a27_train_test_overlap", "SELECT count(*) AS n_shared FROM (SELECT DISTINCT trim(text) AS t FROM benchmark) SEMI JOIN (SELECT trim(unnest(string_split(text, chr(10)))) AS t FROM documents) USING (t)")
def a27(t: Tables) -> DataFrame:
    return evaluation.overlap(t.documents.select(F.explode(F.split("text", "\n")).alias("text")), t.benchmark, "text")


@query("p16_stated_in_text", r"""
WITH i AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM benchmark)
SELECT item_id, count(d.doc_id) FILTER (WHERE contains(lower(regexp_replace(d.text, '[_\s]+', '', 'g')), lower(regexp_replace(i.text, '[_\s]+', '', 'g')))) AS n FROM i LEFT JOIN documents d ON d.doc_id % i.n = i.k GROUP BY item_id""")
def p16(t: Tables) -> DataFrame:
    """Every document against one item, so that all documents and all items are looked at."""
    n = t.benchmark.count()
    items = t.benchmark.select("item_id", F.col("text").alias("value"), (F.row_number().over(Window.orderBy("item_id")) - 1).alias("k"))  # a benchmark is small
    pairs = items.join(t.documents.select((F.col("doc_id") % max(n, 1)).alias("k"), "text"), "k", "left")
    return pairs.groupBy("item_id").agg(F.count_if(F.contains(compact(F.col("text")), compact(F.col("value")))).alias("n"))


@query("x12_judge_verdicts", """
WITH v AS (SELECT user_id AS context_id, CAST(props ->> '$.k' AS BIGINT) - 5 AS item, event_id AS position, event_type AS verdict FROM events)
SELECT context_id, item, min_by(verdict, position) AS verdict FROM v WHERE item >= 0 AND item < 80 GROUP BY ALL""")
def x12(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("context_id"), (F.get_json_object("props", "$.k").cast("bigint") - 5).alias("item"), F.col("event_id").alias("position"), F.col("event_type").alias("verdict"), F.lit(80).alias("n_items"))
    return evaluation.first_verdicts(rows)


@query("x14_corrections", """
SELECT count(*) AS all_rows, count(*) FILTER (WHERE length(text) >= 20) AS b1, count(*) FILTER (WHERE length(text) >= 20 AND lang = 'en') AS b2, count(*) FILTER (WHERE length(text) >= 20 AND lang = 'en' AND contains(text, 'the')) AS b3 FROM documents""")
def x14(t: Tables) -> DataFrame:
    return evaluation.filters_in_turn(t.documents, {"b1": F.length("text") >= 20, "b2": F.col("lang") == "en", "b3": F.contains("text", F.lit("the"))})


@query("j18_triples", """
SELECT l_orderkey AS chunk, c_name AS sub, o_orderpriority AS rel, p_name AS obj FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey""")
def j18(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return rows.select(F.col("l_orderkey").alias("chunk"), F.col("c_name").alias("sub"), F.col("o_orderpriority").alias("rel"), F.col("p_name").alias("obj"))


@query("j19_sentence_fan_out", """
WITH i AS (SELECT doc_id, trim(text) AS s FROM documents), f AS (SELECT s, min(doc_id) AS first_id FROM i GROUP BY s)
SELECT doc_id, first_id FROM i JOIN f USING (s)""")
def j19(t: Tables) -> DataFrame:
    ids = t.documents.select("doc_id", F.trim("text").alias("s"))
    return ids.join(ids.groupBy("s").agg(F.min("doc_id").alias("first_id")), "s").select("doc_id", "first_id")
