"""Row numbers over hot groups, and issues of any number of members, against plain versions."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.operators import layout, score, validate
from kgspark.operators.normalize import normalize
from kgspark.operators.reason import closure
from kgspark.plans import ranks
from kgspark.plans.graph import from_rows, graph


def test_numbers_of_hot_groups(spark, monkeypatch):
    """One group holds 95 % of the rows: the numbers are those of a window, and no task has more than its share."""
    df = spark.range(20_000).select(F.when(F.col("id") % 20 == 0, F.col("id") % 7).otherwise(F.lit(99)).alias("g"), F.xxhash64("id").alias("v"), "id")
    want = df.withColumn("k", F.row_number().over(W.partitionBy("g").orderBy(F.desc("v"), "id")) - 1).withColumn("n", F.count("*").over(W.partitionBy("g")))
    dealt = []
    real = ranks.cut
    monkeypatch.setattr(ranks, "cut", lambda x: dealt.append(real(x)) or dealt[-1])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.numbered(df, ["g"], [F.desc("v"), F.col("id")], size="n")
        assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == 20_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in dealt[0].groupBy("__range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16
    assert ranks.numbered(df.limit(0), ["g"], [F.col("id")]).count() == 0


def test_layouts_with_one_wide_tier(spark):
    nodes = [(f"i{k:03}", f"i{k}", "Instance") for k in range(95)] + [(f"c{k}", f"c{k}", "Class") for k in range(5)]
    g = from_rows(spark, nodes, [(f"e{k}", f"i{k:03}", f"c{k % 5}", "type") for k in range(90)])
    at = {r["id"]: (r["x"], r["y"]) for r in layout.tiered(g).collect()}
    assert len(set(at.values())) == 100 and at["c0"] == (80.0, 80.0) and at["i000"] == (80.0, 240.0) and at["i008"] == (80.0, 400.0)
    ring = layout.radial(g)
    assert ring.count() == 100 and ring.where("id = 'c0'").head()["x"] == 0.0


def test_report_counts_what_the_lists_hold(spark):
    nodes = [(f"n{k}", f"n{k}", "Instance") for k in range(30)]
    edges = [("a", "n0", "n1", "part of"), ("b", "n1", "n0", "has part"), ("c", "n0", "n1", "belongs to"), ("d", "n2", "n2", "uses"), ("e", "n3", "gone", "uses"), ("f", "n4", "n5", "odd one"), ("h", "n4", "n6", "odd two")]
    raw = from_rows(spark, nodes, edges)
    g = normalize(raw)
    facts = closure(g)
    lists = validate.validate(raw, g, facts)
    issues, members = validate.report(raw, g, facts)
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(issues) == told(lists.select("severity", "code", "message", F.size("node_ids").cast("long"), F.size("edge_ids").cast("long")))
    assert told(score.penalty(issues)) == told(score.penalty(lists))
    each = lists.select("code", F.explode(F.concat("node_ids", "edge_ids")).alias("id"))
    assert told(members.select("code", "id")) == told(each)
    assert validate.report(graph(raw.nodes.limit(0), raw.edges.limit(0)), graph(raw.nodes.limit(0), g.edges.limit(0)), facts.limit(0))[0].count() == 0
