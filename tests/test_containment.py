import random

from pyspark.sql import functions as F

from tallyforge.operators import containment
from tallyforge.operators.containment import meets


def test_names_of_any_length_in_one_scan(spark):
    draw = random.Random(9)
    word = lambda low, high: "".join(draw.choice("AB") for _ in range(draw.randrange(low, high)))
    texts = [(w, f"t{k}", word(0, 40)) for w in range(3) for k in range(40)] + [(3, "t", "AB"), (0, "none", None)]
    names = [(w, f"n{k}", word(0, 14)) for w in range(3) for k in range(30)] + [(4, "n", "AB"), (1, "twin", texts[45][2][:9]), (1, "twin2", texts[45][2][:9])]
    left = spark.createDataFrame(texts, "world_id long, tid string, text string")
    pairs = meets(left, "text", spark.createDataFrame(names, "world_id long, sid string, name string"), "name")
    assert str(pairs._jdf.queryExecution().optimizedPlan()).count("LogicalRDD [world_id#") <= 3  # texts once; names for their sizes and their seeds
    got = pairs.join(left, ["world_id", "tid"]).filter(F.contains("text", F.col("name"))).select("world_id", "tid", "sid").collect()
    assert sorted(map(tuple, got)) == sorted((w, t, n) for w, t, text in texts for v, n, name in names if v == w and text and name and name in text)


def test_few_names_or_few_beginnings_cut_a_text_into_few_pieces(spark):
    texts = [(0, "t", "xyz" * 700 + "window AB1"), (1, "t", "".join(f"-HDFC{k:012d}-" + "abcdefgh" * 9 for k in range(30, 40)))]
    names = [(0, "n", "window"), (0, "m", "setl_000000000001")] + [(1, f"n{k}", f"{'HDFC' if k % 2 else 'UTIB'}{k:012d}") for k in range(90)]
    left, named = spark.createDataFrame(texts, "world_id long, tid string, text string"), spark.createDataFrame(names, "world_id long, sid string, _seed string")
    pieces = containment.cut(left, "text", named.withColumn("_size", containment.seed_length("_seed")).withColumn("_seed", F.expr("left(_seed, _size)")))
    assert {r["world_id"]: r["count"] for r in pieces.groupBy("world_id").count().collect()} == {0: 1, 1: 10}
    found = meets(left, "text", named.withColumnRenamed("_seed", "name"), "name").select("world_id", "sid").collect()
    assert sorted(map(tuple, found)) == sorted([(0, "n")] + [(1, f"n{k}") for k in range(31, 40, 2)])
