"""Large buckets of fingerprints are cut into blocks of a bounded size."""

import random

from pyspark.sql import functions as F

from tidewatch.llm import simhash


def test_a_pair_of_blocks_holds_at_most_two_blocks(spark):
    rows = [(7, k, None, 0) for k in range(900)] + [(8, 1000 + k, None, 0) for k in range(5)]
    keyed = spark.createDataFrame([(key, fp, side) for key, fp, _, side in rows], simhash._KEYED).coalesce(1).sortWithinPartitions("key")
    found = keyed.mapInArrow(simhash._bucket_edges(10), simhash._EDGES).where("key IS NOT NULL").select("key", "part", "a", "side")
    pairs = simhash._pairs_of_blocks(found).groupBy("key", "part").agg(F.count("*").alias("n"), F.collect_set("a").alias("fps")).collect()
    assert {p.key for p in pairs} == {7} and len(pairs) == 90 * 91 // 2 and max(p.n for p in pairs) <= 20
    assert len({(x, y) for p in pairs for x in p.fps for y in p.fps}) == 900 * 900


def test_components_do_not_depend_on_the_blocks(spark):
    r, fps = random.Random(5), set()
    for _ in range(40):
        base = r.getrandbits(63)
        fps |= {base} | {base ^ 1 << r.randrange(22) ^ 1 << r.randrange(22, 43) for _ in range(8)}
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = [sorted(map(tuple, simhash.components(simhash.edges_between(frame, block=b)).collect())) for b in (4096, 3)]
    assert roots[0] == roots[1] and len(roots[0]) == len(fps) - 40  # a root has no row of its own
