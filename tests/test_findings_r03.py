"""What the third review found."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from fleetpulse.llm.jaccard_join import dealt_blocks
from fleetpulse.session import BATCH_BYTES, written


def test_python_workers_get_long_texts_a_few_at_a_time(spark):
    def sizes(batches):
        for batch in batches:
            chars = pc.sum(pc.utf8_length(batch.column(0))).as_py()
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64()), pa.array([chars], pa.int64())], names=["n", "chars"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.col("id").cast("string"), 3000).alias("text"))
    got = written(texts.mapInArrow(sizes, "n bigint, chars bigint"), "sizes").agg(F.sum("n"), F.max("chars")).first()
    assert got[0] == 3000 and got[1] <= BATCH_BYTES + 12_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_a_large_tile_of_one_component_is_dealt_about_once(spark):
    """Op8: each of 4,000 sets met all 400 blocks of its tile, though only three are of another component."""
    rows = [(1, 0, i, 4000, 7 if i >= 3 else i) for i in range(4000)]
    named = spark.createDataFrame(rows, "h bigint, band int, rep bigint, size bigint, component bigint")
    for few in (True, False):
        dealt = dealt_blocks(named, 10, few).select("rep", "i", "j", "block", "partial").collect()
        assert len(dealt) <= 2 * 4000 and not any(r.partial for r in dealt)
        met = {}
        for r in dealt:
            met.setdefault(r.rep, set()).add((r.i, r.j))
        assert all(met[a] & met[b] for a in range(3) for b in range(4000))


def test_all_pairs_of_components_of_a_large_tile_meet(spark):
    rows = [(1, 0, i, 120, i % 4 if i < 80 else 9) for i in range(120)]
    named = spark.createDataFrame(rows, "h bigint, band int, rep bigint, size bigint, component bigint")
    few, every = (dealt_blocks(named, 10, f).select("rep", "component", "i", "j", "partial").collect() for f in (True, False))
    assert len(few) <= 5 * 120 and all(r.partial for r in few)
    met, of = {}, {r.rep: r.component for r in every}
    for r in every:
        met.setdefault(r.rep, set()).add((r.i, r.j))
    assert all(met[a] & met[b] for a in of for b in of if of[a] != of[b])
