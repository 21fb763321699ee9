from strandloom.params import DesignParams
from strandloom.plans import design_queries as D


def test_probe_candidates_are_of_every_arm_pair_with_all_columns(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and runs away " * 6
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = D.probe_candidates(spark, str(tmp_path))
    assert {"feature_id", "scan_start", "scan_stop", "ext_probe_start", "lig_probe_start", "ext_probe_sequence", "lig_probe_sequence"} <= set(rows.columns)
    pairs = {(len(r.ext_probe_sequence), len(r.lig_probe_sequence)) for r in rows.select("ext_probe_sequence", "lig_probe_sequence").distinct().collect()}
    assert pairs == {(e, g) for _, e, g in DesignParams().arms()}
    assert all(f"({e}, {g})" in D.PROBE_CANDIDATES for e, g in pairs)


def test_what_condensing_reads_twice_is_written(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and runs away " * 3
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = D._judged(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" not in plan and "Generate" not in plan
    assert rows.count() > 0 and any("/judged-" in f for f in rows.inputFiles())
