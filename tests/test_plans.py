"""Shapes of physical plans that must hold at scale."""

from tollgate.operators import handshake
from tollgate.plans import catalog, views

catalog.load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_policy_lookup_broadcasts_the_policies(spark, sf_dir):
    text = plan(catalog.QUERIES["policy_lookup"](spark, sf_dir))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_top_k_limits_before_the_shuffle(spark, sf_dir):
    text = plan(catalog.QUERIES["retrieve_topk"](spark, sf_dir))
    assert "WindowGroupLimit" in text
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["retrieve_single"](spark, sf_dir))


def test_no_query_uses_a_cross_join(spark, sf_dir):
    for name in ("retrieve_topk", "maxsim_scores", "maxsim_classify", "help_suggestions", "attack_patterns", "class_score_map", "maxsim_rerank"):
        text = plan(catalog.QUERIES[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_scans_read_only_what_they_need(spark, sf_dir):
    text = plan(catalog.QUERIES["invocation_counts"](spark, sf_dir))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in text
    text = plan(catalog.QUERIES["audit_sample"](spark, sf_dir))
    assert "props" not in text.split("ReadSchema")[1]


def test_replays_combine_before_the_shuffle(spark, sf_dir):
    uses = views.as_token_uses(views.events(spark, sf_dir))
    assert "partial_min" in plan(handshake.first_uses(uses))
    # the first uses are stored, so both sides of the join are plain exchanges that can be split
    text = plan(handshake.outcomes(uses))
    assert "Window" not in text and "Scan ExistingRDD" in text


def test_chunking_does_not_shuffle(spark, sf_dir):
    text = plan(catalog.QUERIES["md_chunks"](spark, sf_dir))
    assert "hashpartitioning" not in text and "Window" not in text


def test_only_measured_tables_are_broadcast(spark):
    from tollgate.session import small_side

    left, right = spark.range(100).toDF("k"), spark.range(100).toDF("k")
    wide = right.selectExpr("k", "repeat('x', 1000) AS s")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" in plan(left.join(small_side(right), "k"))
        assert "Broadcast" not in plan(left.join(small_side(right, max_rows=99), "k"))
        assert "Broadcast" not in plan(left.join(small_side(wide, max_bytes=50_000), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_python_runs_once_and_behind_the_repartition(spark, sf_dir):
    """No copy of a Python function in a filter below the exchange, where one task would run it."""
    import __spark_entry__ as entry

    found = entry.queries()
    for name, most in {"code_functions": 1, "code_class_stats": 1, "split_overlap": 1, "md_chunks": 2}.items():
        plan = found[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        lines = [x for x in plan.split("\n") if "ArrowEvalPython" in x or "Exchange RoundRobin" in x]
        assert sum("ArrowEvalPython" in x for x in lines) <= most, (name, lines)
        assert "Exchange RoundRobin" in lines[-1], (name, lines)
