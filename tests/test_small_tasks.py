from cumulus.plans import registry, stage

KEYS = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def test_tasks_grow_in_number_with_the_source_files(spark):
    before = [spark.conf.get(k) for k in KEYS], spark.conf.get(FIRST, None)
    default = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for tasks in (1, default, 5 * default):
        with stage.small_tasks(spark, tasks * stage.TASK_BYTES):
            assert all(int(spark.conf.get(k)) <= stage.TASK_BYTES for k in KEYS)
            assert int(spark.conf.get(FIRST)) == max(default, tasks)
        assert ([spark.conf.get(k) for k in KEYS], spark.conf.get(FIRST, None)) == before


def test_stages_are_written_by_small_tasks(spark, monkeypatch):
    sizes, real = [], stage.small_tasks
    monkeypatch.setattr(registry, "small_tasks", lambda s, n: sizes.append(n) or real(s, n))
    monkeypatch.setattr(registry, "_STAGES", {})
    sf = "/root/testdata/sf0.001"
    carried, plain = registry.staged_carried(spark, sf, "B3").count(), registry.staged_group_day(spark, sf, "B3").count()
    assert carried and plain and len(sizes) == 2 and min(sizes) > 0
