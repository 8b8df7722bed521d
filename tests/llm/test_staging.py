import glob

from kadenz.llm import staging


def test_a_run_deletes_what_it_staged(spark):
    before = staging.stage(spark.range(2), "kept")
    with staging.run(spark):
        staging.stage(spark.range(3), "gone")
        folder = staging.run_folder(spark)
        assert len(glob.glob(f"{folder}/gone-*")) == 1
    assert not glob.glob(f"{folder}*")
    assert before.count() == 2  # tables of before stay


class Elsewhere:
    """A session on a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_without_a_shared_folder_is_refused():
    import pytest

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(Elsewhere)
