from tidemark.session import settings


def test_partitions_follow_the_input():
    small = settings(10 * 1024**2, 8, 1024**3)
    assert small["spark.sql.shuffle.partitions"] == "16"
    large = settings(100 * 1024**4, 8000, 4 * 1024**3)
    assert int(large["spark.sql.shuffle.partitions"]) == 100 * 1024**4 // (128 * 1024**2)
    tight = settings(1024**4, 8, 96 * 1024**2)
    assert int(tight["spark.sql.files.maxPartitionBytes"]) == 32 * 1024**2
