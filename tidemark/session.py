"""Session settings for a job of a known input size."""

from __future__ import annotations

from tidemark.functions.formats import partitions_for

PARTITION_BYTES = 128 * 1024**2


def settings(input_bytes: int, cores: int, task_memory: int) -> dict[str, str]:
    """Shuffle and scan sizes so that a partition fits a task several times over.

    The memory of a task has to hold a partition being read, sorted and written, so a partition
    gets a third of it at most; there are at least two partitions per core, for stragglers.
    """
    partition = max(1024**2, min(PARTITION_BYTES, task_memory // 3))
    most = max(2 * cores, -(-input_bytes // partition))
    shuffle, _ = partitions_for(max(input_bytes, 2 * cores * partition), most, partition, 1)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition),
        "spark.sql.files.maxPartitionBytes": str(partition),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
        "spark.sql.session.timeZone": "UTC",
    }
