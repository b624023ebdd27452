"""Models, partitioning, range queries, partition activity and throughput."""
