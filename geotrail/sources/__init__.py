"""Readers and writers: trajectories, workloads, logs and the partitioned store."""
