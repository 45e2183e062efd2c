"""Incremental runs: micro-batches over durable key state."""
