"""End-to-end flows: one Spark plan per run instead of a process per stage."""
