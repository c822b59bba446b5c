"""The engine's time buckets, sessions and patterns over unbounded tables."""
