"""Rollout-data engine on Spark: grading, cleaning, pairing, voting and encoding of sampled solutions."""
