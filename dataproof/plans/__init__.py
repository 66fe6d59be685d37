"""From evidence to findings, runs and verdicts."""
