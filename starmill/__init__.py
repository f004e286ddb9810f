"""starmill: contract-checked star schemas as plain Spark plans."""
