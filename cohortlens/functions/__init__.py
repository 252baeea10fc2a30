"""Column functions: names, sequences, statistics, hashes and random draws, scores."""
