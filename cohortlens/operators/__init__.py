"""Relational operators on long-form frames: (sample, label, feature, value)."""
