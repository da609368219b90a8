"""Operators on tables: votes, scores, verdicts, duplicates, limits, QR payloads, images."""
