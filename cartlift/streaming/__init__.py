"""Structured Streaming jobs for the cyclic monitoring duties (E-1..E-3) and
the AA randomisation check (E-4)."""
