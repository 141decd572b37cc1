"""Helpers that decide how a plan runs: intermediate tables and fixpoint loops."""
