"""Keyed state from event logs, in batch and as a stream."""
