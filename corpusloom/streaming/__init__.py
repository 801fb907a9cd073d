"""Text-event streams: classification, consecutive duplicates, gating, responses and statistics."""
