"""Whole jobs: consolidation, verification and training-set preparation."""
