"""File inventory, readers per format, archives, and the written corpus."""
