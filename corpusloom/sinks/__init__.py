"""Writers of the split corpus, its manifest and reports."""
