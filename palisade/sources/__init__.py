"""Where files, archives, feeds and table adapters come from."""
