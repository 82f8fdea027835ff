"""Publishing results as immutable bundles."""
