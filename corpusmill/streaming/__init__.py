"""The operators that keep no state, over streams of files."""
