"""Sources: directory trees, structured text and code."""
