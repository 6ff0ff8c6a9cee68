"""Plan helpers: staging, bounded collections."""
