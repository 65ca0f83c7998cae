"""Tables of sources: videos, articles and markdown files, and stage tables on disk."""
