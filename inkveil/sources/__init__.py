"""Pages, files and JSON in and out."""
