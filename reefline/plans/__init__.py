"""End-to-end jobs: files in, files out."""
