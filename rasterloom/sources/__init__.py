"""Image files in and out."""
