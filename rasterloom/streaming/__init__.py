"""File streams of images."""
