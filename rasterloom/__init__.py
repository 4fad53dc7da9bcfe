"""Spark-native raster analytics: pictures as relations of pixels."""

from .model import Options, auto_radius, parse_color
from .operators.metrics import image_metrics
from .plans.clean import clean, clean_with_info
from .functions.color import flatten
from .sources.images import read_images, save_images

__version__ = "0.2.0"
__all__ = ["Options", "auto_radius", "clean", "clean_with_info", "flatten", "image_metrics", "parse_color", "read_images", "save_images", "__version__"]
