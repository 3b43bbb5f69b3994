"""Recognition of page images: seams for models, and everything around them."""
