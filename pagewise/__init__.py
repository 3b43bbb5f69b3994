"""pagewise: a document-reading engine whose files, pages, lines and boxes are Spark tables."""

__version__ = "0.2.1"
