"""Training-data operators (see README). Nothing else in the library imports this subpackage."""
