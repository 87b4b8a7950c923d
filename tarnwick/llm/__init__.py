"""Training-data operators. Nothing else in the library imports this subpackage but for its connected components (operators/entity.py)."""
