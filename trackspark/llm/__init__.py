"""Training-data operators over tables of texts.

Nothing else in the library imports this subpackage.
"""
