"""Operators for collections of texts and terms. Nothing else in the library imports this subpackage."""
