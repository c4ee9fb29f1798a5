"""Operators for preparing training text; nothing else in the library imports this subpackage.

Executors import it by name, so the package must be installed (or on the Python path) there.
"""
