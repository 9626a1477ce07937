"""Operators for training-data pipelines over a table of documents.

Each module holds one operator with its own interface; ``queries`` applies them to
the given tables. Nothing else in the library imports this package.

Common to all of them: words are maximal runs of characters other than space and
``\\t \\n \\v \\f \\r``; hashes have 64 bits, and what is equal by hash counts as equal.
"""
