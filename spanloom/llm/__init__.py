"""Training-data operators.

Nothing outside this subpackage imports it; it imports nothing of the rest of
the library, so either side can be removed without the other noticing.
"""
