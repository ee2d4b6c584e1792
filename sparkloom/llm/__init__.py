"""Training-data operators: ten corpus operators and the thin queries over them.

Nothing outside this subpackage imports it.
"""
