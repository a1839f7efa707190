"""Training-data operators over the ``documents`` table.

Nothing outside this package imports it.  Each module holds one operator; ``queries``
holds the thin ``opN_<name>`` queries built from them.
"""
