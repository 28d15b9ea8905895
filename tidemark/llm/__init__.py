"""Operators for building training corpora at scale.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general interface;
``queries`` wraps them as the registered ``opN_<name>`` queries and holds their SQL counterparts.
"""
