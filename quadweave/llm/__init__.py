"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it.  Each operator module keeps a
general interface; the thin contract queries live in :mod:`.queries`.
"""
