"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Each module holds one operator and
the thin ``opN_*`` query (with its SQL, where SQL can express it) built on it;
:mod:`textfacts.llm.registry` collects them.
"""
