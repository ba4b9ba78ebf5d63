"""Training-data pipeline operators.  Nothing else in the library imports this subpackage.

Each operator has a module of its own; :mod:`replaylab.llm.queries` registers one
``opN_<name>`` query per operator over its whole table, plus the pipeline.
"""
