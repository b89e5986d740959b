"""Evidentia: host-activity correlation as Spark jobs.

One event table (:mod:`evidentia.schema`), column functions that build and
decode it, operators that answer investigators' questions over many hosts, and
streaming counterparts of the stateful ones.
"""

__version__ = "0.1.0"
