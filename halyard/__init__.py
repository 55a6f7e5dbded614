"""Subscription and customer analytics as Spark DataFrame jobs.

Sub-packages:

* ``sources``   - declared schemas, table loading, fixture views, sinks
* ``functions`` - Column expressions (names, day counts, labels, text)
* ``operators`` - DataFrame operators (views, metrics, writes, checks)
* ``streaming`` - the change stream folded with Structured Streaming
* ``plans``     - the registry of named queries and their SQL oracles
"""

from halyard.session import AS_OF, build_session, scratch_dir

__all__ = ["AS_OF", "build_session", "scratch_dir"]
