"""tracewright: a PySpark-native analytics engine for migration and regression data.

Everything is a lazily composed DataFrame transform.  Sub-packages:

* ``sources``    readers, writers and fold-on-read logs
* ``functions``  column expressions
* ``operators``  DataFrame -> DataFrame transforms (filters, joins, graphs, diff, nested JSON)
* ``streaming``  Structured Streaming forms of the stateful operators
* ``plans``      registered queries with their SQL oracles
* ``llm``        operators for text corpora of model calls; nothing else imports it
"""

__version__ = "0.1.0"
