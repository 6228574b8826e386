"""lectern: analytics over course content, written as Spark DataFrame plans.

Sub-packages: ``sources`` (scans and table writers), ``functions`` (scalar expressions), ``operators``
(chunkers, retrieval, evaluation, intervals), ``plans`` (queries over the test tables with their SQL twins),
``streaming`` (incremental ingestion) and the optional ``llm`` (operators for training data; nothing else imports it).
"""
