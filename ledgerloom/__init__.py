"""ledgerloom: statutory-filing analytics expressed as Spark DataFrame plans.

Sub-packages
------------
functions   column expressions (numbers, labels, text); no state, all JVM-side
sources     table, grid, page and dictionary readers, and the written sinks
operators   DataFrame -> DataFrame building blocks
streaming   incremental variants on Structured Streaming
plans       named queries that wire tables to operators
llm         optional corpus operators; nothing else in the package imports it
"""
