"""quillspark: document analytics on Spark DataFrames.

Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame -> DataFrame), ``sources`` (readers and
table writers), ``plans`` (composed reports and the query registry), ``streaming`` (Structured Streaming extras) and
``llm`` (training-data operators; optional, nothing else imports it).
"""
