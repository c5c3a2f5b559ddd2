"""Evidence-verification analytics on Spark DataFrames.

Every stage is a function ``DataFrame(s) -> DataFrame``; nothing is collected
outside the sinks. The subpackage ``llm`` (corpus operators) is optional and
nothing else in the package imports it.
"""

__version__ = "0.1.0"
