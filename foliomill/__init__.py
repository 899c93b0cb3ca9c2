"""foliomill: document analytics on Spark DataFrames.

The core (``functions``, ``operators``, ``sources``, ``plans``, ``streaming``)
parses pages into works and parts, keeps a two-level store, reports sizes and
renders documents. ``foliomill.llm`` holds the operators for training data; the
core never imports it.
"""

__version__ = "0.1.0"
