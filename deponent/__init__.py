"""deponent: evidence processing on Spark DataFrames.

Messy records become typed, source-located claims; claims, their provenance and every state
change live in append-only tables; operators over those tables are plain
``DataFrame -> DataFrame`` functions, planned by Catalyst.
"""

__version__ = "0.1.0"
