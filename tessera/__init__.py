"""tessera: Spark-native preparation and scoring of reasoning-data tables.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing is collected to the driver except bounded aggregates
(a handful of scalars or at most a few thousand bucket counts).
"""

from tessera.functions.tags import Tags, DEFAULT_TAGS

__all__ = ["Tags", "DEFAULT_TAGS"]
