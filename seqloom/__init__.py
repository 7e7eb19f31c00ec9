"""seqloom: a PySpark-native engine for sequence-shaped data.

Sequences, alignments, intervals, k-mers, overlap graphs and gap filling as DataFrame operators. Every public function maps
DataFrames to DataFrames or Columns to Columns; nothing is collected to the driver unless its size is bounded.
"""

__version__ = "0.1.0"
