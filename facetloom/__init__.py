"""facetloom: faceted exploration and bounded group/row queries on Spark DataFrames."""
