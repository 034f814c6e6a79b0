"""Image relations on Spark: texels, blocks and mip levels as DataFrames."""
