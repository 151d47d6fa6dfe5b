"""Analytics over archives of camera raw images, as operators on Spark DataFrames."""
