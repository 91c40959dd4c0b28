"""Line-oriented loading, checking, counting and delivery on Spark DataFrames."""
