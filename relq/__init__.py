"""relq: immutable, composable queries over declared entities, compiled to Spark DataFrames."""
