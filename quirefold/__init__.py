"""quirefold: analytics over growing document corpora, written as Spark jobs."""
