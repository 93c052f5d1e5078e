"""Panel factors, similarity graphs, portfolios and corpora as Spark jobs."""
