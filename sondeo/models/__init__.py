"""Iterative estimators. The heavy lifting of every iteration is a Spark
aggregation over the cached design; only coefficient vectors and small
(p x p) matrices live on the driver."""
