"""DataFrame -> DataFrame survey operators.

Conventions: aggregation is pushed below any reshaping (wide ``agg`` then a
stack of the small result) so the shuffle carries partial aggregates only;
"share of total" uses a scalar subquery over the aggregated result, which
Spark plans as a reuse of the same exchange (no second scan, no
single-partition window).
"""
