"""DataFrame -> DataFrame operators.

* ``consensus``  votes over replicate answers (mode, Gini, gate, review list, multi-label, bands)
* ``agreement``  rater agreement (rating union, mismatches, pair counts, percent agreement,
  prevalence, disagreements, set similarity, label support)
* ``linkage``    fuzzy join, name conformance, overrides, waterfall, unresolved export
* ``reshape``    list explosion, flag unpivot, null-safe full outer join, grid completion
* ``summary``    bins, levels, grouping-set totals, shares, top-k with ties, running totals
* ``requests``   request build and response ingest
"""

from raterspark.operators import agreement, consensus, linkage, requests, reshape, summary

__all__ = ["agreement", "consensus", "linkage", "requests", "reshape", "summary"]
