"""revlume: app-review analytics on Spark.

Landed raw review pages in, one clean, de-duplicated, scored table out.
"""
