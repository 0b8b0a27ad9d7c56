"""Streaming.

The reference has no streams: its "reactive" updates are UI recomputation of
a batch table.  Nothing here adds a streaming operator.  The fitted
transforms in this library (scaling, encoding codes joined from a level
table, outlier caps, Box-Cox with a fixed lambda, influence scoring with a
fitted model) are narrow projections once fitted, so the returned column
expressions apply unchanged to a Structured Streaming DataFrame; the fit
steps themselves (aggregations over the whole table) are batch-only.
"""
