"""tablewright: prepare and understand one table at scale on Apache Spark.

Every public operator takes a Spark ``DataFrame`` (plus plain parameters) and
returns a ``DataFrame``.  Heavy work stays on the executors; only
summary-sized values (a handful of scalars per column) ever reach the driver.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value inside UDFs, so executors need not have it installed."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: ship the package with --py-files instead
        pass


_ship_by_value()
