"""Makes the package's Python functions run on executors that do not have it installed."""

from pyspark import cloudpickle

import skygauge


def ship() -> None:
    """Send functions and classes of this package with the tasks, by value.

    Nothing is written anywhere. Where the package is installed on every executor this
    is not needed.
    """
    cloudpickle.register_pickle_by_value(skygauge)
