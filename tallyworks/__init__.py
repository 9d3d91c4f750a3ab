"""Enrolment and update analytics as DataFrame-to-DataFrame functions for Spark."""

import sys

from pyspark import cloudpickle

# What runs in Python workers travels with the plan, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
