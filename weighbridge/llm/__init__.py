"""Operators for large-scale training-data pipelines.

Each module holds one operator; ``queries.py`` registers one query per operator
over its whole table. Nothing outside this package imports it. The package is
pickled by value, so executors need numpy, pyarrow and the libraries an
operator names, but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
