"""Operations for preparing language-model training data.

Nothing outside this subpackage imports it.  ``registry.queries`` and
``registry.oracle_sql`` hold the registered queries and their SQL.

Functions that run on executors are shipped by value, so executors need numpy and
the hashing libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
