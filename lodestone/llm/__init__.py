"""Training-data operators: scoring, decontamination, tokens, quality, toxicity, copies, chat, pages.

Nothing else in the library imports this package. Its functions travel to the workers by
value, so a cluster needs no copy of the package on its machines.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
