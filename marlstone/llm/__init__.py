"""Training-data operators.  Nothing outside this subpackage imports it.

Functions sent to Python workers live in these modules.  Workers normally
import the package (it is on PYTHONPATH, or the job runs from the repository
root); where neither holds, the functions are shipped by value.
"""

import os
import sys
from pathlib import Path

_ROOT = str(Path(__file__).resolve().parents[2])
_seen = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
if _ROOT not in _seen and os.getcwd() != _ROOT:
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
