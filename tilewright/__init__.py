"""Image-feature analytics as Spark jobs.

Labelled image collections become DataFrames of rasters, strips, runs, regions
and finally one wide feature row per image; the feature table is then cleaned,
modelled, scored and summarised with Spark SQL and Spark ML.
"""

import sys

from pyspark import cloudpickle

from tilewright.session import build_session, cut_lineage, shared_dir

# Arrow helpers travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "cut_lineage", "shared_dir"]
